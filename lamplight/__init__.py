"""Lamplight: a Spark-native analytics engine for collections of public documents."""

"""Operators of a training-data pipeline, each on whole tables.

Nothing else in the library imports this subpackage.
"""

"""The driver's tables in the shapes of the document model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: source as the portal, lang as the category, no link text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.lit(None).cast("string").alias("inferred_title"), F.lit("").alias("link_text"),
        F.col("source").alias("state"), F.col("source").alias("state_key"), F.col("lang").alias("category"), F.lit(None).cast("string").alias("document_date"), F.lit(None).cast("string").alias("pdf_url"), F.lit(None).cast("string").alias("file_path"),
        (F.col("n_chars") > 2000).alias("was_ocr_used"), "text", F.col("doc_id").alias("doc_ord"), F.lit(0).alias("state_ord"), "doc_id",
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: status as the portal, priority as the category; those of low priority have no date."""
    o = table(spark, sf_dir, "orders")
    dated = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("category"), dated.alias("document_date"), F.lit(0).alias("state_ord"), F.col("o_orderkey").alias("doc_ord"), "o_orderdate")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn and the assistant's next as source and output of a translation."""
    c = table(spark, sf_dir, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    given = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return asked.join(given, ["conv_id", "turn"])

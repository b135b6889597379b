"""From raw documents to token ids: toxic documents go, then copies, then near copies; sources are mixed and encoded.

STAGES lists (name, function); each takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and
read again as the docs of the next. All but the last return the columns of documents. A document that a stage rejects
is gone for those after it; the mix may repeat a document. Near copies are those of five-word similarity 0.8 or more
(lamplight.llm.near_copies): op5's SimHash components and, as two bits miss nearly all such pairs, MinHash bands give the
candidates, whole shingle sets decide. No stage is sampled or capped; training reads samples of the sizes named in
lamplight.llm.toxicity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.llm.exact_dedup import drop_exact_copies
from lamplight.llm.mixing import mixed_documents, quality_weights
from lamplight.llm.near_copies import drop_similar
from lamplight.llm.pieces import encode_pieces
from lamplight.llm.queries import tokenizer_path
from lamplight.llm.toxicity import drop_toxic
from lamplight.llm.work import written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, _labels(spark, sf_dir))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, quality_weights(_labels(spark, sf_dir)))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256; a row for each row of docs."""
    rows = encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("mix_sources", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: A trained model and a tokenizer decide; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Written intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamplight.sources.shared import new_path, small_batches, stored


__all__ = ["copied_rows", "drop_rows", "in_arrow", "new_path", "small", "text_digest", "whole_text", "written"]
#: df as a table in the shared folder: it cuts the lineage and outlives lost executors.
written = stored


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow in small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def whole_text(column: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_digest(column: str = "text") -> Column:
    """SHA-256 of the UTF-8 text, 32 bytes."""
    return F.unhex(F.sha2(whole_text(column), 256))


_KEY = "__llm_text_digest"
#: Tables of up to so many short rows are sent to all executors, about 100 bytes a row; larger ones are joined by shuffles.
SMALL_ROWS = 250_000


def small(df: DataFrame) -> DataFrame:
    """df, which must be cheap to count, marked for broadcast if it has at most SMALL_ROWS rows; else as it is."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def drop_rows(docs: DataFrame, gone: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The rows of docs but those that gone (doc_id, digest) lists, all columns; of rows that repeat doc_id and text one.

    Texts stay where they are while gone is small. seen: (doc_id, digest) of all rows of docs, if there is such a table.
    """
    names = docs.columns
    rows = docs.withColumn(_KEY, text_digest())
    if seen is None:
        seen = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(_KEY).alias("digest"))
    again = written(seen.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "digest"), "again")

    def listed(pairs: DataFrame, how: str) -> DataFrame:
        k = small(pairs.select(F.col("doc_id").alias("__llm_id"), F.col("digest").alias("__llm_digest")))
        return rows.join(k, rows["doc_id"].cast("long").eqNullSafe(k["__llm_id"]) & (rows[_KEY] == k["__llm_digest"]), how)

    if again.isEmpty():
        return listed(gone, "left_anti").select(*[F.col(f"`{c}`") for c in names])
    out = listed(written(gone.unionByName(again), "gone"), "left_anti").select(*[F.col(f"`{c}`") for c in names])
    one = again.join(gone.select(F.col("doc_id").alias("of"), F.col("digest").alias("of_digest")), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left_anti")
    return out.unionByName(_first_of_repeats(listed(written(one, "again"), "left_semi"), names))


def _first_of_repeats(rows: DataFrame, names: list[str], *more: str) -> DataFrame:
    """Of rows with equal doc_id and digest that with the least JSON form, so that reruns agree."""
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    one = rows.groupBy("doc_id", _KEY).agg(F.min_by(whole, F.to_json(whole)).alias("__llm_row"), *[F.first(c).alias(c) for c in more])
    return one.select("__llm_row.*", *more)


def copied_rows(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of docs as often as copies (doc_id, digest, copies, rows) says, all columns; rows: how many repeat the pair.

    Rows that repeat doc_id and text count once.
    """
    names = docs.columns
    kept = copies.filter("copies > 0").select(F.col("doc_id").alias("__llm_id"), F.col("digest").alias("__llm_digest"), F.col("copies").cast("int").alias("__llm_copies"), F.col("rows").alias("__llm_rows"))
    kept = written(kept, "copies")
    k = kept.hint("merge")  # nearly as many rows as docs: never small
    rows = docs.withColumn(_KEY, text_digest())
    joined = rows.join(k, rows["doc_id"].cast("long").eqNullSafe(kept["__llm_id"]) & (rows[_KEY] == kept["__llm_digest"]))
    out = joined.filter("__llm_rows = 1").select(*[F.col(f"`{c}`") for c in names], "__llm_copies")
    if not kept.filter("__llm_rows > 1").isEmpty():
        out = out.unionByName(_first_of_repeats(joined.filter("__llm_rows > 1"), names, "__llm_copies"))
    return out.withColumn("__llm_copy", F.explode(F.sequence(F.lit(1), F.col("__llm_copies")))).select(*[F.col(f"`{c}`") for c in names])

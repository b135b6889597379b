"""Browsing, keyword search and exact vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions.strings import or_default, text_or_empty

from .filters import by_date, by_field, compile_where, keyword

PREVIEW, PAGE, MOST_PAGE = 900, 50, 200
NEAREST, FILES = 20, 10


def summary(docs: DataFrame) -> DataFrame:
    """What a result list shows of documents: no body but an excerpt."""
    t = text_or_empty("text")
    return docs.select(
        "id", "filename", or_default("inferred_title", "link_text", F.lit("Untitled")).alias("title"), "state", "state_key", "category", "document_date", "pdf_url", "file_path",
        F.coalesce("was_ocr_used", F.lit(False)).alias("was_ocr_used"), F.substring(t, 1, PREVIEW).alias("excerpt"), (F.length(t) > PREVIEW).alias("has_more_text"),
    )


def _scope(docs: DataFrame, state: str | None, category: str | None, date_from: str | None, date_to: str | None, date_column: str = "document_date") -> DataFrame:
    return docs.filter(by_field("state", state) & by_field("category", category) & by_date(date_column, date_from, date_to))


def browse(docs: DataFrame, page: int = 1, size: int = PAGE, state: str | None = None, category: str | None = None, date_from: str | None = None, date_to: str | None = None, order: tuple[str, ...] = ("state_ord", "doc_ord"), date_column: str = "document_date") -> DataFrame:
    """A page, newest first, undated last, ties in input order; offset and limit push a top-k into the sort."""
    if page < 1 or not 1 <= size <= MOST_PAGE:
        raise ValueError("page counts from 1, size from 1 to 200")
    dated = F.nullif(F.col(date_column), F.lit(""))
    rows = _scope(docs, state, category, date_from, date_to, date_column)
    return rows.orderBy(dated.desc_nulls_last(), *order).offset((page - 1) * size).limit(size)


def page_count(docs: DataFrame, size: int = PAGE, **scope) -> DataFrame:
    """total and total_pages of what browse shows."""
    every = {"state": None, "category": None, "date_from": None, "date_to": None} | scope
    return _scope(docs, **every).agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).alias("total_pages"))


def basic_search(docs: DataFrame, query: str, state: str | None = None, category: str | None = None, date_from: str | None = None, date_to: str | None = None, scan_body: bool = False) -> DataFrame:
    """All documents whose title, link text or file name holds the query, or whose body, if that is searched: a scan.

    `in_input_order` sorts what is shown.
    """
    return _scope(docs, state, category, date_from, date_to).filter(keyword(query, ["inferred_title", "link_text", "filename"], "text" if scan_body else None))


def in_input_order(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """By portal, then by place in its file; with a limit a top-k."""
    rows = docs.orderBy("state_ord", "doc_ord")
    return rows.limit(limit) if limit is not None else rows


def cosine_distance(embedding: Column, query: list[float]) -> Column:
    """1 - cosine in double precision; null where a norm is 0."""
    v, q = embedding.cast("array<double>"), F.array(*[F.lit(float(x)) for x in query])
    add = lambda a, x: a + x
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), add)
    norm = F.sqrt(F.aggregate(F.transform(v, lambda a: a * a), F.lit(0.0), add)) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    return F.lit(1.0) - dot / F.nullif(norm, F.lit(0.0))


def vector_search(chunks: DataFrame, query: list[float], k: int = NEAREST, where: dict | None = None, tie: str = "chunk_id") -> DataFrame:
    """The k nearest rows with their distance, nearest first: a filtered scan and a top-k, no sort of the table."""
    near = chunks.filter(compile_where(where)).withColumn("distance", cosine_distance(F.col("embedding"), query))
    return near.orderBy(F.col("distance").asc_nulls_last(), tie).limit(k)


def best_per_file(nearest: DataFrame, files: int = FILES, file: str = "filename", tie: str = "chunk_id") -> DataFrame:
    """Of a result list of at most k rows the best row of each file, the first files, nearest first, with a similarity."""
    rank = F.row_number().over(Window.partitionBy(file).orderBy(F.col("distance").asc_nulls_last(), tie))
    best = nearest.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
    return best.orderBy(F.col("distance").asc_nulls_last(), tie).limit(files).withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("distance")))


def semantic_search(chunks: DataFrame, query: list[float], k: int = NEAREST, files: int = FILES, where: dict | None = None) -> DataFrame:
    top = best_per_file(vector_search(chunks, query, k, where), files)
    shown = [or_default(c, F.lit("—")).alias(c) for c in ("state", "category", "document_date") if c in chunks.columns]
    rest = [c for c in top.columns if c not in ("embedding", "title_hi", "link_text", "state", "category", "document_date")]
    title = or_default("title_hi", "link_text", F.lit("Untitled")) if {"title_hi", "link_text"} <= set(chunks.columns) else F.lit("Untitled")
    return top.select(title.alias("title"), *shown, *rest)


def similarity_label(similarity: Column | str) -> Column:
    """A similarity as whole per cent."""
    return F.concat(F.bround((F.col(similarity) if isinstance(similarity, str) else similarity) * 100).cast("int").cast("string"), F.lit("%"))


SUMMARY_CHARS = 2500


def summary_prompt(instruction: str, text: Column | str = "text") -> Column:
    """A fixed instruction and the beginning of the text, for a language model."""
    return F.concat(F.lit(instruction), F.substring(text_or_empty(text), 1, SUMMARY_CHARS))

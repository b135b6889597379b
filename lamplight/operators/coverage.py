"""Facets and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions.naming import DEFAULT_CATEGORY


def facet(docs: DataFrame, column: str, default: str, name: str | None = None) -> DataFrame:
    """Counts by value, null as the default; by name."""
    name = name or column
    return docs.groupBy(F.coalesce(F.col(column), F.lit(default)).alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(name)


def by_state(docs: DataFrame) -> DataFrame:
    return facet(docs, "state", "Unknown")


def by_category(docs: DataFrame) -> DataFrame:
    return facet(docs, "category", DEFAULT_CATEGORY)


def date_range(docs: DataFrame, column: str = "document_date") -> DataFrame:
    """min_date, max_date, dated, total; empty dates count as none."""
    d = F.nullif(F.col(column), F.lit(""))
    return docs.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"), F.count(d).alias("dated"), F.count(F.lit(1)).alias("total"))


def coverage(registry: DataFrame, crawled: DataFrame, processed: DataFrame, on_disk: DataFrame, key: str = "state_key", ocr_used: Column | None = None) -> DataFrame:
    """A row for each state of the registry: crawled, processed, pdfs_on_disk, ocr_used, pct, missing.

    Each fact is counted by itself, so what is joined has a row a state.
    """
    used = F.count_if(F.coalesce(ocr_used, F.lit(False))) if ocr_used is not None else F.lit(0).cast("long")
    n = lambda rows, name, *more: rows.groupBy(key).agg(F.count(F.lit(1)).alias(name), *more)
    out = registry
    for part in (n(crawled, "crawled"), n(processed, "processed", used.alias("ocr_used")), n(on_disk, "pdfs_on_disk")):
        out = out.join(part, key, "left")
    out = out.fillna(0, ["crawled", "processed", "ocr_used", "pdfs_on_disk"])
    return with_shares(out)


def with_shares(rows: DataFrame) -> DataFrame:
    done = F.when(F.col("crawled") > 0, F.col("processed") / F.col("crawled") * 100).otherwise(F.lit(0.0))
    missing = F.when(F.col("pdfs_on_disk") < F.col("crawled"), F.col("crawled") - F.col("pdfs_on_disk")).otherwise(F.lit(0))
    return rows.withColumn("pct", done).withColumn("pct_shown", F.floor(done + 0.5)).withColumn("missing", missing.cast("long"))


def totals(rows: DataFrame) -> DataFrame:
    """One row over a coverage report."""
    names = [c for c in ("crawled", "processed", "ocr_used", "pdfs_on_disk") if c in rows.columns]
    return with_shares(rows.agg(*[F.sum(c).alias(c) for c in names]))


def badge(pct: Column) -> Column:
    return F.when(pct >= 100, "complete").when(pct > 0, "partial").otherwise("none")


def report_line(name: str = "name") -> Column:
    """A row of a coverage report for a console."""
    return F.format_string("%-20s crawled %6d  processed %6d (%3d%%)  missing %6d", F.col(name), "crawled", "processed", "pct_shown", "missing")


def index_sample(chunks: DataFrame, limit: int = 500, key: str = "state") -> DataFrame:
    """Counts by state and languages of the first rows of an index: a quick look, not a report."""
    return chunks.limit(limit).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("language")).alias("languages"))


def languages_expected(found: Column, expected: Column) -> Column:
    return F.size(F.array_except(found, expected)) == 0


def status_counts(results: DataFrame, status: str = "status") -> DataFrame:
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("n"))

"""Offence lookup and the verdict over a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions.naming import normalize_section_query
from lamplight.functions.strings import text_or_empty

SNIPPET = 75
LISTED = 1000
# Status codes and what they are shown as.
STATUS_LABELS = (("heinous", "Heinous"), ("not_heinous", "Not heinous"), ("depends", "Depends on other charges/facts"))
UNKNOWN_STATUS = "Unknown / needs data"


def statutes(offences: DataFrame) -> DataFrame:
    return offences.filter(F.length(text_or_empty("statute")) > 0).select("statute").distinct().orderBy("statute")


def section_search(offences: DataFrame, statute: str, query: str) -> DataFrame:
    """Offences of a statute whose section or label holds the query; an empty query finds all."""
    q = normalize_section_query(F.lit(query))
    hit = F.contains(F.lower(text_or_empty("section")), q) | F.contains(F.lower(text_or_empty("label")), q)
    return offences.filter((F.col("statute") == statute) & ((F.length(q) == 0) | hit))


def sections(found: DataFrame, order: str) -> DataFrame:
    """The first record of each section, with a snippet, and whether it can be chosen directly.

    That is so if its only row has no subclause; else the subclauses are options.
    """
    bare = F.length(text_or_empty("subclause")) == 0
    one = found.groupBy("section").agg(F.min_by(F.struct("id", "label", "text"), order).alias("f"), F.min(order).alias("first"), F.count(F.lit(1)).alias("n_rows"), F.count_if(bare).alias("n_bare"))
    return one.select("section", "f.*", "n_rows", ((F.col("n_rows") == 1) & (F.col("n_bare") == 1)).alias("direct"), snippet("f.text").alias("snippet"), "first").orderBy("first").drop("first")


def snippet(text: Column | str) -> Column:
    return F.concat(F.replace(F.substring(text_or_empty(text), 1, SNIPPET), F.lit("\n"), F.lit(" ")), F.lit("…"))


def status_label(status: Column) -> Column:
    out = F.lit(UNKNOWN_STATUS)
    for code, label in reversed(STATUS_LABELS):
        out = F.when(status == code, F.lit(label)).otherwise(out)
    return out


def _listed(rows: DataFrame, ids: list[str] | DataFrame, how: str) -> DataFrame:
    """Rows by their id: those that ids names (left_semi) or the others (left_anti). A list in the plan is short: longer ones are tables."""
    if not isinstance(ids, DataFrame) and len(ids) <= LISTED:
        named = F.coalesce(F.col("id").isin(ids), F.lit(False))
        return rows.filter(named if how == "left_semi" else ~named)
    if not isinstance(ids, DataFrame):
        ids = rows.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return rows.join(ids.select("id"), "id", how).select(*rows.columns)


def add_to_case(case: DataFrame, offences: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """The case with those offences, of a list or a table with `id`, that it does not hold yet."""
    new = _listed(offences, ids, "left_semi").join(case.select("id"), "id", "left_anti")
    return case.unionByName(new.select(*case.columns))


def remove_from_case(case: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    return _listed(case, ids, "left_anti")


def clear_case(case: DataFrame) -> DataFrame:
    return case.filter(F.lit(False))


def verdicts(cases: DataFrame, case: str = "case_id", status: str = "status") -> DataFrame:
    """Counts and the verdict of each case; what is neither heinous nor not is `depends`. A case without offences has no row."""
    s = F.coalesce(F.col(status), F.lit(""))
    n = cases.groupBy(case).agg(F.count_if(s == "heinous").alias("heinous"), F.count_if(s == "not_heinous").alias("not_heinous"), F.count_if(~s.isin("heinous", "not_heinous")).alias("depends"))
    verdict = F.when(F.col("heinous") > 0, "HEINOUS").when(F.col("depends") > 0, "REVIEW FACTS").otherwise("NOT HEINOUS")
    return n.withColumn("verdict", verdict)

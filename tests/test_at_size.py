"""What came out only on larger tables or odd rows."""

from __future__ import annotations

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from lamplight.operators import offences, web
from lamplight.plans import cases  # noqa: F401
from lamplight.plans.queries import QUERIES, SQL
from lamplight.sources import readers


def rows(df, sql: str, **tables: str):
    """The rows of a query and of its SQL over Parquet tables."""
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    return sorted(map(tuple, df.collect()), key=str), sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall(), key=str)


def test_page_link_facts_takes_references_as_written(spark, tmp_path):
    titles = ["a &amp; b", "token = &quot;0b96", "cut off &amp", "cut off &am", "both &amp;quot; &lt;", "&#38; &amp;amp;"]
    pages = [(f"https://h.in/{i}", f'<title>{t}</title><p><a href="/x?a=1&amp;b=2">p &amp; q</a><a href="/y">&copy; z</a></p>') for i, t in enumerate(titles)]
    spark.createDataFrame([*pages, pages[0]], "url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = rows(QUERIES["page_link_facts"](spark, str(tmp_path)), SQL["page_link_facts"], pages=f"{tmp_path}/pages.parquet")
    assert len(got) == len(titles) and got == want


def batch_rows(df) -> int:
    """How many rows of df go to Python at once, at most."""
    return df.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n int").agg(F.max("n")).first()[0]


def large_texts(session):
    """24 texts of a megabyte in one partition, in a session that sets no size of batches."""
    return session.range(0, 24, 1, 1).select("id", F.repeat(F.concat(F.col("id").cast("string"), F.lit(" words.\n")), 110_000).alias("text"))


def test_pdf_contents_go_to_python_in_small_batches(spark):
    texts = large_texts(spark.newSession())
    files = texts.select(F.col("id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    got = readers.extract_texts(files, lambda d, a, z: [d[:8].decode()] * (z - a), lambda d: 1, lambda d, a, z: ["scan"], lambda s: F.lit(False))
    assert sorted(r.text[:2].strip() for r in got.collect()) == sorted(map(str, range(24)))
    assert batch_rows(files) <= 12


def test_links_are_read_in_small_batches(spark):
    pages = large_texts(spark.newSession()).select(F.col("id").cast("string").alias("url"), F.concat(F.lit("<a href='/x'>x</a><!--"), "text", F.lit("-->")).alias("html"))
    assert web.page_links(pages).count() == 24
    assert batch_rows(pages) <= 12


def test_texts_are_split_for_translation_in_small_batches(spark, tmp_path):
    session = spark.newSession()
    large_texts(session).select(F.col("id").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["split_translation"](session, str(tmp_path))
    assert got.count() == 24 * 110_000
    assert batch_rows(large_texts(session)) <= 12


def test_ids_of_a_case_are_no_part_of_the_plan(spark, tmp_path):
    spark.range(1, 40_001, 1, 4).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["case_list"](spark, str(tmp_path))
    assert len(df._jdf.queryExecution().logical().toJSON()) < 200_000
    got, want = rows(df, SQL["case_list"], part=f"{tmp_path}/part.parquet")
    assert len(got) == 2004 and got == want


def test_lists_of_a_case_of_any_length(spark):
    every = spark.createDataFrame([*((str(i), i % 3) for i in range(4000)), (None, 1)], "id string, n int").select("n", "id")
    ids = [str(i) for i in range(0, 4000, 2)]
    case = offences.add_to_case(offences.add_to_case(every.limit(0), every, ids), every, ["1", "2", "2", None])
    assert sorted(int(r.id) for r in case.collect()) == sorted([1, *range(0, 4000, 2)])
    # a row without an id is not one of those that a list names
    for some in (ids, ids[:3], [*ids[:3], None], []):
        left = offences.remove_from_case(every, some)
        assert left.columns == ["n", "id"] and left.count() == 4001 - len([i for i in some if i])

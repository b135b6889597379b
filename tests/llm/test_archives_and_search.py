"""WARC round trips, exact search and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamplight.llm import hamming, warc

BIG = "<p>é " + "0123456789" * 20_000
PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a\r\n/4", ""), (5, "u", BIG), (6, "u", BIG), (7, "u", BIG + "!"), (7, "u", BIG + "!"), (None, "n", "<p>x</p>"), (9, "u", "WARC/1.1\r\n\r\n\r\nnot a record\r\n\r\n"), (10, "u", "日本 𝒳"), (None, None, "only here")]


def read_back(facts, least):
    """What the contract says of (page_id, payload) rows."""
    first = {}
    for i, b in facts:
        if len(b) >= least and (b not in first or first[b] is None or (i is not None and i > first[b])):
            first[b] = i
    want, responses = Counter(), Counter()
    for i, b in facts:
        kind, refers = "response", None
        if b in first:
            own = i == first[b] and not responses[b]
            responses[b] += own
            kind, refers = ("response", None) if own else ("revisit", first[b])
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, refers] += 1
    return want


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, no int")
    for least in (0, 5):
        for size in (32_768, 7):
            pages = [p for p in PAGES if size > 7 or len(p[2] or "") < 99]
            got = Counter(tuple(r) for r in warc.warc_round_trip(df.filter(F.length(F.coalesce("html", F.lit(""))) < (10**9 if size > 7 else 99)), least, size).collect())
            assert got == read_back([(i, (h or "").encode()) for i, _, h in pages], least)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_chunks_are_whole_characters():
    for text in ("", "a", "é日𝒳" * 5, "𝒳" * 3, BIG[:100]):
        for size in (1, 2, 3, 5, 1000):
            got = list(warc.chunks(text.encode(), size))
            assert b"".join(x for x, _ in got) == text.encode() and [z for _, z in got] == [False] * (len(got) - 1) + [True]
            assert all(len(x) <= max(4, size) and (x.decode() or not text) for x, _ in got)


def test_oversized_payloads_travel_in_chunks(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", BIG)], "page_id long, url string, html string")
    rows = warc.record_rows(df, chunk_bytes=1000).collect()
    assert len(rows) >= len(BIG.encode()) // 1000 and max(len(r.value) for r in rows) < 2000
    assert sorted(r.chunk_no for r in rows) == list(range(len(rows)))
    # and in archives of a bounded number of records
    warc.write_archives(df, f"file://{tmp_path}/w", chunk_bytes=1000, archive_records=50)
    assert len(list((tmp_path / "w").glob("part-*"))) == -(-len(rows) // 50)
    assert warc.read_archives(spark, f"file://{tmp_path}/w").collect() == [(1, len(BIG.encode()), base64.b32encode(hashlib.sha1(BIG.encode()).digest()).decode(), "response", None)]


def test_damaged_archives_are_errors(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "u", "<p>hello</p>")], "page_id long, url string, html string")
    path = tmp_path / "w"
    warc.write_archives(df, f"file://{path}")
    for f in path.glob("part-*"):
        f.write_bytes(gzip.compress(gzip.decompress(f.read_bytes()).replace(b"hello", b"hallo")))
    for f in path.glob(".*crc"):
        f.unlink()
    with pytest.raises(Exception, match="does not match"):
        warc.read_archives(spark, f"file://{path}").collect()


def codes(rows):
    out = []
    for _, e in rows:
        total = [0.0] * 64
        for j, x in enumerate(e or []):
            total[j % 64] += 0.0 if x is None or x != x else x
        out.append(sum(1 << b for b in range(64) if total[b] > 0))
    return out


def test_top_k_equals_brute_force(spark):
    r = random.Random(6)
    vec = lambda: [r.gauss(0, 1) for _ in range(64)]
    hot = vec()
    rows = [(i, hot if i % 3 == 0 else vec()) for i in range(240)]
    rows += [(240, None), (260, []), (280, [float("nan"), None, 1.0]), (300, vec() + vec()), (20, vec()), (20, vec())]
    df = spark.createDataFrame([(*x, 1) for x in rows] + [(None, hot, 1)], "vec_id long, embedding array<float>, code int")
    table = [(i, c) for (i, _), c in zip(rows, codes([(i, e and [None if x is None else float(x) for x in e]) for i, e in rows]), strict=True)]
    for shard in (16_384, 40):
        got = Counter(tuple(x) for x in hamming.hamming_top_k(df, shard_codes=shard).collect())
        want = Counter()
        for q, c in table:
            if q % 20 == 0:
                for n, (d, i) in enumerate(sorted(((c ^ x).bit_count(), i) for i, x in table)[:10], 1):
                    want[q, n, i, d] += 1
        assert {(k[0], k[1], k[3]) for k in got} == {(k[0], k[1], k[3]) for k in want} and sum(got.values()) == sum(want.values())
        assert got == want
    few = df.filter("vec_id in (0, 1, 2)")
    assert hamming.hamming_top_k(few).count() == 3 and hamming.hamming_top_k(df.limit(0)).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_and_queries(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, SF)
        if name != "sentencepiece":
            assert at.columns == docs.columns
        if name == "exact_dedup":
            assert at.count() == before.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert corpus_pipeline.run(spark, SF).count() == at.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_pipeline_on_edges(spark, edges):
    """Nulls, empty and long texts, repeated rows and columns whose names clash go through all stages; nothing crashes."""
    import corpus_pipeline

    at = edges.unionByName(edges)
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, SF)
        if name == "exact_dedup":
            assert at.columns == edges.columns and at.count() == before.select(F.coalesce("text", F.lit(""))).distinct().count()
        if name == "simhash_near_dedup":  # the long text and its copy with another end are one; so are the texts without a word
            assert at.count() == before.count() - 2
    assert at.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and at.count() > 0

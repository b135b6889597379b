"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .hamming import hamming_top_k
from .main_text import extract
from .mixing import mix_sources, quality_weights
from .pieces import piece_digests
from .secrets_scan import scan
from .simhash import simhash_near_dedup
from .token_files import token_files
from .toxicity import toxicity
from .warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: the base matches."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), quality_weights(_table(spark, sf_dir, "labels")))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6: sizes and targets; and that no document is taken more than three times."""
    rows = op6_mix_sources(spark, sf_dir)
    return rows.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("bounded"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_top_k(_table(spark, sf_dir, "embeddings"))


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_main_text": op2_html_main_text,
    "op3_warc": op3_warc,
    "op4_secret_scan": op4_secret_scan,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_toxicity": op7_toxicity,
    "op8_hamming_top_k": op8_hamming_top_k,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_token_files": op10_token_files,
    "secret_counts": secret_counts,
    "mix_targets": mix_targets,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    # the pages of the driver's tables have one article element, of h1, p, b and br, so patterns can cut it out
    "op2_html_main_text": r"""
        WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' ', 'g'), '</?b>', '', 'g') AS h FROM pages),
             b AS (SELECT page_id, url, list_transform(string_split_regex(h, '</?(?:h1|p)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS x FROM a),
             t AS (SELECT page_id, url, array_to_string(list_filter(x, lambda y: y <> ''), chr(10) || chr(10)) AS text FROM b)
        SELECT page_id, url, text, length(text) AS n_chars FROM t
    """,
    # SHA-1 in base32 has no DuckDB function, so its bits are read from the hexadecimal digest
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             g AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
        SELECT p.page_id, octet_length(encode(p.h)) AS payload_bytes,
               (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(sha1(p.h), 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1), '' ORDER BY i)
                FROM range(32) r(i)) AS payload_digest,
               CASE WHEN p.page_id = g.first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN p.page_id <> g.first THEN g.first END AS refers_to
        FROM p JOIN g ON p.h = g.h
    """,
    "secret_counts": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, len(list_filter(regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS n_assign,
               len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
        FROM d
    """,
    "mix_targets": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
             s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source),
             w AS (SELECT *, CAST([1, 2, 3][(pos - 1) % 3 + 1] AS DOUBLE) AS w, 3.0 * source_size AS cap FROM s),
             o AS (SELECT *, row_number() OVER (ORDER BY cap / w, pos) AS k, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room, sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights FROM w),
             f AS (SELECT k, room / weights AS share FROM o WHERE room / weights * w <= cap ORDER BY k LIMIT 1),
             t AS (SELECT o.source, source_size, CASE WHEN f.k IS NULL OR o.k < f.k THEN cap ELSE least(f.share * w, cap) END AS target FROM o LEFT JOIN f ON true)
        SELECT doc_id, size, source_size, round(target, 4) AS target, true AS bounded FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    """,
    "op8_hamming_top_k": """
        WITH d AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
                          CAST(list_sum(list_transform(generate_series(1, 64), lambda i: CASE WHEN (q.embedding[i] > 0) <> (c.embedding[i] > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS distance
                   FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 20 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
        SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
    """,
}

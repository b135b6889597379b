"""Queries over the operators that the driver's tables do not reach by themselves: small made rows, files of the shared
folder, and injected functions in place of the network, PDF tools, encoders and models. Each has its SQL."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.functions import dates, naming, quality
from lamplight.operators import coverage, filters, incremental, offences, search, translate, web
from lamplight.sources import readers, registry, sinks
from lamplight.sources.shared import new_path, stored
from lamplight.streaming import ingest

from .queries import _DOCS, _NEAREST, _ORDERS, _SHARES, _letters, _strip, query
from .views import documents, orders, table


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for literal rows."""

    def cell(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


def local(uri: str) -> str:
    return uri.removeprefix("file://").removeprefix("file:")


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """One file of the shared folder, whatever file system it is on."""
    fs, p = sinks._fs(spark, path)
    out = fs.create(p)
    out.write(bytearray(text.encode()))
    out.close()
    return path


# -- sources -----------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS id, 'dir/' || n_name || '.pdf' AS file_path, 'Nation' AS state, 'nat' AS state_key FROM nation")
def json_scan(spark, d):
    """A JSON array of a file, a missing file and a corrupt one; older records lack the portal and have backslashes."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("dir\\"), "n_name", F.lit(".pdf")).alias("file_path"))
    path = new_path(spark, "json")
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(path)
    bad = write_text(spark, f"{new_path(spark, 'bad')}.json", '[{"id": 1, "file_')
    states = [(0, "nat", "Nation", path), (1, "x", "X", f"{path}-missing"), (2, "y", "Y", bad)]
    return readers.load_documents(spark, states, "id long, file_path string, state string, state_key string").select("id", "file_path", "state", "state_key")


@query(values("key, name, language_code, state_ord", [("cg", "Chhattisgarh", "hi", 0), ("karnataka", "Karnataka", "kn", 5)]))
def portal_registry(spark, d):
    return registry.resolve(spark, ["KARNATAKA", "cg"]).select("key", "name", "language_code", "state_ord")


@query(values("n, first, last", [(6, "cg", "karnataka")]))
def portal_registry_all(spark, d):
    r = registry.resolve(spark)
    return r.agg(F.count(F.lit(1)).alias("n"), F.min_by("key", "state_ord").alias("first"), F.max_by("key", "state_ord").alias("last"))


@query(values("filename, length, exact", [("a.pdf", 3, True), ("b.PDF", 4, False), ("d.pdf", 1, True)]))
def pdf_files(spark, d):
    """Both listings of a folder: the suffix as it is, and in any case."""
    root = new_path(spark, "listing")
    for name, text in (("a.pdf", "abc"), ("b.PDF", "abcd"), ("c.txt", "x"), ("sub/d.pdf", "x")):
        write_text(spark, f"{root}/{name}", text)
    exact = readers.pdf_listing(spark, root).select("filename", F.lit(True).alias("exact"))
    return readers.pdf_listing(spark, root, any_case=True).join(exact, "filename", "left").select("filename", "length", F.coalesce("exact", F.lit(False)).alias("exact"))


_CASE = "CASE WHEN contains(url, '/de/') THEN 'robots' WHEN length(url) % 5 = 0 THEN 'OSError: down' WHEN length(url) % 5 = 1 THEN 'status 404' END"


class _NoGerman:
    def can_fetch(self, agent: str, url: str) -> bool:
        return "/de/" not in url

    def crawl_delay(self, agent: str) -> None:
        return None


def _get(url: str) -> tuple[int, str, bytes]:
    n = len(url) % 5
    if n == 0:
        raise OSError("down")
    kind = {1: "text/html", 2: "Text/HTML; charset=utf-8", 3: "application/octet-stream", 4: "application/pdf"}[n]
    return (404 if n == 1 else 200), kind, (b"%PDF" if n == 3 else b"<p>x</p>")


@query(
    f"""SELECT url, {_CASE} AS error, coalesce({_CASE} IS NULL AND length(url) % 5 = 2, false) AS is_page, coalesce({_CASE} IS NULL AND length(url) % 5 IN (3, 4), false) AS is_pdf FROM pages"""
)
def fetch_answers(spark, d):
    """Fetching by host under robots rules; pages, documents from any address and failures told apart."""
    police = lambda: readers.Politeness("ua", 0.0, rules=lambda origin: _NoGerman())
    got = stored(readers.fetch_pages(table(spark, d, "pages").select("url"), _get, police=police), "answers")
    answers = readers.page_answers(got).select(F.col("url").alias("u"), F.col("html").isNotNull().alias("is_page"), "is_pdf")
    return got.dropDuplicates(["url"]).join(answers.dropDuplicates(["u"]), F.col("url") == F.col("u")).select("url", "error", "is_page", "is_pdf").join(table(spark, d, "pages").select("url"), "url")


def _stream(url: str) -> Iterator[bytes]:
    yield b"%PDF"
    if url.endswith("1"):
        raise OSError("cut off")
    yield url.encode()


@query("SELECT 'p' || page_id || '.pdf' AS filename, CASE WHEN page_id % 7 <> 0 AND page_id % 10 <> 1 THEN 4 + length('https://h/' || page_id) END AS length, page_id % 7 <> 0 AND page_id % 10 <> 1 AS stored FROM pages WHERE page_id % 3 <> 0")
def download_missing(spark, d):
    """What the metadata lists and the folder lacks: whole files, or nothing for a failed one."""
    p = table(spark, d, "pages")
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("filename")
    meta = p.select(name, F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("https://h/"), F.col("page_id").cast("string"))).alias("pdf_url"))
    root = local(new_path(spark, "pdfs"))
    done = stored(readers.fetch_missing(meta, p.filter("page_id % 3 = 0").select(name), _stream, readers.FileStore(root)), "downloads")
    os.makedirs(root, exist_ok=True)
    there = readers.pdf_listing(spark, f"file://{root}").select("filename", F.col("length").alias("on_disk"))
    return done.join(there, "filename", "left").select("filename", "length", F.col("on_disk").eqNullSafe(F.col("length")) & F.col("on_disk").isNotNull()).toDF("filename", "length", "stored")


@query("SELECT count(*) FILTER (page_id % 10 <> 1) AS fetched, count(*) FILTER (page_id % 10 = 1) AS failed FROM pages")
def fetch_totals(spark, d):
    rows = table(spark, d, "pages").select(F.concat(F.lit("https://h/"), F.col("page_id").cast("string")).alias("url"), F.concat(F.col("page_id").cast("string"), F.lit(".pdf")).alias("filename"))
    return readers.fetch_counts(readers.download(rows, _stream, readers.FileStore(local(new_path(spark, "pdfs")))))


def _thousands(data: bytes, a: int, z: int) -> list[str]:
    text = data.decode()
    return [text[1000 * i : 1000 * i + 1000] for i in range(a, z)]


_SAMPLE = "array_to_string(list_transform(range(0, least(3, n)), lambda i: substr(t, i * 1000 + 1, 1000)), chr(10) || chr(10))"
_LAYER = "array_to_string(list_transform(range(0, n), lambda i: substr(t, i * 1000 + 1, 1000)), chr(10) || chr(10))"
_BARE = _strip("s")
_VOICED = "length(regexp_replace(s, '[^AEIOUaeiou]', '', 'g')) / greatest(1, length(regexp_replace(s, '[^A-Za-z]', '', 'g'))) >= 0.22 AND length(regexp_replace(s, '[^A-Za-z]', '', 'g')) >= 50"
_FONT = " + ".join(f"CAST(contains(s, '{x.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for x in quality.LEGACY_SIGNATURES)


@query(
    f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, CAST(ceil(length(coalesce(text, '')) / 1000.0) AS BIGINT) AS n FROM documents),
             b AS (SELECT doc_id, t, n, {_SAMPLE} AS s, {_LAYER} AS layer FROM a),
             c AS (SELECT *, length({_BARE}) < 100 OR ({_FONT}) >= 2 OR NOT ({_VOICED}) AS scan FROM b)
        SELECT doc_id, scan AS was_ocr_used, CASE WHEN scan THEN array_to_string(list_transform(range(0, n), lambda i: 'scan'), chr(10) || chr(10)) ELSE layer END AS text FROM c"""
)
def text_layers(spark, d):
    """Texts as PDF contents of 1000-character pages: batches of pages, the gate on the first three, OCR where it says so."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    got = readers.extract_texts(docs, _thousands, lambda b: -(-len(b.decode()) // 1000), lambda b, a, z: ["scan"] * (z - a), read_large=_thousands, least_large=5000)
    return got.select(F.col("path").cast("long").alias("doc_id"), "was_ocr_used", "text")


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1990 AND 2035 AND o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS document_date FROM orders")
def pdf_header_dates(spark, d):
    def read(data: bytes, a: int, z: int) -> list[str]:
        if data.startswith(b"!"):
            raise ValueError("no PDF")
        return ["", data.decode(), "dated 01/01/1991"][a:z]

    rows = _letters(spark, d).select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("!"), "text")).otherwise(F.concat(F.lit("dated: dated "), F.col("text"))).cast("binary").alias("content"))
    # the third page's date has an anchor too, but comes later
    plain = _letters(spark, d).select(F.col("o_orderkey").alias("k"), dates.extract_date(F.concat(F.lit("dated: dated "), F.col("text"))).alias("first"))
    return readers.pdf_dates(rows, read).join(plain, F.col("path") == F.col("k").cast("string")).select(F.col("k").alias("o_orderkey"), F.when(F.col("document_date").isNotNull(), F.col("first")).alias("document_date"))


@query("SELECT n_regionkey AS state, count(*) AS n, array_to_string(list_sort(list(DISTINCT substr(n_name, 1, 1))), ' ') AS languages, count(*) FILTER (substr(n_name, 1, 1) > 'M') = 0 AS expected FROM nation GROUP BY 1")
def index_sample(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("state"), F.substring("n_name", 1, 1).alias("language"))
    seen = coverage.index_sample(rows)  # the table has fewer rows than the sample
    letters = F.array(*[F.lit(chr(c)) for c in range(65, 78)])
    return seen.select("state", "n", F.array_join("languages", " ").alias("languages"), coverage.languages_expected(F.col("languages"), letters).alias("expected"))


@query("SELECT count(*) AS n FROM embeddings")
def index_count(spark, d):
    return table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces FROM conversations WHERE text IS NOT NULL")
def encoded_texts(spark, d):
    rows = table(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", F.col("text").alias("document"))
    done = readers.encode_texts(rows, lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts])
    return done.select("conv_id", "turn", F.col("embedding")[0].cast("double").alias("chars"), F.col("embedding")[1].cast("double").alias("spaces"))


@query(values("id, n", [("a", 1), ("b", None)]))
def sqlite_rows(spark, d):
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.execute("create table segments (id text, n int)")
    con.executemany("insert into segments values (?, ?)", [("a", 1), ("b", None)])
    con.commit()
    path = f"{new_path(spark, 'catalogue')}.sqlite3"
    fs, p = sinks._fs(spark, path)
    out = fs.create(p)
    out.write(bytearray(con.serialize()))
    out.close()
    return readers.read_sqlite(spark, path, "select id, n from segments", "id string, n double").select("id", F.col("n").cast("long").alias("n"))


@query(values("what, said", [("agent", "LamplightCrawler/1.0 (contact: a@b.c)"), ("no certificate", "True"), ("bundle", "roots+own"), ("path", "None"), ("path within", "True"), ("large", str(10 << 20)), ("pages", "7"), ("layer", "one|two")]))
def fetcher_settings(spark, d):
    """User agent, trust store, contained paths, the size from which a subprocess reads, and that subprocess."""
    import subprocess
    import tempfile

    def tool(args, **more):
        return subprocess.CompletedProcess(args, 0, b"Pages:  7\n" if args[0] == "pdfinfo" else b"one\x0ctwo\x0c")

    with tempfile.TemporaryDirectory() as t:
        with open(f"{t}/own.pem", "w") as f:
            f.write("own")
        none = readers.trust_store("other.pem", t, f"{t}/cache", lambda: b"roots")
        with open(readers.trust_store("own.pem", t, f"{t}/cache", lambda: b"roots\n")) as f:
            bundle = f.read().replace("\n", "+")
        paths = readers.contained(t, "../x.pdf"), readers.contained(t, "a/../x.pdf") == os.path.realpath(f"{t}/x.pdf")
    kept = os.environ.pop("TEXT_LAYER_PDFTOTEXT_MB", None)
    large = int(readers.large_bytes())
    if kept is not None:
        os.environ["TEXT_LAYER_PDFTOTEXT_MB"] = kept
    rows = [("agent", readers.user_agent("a@b.c")), ("no certificate", none), ("bundle", bundle), ("path", paths[0]), ("path within", paths[1]), ("large", large), ("pages", readers.pdf_page_count(b"", tool)), ("layer", "|".join(readers.pdf_text_pages(b"", 0, 2, tool)))]
    return spark.createDataFrame([(a, str(b)) for a, b in rows], "what string, said string")


# -- sinks and streams -------------------------------------------------------------------------------------------------


@query("SELECT r_regionkey, r_name FROM region")
def sheet_sync(spark, d):
    """A synced table is stored whole, and an empty answer does not wipe it."""
    path, rows = new_path(spark, "sheet"), table(spark, d, "region").select("r_regionkey", "r_name")
    sinks.replace_if_any(rows.limit(1), path)
    sinks.replace_if_any(rows, path)
    sinks.replace_if_any(rows.limit(0), path)
    return sinks.read_version(spark, path).select("r_regionkey", "r_name")


@query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey NOT IN (0, 1) OR n_regionkey = 0 AND n_nationkey % 2 = 0 UNION ALL SELECT 99, NULL WHERE false")
def replaced_partitions(spark, d):
    """A portal's rows replaced, another's and those without one dropped because nothing is left of them."""
    path = new_path(spark, "partitions")
    rows = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    extra = spark.createDataFrame([(99, None), (98, "a/b")], "n_nationkey int, n_regionkey string").select(F.col("n_nationkey").cast(rows.schema[0].dataType).alias("n_nationkey"), "n_regionkey")
    sinks.replace_partitions(rows.unionByName(extra), path, "n_regionkey")
    sinks.replace_partitions(rows.filter("n_regionkey = '0' and n_nationkey % 2 = 0"), path, "n_regionkey", emptied=spark.createDataFrame([("0",), ("1",), (None,), ("a/b",)], "n_regionkey string"))
    return spark.read.parquet(path).select("n_nationkey", F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query("SELECT rpad(CAST(event_id AS VARCHAR), 36, 'x') AS name FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0")
def orphan_segments(spark, d):
    e = table(spark, d, "events").select("event_id", F.rpad(F.col("event_id").cast("string"), 36, "x").alias("id"))
    names = e.select(F.when(F.col("event_id") % 7 == 0, F.substring("id", 1, 35)).otherwise(F.col("id")).alias("name"))
    return sinks.orphans(names, e.filter("event_id % 3 = 0").select("id"), e.filter("event_id % 5 = 0").select("id"))


@query("SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def streamed_hosts(spark, d):
    """The hosts of pages as a stream of files: first rows only, the checkpoint as the set of what is done."""
    folder, out, done = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "checkpoint")
    table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")).repartition(3).write.json(folder)
    rows = ingest.unseen_stream(ingest.record_stream(spark, folder, "page_id long, host string", 2), "host")
    for _ in range(2):  # the second run finds nothing to do
        ingest.run_batches(rows, done, lambda b, i: sinks.append(b, out)).awaitTermination()
    return spark.read.schema("page_id long, host string").parquet(out).select("host")


@query(values("job, status, attempts, gained", [("second run", "ok", 2, 5), ("never gets on", "stuck", 2, 0), ("gets on, then not", "stuck", 3, 4), ("always killed", "gave-up", 5, 5)]))
def resumed_jobs(spark, d):
    def job(steps: list[tuple[int, bool]]):
        left, n = list(steps), [0]

        def run() -> None:
            gain, fails = left.pop(0)
            n[0] += gain
            if fails:
                raise RuntimeError("killed")

        return ingest.resume(run, lambda: n[0])

    jobs = {"second run": [(3, True), (2, False)], "never gets on": [(0, True)] * 2, "gets on, then not": [(0, True), (4, True), (0, True)], "always killed": [(1, True)] * 5}
    return spark.createDataFrame([(k, *job(v)) for k, v in jobs.items()], "job string, status string, attempts long, gained long")


# -- projections and filters -------------------------------------------------------------------------------------------


@query(f"SELECT vec_id, 'Untitled' AS title, '—' AS state, round(greatest(0, 1 - d), 3) AS similarity, CAST(round_even(greatest(0, 1 - d) * 100, 0) AS BIGINT) || '%' AS shown FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS r FROM {_NEAREST}) WHERE r = 1 ORDER BY d, vec_id LIMIT 10")
def semantic_items(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("filename"), "embedding", F.lit(None).cast("string").alias("state"), F.lit("").alias("title_hi"), F.lit(None).cast("string").alias("link_text"), F.col("vec_id").alias("chunk_id"))
    q = e.orderBy("vec_id").select("embedding").first()[0]  # one vector
    return search.semantic_search(e, q).select("vec_id", "title", "state", F.round("similarity", 3).alias("similarity"), search.similarity_label("similarity").alias("shown"))


@query(f"SELECT id AS doc_id, state AS state_key, '' AS title_hi, '' AS link_text, coalesce(state, '') AS state, '' AS pdf_url, was_ocr_used, CASE WHEN doc_id % 2 = 0 THEN 1704067200 END AS document_date_epoch, 'l-' || state AS language FROM {_DOCS} WHERE state IS NOT NULL")
def index_projection(spark, d):
    docs = documents(spark, d).filter("state is not null").withColumns({"document_date": F.when(F.col("doc_id") % 2 == 0, "2024-01-01").otherwise(""), "subject": F.lit(None).cast("string"), "order_no": F.lit("1"), "source_org": F.lit(None).cast("string")})
    chunks = docs.select("state_key", F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"))
    portals = docs.select(F.col("state_key").alias("key")).distinct().withColumn("language_code", F.concat(F.lit("l-"), "key"))
    return readers.index_rows(chunks, docs, portals).select("doc_id", "state_key", "title_hi", "link_text", "state", "pdf_url", "was_ocr_used", "document_date_epoch", "language")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2020-02-02' WHEN year(o_orderdate) BETWEEN 1990 AND 2035 THEN strftime(o_orderdate, '%Y-%m-%d') END AS document_date, length('dated ' || strftime(o_orderdate, '%d/%m/%Y')) AS char_count FROM orders")
def processed_record(spark, d):
    o = table(spark, d, "orders")
    files = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "2020-02-02").otherwise("").alias("table_date"), F.lit("").alias("document_date"), F.concat(F.lit("dated "), F.date_format("o_orderdate", "dd/MM/yyyy")).alias("raw"))
    return incremental.processed_records(files, F.col("raw")).select("o_orderkey", "document_date", "char_count")


@query("SELECT doc_id, 'Sum up: ' || substr(coalesce(text, ''), 1, 2500) AS prompt FROM documents")
def summary_prompts(spark, d):
    return table(spark, d, "documents").select("doc_id", search.summary_prompt("Sum up: ").alias("prompt"))


_SITE_LINKS = '<a href="/a">A  b</a><a href="page.html?x=1.pdf#top">p</a><a href="#x">x</a><a href="mailto:m@h">m</a><a href="tel:1">t</a><a href="javascript:f()">j</a><a href="">e</a><a href="/x.PDF?v=1">pdf</a><a href="/y.zip">z</a><a href="https://other.in/a">o</a><a href="ftp://h.in/f">f</a><a href="https://h.in:8080/p">port</a><a href="MAILTO:x">up</a>'


@query(
    values(
        "href, url, link_text, followed, pdf, page",
        [
            ("/a", "https://h.in/a", "A b", True, False, True), ("page.html?x=1.pdf#top", "https://h.in/d/page.html?x=1.pdf", "p", True, False, True), ("#x", "https://h.in/d/", "x", False, False, False), ("mailto:m@h", "mailto:m@h", "m", False, False, False),
            ("tel:1", "tel:1", "t", False, False, False), ("javascript:f()", "javascript:f()", "j", False, False, False), ("", "https://h.in/d/", "e", False, False, False), ("/x.PDF?v=1", "https://h.in/x.PDF?v=1", "pdf", True, True, False), ("/y.zip", "https://h.in/y.zip", "z", True, False, False),
            ("https://other.in/a", "https://other.in/a", "o", True, False, False), ("ftp://h.in/f", "ftp://h.in/f", "f", True, False, False), ("https://h.in:8080/p", "https://h.in:8080/p", "port", True, False, False), ("MAILTO:x", "MAILTO:x", "up", True, False, False),
        ],
    )
)
def link_tests(spark, d):
    """Anchors with absolute addresses and text; which are followed, documents, or pages of the same site."""
    links = web.page_links(spark.createDataFrame([("https://h.in/d/", _SITE_LINKS)], "url string, html string"))
    own = web.site_pages(links, "h.in").select(F.col("ord").alias("o"), F.lit(True).alias("page"))
    rows = links.join(own, F.col("ord") == F.col("o"), "left")
    return rows.select("href", "url", "link_text", naming.is_followed_link("href").alias("followed"), naming.is_pdf_link("href").alias("pdf"), F.coalesce("page", F.lit(False)).alias("page"))


@query(values("kind, body, is_pdf", [("application/pdf", "", True), ("Application/PDF; x=1", "", True), ("application/octet-stream", "%PDF-1.7", True), ("application/octet-stream", "MZ", False), ("binary/octet-stream", "%PDF", True), ("application/download", "%PDF", True), ("text/html", "%PDF", False), ("", "%PDF", False)]))
def pdf_responses(spark, d):
    rows = spark.createDataFrame([("application/pdf", ""), ("Application/PDF; x=1", ""), ("application/octet-stream", "%PDF-1.7"), ("application/octet-stream", "MZ"), ("binary/octet-stream", "%PDF"), ("application/download", "%PDF"), ("text/html", "%PDF"), ("", "%PDF")], "kind string, body string")
    return rows.select("kind", "body", naming.is_pdf_response("kind", F.col("body").cast("binary")).alias("is_pdf"))


@query(f"SELECT id, state, category FROM {_ORDERS} WHERE (state = 'F' OR category IN ('1-URGENT', '2-HIGH')) AND state <> 'P' AND category NOT IN ('2-HIGH')")
def filter_tree(spark, d):
    where = {"$and": [{"$or": [{"state": "F"}, {"category": {"$in": ["1-URGENT", "2-HIGH"]}}]}, {"state": {"$ne": "P"}}, {"category": {"$nin": ["2-HIGH"]}}]}
    return orders(spark, d).filter(filters.compile_where(where)).select("id", "state", "category")


@query(f"SELECT id, row_number() OVER (ORDER BY doc_id) AS place FROM {_DOCS} WHERE contains(lower(coalesce(text, '')), 'the') ORDER BY doc_id LIMIT 50")
def search_order(spark, d):
    found = search.in_input_order(search.basic_search(documents(spark, d), " THE ", scan_body=True), 50)
    return incremental.numbered(found.select("id", "doc_ord"), ["doc_ord"], name="place").select("id", F.col("place").cast("long").alias("place"))


# -- joins and aggregates ----------------------------------------------------------------------------------------------


def _site(todo: DataFrame) -> DataFrame:
    site = {f"https://h.in/{i}": f'<a href="/{i + 1}">next</a><a href="/side{i}">side</a>' for i in range(7)} | {"https://h.in/": '<a href="/0">zero</a><a href="/get?Id=7">the form</a>', "https://h.in/side3": '<a href="/doc.pdf">d</a>'}
    pages = todo.sparkSession.createDataFrame(list(site.items()), "url string, html string")
    return todo.join(pages, "url", "left").select("url", "html", F.contains("url", F.lit("get?Id")).alias("is_pdf"))


@query(values("url, depth, kind", [("https://h.in/", 0, "page"), *((f"https://h.in/{i}", i + 1, "page") for i in range(5)), ("https://h.in/side3", 5, "page"), ("https://h.in/get?Id=7", 1, "handler"), ("https://h.in/doc.pdf", 5, "pdf")]))
def crawl_levels(spark, d):
    """Level by level to a depth of five, seen pages once; documents by link and by handler."""
    pages, pdfs = web.crawl(["https://h.in/"], _site, max_depth=5, spark=spark)
    return pages.select("url", "depth", F.lit("page").alias("kind")).unionByName(pdfs.select("url", "depth", F.when(F.col("by_handler"), "handler").otherwise("pdf").alias("kind")))


@query(values("url, depth", [("https://h.in/", 0), ("https://h.in/0", 1), ("https://h.in/1", 2)]))
def crawl_limit(spark, d):
    return web.crawl(["https://h.in/"], _site, max_depth=9, max_pages=3, spark=spark)[0].select("url", "depth")


@query(values("file_path, pdf_url, source_page, state_key, category, document_date, crawled_at, subject, order_no", [("k_pdfs/f.pdf", "https://h/a-order.pdf", "https://h/", "k", "Circulars & Orders", "2005-05-07", "2025-01-01", "S", "No 7"), ("k_pdfs/g.pdf", "https://h/b.pdf", "https://h/", "k", "General / Uncategorized", "2024-01-02", "2025-01-01", None, None)]))
def crawl_record(spark, d):
    rows = [("https://h/a-order.pdf", "https://h/", "", "", {"subject": "S", "order": "No 7, 07/05/2005"}, "f.pdf"), ("https://h/b.pdf", "https://h/", "t", "l", {}, "g.pdf")]
    pdfs = spark.createDataFrame(rows, "url string, page_url string, page_title string, link_text string, fields map<string,string>, filename string")
    found = spark.createDataFrame([("https://h/a-order.pdf", "1999-01-01"), ("https://h/b.pdf", "2024-01-02")], "url string, document_date string")
    return web.crawl_records(pdfs, "k", "K", "k_pdfs", "2025-01-01", found).select("file_path", "pdf_url", "source_page", "state_key", "category", "document_date", "crawled_at", "subject", "order_no")


_LISTING = """<table><tr><td><strong>ಕ್ರ</strong></td><td><strong>ವಿಷಯ</strong></td><td><strong>ಆದೇಶ ಸಂಖ್ಯೆ / ದಿನಾಂಕ</strong></td><td><strong>ಗಾತ್ರ</strong></td></tr>
<tr><td>1<td>ಯೋಜನೆ &nbsp; ಒಂದು<td>ಮಮಇ 293 ಮಮಅ 2005, 05.05.2007<td><p><a href="m1.pdf">Download</a></p></tr>
<tr><td>2</td><td></td><td>ಮಮಇ 81 ಮಮಅ 2025, ದಿನಾಂಕ:04.04.2025</td><td><a href="m2.pdf">Download</a></td></tr>
<tr><td>3</td><td>ಚಿಕ್ಕ</td><td><a href="m3.pdf">short row</a></td></tr></table>
<table><tr><th>ವಿಷಯ</th><th>ಮೂಲ</th><th>ಮಾಧ್ಯಮ</th></tr><tr><td>S</td><td>O</td><td>M <a href="m4.pdf">d</a></td><td>more</td></tr></table><table><tr><th>ವಿಷಯ</th></tr><tr><td>x</td><td><a href="m5.pdf">d</a></td></tr></table>"""


@query(
    values(
        "href, subject, order_no, table_date, source_org, medium",
        [("m1.pdf", "ಯೋಜನೆ ಒಂದು", "ಮಮಇ 293 ಮಮಅ 2005", "2007-05-05", None, None), ("m2.pdf", None, "ಮಮಇ 81 ಮಮಅ 2025", "2025-04-04", None, None), ("m3.pdf", None, None, None, None, None), ("m4.pdf", "S", None, None, "O", "M d"), ("m5.pdf", None, None, None, None, None)],
    )
)
def listing_rows(spark, d):
    """Rows under header cells: by position, none where the header is wider than the row or has one cell."""
    links = web.page_links(spark.createDataFrame([("https://h.in/", _LISTING)], "url string, html string"))
    c = web.listing_columns(F.col("fields"))
    return links.select("href", *[c[n].alias(n) for n in ("subject", "order_no", "table_date", "source_org", "medium")])


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1990 AND 2035 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '1980-01-01' END AS document_date, CASE WHEN o_orderkey % 2 = 0 THEN '1980-01-01' ELSE '1970-01-01' END AS old FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, '1970-01-01', '1970-01-01' FROM orders WHERE o_orderkey % 2 <> 0")
def backfilled_metadata(spark, d):
    """Metadata brought up to date from texts read again: processed files only, the last of equal names decides."""
    letters = _letters(spark, d).select("o_orderkey", F.lit("s").alias("state_key"), F.col("o_orderkey").cast("string").alias("filename"), "text", F.lit(1).alias("doc_ord"), F.lit("1980-01-01").alias("document_date"))
    done = letters.filter("o_orderkey % 2 = 0")
    earlier = done.withColumns({"doc_ord": F.lit(0), "text": F.lit("dated 01/01/2001")})
    meta = letters.select("o_orderkey", "state_key", "filename", F.lit("1970-01-01").alias("document_date"))
    _, synced, _ = incremental.backfill_dates(done.unionByName(earlier), meta)
    return synced.select("o_orderkey", "document_date", F.when(F.col("o_orderkey") % 2 == 0, "1980-01-01").otherwise("1970-01-01").alias("old"))


@query("SELECT count(*) AS docs, count(*) FILTER (o_orderkey % 2 = 0 AND year(o_orderdate) BETWEEN 1990 AND 2035) AS dated FROM orders")
def backfill_counts(spark, d):
    docs = _letters(spark, d).select(F.lit("s").alias("state_key"), F.col("o_orderkey").cast("string").alias("filename"), F.when(F.col("o_orderkey") % 2 == 0, F.col("text")).otherwise("nothing").alias("text"), F.lit(1).alias("doc_ord"), F.lit("1980-01-01").alias("document_date"))
    return incremental.backfill_dates(docs, docs.select("state_key", "filename", "document_date"))[2]


@query(values("langs, missing", [("hin+eng", ""), ("hin+eng+ori", "ori"), ("kan+kan+eng", "kan kan"), ("", ""), ("+hin+", "")]))
def language_packs(spark, d):
    rows = spark.createDataFrame([("hin+eng",), ("hin+eng+ori",), ("kan+kan+eng",), ("",), ("+hin+",)], "langs string")
    return rows.select("langs", F.array_join(incremental.missing_langpacks(F.col("langs"), F.array(F.lit("hin"), F.lit("eng"))), " ").alias("missing"))


@query(values("path, resolved", [("pdfs\\a.pdf", "bihar/pdfs/a.pdf"), ("/abs/x.pdf", "/abs/x.pdf"), ("none.pdf", None), ("z.pdf", "z.pdf")]))
def stored_paths(spark, d):
    paths = spark.createDataFrame([("pdfs\\a.pdf",), ("/abs/x.pdf",), ("none.pdf",), ("z.pdf",)], "path string")
    listing = spark.createDataFrame([("cg/pdfs/a.pdf",), ("bihar/pdfs/a.pdf",), ("z.pdf",), ("cg/z.pdf",)], "path string")
    return incremental.resolve_stored(paths, listing, ["cg", "bihar"]).select("path", "resolved")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, 'Depends on other charges/facts' AS label FROM part WHERE p_partkey % 10 = 0 AND p_partkey % 20 <> 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), CASE p_partkey % 4 WHEN 0 THEN 'Heinous' WHEN 1 THEN 'Not heinous' ELSE 'Unknown / needs data' END FROM part WHERE p_partkey IN (11, 12, 13, 14)")
def case_list(spark, d):
    """A case: offences added once, others taken off; status codes as labels."""
    code = F.when(F.col("p_partkey") % 10 == 0, "depends").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("heinous", "not_heinous", None, "other")]), (F.col("p_partkey") % 4 + 1).cast("int")))
    every = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_partkey", code.alias("status"))
    case = offences.add_to_case(offences.clear_case(every), every.filter("p_partkey % 10 = 0"), every.filter("p_partkey % 10 = 0"))
    case = offences.add_to_case(case, every, ["10", "11", "12", "13", "14", "11"])
    case = offences.remove_from_case(case, every.filter("p_partkey % 20 = 0"))
    return case.select("id", offences.status_label(F.col("status")).alias("label"))


@query("SELECT p_partkey, replace(substr(p_name || chr(10) || repeat(p_type || ' ', 5), 1, 75), chr(10), ' ') || '…' AS snippet FROM part")
def section_snippets(spark, d):
    text = F.concat("p_name", F.lit("\n"), F.repeat(F.concat("p_type", F.lit(" ")), 5))
    return table(spark, d, "part").select("p_partkey", offences.snippet(text).alias("snippet"))


@query(f"SELECT nation, CASE WHEN pct >= 100 THEN 'complete' WHEN pct > 0 THEN 'partial' ELSE 'none' END AS badge, printf('%-20s crawled %6d  processed %6d (%3d%%)  missing %6d', n_name, crawled, processed, pct_shown, missing) AS line FROM (SELECT *, {_SHARES} FROM (SELECT n_nationkey AS nation, n_name, coalesce(c.n, 0) AS crawled, coalesce(s.n, 0) AS processed, CAST(0 AS BIGINT) AS pdfs_on_disk FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey % 2 = 0 OR c_custkey % 3 = 0 AND c_nationkey <> 7 GROUP BY 1) s ON s.k = n_nationkey))")
def coverage_lines(spark, d):
    """A report for a console, with its badges."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    rows = coverage.coverage(names, c.filter("nation <> 3"), c.filter("nation % 2 = 0 or c_custkey % 3 = 0 and nation <> 7"), c.limit(0), "nation")
    lines = rows.select("nation", coverage.badge(F.col("pct")).alias("badge"), coverage.report_line("n_name").alias("line"))
    return lines


# -- text --------------------------------------------------------------------------------------------------------------

_DATES = [
    ("order of 15/08/2021", "2021-08-15"), ("2021-08-15 and 16-08-2022", "2021-08-15"), ("2021.8.5 end", "2021-08-05"), ("15 Jan 2024", None), ("15 January, 2024", "2024-01-15"), ("7 may 2020", "2020-05-07"), ("१५ अगस्त २०२१", "2021-08-15"),
    ("५ फरवरी २०२०", "2020-02-05"), ("31/02/2020", None), ("01/01/1989", None), ("01/01/2036", None), ("last date 01/02/2020", "2020-02-01"), ("01/02/2020 last date 03/04/2021", "2020-02-01"), ("05/05/2019 dated 06/06/2020", "2020-06-06"), ("अंतिम दिनांक: 07/07/2021 " + "x" * 70 + " 08/08/2022", "2021-07-07"),
    ("updated 01/03/2021 02/03/2021", "2021-03-01"), ("Dated 01/03/2021", "2021-03-01"), ("1/2/34 and 12/13/2020", None), ("x" * 3990 + " 01/01/2020", None), ("10 मार्च 2019 01/01/2018", "2019-03-10"), ("ದಿನಾಂಕ ೦೫/೦೬/೨೦೧೭", "2017-06-05"), ("12/2020/13", None), ("112/05/2020", None), ("", None),
]


@query(values("text, iso", _DATES))
def date_cases(spark, d):
    """Competing candidates, anchors, scripts, bounds: what each text's date is."""
    return spark.createDataFrame([(t,) for t, _ in _DATES], "text string").select("text", dates.extract_date("text").alias("iso"))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1990 AND 2035 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso, CASE WHEN o_orderkey % 3 = 0 THEN '2020-02-02' WHEN o_orderkey % 3 = 1 AND year(o_orderdate) BETWEEN 1990 AND 2035 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2001-01-01' END AS chosen FROM orders")
def iso_dates(spark, d):
    """Dates in year-month-day order with any separator; the listing's date before the text's, that before the crawl's."""
    o = table(spark, d, "orders")
    sep = F.element_at(F.array(F.lit("-"), F.lit("/"), F.lit(".")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("No. 5/6 "), F.date_format("o_orderdate", "yyyy"), sep, F.date_format("o_orderdate", "M"), sep, F.date_format("o_orderdate", "d"), F.lit(" end"))
    listed = F.when(F.col("o_orderkey") % 3 == 0, "2020-02-02").otherwise("")
    read = F.when(F.col("o_orderkey") % 3 == 1, text).otherwise("nothing")
    return o.select("o_orderkey", dates.extract_date(text).alias("iso"), dates.document_date(listed, read, F.lit("2001-01-01")).alias("chosen"))


_WORDS = "The committee met on Monday and the members spoke about the report"
_LONG = ". ".join([_WORDS] * 6) + "."
_NOISY = "a noisy answer comes for this line of the text, it says so and there is more of it, " * 2 + "and the end of the line is near"
_GUARDS = [
    ("", "x", "empty source"), ("some words here", " \n", "empty translation"), ("समिति की बैठक हुई", "The committee met.", ""), ("a source of forty characters or more, yes", "too short", "length ratio"), ("short", "s", ""), ("short text", "x" * 61, "length ratio"),
    ("समिति की बैठक हुई और बहुत बात", "समिति की बैठक हुई और बहुत बात", "too little Latin script; still Devanagari (untranslated)"), ("समिति की बैठक हुई और", "committee met समिति", "still Devanagari (untranslated)"),
    ("a text about preachers here", "Jehovah and the Watchtower and jw.org", "contamination: jehovah, jw.org, the watchtower"), ("a text that cannot be read at all", "I cannot translate. Please provide the text.", "model commentary: i cannot, please provide"),
    ("many lines " * 5, "the same line again\n" * 4, "identical lines (degenerate output)"), ("word " * 33, "word " * 33, "few distinct words (degenerate output)"),
    ("phrases of five kinds and more " * 4, "Jehovah, Watchtower, Bible students, Awake!, jw.org, field ministry, pioneer service: so it is written in the text here", "contamination: awake!, bible students, field ministry, jehovah, jw.org"),
]


@query(values("source, output, reasons, ok", [(s, o, r, not r) for s, o, r in _GUARDS]))
def guard_cases(spark, d):
    """Each check of a translation, with at most five phrases of contamination and three of commentary named."""
    rows = spark.createDataFrame([(s, o) for s, o, _ in _GUARDS], "source string, output string").withColumn("c", quality.check_translation("source", "output"))
    return rows.select("source", "output", F.array_join("c.reasons", "; ").alias("reasons"), F.col("c.ok").alias("ok"))


_AUDIT = [("t", _WORDS, _WORDS), ("t", "", "x"), ("b", _WORDS, "short"), ("b", _WORDS, "")]


@query(values("field, failed, n", [("title", 0, 1), ("body", 1, 1)]))
def audit_failures(spark, d):
    """Title and body pairs with both sides; how many fail."""
    rows = spark.createDataFrame([(_WORDS, _WORDS, _WORDS, "short"), ("", "x", _WORDS, "")], "title string, title_en string, body string, body_en string")
    pairs = translate.audit(rows, [("title", "title_en"), ("body", "body_en")])
    return pairs.groupBy("field").agg(F.count_if(~F.col("check.ok")).alias("failed"), F.count(F.lit(1)).alias("n"))


def _model(pieces: pd.Series) -> pd.Series:
    return pieces.map(lambda t: "I can't provide that." if "bad" in t else "Please provide the text.\n" + _LONG if "noisy" in t else _WORDS)


_EXCERPTS = ["समिति की बैठक हुई और सदस्यों ने रिपोर्ट पर बात की थी", "bad words only in this line of text", _NOISY, " ", "समिति की बैठक हुई और सदस्यों ने रिपोर्ट पर बात की थी  ", "1234"]


@query(values("source, status, english, removed, reason", [(_EXCERPTS[0], "ok", _WORDS, 0, ""), (_EXCERPTS[1], "failed", "", 0, "empty translation"), (_EXCERPTS[2], "ok", _LONG, 1, ""), ("", "failed", "", None, "empty source"), ("1234", "failed", "", 0, "empty translation")]))
def translated_excerpts(spark, d):
    """Pieces, an injected model, refusals and commentary taken out, guards; each distinct excerpt once."""
    rows = spark.createDataFrame([(x,) for x in _EXCERPTS], "text string")
    results, _ = translate.translate(rows, "m", _model)
    return results.select("source", "status", "english", F.try_element_at("metrics", F.lit("commentary_lines_removed")).cast("long").alias("removed"), F.array_join("reasons", "; ").alias("reason"))


@query(values("status, cached, n", [("failed", False, 1), ("failed", True, 2), ("ok", True, 2), ("unavailable", False, 1)]))
def translation_tally(spark, d):
    """A second run over a stored cache without a model: what is known, what is not; nothing unavailable is kept."""
    rows, path = spark.createDataFrame([(x,) for x in _EXCERPTS], "text string"), new_path(spark, "cache")
    results, fresh = translate.translate(rows, "m", _model)
    sinks.upsert_cache(fresh, path)
    away = translate.is_available("m", lambda: ["other:7b"])
    again, none = translate.translate(rows.unionByName(spark.createDataFrame([("a new line of words",)], "text string")), "m", _model, cache=spark.read.parquet(path), available=away)
    sinks.upsert_cache(again.select(*none.columns).filter("status = 'unavailable'"), path)
    left = spark.read.parquet(path).filter("status = 'unavailable'")
    assert left.isEmpty()
    return again.groupBy("status", "cached").agg(F.count(F.lit(1)).alias("n"))


@query(values("model, ready, message", [("m:8b", True, "ready"), ("m", True, "ready"), ("n", False, "there is no model n"), ("away", False, "the model service does not answer: refused")]))
def model_check(spark, d):
    def away() -> list[str]:
        raise OSError("refused")

    rows = [(m, *translate.is_available(m, away if m == "away" else lambda: ["m:latest"])) for m in ("m:8b", "m", "n", "away")]
    return spark.createDataFrame(rows, "model string, ready boolean, message string")

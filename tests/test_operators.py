"""Filters, search, coverage, incremental work, web, translation, offences, sources and sinks."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamplight.operators import coverage, filters, incremental, offences, search, translate, web
from lamplight.sources import readers, registry, sinks
from lamplight.streaming import ingest


def test_where_tree():
    assert filters.build_where() is None
    assert filters.build_where("s") == {"state": "s"}
    assert filters.build_where("s", "c", "2024-01-01", "2024-12-31")["$and"][2] == {"document_date_epoch": {"$gte": 1704067200}}
    assert filters.build_where(date_from="junk", date_to="2024-13-01") is None


def test_compiled_filters_drop_nulls(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), ("b", 9)], "state string, document_date_epoch long")
    assert df.filter(filters.compile_where({"$and": [{"state": "a"}, {"document_date_epoch": {"$gte": 1}}]})).count() == 1
    assert df.filter(filters.compile_where({"$or": [{"state": "b"}, {"document_date_epoch": {"$lt": 6}}]})).count() == 2
    assert df.filter(filters.compile_where(None)).count() == 3
    plan = df.filter(filters.compile_where({"state": "a"}))._jdf.queryExecution().toString()
    assert "state" in plan


def test_keyword_is_literal_and_spans_fields(spark):
    df = spark.createDataFrame([(1, "foo", "bar", "50%.pdf", "body"), (2, None, "x", None, "a_b")], "i int, t string, l string, f string, b string")
    ids = lambda q, body=None: sorted(r.i for r in df.filter(filters.keyword(q, ["t", "l", "f"], body)).collect())
    assert ids("O B") == [1] and ids("50%") == [1] and ids("%") == [1] and ids("") == [] and ids("a_b") == [] and ids("A_B", "b") == [2] and ids("_") == []


def test_browse_is_stable_and_pages(spark):
    rows = [(i, "s", "c", d, 0, i) for i, d in enumerate(["2024-01-01", None, "2024-02-01", "", "2024-01-01"])]
    df = spark.createDataFrame(rows, "id int, state string, category string, document_date string, state_ord int, doc_ord int")
    assert [r.id for r in search.browse(df).collect()] == [2, 0, 4, 1, 3]
    assert [r.id for r in search.browse(df, page=2, size=2).collect()] == [4, 1]
    assert [r.id for r in search.browse(df, date_from="2024-01-15").collect()] == [2]
    with pytest.raises(ValueError):
        search.browse(df, size=201)
    assert search.page_count(df, 2).first().total_pages == 3


def test_vector_search_dedups_by_file(spark):
    df = spark.createDataFrame([("c1", "f1", [1.0, 0.0], "a"), ("c2", "f1", [1.0, 0.1], "a"), ("c3", "f2", [0.0, 1.0], "b"), ("c4", "f3", [0.0, 0.0], "b")], "chunk_id string, filename string, embedding array<float>, state string")
    near = search.vector_search(df, [1.0, 0.0])
    assert [r.chunk_id for r in near.collect()] == ["c1", "c2", "c3", "c4"]
    best = search.best_per_file(near).collect()
    assert [r.chunk_id for r in best] == ["c1", "c3", "c4"] and best[0].similarity == pytest.approx(1.0)
    assert search.semantic_search(df, [1.0, 0.0], where={"state": "b"}).first().chunk_id == "c3"
    assert "TakeOrderedAndProject" in near._jdf.queryExecution().executedPlan().toString()


def test_coverage(spark):
    reg = spark.createDataFrame([("a",), ("b",), ("c",)], "state_key string")
    crawled = spark.createDataFrame([("a",)] * 3 + [("b",)], "state_key string")
    done = spark.createDataFrame([("a", True), ("a", None), ("b", False)], "state_key string, u boolean")
    disk = spark.createDataFrame([("a",)] * 2, "state_key string")
    got = {r.state_key: r for r in coverage.coverage(reg, crawled, done, disk, ocr_used=F.col("u")).collect()}
    assert (got["a"].processed, got["a"].ocr_used, got["a"].missing, got["a"].pct_shown) == (2, 1, 1, 67) and got["c"].pct == 0
    assert coverage.totals(coverage.coverage(reg, crawled, done, disk)).first().crawled == 4


def test_incremental(spark):
    df = spark.createDataFrame([("u1", 1), ("u2", 2), ("u1", 3), ("u3", 4)], "url string, ord int")
    seen = spark.createDataFrame([("u3",), ("u3",)], "url string")
    assert sorted(tuple(r) for r in incremental.unseen(df, seen, "url", "ord").collect()) == [("u1", 1), ("u2", 2)]
    n = incremental.numbered(df, ["ord"], base=10).orderBy("ord").collect()
    assert [r.number for r in n] == [11, 12, 13, 14]
    assert incremental.next_number(spark.createDataFrame([("doc_9",), ("x",), (None,)], "n string"), "n").first().next == 10
    names = incremental.disambiguated(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "s string, i int"), "s", "i", spark.createDataFrame([("b.pdf",)], "filename string"))
    assert sorted(r.filename for r in names.collect()) == ["a.pdf", "a_2.pdf", "b_3.pdf"]
    assert spark.range(1).select(incremental.missing_langpacks(F.lit("kan+eng"), F.array(F.lit("eng")))).first()[0] == ["kan"]
    assert spark.range(1).select(incremental.missing_langpacks(F.lit("kan+eng"), None)).first()[0] == []


def test_backfill(spark):
    docs = spark.createDataFrame([("s", "a.pdf", 1, "dated 01/02/2024", None), ("s", "b.pdf", 2, "nothing", None), ("s", "a.pdf", 3, "dated 03/02/2024", "2020-01-01")], "state_key string, filename string, doc_ord int, text string, document_date string")
    meta = spark.createDataFrame([("s", "a.pdf", None), ("s", "b.pdf", "2019-01-01")], "state_key string, filename string, document_date string")
    new, synced, counts = incremental.backfill_dates(docs, meta)
    assert sorted((r.doc_ord, r.document_date) for r in new.collect()) == [(1, "2024-02-01"), (2, None), (3, "2024-02-03")]
    assert sorted((r.filename, r.document_date) for r in synced.collect()) == [("a.pdf", "2024-02-03"), ("b.pdf", "2019-01-01")]
    assert tuple(counts.first()) == (3, 2)


def test_resolve_stored(spark):
    paths = spark.createDataFrame([("pdfs\\a.pdf",), ("/abs/x.pdf",), ("none.pdf",), ("z.pdf",)], "path string")
    listing = spark.createDataFrame([("cg/pdfs/a.pdf",), ("bihar/pdfs/a.pdf",), ("z.pdf",), ("cg/z.pdf",)], "path string")
    got = {r.path: r.resolved for r in incremental.resolve_stored(paths, listing, ["cg", "bihar"]).collect()}
    assert got == {"pdfs\\a.pdf": "bihar/pdfs/a.pdf", "/abs/x.pdf": "/abs/x.pdf", "none.pdf": None, "z.pdf": "z.pdf"}


LISTING = """<title>ಆದೇಶಗಳು</title><table><tr><td><strong>ಕ್ರ</strong></td><td><strong>ವಿಷಯ</strong></td><td><strong>ಆದೇಶ ಸಂಖ್ಯೆ / ದಿನಾಂಕ</strong></td><td><strong>ಗಾತ್ರ</strong></td></tr>
<tr><td>1<td>ಯೋಜನೆ  ಒಂದು<td>ಮಮಇ 293 ಮಮಅ 2005, 05.05.2007<td><p><a href="uploads/m1.pdf">Download</a></p></tr>
<tr><td>2</td><td></td><td>ಮಮಇ 81 ಮಮಅ 2025, ದಿನಾಂಕ:04.04.2025</td><td><a href="/uploads/m2.pdf">Download</a></td></tr></table><a href="mailto:x">m</a><a href="page.html?x=1.pdf">p</a>
<table><tr><th>ವಿಷಯ ದಿನಾಂಕ</th></tr><tr><td>x</td><td><a href=y.pdf>d</a></td></tr></table>"""


def test_listing_tables(spark):
    pages = spark.createDataFrame([("https://h.in/a/", LISTING), ("https://h.in/b", None)], "url string, html string")
    links = web.page_links(pages)
    got = web.pdf_links(links).select("url", "page_title", "link_text", *[c.alias(n) for n, c in web.listing_columns(F.col("fields")).items()]).orderBy("url").collect()
    assert [r.url for r in got] == ["https://h.in/a/uploads/m1.pdf", "https://h.in/a/y.pdf", "https://h.in/uploads/m2.pdf"]
    assert (got[0].subject, got[0].order_no, got[0].table_date, got[0].page_title) == ("ಯೋಜನೆ ಒಂದು", "ಮಮಇ 293 ಮಮಅ 2005", "2007-05-05", "ಆದೇಶಗಳು")
    assert (got[2].subject, got[2].order_no, got[2].table_date) == (None, "ಮಮಇ 81 ಮಮಅ 2025", "2025-04-04")
    assert (got[1].subject, got[1].order_no) == (None, None)
    assert [r.url for r in web.site_pages(links, "h.in").collect()] == ["https://h.in/a/page.html?x=1.pdf"]


def test_crawl_goes_level_by_level(spark):
    site = {"https://h.in/": '<a href="/a">a</a><a href="x.pdf">x</a>', "https://h.in/a": '<a href="/b">b</a><a href="/">home</a><a href="x.pdf">x</a>', "https://h.in/b": '<a href="/c">c</a>'}

    def fetch(todo):
        get = F.udf(lambda u: site.get(u), "string")
        return todo.select("url", get("url").alias("html"))

    pages, pdfs = web.crawl(["https://h.in/"], fetch, max_depth=1, spark=spark)
    assert sorted(r.url for r in pages.collect()) == ["https://h.in/", "https://h.in/a"] and [r.url for r in pdfs.collect()] == ["https://h.in/x.pdf"]
    pages, _ = web.crawl(["https://h.in/"], fetch, max_depth=5, max_pages=1, spark=spark)
    assert pages.count() == 1


def test_translation_with_cache(spark):
    def model(s: pd.Series) -> pd.Series:
        return s.map(lambda t: "I can't provide that." if "bad" in t else "The committee met and the members spoke on it.")

    rows = spark.createDataFrame([("समिति की बैठक हुई और सदस्यों ने बात की थी",), ("bad words only here",), (" ",), (None,)], "text string")
    results, fresh = translate.translate(rows, "m", model)
    got = {r.source: r for r in results.collect()}
    assert got["समिति की बैठक हुई और सदस्यों ने बात की थी"].status == "ok" and got["bad words only here"].status == "failed" and got[""].reasons == ["empty source"]
    again, none = translate.translate(rows, "m", model, cache=fresh)
    assert none.count() == 0 and sum(r.cached for r in again.collect()) == 2
    audited = translate.audit(spark.createDataFrame([("शब्द", "word", "", "x")], "a string, b string, c string, d string"), [("a", "b"), ("c", "d")])
    assert audited.count() == 1


def test_offences(spark):
    df = spark.createDataFrame([("1", "BNS", "302", "", "Murder", "t\nx", 1), ("2", "BNS", "303", "a", "Theft", "t", 2), ("3", "BNS", "303", "b", "Theft", "t", 3)], "id string, statute string, section string, subclause string, label string, text string, ord int")
    assert [r.id for r in offences.section_search(df, "BNS", "Section 30").collect()] == ["1", "2", "3"] and offences.section_search(df, "BNS", "").count() == 3
    s = offences.sections(df, "ord").collect()
    assert [(r.section, r.id, r.direct) for r in s] == [("302", "1", True), ("303", "2", False)] and s[0].snippet == "t x…"
    cases = spark.createDataFrame([("c1", "heinous"), ("c1", None), ("c2", "not_heinous"), ("c3", "x"), ("c3", "not_heinous")], "case_id string, status string")
    assert {r.case_id: r.verdict for r in offences.verdicts(cases).collect()} == {"c1": "HEINOUS", "c2": "NOT HEINOUS", "c3": "REVIEW FACTS"}
    case = offences.add_to_case(df.limit(0), df, ["1", "2"])
    assert offences.add_to_case(case, df, ["1"]).count() == 2 and offences.remove_from_case(case, ["1"]).count() == 1
    assert [r[0] for r in spark.createDataFrame([("depends",), (None,)], "s string").select(offences.status_label(F.col("s"))).collect()] == ["Depends on other charges/facts", "Unknown / needs data"]


def test_readers_and_registry(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"filename": "a.pdf", "file_path": "x\\\\a.pdf"}, {"filename": "b.pdf"}]')
    (tmp_path / "bad.json").write_text('[{"filename": ')
    docs = readers.load_documents(spark, [(0, "cg", "C", str(tmp_path / "good.json")), (1, "up", "U", str(tmp_path / "missing.json")), (2, "k", "K", str(tmp_path / "bad.json"))], readers.METADATA)
    assert [(r.filename, r.state, r.file_path) for r in docs.orderBy("state_ord", "doc_ord").collect()] == [("a.pdf", "C", "x/a.pdf"), ("b.pdf", "C", None)]
    assert registry.resolve(spark).count() == 6 and registry.resolve(spark, ["CG"]).first().name == "Chhattisgarh"
    with pytest.raises(KeyError):
        registry.resolve(spark, ["nowhere"])


def test_text_extraction_with_fakes(spark):
    files = spark.createDataFrame([("ok", b"5"), ("scan", b"2"), ("broken", b"x")], "path string, content binary")

    def read(data, a, z):
        return [f"page {i} {data.decode()}" for i in range(a, z)]

    got = {r.path: r for r in readers.extract_texts(files, read, lambda d: int(d), lambda d, a, z: ["scanned"] * (z - a), lambda s: s.endswith("2")).collect()}
    assert got["ok"].text.count("page") == 5 and got["scan"].text == "scanned\n\nscanned" and got["scan"].was_ocr_used and got["broken"].text == "" and got["broken"].error
    assert readers.page_batches(50) == [(0, 24), (24, 48), (48, 50)] and readers.split_form_feeds("a\fb\f") == ["a", "b"]


def test_fetch_and_politeness(spark):
    def get(url):
        if "bad" in url:
            raise OSError("down")
        return (404 if "no" in url else 200), "text/html", b"x"

    got = {r.url: r for r in readers.fetch_pages(spark.createDataFrame([("https://a/ok",), ("https://a/no",), ("https://b/bad",)], "url string"), get).collect()}
    assert got["https://a/ok"].body == b"x" and got["https://a/no"].error == "status 404" and "down" in got["https://b/bad"].error
    slept, now = [], [0.0]
    p = readers.Politeness("ua", 2.0, clock=lambda: now[0], sleep=slept.append)
    p.wait("a"), p.wait("a"), p.wait("b")
    assert slept == [2.0] and p.allowed("a", "u")


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.write_version(spark.range(3), path)
    sinks.write_version(spark.range(5), path)
    assert sinks.read_version(spark, path).count() == 5
    table = f"file://{tmp_path}/p"
    sinks.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int"), table, "k")
    sinks.replace_partitions(spark.createDataFrame([("a", 9)], "k string, v int"), table, "k", emptied=spark.createDataFrame([("a",), ("b",)], "k string"))
    assert sorted((r.k, r.v) for r in spark.read.parquet(table).collect()) == [("a", 9), ("c", 3)]
    assert not sinks.replace_if_any(spark.range(0), path) and sinks.replace_if_any(spark.range(1), path)
    d = spark.createDataFrame([("x" * 36,), ("y" * 36,), ("short",)], "name string")
    assert [r.name for r in sinks.orphans(d, spark.createDataFrame([("x" * 36,)], "id string"), spark.createDataFrame([], "id string")).collect()] == ["y" * 36]


def test_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "src", f"file://{tmp_path}/out"
    src.mkdir()
    (src / "1.json").write_text('{"pdf_url": "a"}\n{"pdf_url": "b"}\n{"pdf_url": "a"}\n')
    run = lambda: ingest.run_batches(ingest.unseen_stream(ingest.record_stream(spark, str(src), "pdf_url string")), f"{tmp_path}/cp", lambda df, _: sinks.append(df, out)).awaitTermination()
    run()
    (src / "2.json").write_text('{"pdf_url": "b"}\n{"pdf_url": "c"}\n')
    run()
    assert sorted(r.pdf_url for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_crawl_is_deep_and_takes_documents_from_handlers(spark):
    site = {f"https://h.in/{i}": f'<a href="/{i + 1}">next</a><a href="/side{i}">side</a>' for i in range(7)} | {"https://h.in/": '<a href="/0">zero</a><a href="/get?Id=7">the form</a>', "https://h.in/side3": '<a href="/doc.pdf">d</a>'}

    def fetch(todo):
        get = F.udf(lambda u: site.get(u), "string")
        return todo.select("url", get("url").alias("html"), F.contains("url", F.lit("get?Id")).alias("is_pdf"))

    pages, pdfs = web.crawl(["https://h.in/", "https://h.in/0"], fetch, max_depth=6, spark=spark)
    assert {r.url: r.depth for r in pages.collect()} == {"https://h.in/": 0, "https://h.in/0": 0, **{f"https://h.in/{i}": i for i in range(1, 7)}, "https://h.in/side3": 4}
    assert sorted((r.url, r.link_text, r.by_handler, r.page_url) for r in pdfs.collect()) == [("https://h.in/doc.pdf", "d", False, "https://h.in/side3"), ("https://h.in/get?Id=7", "the form", True, "https://h.in/")]
    named = pdfs.withColumn("filename", F.concat(F.lit("f"), F.col("depth").cast("string"), F.lit(".pdf")))
    dates = spark.createDataFrame([("https://h.in/doc.pdf", "2024-01-02")], "url string, document_date string")
    r = {x.pdf_url: x for x in web.crawl_records(named, "k", "K", "k_pdfs/", "2025-01-01", dates).collect()}["https://h.in/doc.pdf"]
    assert (r.file_path, r.document_date, r.state_key, r.crawled_at, r.source_page, r.subject) == ("k_pdfs/f4.pdf", "2024-01-02", "k", "2025-01-01", "https://h.in/side3", None)


def test_pages_and_documents_are_told_apart(spark):
    rows = [("a", 200, "text/html; charset=utf-8", b"<p>x</p>", None), ("b", 200, "application/octet-stream", b"%PDF-1.4", None), ("c", 200, "application/octet-stream", b"MZ", None), ("d", 404, "text/html", None, "status 404"), ("e", 200, "image/png", b"x", None)]
    got = readers.page_answers(spark.createDataFrame(rows, "url string, status int, content_type string, body binary, error string"))
    assert sorted((r.url, r.html, r.is_pdf) for r in got.collect()) == [("a", "<p>x</p>", False), ("b", None, True), ("c", None, False), ("d", None, False), ("e", None, False)]


def test_downloads_leave_whole_files_or_nothing(spark, tmp_path):
    root = str(tmp_path / "pdfs")

    def stream(url):
        yield b"%PDF"
        if "bad" in url:
            raise OSError("cut off")
        yield b" rest"

    meta = spark.createDataFrame([("a.pdf", "https://h/a"), ("b.pdf", "https://h/bad"), ("c.pdf", None), ("../d.pdf", "https://h/d"), ("there.pdf", "https://h/t")], "filename string, pdf_url string")
    have = spark.createDataFrame([("there.pdf",)], "filename string")
    done = readers.fetch_missing(meta, have, stream, readers.FileStore(root)).cache()
    assert sorted((r.filename, r.length) for r in done.collect() if r.error is None) == [("a.pdf", 9)]
    assert readers.fetch_counts(done).first() == (1, 3)
    assert [f.name for f in (tmp_path / "pdfs").iterdir()] == ["a.pdf"] and not (tmp_path / "d.pdf").exists()
    assert readers.contained(root, "../d.pdf") is None and readers.contained(root, "/etc/passwd") is None and readers.contained(root, "x/../y.pdf").endswith("/pdfs/y.pdf")


def test_robots_and_waiting_in_fetching(spark):
    class Rules:
        def can_fetch(self, agent, url):
            return "private" not in url

        def crawl_delay(self, agent):
            return None

    urls = spark.createDataFrame([("https://a/private/1",), ("https://a/2",)], "url string")
    police = lambda: readers.Politeness("ua", 0.0, rules=lambda origin: Rules())
    got = {r.url: r for r in readers.fetch_pages(urls, lambda u: (200, "text/html", b"x"), police=police).collect()}
    assert got["https://a/private/1"].error == "robots" and got["https://a/2"].body == b"x"


def test_pdf_tools_and_dates(spark, monkeypatch):
    import subprocess

    def tool(args, **more):
        assert more["timeout"] == 120 and more["check"]
        return subprocess.CompletedProcess(args, 0, b"Title: x\nPages:  7\n" if args[0] == "pdfinfo" else b"one\x0ctwo\x0c")

    assert readers.pdf_page_count(b"%PDF", tool) == 7 and readers.pdf_text_pages(b"%PDF", 0, 2, tool) == ["one", "two"]
    monkeypatch.setenv("TEXT_LAYER_PDFTOTEXT_MB", "2")
    assert readers.large_bytes() == 2 << 20
    monkeypatch.setenv("TEXT_LAYER_PDFTOTEXT_MB", "many")
    assert readers.large_bytes() == 10 << 20

    def read(data, a, z):
        if data == b"x":
            raise ValueError("no PDF")
        return ["", "dated 5 May 2021", "", "dated 6 June 2022"][a:z]

    files = spark.createDataFrame([("a", b"%PDF"), ("b", b"x")], "path string, content binary")
    assert sorted(map(tuple, readers.pdf_dates(files, read).collect())) == [("a", "2021-05-05"), ("b", None)]


def test_trust_store_agent_and_sqlite(spark, tmp_path):
    import sqlite3

    certs, cache = tmp_path / "certs", str(tmp_path / "cache")
    certs.mkdir()
    (certs / "x.pem").write_bytes(b"own")
    assert readers.trust_store(None, str(certs), cache, lambda: b"roots") is True and readers.trust_store("none.pem", str(certs), cache, lambda: b"roots") is True
    bundle = readers.trust_store("x.pem", str(certs), cache, lambda: b"roots\n\n")
    assert open(bundle, "rb").read() == b"roots\nown" and readers.trust_store("x.pem", str(certs), cache, lambda: b"not read again") == bundle
    assert open(bundle, "rb").read() == b"roots\nown"
    assert readers.user_agent("a@b.c").endswith("(contact: a@b.c)") and "set CRAWLER_CONTACT" in readers.user_agent("")
    con = sqlite3.connect(tmp_path / "c.sqlite3")
    con.execute("create table segments (id text, n int)")
    con.executemany("insert into segments values (?, ?)", [("a", 1), ("b", None)])
    con.commit()
    con.close()
    got = readers.read_sqlite(spark, f"file://{tmp_path}/c.sqlite3", "select id, n from segments", "id string, n double").collect()
    assert sorted((r.id, r.n) for r in got)[0] == ("a", 1.0) and len(got) == 2


def test_resume_stops_without_progress():
    from lamplight.streaming.ingest import resume

    def job(gains):
        state = {"n": 0, "i": 0}

        def run():
            state["n"] += gains[state["i"]][0]
            state["i"] += 1
            if gains[state["i"] - 1][1]:
                raise RuntimeError("killed")

        return run, lambda: state["n"]

    assert resume(*job([(3, True), (2, False)])) == ("ok", 2, 5)
    assert resume(*job([(0, True), (0, True)])) == ("stuck", 2, 0)
    assert resume(*job([(0, True), (4, True), (0, True)])) == ("stuck", 3, 4)
    assert resume(*job([(1, True)] * 5)) == ("gave-up", 5, 5)


def test_versions_survive_a_crash_and_null_partitions_are_dropped(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    sinks.write_version(spark.range(3), path)
    monkeypatch.setattr(sinks, "_put_over", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        sinks.write_version(spark.range(5), path)
    assert sinks.read_version(spark, path).count() == 3
    monkeypatch.undo()
    sinks.write_version(spark.range(7), path)
    assert sinks.read_version(spark, path).count() == 7
    table, schema = f"file://{tmp_path}/p", "k string, v int"
    sinks.replace_partitions(spark.createDataFrame([(None, 1), ("a/b=c", 2), ("x", 3)], schema), table, "k")
    sinks.replace_partitions(spark.createDataFrame([("x", 4)], schema), table, "k", emptied=spark.createDataFrame([(None,), ("a/b=c",), ("x",)], "k string"))
    assert [tuple(r) for r in spark.read.parquet(table).select("v").collect()] == [(4,)]
    (tmp_path / "o" / "gone").mkdir(parents=True)
    assert sinks.delete_orphans(spark, f"file://{tmp_path}/o", spark.createDataFrame([("gone",), ("never",)], "name string")) == 1 and not (tmp_path / "o" / "gone").exists()


def test_translation_without_a_model(spark):
    assert translate.is_available("m:8b", lambda: ["m:latest"]) == (True, "ready") and not translate.is_available("m", lambda: ["n"])[0]
    away = translate.is_available("m", lambda: 1 / 0)
    rows = spark.createDataFrame([("some words here",), ("",)], "text string")
    results, fresh = translate.translate(rows, "m", lambda s: s, available=away)
    assert {(r.source, r.status) for r in results.collect()} == {("some words here", "unavailable"), ("", "failed")} and fresh.count() == 0


def test_windows_of_any_overlap(spark):
    from lamplight.functions.chunking import windows

    text = "ab 𝒳" * 50 + "  tail "
    for size, overlap in ((800, 100), (10, 3), (10, 0), (10, 9), (7, 5), (3, 7)):
        step = max(1, size - overlap)
        n = len(text)
        want = [(text[a : a + size].strip(), a, min(a + size, n)) for a in range(0, max(0, -(-max(0, n - size) // step)) * step + 1, step) if text[a : a + size].strip()]
        got = spark.createDataFrame([(text,)], "t string").select(windows("t", size, overlap).alias("w")).first().w
        assert [tuple(x) for x in got] == want


def test_intermediate_tables_can_be_cleared(spark):
    from lamplight.sources import shared

    shared.clear(spark)
    kept = shared.stored(spark.range(3), "numbers")
    assert kept.count() == 3 and shared.clear(spark) == 1 and shared.clear(spark) == 0


def test_only_a_local_master_may_lack_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from lamplight.sources import shared

    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://h:7077"))
    with pytest.raises(RuntimeError):
        shared.shared_dir(cluster)

"""Reading crawl records, processed documents, listings and file contents."""

from __future__ import annotations

import os
import subprocess
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from urllib.parse import urlsplit

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.functions.dates import date_epoch, extract_date
from lamplight.functions.naming import is_pdf_response, posix_path
from lamplight.functions.quality import needs_ocr
from lamplight.functions.strings import or_default
from lamplight.sources.shared import in_pandas, small_batches

METADATA = "filename string, file_path string, pdf_url string, source_page string, state string, state_key string, category string, link_text string, document_date string, crawled_at string, subject string, order_no string, table_date string, source_org string, medium string, size_reported string"
PROCESSED = "id string, filename string, inferred_title string, file_path string, pdf_url string, source_page string, state string, state_key string, category string, link_text string, document_date string, char_count int, was_ocr_used boolean, text string, subject string, order_no string, source_org string, medium string"
OFFENCES = "id string, statute string, section string, subclause string, label string, text string, minPunishment string, heinousStatus string"
_BAD = "_corrupt"
BODY_BYTES = 8 << 20


def read_json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The objects of JSON arrays; a file that is missing or corrupt has none. Absent fields are null."""
    try:
        rows = spark.read.schema(f"{schema}, {_BAD} string").option("multiLine", True).option("columnNameOfCorruptRecord", _BAD).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return rows.filter(F.col(_BAD).isNull()).drop(_BAD)


def with_state(rows: DataFrame, key: str, name: str, state_ord: int) -> DataFrame:
    """Records of one portal: older ones lack its name and key and have backslashes in their paths."""
    fixed = rows.withColumns({"state": F.coalesce("state", F.lit(name)), "state_key": F.coalesce("state_key", F.lit(key)), "state_ord": F.lit(state_ord)})
    return fixed.withColumn("file_path", posix_path("file_path")) if "file_path" in rows.columns else fixed


def union_states(parts: list[DataFrame]) -> DataFrame:
    """All portals in one table; columns that some lack are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def load_documents(spark: SparkSession, states: list[tuple[int, str, str, str]], schema: str = PROCESSED) -> DataFrame:
    """states: (state_ord, key, name, path). doc_ord is the place within the file, which JSON arrays keep."""
    parts = [with_state(read_json_array(spark, path, schema), key, name, n).withColumn("doc_ord", F.monotonically_increasing_id()) for n, key, name, path in states]
    return union_states(parts)


def pdf_listing(spark: SparkSession, path: str, any_case: bool = False) -> DataFrame:
    """path, filename, length of PDF files under a folder; contents are not read. Files without a byte are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (files if any_case else files.option("pathGlobFilter", "*.pdf")).load(path).select("path", "length")
    named = rows.withColumn("filename", F.element_at(F.split("path", "/"), -1))
    return named.filter(F.lower("filename").endswith(".pdf")) if any_case else named


def origin_of(url: str) -> str:
    """scheme://host of a URL."""
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}"


def _by_host(urls: DataFrame, hosts: int | None) -> DataFrame:
    """URLs of a host in one task and in order, so that this task holds the host's rate."""
    placed = urls.withColumn("__host", F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1))
    return (placed.repartition(hosts, "__host") if hosts else placed.repartition("__host")).sortWithinPartitions("__host", "url")


def fetch_pages(urls: DataFrame, get: Callable[[str], tuple[int, str, bytes]], hosts: int | None = None, police: Callable[[], Politeness] | None = None) -> DataFrame:
    """url, status, content_type, body, error of each URL.

    get is the only part that meets the network: (status, content type, body), or an exception, which becomes an error.
    police makes a task's Politeness: what it does not allow is not asked for, and it waits before each request.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = police() if police else None
        for b in batches:
            rows: list[tuple] = []
            for url in b["url"]:
                try:
                    if rules and not rules.allowed(origin_of(url), url):
                        rows.append((url, None, None, None, "robots"))
                        continue
                    if rules:
                        rules.wait(origin_of(url))
                    status, kind, body = get(url)
                    rows.append((url, status, kind, body, None) if status < 400 else (url, status, kind, None, f"status {status}"))
                except Exception as e:  # a server may fail in any way; the row says how
                    rows.append((url, None, None, None, f"{type(e).__name__}: {e}"))
                if sum(len(r[3] or b"") for r in rows) > BODY_BYTES:
                    yield pd.DataFrame(rows, columns=["url", "status", "content_type", "body", "error"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["url", "status", "content_type", "body", "error"])

    return in_pandas(_by_host(urls.select("url"), hosts).select("url"), run, "url string, status int, content_type string, body binary, error string")


def page_answers(fetched: DataFrame) -> DataFrame:
    """url, html, is_pdf of fetched pages, as `crawl` takes them: only HTML is a page; a document may come from any address."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    html = F.when(F.contains(kind, F.lit("text/html")), F.decode("body", "UTF-8"))
    return fetched.select("url", html.alias("html"), (html.isNull() & F.col("body").isNotNull() & is_pdf_response("content_type", F.col("body"))).alias("is_pdf"))


class FileStore:
    """Writes files under a folder that all executors share: bytes go to a temporary name, which is renamed at the end."""

    def __init__(self, root: str):
        self.root = root

    def write(self, name: str, pieces: Iterator[bytes]) -> int:
        target = contained(self.root, name)
        if target is None:
            raise ValueError(f"{name} is not under {self.root}")
        os.makedirs(os.path.dirname(target), exist_ok=True)
        temp, n = f"{target}.{uuid.uuid4().hex}.part", 0
        try:
            with open(temp, "wb") as f:
                for piece in pieces:
                    f.write(piece)
                    n += len(piece)
            os.replace(temp, target)
        finally:
            if os.path.exists(temp):
                os.unlink(temp)
        return n


def contained(root: str, name: str) -> str | None:
    """The path of a file under root, None for a name that leads out of it."""
    base = os.path.realpath(root)
    target = os.path.realpath(os.path.join(base, name))
    return target if target != base and os.path.commonpath([base, target]) == base else None


def download(files: DataFrame, stream: Callable[[str], Iterator[bytes]], store: FileStore, hosts: int | None = None, police: Callable[[], Politeness] | None = None) -> DataFrame:
    """url, filename, length, error of files (url, filename), which are stored piece by piece; a failed one leaves nothing.

    stream is the only part that meets the network. The result is a table: write it once, as each reading downloads again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = police() if police else None
        for b in batches:
            rows: list[tuple] = []
            for url, name in zip(b["url"], b["filename"], strict=True):
                try:
                    if not url:
                        raise ValueError("no address")
                    if rules:
                        rules.wait(origin_of(url))
                    rows.append((url, name, store.write(name, stream(url)), None))
                except Exception as e:
                    rows.append((url, name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "filename", "length", "error"])

    return in_pandas(_by_host(files.select("url", "filename"), hosts).select("url", "filename"), run, "url string, filename string, length long, error string")


def fetch_missing(metadata: DataFrame, listing: DataFrame, stream: Callable[[str], Iterator[bytes]], store: FileStore, police: Callable[[], Politeness] | None = None) -> DataFrame:
    """Downloads what metadata (filename, pdf_url) lists and listing (filename) lacks; the result of `download`."""
    missing = metadata.join(listing.select("filename").distinct(), "filename", "left_anti")
    return download(missing.select(F.col("pdf_url").alias("url"), "filename"), stream, store, police=police)


def fetch_counts(done: DataFrame) -> DataFrame:
    """fetched, failed."""
    return done.agg(F.count_if(F.col("error").isNull()).alias("fetched"), F.count_if(F.col("error").isNotNull()).alias("failed"))


AGENT = "LamplightCrawler/1.0"


def user_agent(contact: str | None = None, project: str | None = None) -> str:
    """Names the crawler and whom to write to, from CRAWLER_CONTACT unless given; never a browser's name."""
    contact = (contact if contact is not None else os.environ.get("CRAWLER_CONTACT", "")).strip()
    notes = [*([f"+{project}"] if project else []), f"contact: {contact or 'set CRAWLER_CONTACT'}"]
    return f"{AGENT} ({'; '.join(notes)})"


def trust_store(extra_ca: str | None, certs: str, cache: str, roots: Callable[[], bytes]) -> bool | str:
    """What verifies a portal's TLS chain: True for the standard roots, or a file of these and the portal's own intermediate.

    The file is made again when the certificate is newer. A certificate that is not there adds nothing; verification is
    never off.
    """
    extra = os.path.join(certs, extra_ca) if extra_ca else ""
    if not extra or not os.path.exists(extra):
        return True
    bundle = os.path.join(cache, os.path.basename(extra))
    if not os.path.exists(bundle) or os.path.getmtime(bundle) < os.path.getmtime(extra):
        os.makedirs(cache, exist_ok=True)
        with open(extra, "rb") as f:
            own = f.read()
        temp = f"{bundle}.{uuid.uuid4().hex}"
        with open(temp, "wb") as f:
            f.write(roots().rstrip() + b"\n" + own)
        os.replace(temp, bundle)
    return bundle


def read_sqlite(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """The rows of a query over SQLite files of a shared store, such as a vector store's catalogue; a file in one task."""
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for b in batches:
            for content in b["content"]:
                con = sqlite3.connect(":memory:")
                con.deserialize(content)
                yield pd.DataFrame(con.execute(sql).fetchall(), columns=names)
                con.close()

    return in_pandas(spark.read.format("binaryFile").load(path).select("content"), run, schema)


class Politeness:
    """When a host may be asked again, and whether at all; a host's robots rules are read once in a task."""

    def __init__(self, agent: str, delay: float = 1.0, rules: Callable[[str], object | None] | None = None, clock: Callable[[], float] | None = None, sleep: Callable[[float], None] | None = None, ignore: bool = False):
        import time

        self.agent, self.delay, self.rules, self.ignore = agent, delay, rules, ignore
        self.clock, self.sleep = clock or time.monotonic, sleep or time.sleep
        self.known: dict[str, object | None] = {}
        self.last: dict[str, float] = {}

    def _of(self, origin: str):
        if origin not in self.known:
            try:
                self.known[origin] = self.rules(origin) if self.rules else None
            except Exception:  # rules that cannot be read forbid nothing
                self.known[origin] = None
        return self.known[origin]

    def allowed(self, origin: str, url: str) -> bool:
        if self.ignore or (rules := self._of(origin)) is None:
            return True
        try:
            return bool(rules.can_fetch(self.agent, url))
        except Exception:
            return True

    def wait(self, origin: str) -> None:
        rules = None if self.ignore else self._of(origin)
        declared = rules.crawl_delay(self.agent) if rules is not None else None
        pause = max(self.delay, float(declared or 0))
        if origin in self.last and (rest := self.last[origin] + pause - self.clock()) > 0:
            self.sleep(rest)
        self.last[origin] = self.clock()


TEXT_PAGES, SAMPLE_PAGES, RASTER_PAGES, LARGE_MB, TOOL_SECONDS = 24, 3, 5, 10.0, 120


def large_bytes() -> float:
    """From which size on a subprocess reads the text layer: TEXT_LAYER_PDFTOTEXT_MB, else LARGE_MB."""
    try:
        return float(os.environ.get("TEXT_LAYER_PDFTOTEXT_MB", LARGE_MB)) * (1 << 20)
    except ValueError:
        return LARGE_MB * (1 << 20)


def pdf_page_count(data: bytes, run: Callable[..., subprocess.CompletedProcess] = subprocess.run) -> int:
    """The pages of a PDF by pdfinfo, which reads the file from its standard input."""
    out = run(["pdfinfo", "-"], input=data, capture_output=True, timeout=TOOL_SECONDS, check=True).stdout.decode(errors="replace")
    for line in out.splitlines():
        if line.startswith("Pages:"):
            return int(line.partition(":")[2])
    raise ValueError("pdfinfo names no number of pages")


def pdf_text_pages(data: bytes, first: int, last: int, run: Callable[..., subprocess.CompletedProcess] = subprocess.run) -> list[str]:
    """The text layer of pages (first, last] by pdftotext; the text is in another process, so memory stays bounded."""
    out = run(["pdftotext", "-enc", "UTF-8", "-f", str(first + 1), "-l", str(last), "-", "-"], input=data, capture_output=True, timeout=TOOL_SECONDS, check=True)
    return split_form_feeds(out.stdout.decode(errors="replace"))


def page_batches(pages: int, size: int = TEXT_PAGES) -> list[tuple[int, int]]:
    """(first, last] of page ranges that are read apart, so that memory stays bounded."""
    return [(a, min(a + size, pages)) for a in range(0, pages, size)]


def split_form_feeds(text: str) -> list[str]:
    """The pages of a text layer that a subprocess wrote: an empty last one is none."""
    pages = text.split("\f")
    return pages[:-1] if pages and not pages[-1].strip() else pages


Reader = Callable[[bytes, int, int], list[str]]


def sample_texts(files: DataFrame, read: Reader, count: Callable[[bytes], int] | None = None, read_large: Reader | None = None, least_large: float | None = None) -> DataFrame:
    """path, content, pages, sample of PDF contents (path, content): the text layer of the first pages, null if none is read."""
    limit = large_bytes() if least_large is None else least_large

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b["path"], b["content"], strict=True):
                n, sample = None, None
                with suppress(Exception):
                    n = count(content) if count else SAMPLE_PAGES
                    for fn in _layers(read, read_large, len(content), limit):
                        with suppress(Exception):
                            sample = "\n\n".join(fn(content, 0, min(n, SAMPLE_PAGES)))
                            break
                rows.append((path, content, n, sample))
            out = pd.DataFrame(rows, columns=["path", "content", "pages", "sample"])
            yield out.astype({"pages": "Int64"})

    return in_pandas(files.select("path", "content"), run, "path string, content binary, pages long, sample string")


def _layers(read: Reader, read_large: Reader | None, size: int, limit: float) -> list[Reader]:
    return [read_large, read] if read_large and size > limit else [read]


def extract_texts(files: DataFrame, read: Reader, count: Callable[[bytes], int], ocr: Reader, gate: Callable[[Column], Column] = needs_ocr, read_large: Reader | None = None, least_large: float | None = None) -> DataFrame:
    """path, text, was_ocr_used, error of PDF contents (path, content).

    The readers are injected. Files over least_large bytes go to read_large, and to read if that fails. A sample of the first
    pages decides on OCR through gate, a Column; OCR that fails leaves the text layer, and with neither the text is empty.
    """
    limit = large_bytes() if least_large is None else least_large

    def pages(fn: Reader, data: bytes, n: int, size: int) -> str:
        return "\n\n".join(p for a, z in page_batches(n, size) for p in fn(data, a, z))

    def one(data: bytes, n: int | None, scan: bool) -> tuple[str, bool, str | None]:
        if n is None:
            return "", False, "the pages cannot be counted"
        layers, error = _layers(read, read_large, len(data), limit), None
        if scan:
            try:
                return pages(ocr, data, n, RASTER_PAGES), True, None
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        for fn in layers:
            try:
                return pages(fn, data, n, TEXT_PAGES), False, error
            except Exception as e:
                error = error or f"{type(e).__name__}: {e}"
        return "", False, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, *one(content, None if pd.isna(n) else int(n), scan)) for path, content, n, scan in zip(b["path"], b["content"], b["pages"], b["scan"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "text", "was_ocr_used", "error"])

    seen = sample_texts(files, read, count, read_large, least_large).withColumn("scan", F.coalesce(gate(F.col("sample")), F.lit(True)))
    return in_pandas(seen.select("path", "content", "pages", "scan"), run, "path string, text string, was_ocr_used boolean, error string")


def pdf_dates(files: DataFrame, read: Reader) -> DataFrame:
    """path, document_date of PDF contents (path, content): the date in the text layer of the first pages, null without one."""
    return sample_texts(files, read).select("path", extract_date("sample").alias("document_date"))


def encode_texts(rows: DataFrame, encode: Callable[[list[str]], list[list[float]]], text: str = "document", batch: int = 32) -> DataFrame:
    """rows with `embedding`, through an injected encoder, 32 texts at a time; the model loads once in a worker."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out: list[list[float]] = []
            for i in range(0, len(s), batch):
                out += encode(s.iloc[i : i + batch].tolist())
            yield pd.Series(out)

    small_batches(rows.sparkSession)
    return rows.withColumn("embedding", run(F.col(text)))


def index_rows(chunks: DataFrame, docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks with what the index keeps of their documents: empty strings for nulls, a null epoch without a date."""
    kept = ["filename", "link_text", "state", "category", "file_path", "pdf_url", "document_date", "subject", "order_no", "source_org"]
    facts = docs.select("state_key", F.col("id").alias("doc_id"), or_default("inferred_title", F.lit("")).alias("title_hi"), *[F.coalesce(c, F.lit("")).alias(c) for c in kept], F.coalesce("was_ocr_used", F.lit(False)).alias("was_ocr_used"), date_epoch("document_date").alias("document_date_epoch"))
    languages = F.broadcast(registry.select(F.col("key").alias("state_key"), F.col("language_code").alias("language")))  # six rows
    return chunks.join(facts, ["state_key", "doc_id"]).join(languages, "state_key", "left")

"""WARC archives through a chunked record table.

`record_rows` turns pages into rows of (record identifier, chunk number): a payload over CHUNK_BYTES becomes a
segmented record (a response and its continuations), cut off the payload one at a time, so that neither a writer nor a
reader holds a record beside the row it comes from. `write_archives` writes the rows as gzipped .warc content with Spark's own
committer, on any shared file system, ARCHIVE_RECORDS rows an archive at most, which bounds its bytes.
`read_archives` decompresses archives as streams, digests payloads piece by piece, passes the chunks of segmented
records on as (identifier, number, bytes) rows and carries an incremental digest through them in order. A payload that
does not match its record's digest is an error.

Payloads are equal if their SHA-256 is. Of equal ones of at least `revisit_bytes` bytes that with the largest page_id
is a response and the others revisit it, without a payload of their own; smaller ones are all responses.

Defined results: null html is an empty payload; of rows that repeat the largest page_id one is the response and the
others revisit it; a null page_id ranks below all others; a null url gives a record without a target; control
characters of a url are percent-encoded; an empty table gives empty archives and an empty result; only page_id, url and
html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import in_arrow, new_path, written

CHUNK_BYTES = 32_768
#: Records of an archive, so that one has at most this times CHUNK_BYTES and its heads.
ARCHIVE_RECORDS = 4096
#: Bytes of the record table that a task gives on at a time.
OUT_BYTES = 4 << 20
PIECE = 1 << 16
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_of_hex(hex40: Column) -> Column:
    """Upper-case base32 of 20 bytes given as 40 hexadecimal digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for g in range(8):
        v = F.conv(F.substring(hex40, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substr(letters, F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _pages(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))


def roles(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, sha256, n_bytes, digest, copies, of_page, of_url, own): a row for each distinct page.

    own: the first copy of this page is the response; of_page and of_url name the response of its payload.
    """
    facts = _pages(pages).select("page_id", "url", F.unhex(F.sha2("html", 256)).alias("sha256"), F.octet_length("html").cast("long").alias("n_bytes"), F.sha1("html").alias("sha1"))
    facts = written(facts.groupBy("page_id", "url", "sha256", "n_bytes", "sha1").agg(F.count(F.lit(1)).alias("copies")), "pages")
    best = facts.filter(F.col("n_bytes") >= revisit_bytes).groupBy(F.col("sha256").alias("of")).agg(F.max(F.struct("page_id", "url")).alias("best"))
    joined = facts.join(best, facts["sha256"] == best["of"], "left")
    own = F.col("best").isNull() | F.struct("page_id", "url").eqNullSafe(F.col("best"))
    return joined.select("page_id", "url", "sha256", "n_bytes", base32_of_hex(F.col("sha1")).alias("digest"), "copies", F.col("best.page_id").alias("of_page"), F.col("best.url").alias("of_url"), own.alias("own"), F.col("best").isNotNull().alias("paired"))


def _row_key() -> Column:
    """32 bytes that are equal for equal (page_id, url, sha256), nulls included."""
    parts = [F.coalesce(F.concat(F.lit("i"), F.col("page_id").cast("string")), F.lit("n")), F.hex("sha256"), F.coalesce(F.concat(F.lit("u"), F.col("url")), F.lit("n"))]
    return F.unhex(F.sha2(F.concat_ws(" ", *parts), 256))


def _head(kind: str, rid: str, **fields: object) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", DATE), *((k.replace("_", "-"), v) for k, v in fields.items() if v is not None)]
    return ("WARC/1.1" + END + "".join(f"{k}: {v}{END}" for k, v in lines) + END).encode()


def chunks(payload: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
    """(piece, last) of a UTF-8 payload, each of at most size bytes unless a character has more; no character is cut."""
    at, n = 0, len(payload)
    while True:
        z = min(n, at + size)
        while at < z < n and payload[z] & 0xC0 == 0x80:
            z -= 1
        if z == at < n:
            z = at + 1
            while z < n and payload[z] & 0xC0 == 0x80:
                z += 1
        yield payload[at:z], z == n
        at = z
        if z == n:
            return


def record_parts(row: dict, payload: bytes, chunk_bytes: int) -> Iterator[tuple[str, int, bytes]]:
    """(record_id, chunk_no, value) of the records of a page and its copies, each without the two line ends that close it."""
    url = row["url"]
    target = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    digest = row["digest"]
    name = lambda page, of_url, copy: f"urn:x-page:{'' if page is None else page}:{of_url}:{digest}:{copy}"
    for copy in range(1, row["copies"] + 1):
        rid = name(row["page_id"], row["url_key"], copy)
        known = {"WARC_Payload_Digest": f"sha1:{digest}", "WARC_X_Page_ID": row["page_id"], "WARC_X_Payload_Length": row["n_bytes"]}
        if row["paired"] and (not row["own"] or copy > 1):
            first = name(row["of_page"], row["of_url_key"], 1)
            yield rid, 0, _head("revisit", rid, WARC_Target_URI=target, **known, WARC_Profile=PROFILE, WARC_Refers_To=f"<{first}>", WARC_X_Refers_To_Page=row["of_page"], Content_Length=0)
            continue
        for no, (piece, last) in enumerate(chunks(payload, chunk_bytes)):
            block = HTTP + piece if no == 0 else piece
            many = {"WARC_Segment_Number": no + 1} if no or not last else {}
            if no:
                many |= {"WARC_Segment_Origin_ID": f"<{rid}>"}
                if last:
                    many |= {"WARC_Segment_Total_Length": row["n_bytes"] + len(HTTP)}
                head = _head("continuation", f"{rid}:{no + 1}", WARC_Target_URI=target, **many, Content_Length=len(block))
            else:
                head = _head("response", rid, WARC_Target_URI=target, **known, **many, Content_Type="application/http; msgtype=response", Content_Length=len(block))
            yield rid, no, head + block


def _table(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, bytes]] = []
        held = 0

        def out() -> pa.RecordBatch:
            ids, numbers, values = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(numbers, pa.int32()), pa.array(values, pa.binary())], names=["record_id", "chunk_no", "value"])

        for b in batches:
            names, html = b.schema.names[:-1], b.column(b.num_columns - 1).cast(pa.binary())
            for facts, payload in zip(zip(*[b.column(i).to_pylist() for i in range(len(names))], strict=True), html, strict=True):
                for part in record_parts(dict(zip(names, facts, strict=True)), payload.as_py() or b"", chunk_bytes):
                    rows.append(part)
                    held += len(part[2])
                    if held > OUT_BYTES:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    return run


def record_rows(pages: DataFrame, revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(record_id, chunk_no, value): WARC records, each without the two line ends that close it."""
    r = roles(pages, revisit_bytes)
    r = r.select(_row_key().alias("r_key"), *[F.col(c).alias(f"r_{c}") for c in r.columns])
    rows = _pages(pages).withColumn("sha256", F.unhex(F.sha2("html", 256)))
    # payloads are shuffled once, repeated rows but once from each task; the join reuses that shuffle
    rows = rows.withColumn("key", _row_key()).dropDuplicates(["key"])
    joined = rows.join(r.hint("merge"), rows["key"] == r["r_key"])
    facts = ["digest", "copies", "n_bytes", "paired", "own", "of_page"]
    shown = F.when(F.col("r_own") | ~F.col("r_paired"), F.col("html"))  # a page that only revisits needs no payload
    named = joined.select("page_id", "url", F.hex(F.xxhash64("url")).alias("url_key"), *[F.col(f"r_{c}").alias(c) for c in facts], F.hex(F.xxhash64("r_of_url")).alias("of_url_key"), shown.alias("html"))
    return in_arrow(named, _table(chunk_bytes), "record_id string, chunk_no int, value binary")


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, archive_records: int = ARCHIVE_RECORDS) -> None:
    """Gzipped archives of pages under path. Records are whole UTF-8 characters, so text is a safe way to write them."""
    values = record_rows(pages, revisit_bytes, chunk_bytes).select(F.col("value").cast("string").alias("value"))
    values.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", archive_records).text(path)


def _pieces(f, n: int) -> Iterator[bytes]:
    while n:
        piece = f.read(min(n, PIECE))
        if not piece:
            raise ValueError("an archive ends within a record")
        n -= len(piece)
        yield piece


def records(f) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(fields, pieces of the block) of each record of a stream; pieces must be used before the next record."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        fields: dict[str, str] = {}
        while (line := f.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(": ")
            fields[name.lower()] = value
        yield fields, _pieces(f, int(fields["content-length"]))


def _after_http(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The payload of an HTTP response."""
    head = b""
    for piece in pieces:
        head += piece
        if (at := head.find(b"\r\n\r\n")) >= 0:
            yield head[at + 4 :]
            yield from pieces
            return
    raise ValueError("a response has no payload")


_PARSED = pa.schema([("record_id", pa.string()), ("no", pa.int32()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.binary())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    for b in batches:
        for content in b.column(0):
            rows: list[tuple] = []
            held = 0
            for fields, pieces in records(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
                rid = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                page, size, chunk = number(fields.get("warc-x-page-id")), number(fields.get("warc-x-payload-length")), None
                if kind == "response" and "warc-segment-number" not in fields:
                    h, size = hashlib.sha1(), 0
                    for piece in _after_http(pieces):
                        h.update(piece)
                        size += len(piece)
                    if base64.b32encode(h.digest()).decode() != digest:
                        raise ValueError(f"{rid}: the payload does not match its digest")
                else:
                    chunk = b"".join(_after_http(pieces) if kind == "response" else pieces)
                    held += len(chunk)
                rows.append((rid, int(fields.get("warc-segment-number", 0)), page, size, digest, kind, number(fields.get("warc-x-refers-to-page")), chunk if "warc-segment-number" in fields else None))
                if len(rows) == 4096 or held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARSED.types, strict=True)], schema=_PARSED)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARSED.types, strict=True)], schema=_PARSED)


_OUT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (record_id, no): one row a record, its digest carried from chunk to chunk."""
    at, h, size, row = None, None, 0, None

    def end(out: list) -> None:
        if h is not None:
            if base64.b32encode(h.digest()).decode() != row[2] or size != row[1]:
                raise ValueError(f"{at}: the chunks do not make up the payload")
            out.append(row)

    for b in batches:
        out: list[tuple] = []
        for rid, no, page, n, digest, kind, refers, held in zip(*[b.column(i).to_pylist() for i in range(7)], b.column(7), strict=True):
            chunk = held.as_py()
            if no == 0:
                out.append((page, n, digest, kind, refers))
                continue
            if rid != at:
                end(out)
                at, h, size, row = rid, hashlib.sha1(), 0, (page, n, digest, kind, refers)
            h.update(chunk)
            size += len(chunk)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT.types, strict=True)], schema=_OUT)
    out = []
    end(out)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT.types, strict=True)], schema=_OUT)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page_id, payload_bytes, payload_digest (both of the full payload), record_type, refers_to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    ddl = "record_id string, no int, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, chunk binary"
    return in_arrow(in_arrow(files, _parse, ddl).repartition("record_id").sortWithinPartitions("record_id", "no"), _join_chunks, RESULT)


def warc_round_trip(pages: DataFrame, revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes the archives of pages in the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, revisit_bytes, chunk_bytes)
    return read_archives(pages.sparkSession, path)

"""Token ids of a corpus in binary files with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by doc_id (a doc_id that many rows repeat is spread by its text), encoded
through distinct-chunk tables, and written by Spark's own committer, so that any shared file system will do and a lost
executor leaves no part of a file behind. A file is a run of blocks of about BLOCK_IDS ids:

    "EFT1", body length u64 | file number u32, block number u32, documents u64, ids u64, id bytes u8, doc_id flag u8
    | doc_ids i64 each, with a bit set of the nulls | Elias-Fano boundaries (n + 1 values) | the ids | line feed

Ids take 2 bytes where the vocabulary allows it, else 4. The text writer writes the bytes of a string as they are, which a
cast from binary leaves alone; lengths, not line feeds, say where a block ends. A file has FILE_BLOCKS blocks at most, so
reading holds a bounded one. Reading gives each document its ids and its start in the whole corpus: boundaries by select
within the block, READ_DOCS documents at a time, then the sums of the blocks before in the same range of documents, and
those of the ranges before, a table with one row a range.

Defined results: a null text counts as empty, so that only the end id is written; null doc_ids come first; rows that
repeat a doc_id follow one another, by their texts; an empty table gives no blocks and an empty result; only doc_id and
text are read. A document longer than a block has a block of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .elias_fano import EliasFano
from .token_tables import WordEncoder
from .work import in_arrow, new_path, small, whole_text, written

MAGIC = b"EFT1"
BLOCK_IDS = 1 << 20
FILE_BLOCKS = 16
READ_DOCS = 4096
_HEAD = "<IIQQBB"

#: One encoder for each worker process, so that its tables serve all tasks of the worker.
_encoders: dict[str, WordEncoder] = {}


def _encoder(tokenizer_file: str) -> WordEncoder:
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = WordEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def pack_block(file: int, block: int, doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """ids: of each document, little-endian unsigned 32-bit."""
    bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)])
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    known = [0 if d is None else d for d in doc_ids]
    nulls = np.packbits(np.array([d is None for d in doc_ids], dtype=np.uint8), bitorder="little").tobytes()
    ef = EliasFano.of(bounds).to_bytes()
    body = struct.pack(_HEAD, file, block, len(ids), len(flat), width, int(any(d is None for d in doc_ids))) + np.array(known, dtype="<i8").tobytes() + nulls + struct.pack("<Q", len(ef)) + ef + flat.astype(f"<u{width}").tobytes()
    return MAGIC + struct.pack("<Q", len(body)) + body


def blocks_of(data: bytes | pa.Buffer) -> Iterator[tuple[int, int, list[int | None], EliasFano, np.ndarray]]:
    """(file, block, doc_ids, boundaries, ids) of each block of a file."""
    data, at, head = memoryview(data), 0, struct.calcsize(_HEAD)
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ValueError("not a block of token ids")
        (size,) = struct.unpack_from("<Q", data, at + 4)
        body, at = data[at + 12 : at + 12 + size], at + 13 + size
        file, block, n, n_ids, width, some = struct.unpack_from(_HEAD, body)
        doc_ids: list[int | None] = np.frombuffer(body, "<i8", n, head).tolist()
        k = head + 8 * n
        if some:
            gone = np.unpackbits(np.frombuffer(body, np.uint8, -(-n // 8), k), count=n, bitorder="little")
            doc_ids = [None if g else d for d, g in zip(doc_ids, gone, strict=True)]
        k += -(-n // 8)
        (ef,) = struct.unpack_from("<Q", body, k)
        yield file, block, doc_ids, EliasFano.from_bytes(bytes(body[k + 8 : k + 8 + ef])), np.frombuffer(body, f"<u{width}", n_ids, k + 8 + ef)


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, block_ids: int = BLOCK_IDS, id_bytes: int | None = None) -> None:
    """The files of docs under path, in ascending order of doc_id."""
    if id_bytes is None:
        id_bytes = 2 if _encoder(tokenizer_file).lib.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file, block, size = _encoder(tokenizer_file), TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_block(file, block, doc_ids, ids, id_bytes)], pa.binary())], names=["value"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                one = enc.encode(t.as_py()) + end
                if ids and size + len(one) // 4 > block_ids:
                    yield out()
                    doc_ids, ids, size, block = [], [], 0, block + 1
                doc_ids.append(d)
                ids.append(one)
                size += len(one) // 4
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text")]
    ranged = rows.repartitionByRange(order[0], order[1]).sortWithinPartitions(*order)
    in_arrow(ranged.select("doc_id", "text"), run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def read_token_files(spark: SparkSession, path: str, digests_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document of the files under path."""
    schema = [("file", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    if not digests_only:
        schema.append(("ids", pa.list_(pa.int32())))
    ddl = "file int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + ("" if digests_only else ", ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for file, block, doc_ids, ef, flat in blocks_of(content.as_buffer()):
                    for lo in range(0, len(doc_ids), READ_DOCS):
                        n = min(READ_DOCS, len(doc_ids) - lo)
                        bounds = ef.select_many(np.arange(lo, lo + n + 1))
                        crc = [zlib.crc32(flat[a:z].astype("<u4").tobytes()) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                        cols = [pa.array(np.full(n, file, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(doc_ids[lo : lo + n], pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
                        if not digests_only:
                            cols.append(pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(flat[bounds[0] : bounds[-1]].astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(schema))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                found = [(file, block, len(flat)) for file, block, _, _, flat in blocks_of(content.as_buffer())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["file", "block", "total"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("content")
    rows = in_arrow(files, run, ddl)
    blocks = written(in_arrow(files, heads, "file int, block int, total long"), "blocks")
    within = F.sum("total").over(Window.partitionBy("file").orderBy("block")) - F.col("total")
    ranges = blocks.groupBy("file").agg(F.sum("total").alias("whole"))
    # one row a range
    before = ranges.select("file", (F.sum("whole").over(Window.orderBy("file")) - F.col("whole")).alias("base"))
    starts = written(blocks.withColumn("within", within).join(before, "file").select(F.col("file").alias("f"), F.col("block").alias("b"), (F.col("base") + F.col("within")).alias("base")), "starts")
    starts = small(starts)
    placed = rows.join(starts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return placed.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *([] if digests_only else ["ids"]))


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Writes the files in the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_file, end_id)
    return read_token_files(docs.sparkSession, path, digests_only=True)

"""SentencePiece encoding and decoding of whole texts through distinct-chunk tables.

Each task cuts texts at the boundaries that no piece crosses, segments each distinct chunk of its table once, and
joins ids and decoded bytes back by position: the ids are those of the library for the whole text, begin and end ids
included. There is no shuffle; a task holds one text, its chunks and two bounded tables (token_tables says what one table
for the corpus would cost).

Defined results: a null text counts as empty and gets the begin and end ids only; rows that repeat, ties and null
doc_ids each keep a row; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_tables import PieceEncoder
from .work import in_arrow, whole_text

#: One encoder for each worker process, so that its tables serve all tasks of the worker.
_encoders: dict[str, PieceEncoder] = {}


def _encoder(model_file: str) -> PieceEncoder:
    if model_file not in _encoders:
        _encoders[model_file] = PieceEncoder(model_file)
    return _encoders[model_file]


def encode_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the real ids and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model_file)
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):  # a text may be very long
                ids, text = enc.encode_decode(t.as_py())
                flat = pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.ListArray.from_arrays([0, len(flat)], flat), pa.array([text.decode()])], names=["doc_id", "ids", "decoded"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), run, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model_file)
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b.column(1):
                ids, text = enc.encode_decode(t.as_py())
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Exact duplicates by a minimal perfect hash over the digests seen before.

`build_index` turns the distinct digests of a history into shards. A shard holds a minimal perfect hash and, slot by
slot, the full digest, the winner's locator (its doc_id) and the number of rows. `merge` looks the distinct digests of
new rows up: where the slot holds the same 32 bytes the row repeats the history and the slot is brought up to date;
the others, nonmembers, are groups of their own. Digests are pre-aggregated before every shuffle, so a text with a
third of all rows is one entry. A shard has at most about SHARD_DIGESTS entries at any size of the table, and a task takes
the shards that the session's shuffle partitions deal it, one at a time.

Defined results: a null text counts as empty; texts are equal only if identical; of equal texts the largest doc_id
stays; a null doc_id ranks below all others; rows that repeat doc_id and text are flagged alike; an empty table gives
an empty result; only doc_id and text are read, so further columns of any name are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mph import MinimalPerfectHash, words
from .work import drop_rows, in_arrow, small, text_digest, written

SHARD_DIGESTS = 65_536
INDEX = "shard long, hash binary, digests binary, winners array<long>, counts array<long>"
GROUPS = "digest binary, keep_id long, group_size long, known boolean"


def digest_table(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row; the only pass over the texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """(digest, winner, n): one row for each text."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))


def _shard(n_shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n_shards)).alias("shard")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each key, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield held[0].column(key)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(key)[0].as_py(), pa.Table.from_batches(held)


_INDEX_ARROW = pa.schema([("shard", pa.int64()), ("hash", pa.binary()), ("digests", pa.binary()), ("winners", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, rows in _runs(batches, "shard"):
        keys = words(rows.column("digest").to_pylist())
        mph = MinimalPerfectHash.build(keys)
        order = np.argsort(mph.slots(keys))
        winners = rows.column("winner").combine_chunks().take(pa.array(order)).to_pylist()
        counts = rows.column("n").to_numpy()[order]
        yield pa.RecordBatch.from_pydict({"shard": [shard], "hash": [mph.to_bytes()], "digests": [keys[order].tobytes()], "winners": [winners], "counts": [counts]}, schema=_INDEX_ARROW)


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """history: (digest, winner, n), digests distinct."""
    return in_arrow(history.withColumn("shard", _shard(n_shards)).repartition("shard").sortWithinPartitions("shard"), _build, INDEX)


_GROUPS_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("known", pa.bool_())])


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None or (b is not None and b > a) else a


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _runs(batches, "shard"):
        parts = rows.to_pydict()
        own = [i for i, h in enumerate(parts["hash"]) if h is not None]
        new = [i for i, h in enumerate(parts["hash"]) if h is None]
        digests, keep, sizes = b"", [], []
        fresh = new
        if own:  # the index has one row a shard
            i = own[0]
            digests, keep, sizes = parts["digests"][i], list(parts["winners"][i]), list(parts["counts"][i])
            if new:
                table, keys = np.frombuffer(digests, dtype="<u8").reshape(-1, 4), words([parts["digest"][i] for i in new])
                slots = MinimalPerfectHash.from_bytes(parts["hash"][i]).slots(keys)
                member = (slots >= 0) & (table[np.maximum(slots, 0)] == keys).all(axis=1)
                for j, slot in zip(np.flatnonzero(member).tolist(), slots[member].tolist(), strict=True):
                    keep[slot] = _larger(keep[slot], parts["winner"][new[j]])
                    sizes[slot] += parts["n"][new[j]]
                fresh = [new[j] for j in np.flatnonzero(~member).tolist()]
        out = [digests[k : k + 32] for k in range(0, len(digests), 32)] + [parts["digest"][i] for i in fresh]
        known = [True] * len(keep) + [False] * len(fresh)
        yield pa.RecordBatch.from_pydict({"digest": out, "keep_id": keep + [parts["winner"][i] for i in fresh], "group_size": sizes + [parts["n"][i] for i in fresh], "known": known}, schema=_GROUPS_ARROW)


def merge(index: DataFrame, new: DataFrame, n_shards: int) -> DataFrame:
    """All groups after new (digest, winner, n; digests distinct) has met the index."""
    null = lambda kind: F.lit(None).cast(kind)
    probes = new.select(_shard(n_shards), null("binary").alias("hash"), null("binary").alias("digests"), null("array<long>").alias("winners"), null("array<long>").alias("counts"), "digest", "winner", "n")
    held = index.select("shard", "hash", "digests", "winners", "counts", null("binary").alias("digest"), null("long").alias("winner"), null("long").alias("n"))
    return in_arrow(held.unionByName(probes).repartition("shard").sortWithinPartitions("shard"), _merge, GROUPS)


def groups(rows: DataFrame) -> DataFrame:
    """The groups of a digest table: its lower half by doc_id is the history, the upper half the new batch."""
    lo, hi, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    split = (lo + hi) // 2 if lo is not None else 0
    n_shards = max(1, -(-n // SHARD_DIGESTS), min(1024, n // 256))
    old = F.coalesce(F.col("doc_id") <= split, F.lit(True))
    index = build_index(distinct_digests(rows.filter(old)), n_shards)
    return merge(index, distinct_digests(rows.filter(~old)), n_shards)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(digest_table(docs), "digests")
    g = groups(rows).select(F.col("digest").alias("d"), "keep_id", "group_size")
    return rows.join(g.hint("merge"), rows["digest"] == g["d"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs, of equal texts only the row with the largest doc_id, all columns."""
    rows = written(digest_table(docs), "digests")
    g = written(groups(rows).filter("group_size > 1").select(F.col("digest").alias("d"), "keep_id"), "groups")
    copies = rows.join(small(g), rows["digest"] == g["d"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # the digest as an expression: the removal of repeats then has a shuffle of its own, after pre-aggregation, and Spark may
    # split the join of a text that very many rows have
    gone = copies.select("doc_id", F.unhex(F.hex("digest")).alias("digest")).distinct()
    return drop_rows(docs, written(gone, "gone"), rows)

"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 values (seed 42) of a text's word
shingles, repeats included. Two fingerprints link if they differ in RADIUS bits or fewer. Every bit position gets a
nonzero vector of RADIUS + 1 bits; each nonzero vector v of that length gives a table whose mask keeps the positions
whose vector has an odd product with v. Any RADIUS positions leave at least one v that is orthogonal to all of them, so
a pair within the radius agrees on all bits of at least one of the 2^(RADIUS + 1) - 1 masks: no link is lost.

Only distinct fingerprints enter the tables, with the smallest doc_id of each, so copies cost nothing. In a bucket
(table, masked bits) links are found in sorted runs: small ones by comparing neighbours in the run, large ones by
looking up each fingerprint's possible neighbours, which is linear in the run. Buckets over HEAVY are split first:
the bits that the mask leaves free form RADIUS + 1 blocks, and a linked pair agrees on one of them, so the splitting
loses nothing and bounds a bucket by the values of its last free bits. A bucket emits a spanning forest of its links,
never all pairs; components follow by alternating star contractions, each written to the shared folder.

Defined results: null counts as empty; texts of fewer words than a shingle are one shingle; texts without a word have
fingerprint zero, and link like any other; rows that repeat a doc_id each keep a row; a null doc_id is never a
component's name unless all are null; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import drop_rows, in_arrow, text_digest, whole_text, written

SEED = 42
WORDS = 3
RADIUS = 2
HEAVY = 4096
#: Runs up to this length are compared pair by pair inside one vectorised task.
SMALL_RUN = 512
BLOCK = 65_536


def fingerprint(text: bytes, k: int = WORDS) -> int:
    """text: UTF-8. A-Z are lower-cased; words are what ASCII white space separates."""
    words = text.lower().split()
    if not words:
        return 0
    line, at, ends, starts = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    h = xxhash.xxh64_intdigest
    pairs = list(zip(starts, ends[k - 1 :])) if len(words) >= k else [(0, len(line))]  # noqa: B905
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(pairs), BLOCK):
        values = np.array([h(line[a:b], SEED) for a, b in pairs[i : i + BLOCK]], dtype="<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(pairs), bitorder="little").view("<u8")[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py(), k) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints)], names=[*b.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, k: int = WORDS, digest: bool = False) -> DataFrame:
    """(doc_id, [digest,] fp long) of every row."""
    more = [text_digest().alias("digest")] if digest else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, whole_text().alias("text"))
    return in_arrow(rows, _fingerprints(k), "doc_id long, digest binary, fp long" if digest else "doc_id long, fp long")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The tables' masks: structured, so that every pair within the radius agrees under at least one."""
    vectors = range(1, 2 ** (radius + 1))
    of = [vectors[i % len(vectors)] for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (of[i] & v).bit_count() % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def blocks(mask: int, radius: int = RADIUS) -> list[int]:
    """The bits that a mask leaves free, dealt to radius + 1 blocks."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [sum(1 << i for i in free[j :: radius + 1]) for j in range(radius + 1)]


def _forest(keys: np.ndarray, radius: int, free: int) -> tuple[list[int], list[int]]:
    """Spanning edges (larger, smaller) of the links between sorted distinct fingerprints that agree outside free."""
    n = len(keys)
    parent = list(range(n))
    edges: tuple[list[int], list[int]] = ([], [])

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(i: int, j: int) -> None:
        a, b = sorted((root(i), root(j)))
        if a != b:
            parent[b] = a
            edges[0].append(int(keys[b]))
            edges[1].append(int(keys[a]))

    u = keys.view(np.uint64)
    if n <= SMALL_RUN:
        for step in range(1, n):
            for i in np.flatnonzero(np.bitwise_count(u[step:] ^ u[:-step]) <= radius).tolist():
                link(i, i + step)
    else:
        bits = [np.uint64(1 << i) for i in range(64) if free >> i & 1]
        for r in range(1, radius + 1):
            for flip in combinations(bits, r):
                wanted = (u ^ np.bitwise_or.reduce(np.array(flip))).view(np.int64)
                at = np.minimum(np.searchsorted(keys, wanted), n - 1)
                for i in np.flatnonzero((keys[at] == wanted) & (at > np.arange(n))).tolist():
                    link(i, int(at[i]))
    return edges


def _runs(radius: int, all_masks: list[int]):
    full = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 4
        for b in _with_end(batches):
            cols = [np.concatenate([h, b.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held)] if b is not None else held
            n = len(cols[0])
            cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:3]], axis=0)) + 1 if n else np.empty(0, np.int64)
            starts = np.concatenate([[0], cut]).astype(np.int64) if n else np.empty(0, np.int64)
            ends = np.concatenate([cut, [n]]).astype(np.int64) if n else np.empty(0, np.int64)
            if b is not None and n:  # the last run may go on
                held = [c[starts[-1] :] for c in cols]
                starts, ends = starts[:-1], ends[:-1]
            big, small = ([], [])
            for a, z in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                free = full & ~all_masks[cols[0][a]]
                x, y = _forest(cols[3][a:z], radius, free)
                big += x
                small += y
            if big:
                yield pa.RecordBatch.from_arrays([pa.array(big, pa.int64()), pa.array(small, pa.int64())], names=["a", "b"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(prints: DataFrame, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join all pairs within the radius."""
    all_masks = masks(radius)
    fp = F.col("fp")

    def chosen(parts: list[int], at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(_signed(m)) for m in parts]), at + 1)

    tables = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(all_masks)])).alias("t")).select("fp", "t.v", "t.key")
    counts = tables.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n"))
    crowded = counts.filter(F.col("n") > heavy).select("v", "key", F.lit(True).alias("crowded"))
    crowded = written(crowded, "crowded")
    rows = tables
    if not crowded.isEmpty():
        rows = tables.join(crowded, ["v", "key"], "left")
        split = F.explode(F.when(F.col("crowded"), F.sequence(F.lit(0), F.lit(radius))).otherwise(F.array(F.lit(-1))))
        rows = rows.select("fp", "v", "key", split.alias("block"))
        flat = [m for mask in all_masks for m in blocks(mask, radius)]
        part = fp.bitwiseAND(chosen(flat, F.col("v") * (radius + 1) + F.col("block")))
        rows = rows.select("v", F.when(F.col("block") >= 0, F.xxhash64("key", "block", part)).otherwise(F.col("key")).alias("key"), "block", "fp")
    else:
        rows = rows.select("v", "key", F.lit(-1).alias("block"), "fp")
    return in_arrow(rows.repartition("v", "block", "key").sortWithinPartitions("v", "block", "key", "fp").select("v", "block", "key", "fp"), _runs(radius, all_masks), "a long, b long")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): root is the smallest node of the component; for every node that has an edge.

    Alternating large-star and small-star contractions over written tables, until a round changes nothing. The least
    neighbours are aggregated before the shuffle; in the joins a node of very many edges meets one row, so Spark's adaptive
    execution can split them.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state(e)
    for _ in range(rounds):
        if not before[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low, "a")
        small = pairs.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b").distinct()
        new = written(small, "edges")
        e, last, before = new, before, state(new)
        if last == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"the components did not settle in {rounds} rounds")


def classes(prints: DataFrame, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of prints (doc_id, fp)."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    stars = components(links(distinct, radius, heavy))
    named = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id")


def simhash_near_dedup(docs: DataFrame, k: int = WORDS, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = written(fingerprints(docs, k), "fingerprints")
    c = classes(prints, radius, heavy).withColumnRenamed("fp", "c")
    return prints.join(c.hint("merge"), prints["fp"] == c["c"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, k: int = WORDS, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """docs, of each component only the row with the smallest doc_id (then the smallest text digest), all columns."""
    prints = written(fingerprints(docs, k, digest=True), "fingerprints")
    c = classes(prints.select("doc_id", "fp"), radius, heavy).withColumnRenamed("fp", "c")
    joined = written(prints.join(c.hint("merge"), prints["fp"] == c["c"]).select("doc_id", "digest", "component_id"), "classes")
    first = joined.groupBy(F.col("component_id").alias("of")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first"))
    others = joined.join(first, F.col("component_id").eqNullSafe(F.col("of"))).filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))))
    return drop_rows(docs, written(others.select("doc_id", "digest").distinct(), "gone"), joined.select("doc_id", "digest"))

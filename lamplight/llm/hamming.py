"""Exact top-k search of binary codes in Hamming space by incremental multi-index hashing.

A vector's code has 64 bits: bit i is set where the sum of its components i, i + 64, ... is above zero. Codes are cut
into SEGMENTS segments of equal width. A code within distance d of a query has a segment within d // SEGMENTS of the
query's, so after all segments were searched up to radius r every code up to SEGMENTS * (r + 1) - 1 is verified. The
radius grows round by round along ROUNDS; a query is done once its k-th verified distance is covered, and the others
go on, up to the width of a segment, where everything is covered.

Only distinct codes are searched, with their smallest id; a code's k smallest ids come in at the end, so copies cost
nothing. The index has a row for each code and segment, dealt to shards by segment, by the segment value's first bits
and, where such a range is crowded, by a hash of the code, so that a shard holds about SHARD_CODES codes however
skewed the values are. A query goes to the shards whose first bits are within the radius, and a shard gives back k
codes at most.

Result: of all rows, the query's own included, the k with the smallest (distance, id), ranked from 1; all rows if
there are fewer. Defined results: a null vector or an empty one has the code zero, null and NaN components count as
zero; rows that repeat an id each count; rows with a null id are neither found nor queries; an empty table gives an
empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import in_arrow, written

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
#: First and last radius of each round.
ROUNDS = ((0, 1), (2, 3), (4, 5), (6, 8), (9, WIDTH))
SHARD_CODES = 16_384
K = 10


def code(embedding: Column) -> Column:
    """The 64-bit code of an array of numbers."""
    clean = F.transform(F.coalesce(embedding, F.array().cast("array<float>")), lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x.cast("double")))
    zero = F.lit(0).cast("long")
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(zero)
    joined = lambda bits: F.aggregate(bits, zero, lambda a, x: a.bitwiseOR(x))
    plain = joined(F.transform(clean, bit))
    total = lambda i: F.aggregate(F.filter(clean, lambda _, j: j % BITS == i), F.lit(0.0), lambda a, x: a + x)
    folded = joined(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: bit(total(i), i)))
    return F.when(F.size(clean) <= BITS, plain).otherwise(folded)


def segment(value: Column, s: int) -> Column:
    return F.shiftrightunsigned(value, s * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def _rings() -> list[np.ndarray]:
    values = np.arange(1 << WIDTH, dtype=np.uint32)
    ones = np.bitwise_count(values)
    return [values[ones == r] for r in range(WIDTH + 1)]


class Shard:
    """The codes of a shard, in the order of their segment values."""

    def __init__(self, codes: np.ndarray, least: np.ndarray, n: np.ndarray, s: int):
        values = (codes.view(np.uint64) >> np.uint64(s * WIDTH)).astype(np.uint32) & np.uint32((1 << WIDTH) - 1)
        order = np.argsort(values, kind="stable")
        self.codes, self.least, self.n, self.values, self.s = codes[order].view(np.uint64), least[order], n[order], values[order], s
        self.starts = np.searchsorted(self.values, np.arange((1 << WIDTH) + 1))

    def ring(self, query: int, radius: int, rings: list[np.ndarray]) -> np.ndarray:
        """The places whose segment is at exactly this radius from the query's."""
        own = np.uint32(query >> self.s * WIDTH & (1 << WIDTH) - 1)
        if len(rings[radius]) >= len(self.codes):  # fewer codes than segment values
            return np.flatnonzero(np.bitwise_count(self.values ^ own) == radius)
        wanted = rings[radius] ^ own
        a, z = self.starts[wanted], self.starts[wanted + 1]
        full = z > a
        a, z = a[full], z[full]
        if not len(a):
            return a
        counts = z - a
        return np.repeat(a - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())

    def best(self, query: int, first: int, last: int, k: int, bound: int, rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the k codes with the smallest (distance, least id), none beyond bound."""
        at = np.concatenate([self.ring(query, r, rings) for r in range(first, last + 1)])
        d = np.bitwise_count(self.codes[at] ^ np.uint64(query)).astype(np.int64)
        keep = d <= bound
        at, d = at[keep], d[keep]
        if len(at) > k:
            first = np.lexsort((self.least[at], d))[:k]
            at, d = at[first], d[first]
        return at, d


_FOUND = pa.schema([("q", pa.int64()), ("code", pa.int64()), ("least", pa.int64()), ("n", pa.int32()), ("d", pa.int32())])


def _search(first: int, last: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (s, part, salt, is_query): the codes of a shard, then the queries that it gets."""
        rings, key, parts, shard = _rings(), None, [], None
        for b in batches:
            shards = np.stack([b.column(i).to_numpy() for i in range(3)]) if b.num_rows else np.empty((3, 0), np.int32)
            cuts = np.flatnonzero((np.diff(shards) != 0).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                if tuple(shards[:, lo]) != key:
                    key, parts, shard = tuple(shards[:, lo].tolist()), [], None
                kind = b.column(3).to_numpy(zero_copy_only=False)[lo:hi]
                cols = [b.column(i).to_numpy()[lo:hi] for i in (4, 5, 6)]
                codes = int((~kind).sum())
                if codes:
                    parts.append([c[:codes] for c in cols])
                if codes == hi - lo or not parts:
                    continue
                if shard is None:
                    shard = Shard(*(np.concatenate(c) for c in zip(*parts, strict=True)), key[0])
                q, rows, ds = [], [], []
                for query, bound in zip(cols[0][codes:].tolist(), cols[2][codes:].tolist(), strict=True):
                    at, d = shard.best(query & (1 << BITS) - 1, first, last, k, bound, rings)
                    q.append(np.full(len(at), query, np.int64))
                    rows.append(at)
                    ds.append(d)
                at = np.concatenate(rows)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q)), pa.array(shard.codes[at].view(np.int64)), pa.array(shard.least[at]), pa.array(shard.n[at], pa.int32()), pa.array(np.concatenate(ds), pa.int32())], schema=_FOUND)

    return run


def top_codes(codes: DataFrame, queries: DataFrame, k: int, shard_codes: int = SHARD_CODES) -> DataFrame:
    """(q, code, least, n, d): for each distinct query code the k nearest of codes (code, least, n), exactly."""
    total = codes.count()
    first_bits = min(10, max(0, (total // shard_codes).bit_length() - 1))
    rest = WIDTH - first_bits
    spread = codes.select("code", "least", "n", F.posexplode(F.array(*[segment(F.col("code"), s) for s in range(SEGMENTS)])).alias("s", "value"))
    spread = spread.withColumn("part", F.shiftright("value", rest)).drop("value")
    sizes = spread.groupBy("s", "part").agg(F.ceil(F.count(F.lit(1)) / shard_codes).cast("int").alias("salts"))  # at most SEGMENTS * 1024 rows
    sizes = written(sizes, "shards")
    index = spread.join(F.broadcast(sizes), ["s", "part"]).select("s", "part", F.pmod(F.xxhash64("code"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("is_query"), "code", "least", "n")
    index = written(index, "index")
    none = lambda kind: F.lit(None).cast(kind)
    # each query has a row without a code, which keeps it where nothing was found yet
    best = queries.select("q", none("long").alias("code"), none("long").alias("least"), F.lit(0).alias("n"), F.lit(BITS + 1).alias("d"), none("int").alias("kth"))
    best = written(best, "queries")
    done: list[DataFrame] = []
    near = Window.partitionBy("q").orderBy("d", "least")
    for first, last in ROUNDS:
        sent = best.filter(F.col("code").isNull()).select("q", F.coalesce("kth", F.lit(BITS)).alias("bound"), F.posexplode(F.array(*[segment(F.col("q"), s) for s in range(SEGMENTS)])).alias("s", "value"))
        near_parts = F.array(*[F.lit(m) for m in range(1 << first_bits) if m.bit_count() <= last])
        sent = sent.select("q", "bound", "s", F.shiftright("value", rest).alias("own"), F.explode(near_parts).alias("m")).withColumn("part", F.col("own").bitwiseXOR(F.col("m"))).join(F.broadcast(sizes), ["s", "part"])
        sent = sent.select("s", "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("is_query"), F.col("q").alias("code"), F.lit(0).cast("long").alias("least"), F.col("bound").cast("int").alias("n"))
        keys = ["s", "part", "salt"]
        found = in_arrow(index.unionByName(sent).repartition(*keys).sortWithinPartitions(*keys, "is_query"), _search(first, last, k), "q long, code long, least long, n int, d int")
        # one shuffle by query serves the removal of repeats, the ranks and the k-th distances
        found = found.unionByName(best.drop("kth")).repartition("q").dropDuplicates(["q", "code"])
        ranked = found.withColumn("rank", F.row_number().over(near)).filter((F.col("rank") <= k) | F.col("code").isNull())
        so_far = F.sum("n").over(near.rowsBetween(Window.unboundedPreceding, 0))
        ranked = ranked.withColumn("so_far", so_far).withColumn("kth", F.min(F.when(F.col("code").isNotNull() & (F.col("so_far") >= k), F.col("d"))).over(Window.partitionBy("q")))
        best = written(ranked.select("q", "code", "least", "n", "d", "kth"), "nearest")
        over = F.lit(last == WIDTH) | F.coalesce(F.col("kth") <= SEGMENTS * (last + 1) - 1, F.lit(False))
        done.append(best.filter(over & F.col("code").isNotNull()).drop("kth"))
        best = best.filter(~over)
        if best.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def hamming_top_k(vectors: DataFrame, k: int = K, every: int = 20, shard_codes: int = SHARD_CODES) -> DataFrame:
    """The rows whose vec_id is divisible by every are the queries: query_id, rank, neighbor_id, distance."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), code(F.col("embedding")).alias("code")).filter(F.col("id").isNotNull())
    rows = written(rows, "codes")
    counted = rows.groupBy("code").agg(F.min("id").alias("least"), F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    of_code = Window.partitionBy("code").orderBy("id")  # only k rows of a code and task reach the shuffle
    ids = rows.withColumn("r", F.row_number().over(of_code)).filter(F.col("r") <= k).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    queries = rows.filter(F.col("id") % every == 0)
    nearest = top_codes(written(counted, "distinct-codes"), queries.select(F.col("code").alias("q")).distinct(), k, shard_codes)
    named = nearest.join(ids.hint("merge"), "code").select("q", F.explode("ids").alias("id"), "d")
    order = Window.partitionBy("q").orderBy("d", "id")
    top = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    top = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "d"))).alias("top"))  # k entries
    top = written(top, "top")
    found = queries.join(top.hint("merge"), F.col("code") == F.col("q")).select(F.col("id").alias("query_id"), F.explode("top").alias("t"))
    return found.select("query_id", F.col("t.rank").cast("long").alias("rank"), F.col("t.id").alias("neighbor_id"), F.col("t.d").cast("long").alias("distance"))

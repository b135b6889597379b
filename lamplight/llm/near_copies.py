"""Near copies by the similarity of whole word-shingle sets: candidates by SimHash and banded MinHash, checked exactly.

A text's set holds the XXH64 values (seed 42) of its shingles of WORDS words; A-Z are lower-cased, ASCII white space
separates. Two texts link if the Jaccard similarity of their sets is 4/5 or more, tested in integers. Candidates are of
two kinds. Texts of one SimHash component (lamplight.llm.simhash, whole: fingerprints of three-word shingles, covering
masks, links within two bits, contraction) are candidates without loss; but most texts at 4/5 are more bits apart. So are
texts that agree on all ROWS values of one of BANDS bands of minima: of pairs at exactly 4/5 all but (1 - 0.8^ROWS)^BANDS
= 7 in 100,000 are expected to, of more similar ones all but fewer. Only pairs that neither kind holds are lost. A
fingerprint alone drops nothing: a passage repeated often decides it, whatever else stands in the text.

A bucket (band, values) emits one edge from each member to its smallest, never all pairs, and so does a SimHash component;
components of these edges hold every candidate pair. A component is dealt by a hash to bins of about BIN_SHINGLES shingles; most components have one bin.
Each bin is searched breadth first: a text is compared with those that no text has reached so far and whose sizes allow
the similarity, so a large group of near copies takes few scans. Then bin after bin of a component that still has more
than one group meets the later ones, two bins in a task at a time, and only texts of groups that are not joined yet are
compared. So every pair of a component is compared or already joined, and no task holds more than two bins, however
large a group is.

Defined results: null counts as empty; texts of fewer words than a shingle are one shingle, texts without a word the
empty one; of equal texts and of near copies the smallest doc_id stays, then the smallest digest; a null doc_id comes
last; rows that repeat doc_id and text count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import SEED, classes, components, fingerprint
from .work import drop_rows, in_arrow, small, text_digest, whole_text, written

WORDS = 5
BANDS, ROWS = 24, 5
BLOCK = 512
BIN_SHINGLES = 1 << 20
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: bytes, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a UTF-8 text."""
    words = text.lower().split()
    line, at, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    h = xxhash.xxh64_intdigest
    pairs = zip(starts, ends[k - 1 :]) if len(words) >= k else [(0, len(line))]  # noqa: B905
    return np.unique(np.fromiter((h(line[a:b], SEED) for a, b in pairs), dtype=np.uint64))


def bands(shingles: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band; the band's number is part of it."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), BLOCK):
        mixed = shingles[i : i + BLOCK, None] * _FACTORS + _TERMS
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, mixed.min(axis=0), out=least)
    low = least.reshape(BANDS, ROWS)
    return [x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh64_intdigest(low[i].tobytes(), i) for i in range(BANDS))]


def similar_groups(sets: list[np.ndarray]) -> list[int]:
    """The number of the component of each set, where sets of similarity 4/5 or more link."""
    n = len(sets)
    order = sorted(range(n), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
    _, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    codes = codes.astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(codes.max()) + 1, dtype=np.int32)
    # those that are not reached yet: their places in order, sizes, and codes one after the other
    left, left_sizes, flat = np.arange(n), sizes, codes
    group = [-1] * n
    name = 0
    while len(left):
        queue = [int(left[0])]
        group[order[queue[0]]] = name
        left, left_sizes, flat = left[1:], left_sizes[1:], flat[left_sizes[0] :]
        while queue and len(left):
            i = queue.pop()
            own = codes[starts[i] : starts[i + 1]]
            lo = np.searchsorted(left_sizes, -(-4 * sizes[i] // 5))
            hi = np.searchsorted(left_sizes, 5 * sizes[i] // 4, side="right")
            if lo >= hi:
                continue
            at = np.concatenate([[0], np.cumsum(left_sizes)])
            mark[own] = 1
            both = np.add.reduceat(mark[flat[at[lo] : at[hi]]], at[lo:hi] - at[lo])
            mark[own] = 0
            near = np.zeros(len(left), dtype=bool)
            near[lo:hi] = 9 * both >= 4 * (sizes[i] + left_sizes[lo:hi])
            if near.any():
                found = left[near].tolist()
                for j in found:
                    group[order[j]] = name
                queue += found
                flat = flat[np.repeat(~near, left_sizes)]
                left, left_sizes = left[~near], left_sizes[~near]
        name += 1
    return group


def joined_groups(pivots: list[np.ndarray], of_pivots: list[int], others: list[np.ndarray], of_others: list[int]) -> list[tuple[int, int]]:
    """Pairs of groups with a link between a pivot and another; of_pivots, of_others: the groups that they are known to be in."""
    parent: dict[int, int] = {g: g for g in [*of_pivots, *of_others]}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    out: list[tuple[int, int]] = []
    order = sorted(range(len(others)), key=lambda i: len(others[i]))
    sizes = np.array([len(others[i]) for i in order], dtype=np.int64)
    vocabulary, codes = np.unique(np.concatenate([others[i] for i in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    groups = np.array([of_others[i] for i in order], dtype=np.int64)
    mark = np.zeros(len(vocabulary), dtype=np.int32)
    for p, g in sorted(zip(pivots, of_pivots, strict=True), key=lambda x: x[1]):
        lo = int(np.searchsorted(sizes, -(-4 * len(p) // 5)))
        hi = int(np.searchsorted(sizes, 5 * len(p) // 4, side="right"))
        away = np.flatnonzero(groups[lo:hi] != root(g)) + lo
        if not len(away):
            continue
        at = np.minimum(np.searchsorted(vocabulary, p), len(vocabulary) - 1)
        own = at[vocabulary[at] == p]
        mark[own] = 1
        n = sizes[away]
        ends = np.cumsum(n)
        places = np.repeat(starts[away] - (ends - n), n) + np.arange(ends[-1])
        both = np.add.reduceat(mark[codes[places]], ends - n)
        mark[own] = 0
        for j in away[9 * both >= 4 * (len(p) + n)].tolist():
            a, b = sorted((root(g), root(int(groups[j]))))
            if a != b:
                parent[b] = a
                out.append((b, a))
                groups[groups == b] = a
    return out


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2).cast(pa.binary())
        keys = [bands(shingle_set(t.as_py())) for t in texts]
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(prints)], names=["doc_id", "digest", "bands", "fp"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, BLOCK):
            part = b.slice(i, BLOCK)
            sets = [shingle_set(t.as_py()) for t in part.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["root", "node", "n", "shingles"])


_LINKS = pa.schema([("node", pa.int64()), ("grp", pa.int64())])


def _bins(run: Callable[[list[tuple[bool, int, int, np.ndarray]]], list[tuple[int, int]]]):
    """run over the rows (root, bin, later, node, grp, shingles) of each (root, bin), which are sorted by it."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bool, int, int, np.ndarray]] = []
        key = None

        def out() -> pa.RecordBatch:
            found = run(held)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=_LINKS)

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for root, at, later, node, group, s in zip(*cols, b.column(5), strict=True):
                if held and (root, at) != key:
                    yield out()
                    held = []
                key = (root, at)
                held.append((later, node, group, np.frombuffer(s.as_py(), np.uint64)))
        if held:
            yield out()

    return over


def _in_bin(held: list[tuple[bool, int, int, np.ndarray]]) -> list[tuple[int, int]]:
    least: dict[int, int] = {}
    groups = similar_groups([s for *_, s in held])
    for (_, node, _, _), g in zip(held, groups, strict=True):
        least[g] = min(node, least.get(g, node))
    return [(node, least[g]) for (_, node, _, _), g in zip(held, groups, strict=True)]


def _across(held: list[tuple[bool, int, int, np.ndarray]]) -> list[tuple[int, int]]:
    first, later = ([x for x in held if x[0] is late] for late in (False, True))
    if not first or not later:
        return []
    return joined_groups([x[3] for x in first], [x[2] for x in first], [x[3] for x in later], [x[2] for x in later])


def exact_groups(sets: DataFrame, bin_shingles: int = BIN_SHINGLES) -> DataFrame:
    """(node, grp) for sets (root, node, n, shingles): the texts of a root that links join have one grp."""
    bins = sets.groupBy("root").agg(F.ceil(F.sum("n") / bin_shingles).cast("int").alias("bins"))
    placed = sets.join(bins, "root").withColumn("bin", F.pmod(F.xxhash64("node"), "bins").cast("int"))
    placed = written(placed, "sets")
    layout, keys = ["root", "bin", "later", "node", "grp", "shingles"], ["root", "bin"]

    def run(rows: DataFrame, fn) -> DataFrame:
        return in_arrow(rows.select(*layout).repartition(*keys).sortWithinPartitions(*keys), _bins(fn), "node long, grp long")

    named = written(run(placed.withColumns({"later": F.lit(False), "grp": F.lit(0).cast("long")}), _in_bin), "groups")
    last = placed.agg(F.max("bins")).first()[0] or 1
    for i in range(last - 1):
        many = placed.filter(F.col("bins") > i + 1).select("root", "node", "bins").join(named, "node")
        open_roots = written(many.groupBy("root").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo <> hi").select("root"), "open")
        if open_roots.isEmpty():
            break
        rows = placed.join(open_roots, "root", "left_semi").filter((F.col("bins") > i + 1) & (F.col("bin") >= i)).join(named, "node")
        first = rows.filter(F.col("bin") == i).withColumn("bin", F.explode(F.sequence(F.lit(i + 1), F.col("bins") - 1))).withColumn("later", F.lit(False))
        pairs = components(run(first.unionByName(rows.filter(F.col("bin") > i).withColumn("later", F.lit(True))), _across).select(F.col("node").alias("a"), F.col("grp").alias("b")))
        named = written(named.join(pairs.select(F.col("node").alias("grp"), F.col("root").alias("to")), "grp", "left").select("node", F.coalesce("to", "grp").alias("grp")), "groups")
    return named


def near_copies(docs: DataFrame, bin_shingles: int = BIN_SHINGLES) -> DataFrame:
    """(doc_id, digest) of the rows of docs that go: all copies and near copies but the first of each component."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), whole_text().alias("text"))
    keyed = in_arrow(rows, _key_rows, "doc_id long, digest binary, bands array<long>, fp long")
    place = lambda: F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "digest")
    # texts of one node number would only share a component of candidates
    nodes = keyed.groupBy("digest").agg(F.min(place()).alias("least"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    nodes = written(nodes.select("digest", F.col("least.id").alias("doc_id"), "rows", F.xxhash64("digest").alias("node"), "bands", "fp"), "bands")
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("key", "least")
    banded = members.join(shared, "key").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    of_print = classes(nodes.select(F.col("node").alias("doc_id"), "fp")).withColumnRenamed("fp", "c")
    printed = nodes.join(of_print.hint("merge"), nodes["fp"] == of_print["c"]).filter("node <> component_id").select(F.col("node").alias("a"), F.col("component_id").alias("b"))
    stars = components(banded.unionByName(printed))
    stars = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())  # a root is no node of its own star
    wanted = written(nodes.select("doc_id", "digest", "node").join(stars, "node"), "candidates")
    of = small(wanted.select(F.col("doc_id").alias("of"), F.col("digest").alias("of_digest"), "root", "node"))
    texts = rows.join(of, rows["doc_id"].eqNullSafe(of["of"]) & (rows["digest"] == of["of_digest"])).select("root", "node", "text")
    copied = nodes.filter("rows > 1")
    sets = texts if copied.isEmpty() else texts.dropDuplicates(["node"])
    groups = exact_groups(in_arrow(sets, _set_rows, "root long, node long, n long, shingles binary"), bin_shingles)
    named = wanted.join(groups, "node").select("grp", "doc_id", "digest")
    first = named.groupBy("grp").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp", F.col("first.digest").alias("stays"))
    gone = written(named.join(first, "grp").filter("digest <> stays").select("doc_id", "digest"), "gone")
    if copied.isEmpty():
        return gone
    # of equal texts only the one of the smallest doc_id can stay
    c = small(copied.select(F.col("digest").alias("of_digest"), F.col("doc_id").alias("stays")))
    more = rows.select("doc_id", "digest").join(c, F.col("digest") == F.col("of_digest")).filter(~F.col("doc_id").eqNullSafe(F.col("stays")))
    return gone.unionByName(more.select("doc_id", "digest")).distinct()


def drop_similar(docs: DataFrame, bin_shingles: int = BIN_SHINGLES) -> DataFrame:
    """docs, of each component of similar texts only the row with the smallest doc_id (then the smallest text digest), all columns."""
    return drop_rows(docs, near_copies(docs, bin_shingles))

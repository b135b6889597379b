"""Exact and near copies: edges, a brute-force reading and the parts of the methods."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lamplight.llm import exact_dedup, near_copies, simhash
from lamplight.llm.mph import MinimalPerfectHash, words

from .conftest import EDGES, doc_rows


def test_minimal_perfect_hash_has_each_slot_once():
    keys = words([hashlib.sha256(str(i).encode()).digest() for i in range(5000)])
    h = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(keys).to_bytes())
    assert sorted(h.slots(keys)) == list(range(5000))
    others = words([hashlib.sha256(f"o{i}".encode()).digest() for i in range(2000)])
    slots = h.slots(others)
    assert ((slots >= -1) & (slots < 5000)).all() and not (keys[np.argsort(h.slots(keys))][np.maximum(slots, 0)] == others).all(axis=1).any()


def larger(a, b):
    return b if a is None or (b is not None and b > a) else a


def test_exact_dedup_edges(edges, no_docs):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(edges).collect())
    keep, size = {}, Counter()
    for i, t, _ in EDGES:
        t = t or ""
        keep[t] = larger(keep.get(t), i)
        size[t] += 1
    want = Counter((i, keep[t or ""], size[t or ""], i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in EDGES)
    assert got == want
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_drop_exact_copies_keeps_columns(edges, no_docs):
    out = exact_dedup.drop_exact_copies(edges)
    assert out.columns == edges.columns
    texts = Counter(r.text or "" for r in out.collect())
    assert set(texts) == {t or "" for _, t, _ in EDGES} and max(texts.values()) == 1
    assert {r.doc_id for r in out.collect() if r.text == "same text here now ok"} == {11}
    assert exact_dedup.drop_exact_copies(no_docs).count() == 0


def fingerprint(text, k=3):
    """Straight from the definition."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, f"{f:016x}", least.get(root(i))) for i, (d, f) in enumerate(prints)]


def near_rows(seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 300))]
        for _ in range(r.randint(1, 6)):
            text = list(base)
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append((n, " ".join(text), "s"))
            n += 1
    return rows


def test_simhash_equals_brute_force(spark, edges):
    for rows, df in ((EDGES, edges), (near_rows(), doc_rows(spark, near_rows()))):
        want = Counter(components([(i, fingerprint(t)) for i, t, _ in rows], 2))
        for heavy in (4096, 2):  # the second splits every bucket
            got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_near_dedup(df, heavy=heavy).collect())
            assert got == want


def test_simhash_links_all_pairs_within_the_radius(spark):
    r = random.Random(1)
    prints = []
    for _ in range(60):  # chains whose links differ in one or two bits, at random places
        x = r.getrandbits(64)
        for _ in range(4):
            prints.append(x)
            for b in r.sample(range(64), r.randint(1, 2)):
                x ^= 1 << b
    rows = [(i, x) for i, x in enumerate(dict.fromkeys(prints))]
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in rows], "doc_id long, fp long")
    want = Counter(c for _, _, c in components(rows, 2))
    for heavy in (4096, 1):
        assert Counter(x.component_id for x in simhash.classes(df, heavy=heavy).collect()) == want


def test_masks_cover_every_pair_of_positions():
    masks = simhash.masks()
    assert len(masks) == 7
    for a, b in combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_large_runs_find_the_same_links():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**62, 400, dtype=np.int64) & ~np.int64(0xFFFF)
    keys = np.unique(np.concatenate([base, base ^ 1, base ^ 6, r.integers(0, 2**16, 900)]))
    free = (1 << 64) - 1
    sizes = []
    for small in (10**9, 1):
        simhash.SMALL_RUN, old = small, simhash.SMALL_RUN
        sizes.append(len(simhash._forest(keys, 2, free)[0]))
        simhash.SMALL_RUN = old
    assert sizes[0] == sizes[1] > 400


def test_drop_near_copies(spark, no_docs, edges):
    rows = near_rows()
    df = doc_rows(spark, rows)
    out = simhash.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in components([(i, fingerprint(t)) for i, t, _ in rows], 2)})
    assert simhash.drop_near_copies(no_docs).count() == 0 and simhash.simhash_near_dedup(no_docs).count() == 0
    assert simhash.drop_near_copies(edges).filter(F.col("text") == "same text here now ok").count() <= 1


def shingles(text, k=5):
    w = text.lower().split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)}


def similar_components(rows):
    """All pairs, straight from the definition; the smallest doc_id of each component."""
    sets, parent = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return {rows[root(i)][0] for i in range(len(rows))}


def test_pipeline_drops_copies_of_similarity_four_fifths(spark, edges, no_docs):
    import corpus_pipeline

    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for size in (3, 40, 120, 400):
        base = [r.choice(vocabulary) for _ in range(size)]
        for n in (0, 1, 2, 3, 5, 8, 12, 20):
            text = list(base)
            for _ in range(min(n, size // 12)):
                text[r.randrange(size)] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(text), "s"))
    rows += [(90 + i, " ".join(r.choice(vocabulary) for _ in range(60)), "s") for i in range(9)]
    df = doc_rows(spark, rows)
    want = similar_components(rows)
    out = corpus_pipeline.near_dedup_stage(spark, df, "")
    assert out.columns == df.columns and {x.doc_id for x in out.collect()} == want
    assert want < {x.doc_id for x in simhash.drop_near_copies(df).collect()}  # two bits of a fingerprint leave some of them
    assert near_copies.drop_similar(no_docs).count() == 0 and near_copies.drop_similar(edges).filter(F.col("text") == "same text here now ok").count() == 1


def test_pipeline_takes_simhash_components_as_candidates(spark):
    """Pairs at similarity 4/5 and within two bits that no band holds; a fingerprint alone drops nothing."""
    import corpus_pipeline

    rows = []
    for n in (4181, 16099, 43982):
        text = " ".join([f"w{n}x{i}" for i in range(8)] * 21)
        rows += [(n, text, "s"), (n + 1, f"{text} y{n} z{n}", "s")]
        a, b = (near_copies.shingle_set(t.encode()) for _, t, _ in rows[-2:])
        assert not set(near_copies.bands(a)) & set(near_copies.bands(b)) and 5 * len(np.intersect1d(a, b)) == 4 * len(np.union1d(a, b))
        assert (fingerprint(rows[-2][1]) ^ fingerprint(rows[-1][1])).bit_count() <= 2
    line = "one two three " * 400
    rows += [(i, line + " ".join(f"v{i}x{j}" for j in range(20)), "s") for i in (1, 2)]
    assert (fingerprint(rows[-2][1]) ^ fingerprint(rows[-1][1])).bit_count() <= 2
    df = doc_rows(spark, rows)
    want = similar_components(rows)
    assert want == {1, 2, 4181, 16099, 43982}
    out = corpus_pipeline.near_dedup_stage(spark, df, "")
    assert out.columns == df.columns and sorted(x.doc_id for x in out.collect()) == sorted(want)


def test_similar_groups_equal_all_pairs():
    r = np.random.default_rng(8)
    base = r.integers(0, 2**62, 50, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(50) > 0.12], r.integers(0, 2**62, int(r.integers(1, 9)), dtype=np.uint64)])) for _ in range(120)]
    got = near_copies.similar_groups(sets)
    rows = [(i, s) for i, s in enumerate(sets)]
    near = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
    name = list(range(120))
    for (i, a), (j, b) in combinations(rows, 2):
        if near(a, b):
            name = [name[i] if x == name[j] else x for x in name]
    assert len(set(got)) == len(set(name)) == len(set(zip(got, name, strict=True))) > 1


def test_bins_of_a_component_are_compared_with_each_other(spark):
    r = random.Random(4)
    rows, sets = [], []
    for root in range(3):
        base = r.sample(range(1 << 40), 60)
        chain = [list(base)]
        for _ in range(30):  # neighbours link, far ones do not
            chain.append([x if r.random() > 0.05 else r.getrandbits(40) for x in chain[-1]])
        for s in chain + [r.sample(range(1 << 40), 60) for _ in range(5)]:
            s = np.unique(np.array(s, dtype=np.uint64))
            rows.append((root, len(rows), len(s), bytearray(s.tobytes())))
            sets.append((root, set(s.tolist())))
    df = spark.createDataFrame(rows, "root long, node long, n long, shingles binary")
    parent = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        (a, x), (b, y) = sets[i], sets[j]
        if a == b and 5 * len(x & y) >= 4 * len(x | y):
            old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
            parent = [new if p == old else p for p in parent]
    want = Counter(Counter(parent).values())
    for size in (1 << 20, 500):  # one bin; five of them
        got = {x.node: x.grp for x in near_copies.exact_groups(df, size).collect()}
        assert len(got) == len(rows) and Counter(Counter(got.values()).values()) == want
        assert all(got[i] == got[j] for i, j in enumerate(parent))


def test_fingerprints_over_many_blocks():
    text = " ".join(f"w{i % 977}x{i % 1013}" for i in range(simhash.BLOCK + 900))
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def test_large_lists_give_the_same_rows(spark, edges, monkeypatch):
    """Joins by shuffles in place of broadcasts, and the choice among rows that repeat doc_id and text."""
    from lamplight.llm import mixing, work

    twice = edges.unionByName(edges.withColumn("source", F.lit("another")))
    df = doc_rows(spark, near_rows())

    def results():
        order = lambda d: sorted(map(str, d.collect()))
        return [order(exact_dedup.drop_exact_copies(twice)), order(near_copies.drop_similar(twice)), order(near_copies.drop_similar(df)), order(mixing.mixed_documents(twice))]

    first = results()
    monkeypatch.setattr(work, "SMALL_ROWS", 0)
    assert results() == first
    assert exact_dedup.drop_exact_copies(twice.repartition(5)).select("source").groupBy().agg(F.sum(F.hash("source"))).first() == exact_dedup.drop_exact_copies(twice).select("source").groupBy().agg(F.sum(F.hash("source"))).first()

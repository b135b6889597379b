"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Words are runs of letters; those over LONG_WORD, such as clauses of scripts without spaces, are cut into overlapping
pieces over their whole length, each a word. A word's weight is the mean-scaled sum of its hashed features: itself, its beginnings and its runs of five characters.
A text's value is a bias plus the soft positive parts, softplus(SHARP * (weight - OFFSET)) / SHARP, of its distinct
words' weights, so that a long text is not toxic for its length. Features that two words of the toxic rows share are
trained from confirmed toxic documents and from unlabelled ones by the non-negative risk estimator: with the class
prior p and the logistic loss, p R+(toxic) + max(0, R-(unlabelled) - p R-(toxic)); where the second part falls below
zero its gradient is turned round. The prior is the toxic share of the labelled training rows, which also place the score of 0.3.

Training reads bounded samples of the rows that the label table lists, in the order of a hash of the doc_id: TOXIC_ROWS
confirmed toxic, UNLABELLED_ROWS of any kind whose labels are not looked at (so the prior is theirs) and CLEAN_ROWS
labelled not toxic (for the threshold only). All rows are scored, over whole texts, by a task-local table of word weights of
bounded size. Rows whose crc32(doc_id) mod 4 is 2 are never trained on.

Defined results: null counts as empty; a text without a word has the score of the bias alone; without one toxic
training row every score is 0; conflicting labels of a doc_id count as toxic, null labels not at all; rows that
repeat each keep a row; an empty table gives an empty result; only doc_id and text, doc_id and toxic are read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .token_tables import ChunkTable
from .work import in_arrow, whole_text

FEATURE_BITS = 18
TOXIC_ROWS, UNLABELLED_ROWS, CLEAN_ROWS = 2000, 6000, 3000
CUTOFF = 0.3
ROUNDS, RATE = 50, 0.15
OFFSET, SHARP, LEAST_WORDS = 1.0, 4.0, 2
FOLDS, HELD_OUT = 4, 2
#: Words over LONG_WORD become pieces of PIECE characters that begin every STEP: any STEP + 1 characters in a row are within one.
LONG_WORD, PIECE, STEP = 40, 16, 8
_WORD = re.compile(r"[^\W\d_]+")


def distinct_words(text: str) -> list[str]:
    words = dict.fromkeys(_WORD.findall(text.lower()))
    if max(map(len, words), default=0) <= LONG_WORD:
        return list(words)
    return list(dict.fromkeys(p for w in words for p in ([w] if len(w) <= LONG_WORD else (w[i : i + PIECE] for i in range(0, len(w) - PIECE + STEP, STEP)))))


_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
LEAST_START, MOST_START, RUN = 4, 8, 5
WORD_BLOCK = 1 << 15


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word number) pairs: each word, its beginnings of three to seven characters, its runs of five, its ends marked.

    A feature is the hash of a string; the hashes of all words' strings of a length are worked out at once.
    """
    marked = [f"<{w}>" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    start = np.cumsum(size) - size
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    number = np.arange(len(marked), dtype=np.int32)
    found = [np.fromiter((xxhash.xxh32_intdigest("=" + w) for w in words), np.uint64, len(words)) << np.uint64(32)]
    of = [number]
    h = code
    for n in range(2, MOST_START + 1):
        h = h[:-1] * _BASE + code[n - 1 :]
        if n >= LEAST_START:
            some = size > n
            found.append(h[start[some]] * _MIX)
            of.append(number[some])
        if n == RUN:
            runs = np.maximum(size - RUN, 0)
            at = np.repeat(start + 1 - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
            found.append(h[at] * _MIX)
            of.append(np.repeat(number, runs))
        if len(h) < 2:
            break
    return (np.concatenate(found) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32), np.concatenate(of)


class Examples:
    """Documents as runs of word numbers, words as runs of features."""

    def __init__(self, docs: list[str]):
        """docs: the distinct words of each, with spaces between."""
        numbers: dict[str, int] = {}
        flat, counts = array("i"), array("i")
        for d in docs:
            own = d.split()
            counts.append(len(own))
            flat.extend(numbers.setdefault(w, len(numbers)) for w in own)
        words, n = list(numbers), len(numbers)
        del numbers
        blocks = [features(words[i : i + WORD_BLOCK]) for i in range(0, n, WORD_BLOCK)]
        self.features = np.concatenate([f for f, _ in blocks] or [np.empty(0, np.int32)])
        self.of_word = np.concatenate([o + np.int32(i * WORD_BLOCK) for i, (_, o) in enumerate(blocks)] or [np.empty(0, np.int32)])
        self.per_word = np.bincount(self.of_word, minlength=n)
        del blocks, words
        self.words, self.counts = np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32), np.array(counts, np.int64)
        self.scale = 1 / np.sqrt(self.per_word)
        self.of_doc = np.repeat(np.arange(len(docs), dtype=np.int32), self.counts)

    def word_weights(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.of_word, weights=weights[self.features], minlength=len(self.per_word)) * self.scale

    def over_docs(self, of_words: np.ndarray) -> np.ndarray:
        return np.bincount(self.of_doc, weights=of_words[self.words], minlength=len(self.counts))

    def back(self, of_docs: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        """The gradient in the features' weights."""
        by_word = np.bincount(self.words, weights=of_docs[self.of_doc], minlength=len(self.per_word)) * slopes * self.scale
        return np.bincount(self.features, weights=by_word[self.of_word], minlength=1 << FEATURE_BITS)

    def shared(self, first: int) -> np.ndarray:
        """The features that at least LEAST_WORDS word uses of the first documents have."""
        uses = np.bincount(self.words[: int(self.counts[:first].sum())], minlength=len(self.per_word))
        return np.bincount(self.features, weights=uses[self.of_word], minlength=1 << FEATURE_BITS) >= LEAST_WORDS


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def nn_pu_risk(f: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The risk and its gradient in f; toxic marks the confirmed rows, the others are unlabelled."""
    p, u = toxic, ~toxic
    positive = prior * softplus(-f[p]).mean()
    negative = softplus(f[u]).mean() - prior * softplus(f[p]).mean()
    grad, minus = np.zeros(len(f)), np.zeros(len(f))
    minus[u] = sigmoid(f[u]) / u.sum()
    minus[p] = -prior * sigmoid(f[p]) / p.sum()
    if negative >= 0:
        grad[p] = -prior * sigmoid(-f[p]) / p.sum()
        grad += minus
    else:
        grad = -minus
    return positive + max(0.0, negative), grad


def positive_part(weights: np.ndarray) -> np.ndarray:
    return softplus(SHARP * (weights - OFFSET)) / SHARP


class ToxicityModel:
    """score = sigmoid(slope * (bias + sum of the words' positive parts - threshold) + logit(CUTOFF))"""

    def __init__(self, weights: np.ndarray, bias: float, threshold: float = 0.0, slope: float = 1.0):
        self.weights, self.bias, self.threshold, self.slope = weights.astype(np.float32), bias, threshold, slope

    @classmethod
    def train(cls, toxic: list[str], unlabelled: list[str], prior: float) -> ToxicityModel | None:
        """None without a toxic or an unlabelled example."""
        if not toxic or not unlabelled:
            return None
        x = Examples([*toxic, *unlabelled])
        is_toxic = np.arange(len(x.counts)) < len(toxic)
        used = x.shared(len(toxic))
        w, bias = np.zeros(1 << FEATURE_BITS), math.log(prior / (1 - prior))
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, ROUNDS + 1):  # Adam
            by_word = x.word_weights(w)
            _, g = nn_pu_risk(bias + x.over_docs(positive_part(by_word)), is_toxic, prior)
            gw, gb = np.where(used, x.back(g, sigmoid(SHARP * (by_word - OFFSET))), 0.0), float(g.sum())
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            a, b = 1 - 0.9**t, 1 - 0.999**t
            w -= RATE * (m / a) / (np.sqrt(v / b) + 1e-8)
            bias -= RATE * (mb / a) / (math.sqrt(vb / b) + 1e-8)
        return cls(w, bias)

    def values(self, docs: list[str]) -> np.ndarray:
        if not docs:
            return np.empty(0)
        x = Examples(docs)
        return self.bias + x.over_docs(positive_part(x.word_weights(self.weights)))

    def place(self, toxic: list[str], clean: list[str], prior: float) -> None:
        """Puts the score CUTOFF where the F-measure of labelled training rows is best, in the middle of the gap."""
        ft, fc = self.values(toxic), self.values(clean)
        f = np.concatenate([ft, fc])
        y = np.concatenate([np.ones(len(ft)), np.zeros(len(fc))])
        weight = np.where(y == 1, prior / max(1, len(ft)), (1 - prior) / max(1, len(fc)))
        order = np.argsort(-f, kind="stable")
        hits, taken = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
        best = int(np.argmax(2 * hits / (taken + prior)))
        below = f[order][best + 1] if best + 1 < len(f) else f[order][best] - 1.0
        self.threshold = float((f[order][best] + below) / 2)
        self.slope = float(2.0 / max(1e-3, f.std()))

    def parts(self, words: list[str]) -> list[float]:
        """The positive part of each word's weight."""
        if not words:
            return []
        hashed, of = features(words)
        total = np.bincount(of, weights=self.weights[hashed], minlength=len(words))
        return positive_part(total / np.sqrt(np.bincount(of, minlength=len(words)))).tolist()

    def score(self, total: float) -> float:
        return float(sigmoid(np.float64(self.slope * (self.bias + total - self.threshold) + math.log(CUTOFF / (1 - CUTOFF)))))

    def scorer(self):
        """A function from texts to scores, with a word table of bounded size."""
        table = ChunkTable(self.parts)

        def of(text: str | None) -> float:
            words = distinct_words(text or "")
            part = table.rows(words)
            return self.score(math.fsum([part[w] for w in words]))

        return of


def held_out(column: str = "doc_id") -> Column:
    """The rows that are never trained on."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"))


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, clean_rows: int = CLEAN_ROWS) -> tuple[dict[str, list[str]], float]:
    """Distinct words of the sampled documents, by kind, and the class prior."""
    listed = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & ~held_out())
    listed = listed.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = listed.filter(F.col("toxic").isNotNull())
    n, hits = known.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") > 0)).first()
    prior = min(0.9, max(1e-3, hits / n)) if n else 1e-3

    def some(rows: DataFrame, kind: str, seed: int, limit: int) -> DataFrame:
        return rows.orderBy(_order(seed), "doc_id").limit(limit).select("doc_id").distinct().withColumn("kind", F.lit(kind))

    chosen = some(known.filter("toxic > 0"), "toxic", 1, toxic_rows).unionByName(some(known.filter("toxic <= 0"), "clean", 2, clean_rows)).unionByName(some(listed.select("doc_id"), "unlabelled", 3, unlabelled_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("kind", "doc_id", "text")  # at most the sum of the three limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [" ".join(distinct_words(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.string())], names=["kind", "doc_id", "words"])

    rows = in_arrow(sample, run, "kind string, doc_id long, words string").groupBy("kind", "doc_id").agg(F.max("words").alias("words")).collect()
    out: dict[str, list[str]] = {"toxic": [], "clean": [], "unlabelled": []}
    for r in sorted(rows):
        out[r["kind"]].append(r["words"])
    return out, prior


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    rows, prior = training_rows(docs, labels)
    model = ToxicityModel.train(rows["toxic"], rows["unlabelled"], prior)
    if model:
        model.place(rows["toxic"], rows["clean"], prior)
    return model


def scores(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """(doc_id, score) of every row, over its whole text."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            out = [of(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    s = scores(docs, train(docs, labels))
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs under the cutoff, all columns.

    The model is applied beside the other columns in one pass, so nothing is joined back.
    """
    model = train(docs, labels)
    if model is None:
        return docs
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            keep = [of(t.as_py()) < cutoff for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return in_arrow(docs, run, schema)

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share the corpus's words by weight; a target stops at MAX_EPOCHS times its source's size and the excess is
shared again by weight. A source gives whole epochs first: every document as often as its size fits into the target.
What is left is a budget of words: documents come in the order of exponential keys, -ln(u) / quality weight with u
hashed from the doc_id, and are taken while their running sum stays within the budget. Past that point the sampling
goes on with those that still fit, and at last with the one that comes nearest, so that small sources end close to
their targets too. Documents are always taken whole.

The running sum never sorts a source in one task: keys are cut into bins of about BIN_ROWS documents, bins are summed
and the sums accumulated, and only the bin in which the budget ends is put in order. A source with a third of all rows
has more bins, not a larger task.

Defined results: null text has size 0; a null source comes last and is a source like any other; ties of keys go by
doc_id, then size; rows that repeat are each a document; if nothing has words all targets are 0; an empty table gives
an empty result; only doc_id, text, source and the weights are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import copied_rows, in_arrow, small, text_digest, whole_text, written

MAX_EPOCHS = 3
BIN_ROWS = 1024
SEED = 20_240_607
WEIGHTS = (1, 2, 3)


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, quality_weight) from 0/1 quality labels: 2 for good, 0.5 for poor; unlabelled documents count 1."""
    return labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.when(F.max("quality") > 0, 2.0).otherwise(0.5).alias("quality_weight"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, rows, least_weight, target, pos) of each source; the windows run over one row a source, in one
    task, so there should be no more than some millions of sources.

    With sources in the order of cap / weight, those before the first k whose share of what the earlier ones leave is
    under its cap get their caps; the others get that share by weight. This is where repeated resharing ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"), F.min("quality_weight").alias("least_weight"))
    named = per.withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = named.withColumn("weight", F.element_at(cycle, (F.col("pos") - 1) % len(weights) + 1)).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - (F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    weight_left = F.sum("weight").over(everything) - (F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight"))
    shared = w.withColumn("share", left / weight_left).withColumn("k", F.row_number().over(order))
    fits = F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct("k", "share"))
    level = F.min(fits).over(everything)
    target = F.when(level.isNull() | (F.col("k") < level["k"]), F.col("cap")).otherwise(F.least(level["share"] * F.col("weight"), F.col("cap")))
    return shared.select("source", "source_size", "rows", "least_weight", target.alias("target"), "pos")


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of boundary bins, sorted by (pos, key, doc_id, size): one more copy for those that the budget takes."""
    group, left, best = None, 0.0, None  # best: row, size
    rows: list[tuple] = []

    def end() -> None:
        if best:
            rows.append((*best[0], best[0][-1] + int(best[1] - left < left)))

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(cols[i], t) for i, t in ((0, pa.int64()), (1, pa.binary()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64()), (7, pa.int32()))], names=["doc_id", "digest", "size", "source_size", "target", "copies"])

    for b in batches:
        cols = b.to_pydict()
        for doc_id, digest, size, source_size, target, pos, room, epochs in zip(*[cols[c] for c in ("doc_id", "digest", "size", "source_size", "target", "pos", "room", "epochs")], strict=True):
            if pos != group:
                end()
                group, left, best = pos, room, None
            row = (doc_id, digest, size, source_size, target, pos, epochs)
            if size <= left:
                left -= size
                rows.append((*row, epochs + 1))
            elif best is None or size < best[1]:
                if best:
                    rows.append((*best[0], best[0][-1]))
                best = (row, size)
            else:
                rows.append((*row, epochs))
        yield out()
        rows = []
    end()
    yield out()


def mix_copies(docs: DataFrame, weights: DataFrame | None = None, digest: bool = False, bin_rows: int = BIN_ROWS) -> DataFrame:
    """(doc_id, digest, size, source_size, target, copies) of each row of docs; digest only on demand."""
    words = F.regexp_count(whole_text(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), (text_digest() if digest else F.lit(None).cast("binary")).alias("digest"))
    if weights is not None:
        sizes = sizes.join(weights.select(F.col("doc_id").alias("of"), "quality_weight"), F.col("doc_id") == F.col("of"), "left").drop("of")
    else:
        sizes = sizes.withColumn("quality_weight", F.lit(1.0))
    sizes = written(sizes.withColumn("quality_weight", F.coalesce("quality_weight", F.lit(1.0))), "sizes")
    s = source_targets(sizes).withColumnRenamed("source", "of")
    s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("int"))
    s = s.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))).withColumn("bins", F.ceil(F.col("rows") / bin_rows))
    s = written(s, "targets")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    key = -F.log(u) / F.col("quality_weight")
    keyed = sizes.withColumn("key", key).join(small(s), F.col("source").eqNullSafe(F.col("of")))
    # by the least weight no bin gets more than (weight / least weight) times its share of the documents of a weight
    place = F.least(F.floor((1 - F.exp(-F.col("key") * F.col("least_weight"))) * F.col("bins")), F.col("bins") - 1)
    keyed = written(keyed.withColumn("bin", place.cast("long")).drop("of", "source", "quality_weight", "rows", "bins", "least_weight"), "keyed")
    sums = keyed.groupBy("pos", "bin").agg(F.sum("size").alias("in_bin"))
    to = F.sum("in_bin").over(Window.partitionBy("pos").orderBy("bin"))
    bins = sums.select(F.col("pos").alias("p"), F.col("bin").alias("b"), to.alias("to"), (to - F.col("in_bin")).alias("before"))
    rows = keyed.join(bins, (F.col("pos") == F.col("p")) & (F.col("bin") == F.col("b"))).drop("p", "b")
    cut = (F.col("before") < F.col("budget")) & (F.col("to") > F.col("budget"))
    names = ["doc_id", "digest", "size", "source_size", "target"]
    whole = rows.filter(~cut).select(*names, (F.col("epochs") + ((F.col("to") <= F.col("budget")) & (F.col("budget") > 0)).cast("int")).alias("copies"))
    edge = rows.filter(cut).withColumn("room", F.col("budget") - F.col("before")).select(*names, "pos", "room", "epochs", "key")
    filled = in_arrow(edge.repartition("pos").sortWithinPartitions("pos", "key", "doc_id", "size"), _fill, "doc_id long, digest binary, size long, source_size long, target double, copies int")
    return whole.unionByName(filled)


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words), copies."""
    return mix_copies(docs, weights, bin_rows=bin_rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    copies = mix_copies(docs, weights, digest=True).groupBy("doc_id", "digest").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    return copied_rows(docs, copies)

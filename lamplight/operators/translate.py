"""Translation through an injected model: pieces, guards and a cache that is a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.functions.chunking import PIECE, translation_pieces
from lamplight.functions.naming import cache_key
from lamplight.functions.quality import check_translation, has_translatable, is_refusal, strip_commentary
from lamplight.functions.strings import strip, text_or_empty
from lamplight.sources.shared import in_pandas

MOST_SOURCE = 4000
CACHE = "cache_key string, model string, status string, english string, reasons array<string>, metrics map<string,double>, source_chars int"


def is_available(model: str, listing: Callable[[], list[str]]) -> tuple[bool, str]:
    """Whether an injected listing of models can be read and names the model, up to its tag; and a message."""
    try:
        names = listing()
    except Exception as e:  # a service may be away in any way
        return False, f"the model service does not answer: {e}"
    if any(n == model or n.split(":")[0] == model.split(":")[0] for n in names):
        return True, "ready"
    return False, f"there is no model {model}"


def pieces(rows: DataFrame, key: str = "cache_key", text: str = "source", most: int = PIECE) -> DataFrame:
    """(key, ord, piece, wanted): the pieces of each text and whether there is anything to translate in one."""
    return translation_pieces(rows, key, text, most).withColumn("wanted", has_translatable("piece"))


def translate(rows: DataFrame, model: str, generate: Callable[[pd.Series], pd.Series], cache: DataFrame | None = None, text: str = "text", force: bool = False, available: tuple[bool, str] = (True, "ready")) -> tuple[DataFrame, DataFrame]:
    """(results, new cache rows) of the distinct excerpts of rows[text].

    available: what `is_available` says; where the model is away, what the cache does not know is `unavailable`.

    generate maps a batch of pieces to outputs, on executors; it is called once for each piece of what the cache does
    not know. Failures are cached like successes. An excerpt is stripped, then cut to MOST_SOURCE characters.
    """
    source = F.substring(strip(text_or_empty(text)), 1, MOST_SOURCE)
    every = rows.select(source.alias("source")).distinct().withColumn("cache_key", cache_key(F.lit(model), F.col("source")))
    blank = every.filter(F.length("source") == 0)
    todo = every.filter(F.length("source") > 0)
    known = None
    if cache is not None and not force:
        known = todo.join(latest(cache), "cache_key").withColumn("cached", F.lit(True))
        todo = todo.join(cache.select("cache_key"), "cache_key", "left_anti")

    if not available[0]:
        away = todo.select("cache_key", F.lit(model).alias("model"), F.lit("unavailable").alias("status"), F.lit("").alias("english"), F.array(F.lit(available[1])).alias("reasons"), F.create_map().cast("map<string,double>").alias("metrics"), F.length("source").alias("source_chars"), "source", F.lit(False).alias("cached"))
        results = away.unionByName(_blank(blank, model))
        if known is not None:
            results = results.unionByName(known.select(*results.columns))
        return results, away.limit(0).drop("source", "cached")

    cut = pieces(todo)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["output"] = generate(b["piece"])
            yield b[["cache_key", "ord", "piece", "output"]]

    asked = in_pandas(cut.filter("wanted").select("cache_key", "ord", "piece"), run, "cache_key string, ord int, piece string, output string")
    kept = asked.select("cache_key", "ord", "piece", F.when(~is_refusal("output"), strip_commentary("output")).alias("c"))
    # an excerpt has MOST_SOURCE characters, so few pieces
    good = F.filter(F.array_sort(F.collect_list(F.struct("ord", F.col("piece").alias("p"), F.col("c.text").alias("t"), F.coalesce("c.removed", F.lit(0)).alias("r")))), lambda x: F.lit(True))
    joined = kept.groupBy("cache_key").agg(good.alias("x"))
    texts = F.filter(F.transform("x", lambda x: x["t"]), lambda t: F.coalesce(F.length(t) > 0, F.lit(False)))
    done = joined.select("cache_key", strip(F.array_join(texts, "\n\n")).alias("out"), F.array_join(F.transform("x", lambda x: x["p"]), "\n").alias("asked"), (F.size("x") - F.size(texts)).alias("lost"), F.aggregate("x", F.lit(0), lambda a, x: a + x["r"]).alias("removed"))
    skipped = cut.groupBy("cache_key").agg(F.count_if(~F.col("wanted")).alias("skipped"))
    all_ = todo.join(done, "cache_key", "left").join(skipped, "cache_key", "left")
    checked = all_.withColumn("check", check_translation(F.coalesce("asked", "source"), "out"))
    extra = F.create_map(F.lit("chunks_dropped"), (F.coalesce("lost", F.lit(0)) + F.coalesce("skipped", F.lit(0))).cast("double"), F.lit("commentary_lines_removed"), F.coalesce("removed", F.lit(0)).cast("double"))
    fresh = checked.select(
        "cache_key", F.lit(model).alias("model"), F.when(F.col("check.ok"), "ok").otherwise("failed").alias("status"), F.when(F.col("check.ok"), F.col("out")).otherwise(F.lit("")).alias("english"),
        F.col("check.reasons").alias("reasons"), F.map_concat("check.metrics", extra).alias("metrics"), F.length("source").alias("source_chars"),
    )
    named = fresh.join(todo, "cache_key").withColumn("cached", F.lit(False))
    results = named.unionByName(_blank(blank, model))
    if known is not None:
        results = results.unionByName(known.select(*results.columns))
    return results, fresh


def _blank(blank: DataFrame, model: str) -> DataFrame:
    return blank.select("cache_key", F.lit(model).alias("model"), F.lit("failed").alias("status"), F.lit("").alias("english"), F.array(F.lit("empty source")).alias("reasons"), F.create_map().cast("map<string,double>").alias("metrics"), F.lit(0).alias("source_chars"), "source", F.lit(False).alias("cached"))


def latest(cache: DataFrame, order: str = "put_at") -> DataFrame:
    """One row a key of an append-only cache: the last by order; where a cache has no such column, that with the largest JSON form."""
    rest = [c for c in cache.columns if c != "cache_key"]
    pick = F.max_by(F.struct(*rest), F.col(order) if order in rest else F.to_json(F.struct(*rest)))
    return cache.groupBy("cache_key").agg(pick.alias("__v")).select("cache_key", "__v.*")


def audit(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(field, source, output, check) of each pair of columns with both sides; pairs with an empty side are skipped."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("field"), text_or_empty(s).alias("source"), text_or_empty(o).alias("output")) for s, o in pairs])).alias("p")
    keep = (F.length(strip("source")) > 0) & (F.length(strip("output")) > 0)
    return rows.select("*", each).select(*[c for c in rows.columns if c not in ("source", "output", "field")], "p.*").filter(keep).withColumn("check", check_translation("source", "output"))

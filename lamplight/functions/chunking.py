"""Windows of a text with exact offsets, and pieces for translation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.sources.shared import small_batches

from .naming import chunk_id
from .strings import is_blank, let, strip, text_or_empty

SIZE, OVERLAP = 800, 100
PIECE = 900


def windows(text: Column | str, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<struct<chunk, start, end>>: the stripped window and its raw bounds; blank windows are dropped."""
    t = text_or_empty(text)
    n, step = F.length(t), max(1, size - overlap)
    last = F.ceil(F.greatest(F.lit(0), n - size) / step).cast("int")
    # the text is cut once into steps; a window is a step and as much of those behind it as it overlaps
    steps = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def window(parts: Column, k: Column) -> Column:
        more = F.array_join(F.slice(parts, k + 2, F.lit(-(-(size - step) // step))), "") if size > step else F.lit("")
        return F.struct(strip(F.concat(parts[k], F.substring(more, 1, max(0, size - step)))).alias("chunk"), (k * step).alias("start"), F.least(k * step + size, n).alias("end"))

    cut = let(steps, lambda parts: F.transform(F.sequence(F.lit(0), last), lambda k: window(parts, k)))
    none = F.array().cast("array<struct<chunk:string,start:int,end:int>>")
    return F.filter(F.when(n > 0, cut).otherwise(none), lambda w: F.length(w["chunk"]) > 0)


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each window of docs (state_key, id, text): chunk_id, doc_id, state_key, chunk_index, hi_start, hi_end, document."""
    cut = docs.filter(~is_blank("text")).select("state_key", F.col("id").alias("doc_id"), F.posexplode(windows("text", size, overlap)).alias("chunk_index", "w"))
    return cut.select(chunk_id("state_key", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "state_key", "chunk_index", F.col("w.start").alias("hi_start"), F.col("w.end").alias("hi_end"), F.col("w.chunk").alias("document"))


# Where a paragraph is cut, in the order of preference.
SEPARATORS = ("। ", ". ", "।", "? ", "! ", "; ", ", ", " ")


def pieces_of(text: str | None, most: int = PIECE) -> list[str]:
    """Each paragraph in pieces of at most `most` characters, cut behind the last separator of the best kind."""
    out: list[str] = []
    for paragraph in (text or "").split("\n"):
        rest = paragraph.strip()
        while len(rest) > most:
            ends = (at + len(s) for s in SEPARATORS if (at := rest.rfind(s, 1, most)) > 0)
            cut = next(ends, most)
            out.append(rest[:cut].strip())
            rest = rest[cut:].strip()
        out.append(rest)
    return [p for p in out if p]


def split_for_translation(most: int = PIECE):
    """A vectorised function from text to array<string>; each cut depends on the one before it."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pieces_of(t, most))

    return split


def translation_pieces(rows: DataFrame, key: str, text: str = "text", most: int = PIECE) -> DataFrame:
    """(key, ord, piece) of the texts of rows, which go to Python in small batches."""
    small_batches(rows.sparkSession)
    return rows.select(key, F.posexplode(split_for_translation(most)(F.col(text))).alias("ord", "piece"))

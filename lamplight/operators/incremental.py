"""Incremental work: what is still to do, numbers and names for it, and dates brought up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions.dates import extract_date
from lamplight.functions.strings import or_default
from lamplight.sources.shared import stored


def last_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by order; aggregated before the shuffle, so a hot key is one row a task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(*keys, "__last.*")


def not_yet(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in done; keys count once there, so copies do not multiply."""
    return rows.join(done.select(*keys), keys, "left_anti")


def unseen(rows: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each new key, in the order of discovery."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__first")).select(key, "__first.*")
    return not_yet(first, seen, [key]).select(*rows.columns)


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None, base: Column | int = 0, name: str = "number") -> DataFrame:
    """name: base + 1, base + 2, ... in order, within each group of `by`.

    Without groups rows are range-partitioned by the order and numbered by the counts of the partitions before, so no
    task sorts the whole table.
    """
    start = F.lit(base) if isinstance(base, int) else base
    if by:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + start)
    # stored, as another run of the range partitioning may cut elsewhere
    placed = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a partition
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.join(before, "__part").withColumn(name, local + F.col("__before") + start).drop("__part", "__before")


def next_number(names: DataFrame, column: str, pattern: str = r"(\d+)$") -> DataFrame:
    """next: one past the largest trailing number, 1 if there is none."""
    n = F.regexp_extract(F.coalesce(F.col(column), F.lit("")), pattern, 1).try_cast("bigint")
    return names.agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))


def disambiguated(rows: DataFrame, stem: str, index: str, taken: DataFrame, name: str = "filename") -> DataFrame:
    """<stem>.pdf, or <stem>_<index>.pdf for all but the first row of a stem and where the name is taken already."""
    named = F.concat(F.col(stem), F.lit(".pdf"))
    stored = taken.select(F.col(name).alias("__taken")).distinct()
    rank = F.row_number().over(Window.partitionBy(stem).orderBy(index))
    marked = rows.withColumn("__rank", rank).join(stored, named == F.col("__taken"), "left")
    other = F.concat(F.col(stem), F.lit("_"), F.col(index).cast("string"), F.lit(".pdf"))
    return marked.withColumn(name, F.when((F.col("__rank") > 1) | F.col("__taken").isNotNull(), other).otherwise(named)).drop("__rank", "__taken")


def with_metadata(files: DataFrame, metadata: DataFrame, fields: dict[str, str], order: str, keys: tuple[str, ...] = ("state_key", "filename")) -> DataFrame:
    """Files with the last metadata row of their name; fields: column -> default where there is none."""
    last = last_by(metadata.select(*keys, order, *fields), list(keys), order).drop(order)
    joined = files.join(last, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in fields.items()})


def backfill_dates(processed: DataFrame, metadata: DataFrame, order: str = "doc_ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(processed, metadata, counts): dates read again from the texts go before old ones, and into the metadata.

    Of documents with equal names the last decides; counts has docs and dated, those in which a date was found.
    """
    found = processed.withColumn("__found", extract_date("text"))
    new = found.withColumn("document_date", F.coalesce("__found", F.nullif("document_date", F.lit(""))))
    counts = found.agg(F.count(F.lit(1)).alias("docs"), F.count("__found").alias("dated"))
    dates = new.filter(F.col("document_date").isNotNull()).groupBy("state_key", "filename").agg(F.max_by("document_date", order).alias("__date"))
    synced = metadata.join(dates, ["state_key", "filename"], "left").withColumn("document_date", F.coalesce("__date", "document_date")).drop("__date")
    return new.drop("__found"), synced, counts


def processed_records(files: DataFrame, text: Column, table_date: str = "table_date", crawl_date: str = "document_date") -> DataFrame:
    """Files joined with metadata as processed documents: the date by precedence, the length of the text."""
    dated = or_default(F.nullif(F.col(table_date), F.lit("")), F.coalesce(extract_date(text), F.nullif(F.col(crawl_date), F.lit(""))))
    return files.withColumns({"document_date": dated, "text": text, "char_count": F.length(text)})


def missing_langpacks(langs: Column, installed: Column | None) -> Column:
    """What langs (a+b) asks for and is not installed, in order, repeats kept; nothing if what is installed is unknown."""
    if installed is None:
        return F.array().cast("array<string>")
    return F.coalesce(F.filter(F.split(langs, r"\+"), lambda x: (x != "") & ~F.array_contains(installed, x)), F.array().cast("array<string>"))


def resolve_stored(paths: DataFrame, listing: DataFrame, dirs: list[str], path: str = "path") -> DataFrame:
    """paths with `resolved`: an absolute path as it is, else the first of the roots (the own one, then dirs by name) that holds it."""
    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    roots = F.array(*[F.lit(d) for d in ["", *sorted(f"{d}/" for d in dirs)]])
    tried = paths.select(F.col(path).alias("__stored")).distinct().select("__stored", F.posexplode(F.transform(roots, lambda r: F.concat(r, F.replace(F.col("__stored"), F.lit("\\"), F.lit("/"))))).alias("__order", "__try"))
    there = tried.join(listing.select(F.col("path").alias("__try")).distinct(), "__try").groupBy("__stored").agg(F.min_by("__try", "__order").alias("__found"))
    joined = paths.join(there, paths[path] == there["__stored"], "left")
    return joined.withColumn("resolved", F.when(p.startswith("/"), p).otherwise(F.col("__found"))).drop("__stored", "__found")

"""Writing tables so that readers see the old or the new state and nothing between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    """(file system, Path) of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put_over(spark: SparkSession, source, target) -> None:
    """Renames over what is there in one step."""
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = kind.getField("OVERWRITE").get(None)
    context.rename(source, target, options)


def write_version(df: DataFrame, path: str) -> str:
    """A new version beside the old ones, then a pointer to it, renamed over the old one: readers see one or the other."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    spark = df.sparkSession
    fs, target = _fs(spark, f"{path}/{_POINTER}")
    _, temp = _fs(spark, f"{path}/{_POINTER}-{version}")
    out = fs.create(temp)
    out.write(bytearray(version.encode()))
    out.close()
    _put_over(spark, temp, target)
    return version


def read_version(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.text(f"{path}/{_POINTER}").first()[0]
    return spark.read.parquet(f"{path}/{version}")


def replace_partitions(df: DataFrame, path: str, key: str, emptied: DataFrame | None = None) -> None:
    """Writes df over its partitions of a table; partitions of `emptied` (key) that df has no row for are dropped.

    A portal that has documents but no text left must lose its old rows, which overwriting alone would leave.
    """
    spark = df.sparkSession
    gone = []
    if emptied is not None:
        there = df.select(F.col(key).alias("__key")).distinct()
        gone = [r[0] for r in emptied.select(key).distinct().join(there, F.col(key).eqNullSafe(F.col("__key")), "left_anti").collect()]  # a row a portal
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    named = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for value in gone:
        fs, p = _fs(spark, f"{path}/{named.getPartitionPathString(key, None if value is None else str(value))}")
        fs.delete(p, True)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert_cache(new: DataFrame, path: str) -> None:
    """An append-only cache; `latest` reads the last row of a key by put_at. What was unavailable is not kept."""
    append(new.filter(F.col("status") != "unavailable").withColumn("put_at", F.current_timestamp()), path)


def orphans(directories: DataFrame, segments: DataFrame, collections: DataFrame, name: str = "name") -> DataFrame:
    """Directories with names like identifiers (36 characters) that neither table refers to."""
    used = segments.select(F.col("id").alias(name)).unionByName(collections.select(F.col("id").alias(name)))
    return directories.filter(F.length(name) == 36).join(used.distinct(), name, "left_anti")


def delete_orphans(spark: SparkSession, root: str, names: DataFrame, name: str = "name") -> int:
    """Deletes the directories under root that names lists, such as those of `orphans`; how many there were."""
    n = 0
    for r in names.select(name).toLocalIterator():
        fs, p = _fs(spark, f"{root.rstrip('/')}/{r[0]}")
        n += bool(fs.delete(p, True))
    return n


def replace_if_any(df: DataFrame, path: str) -> bool:
    """Stores a synced table only if it has rows, so that an empty answer does not wipe the last good one."""
    if df.isEmpty():
        return False
    write_version(df.withColumn("synced_at", F.current_timestamp()), path)
    return True

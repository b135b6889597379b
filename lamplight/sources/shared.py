"""Intermediate tables in the folder that the whole cluster shares, and the batches that go to Python."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master may leave it unset, as in tests, and gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lamplight-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: What this process has put into the shared folder.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> int:
    """Deletes what this process has put into the shared folder; for when all results that were read from it are stored."""
    n = 0
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: what follows sees the same rows in every job, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch; Spark's own default lets a task hold 64 MB of texts in the JVM and as much in Python.
BATCH_BYTES = 8 << 20
SPARK_BATCH = "67108864b"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES, or of what the session sets: where it sets none, this does."""
    if spark.conf.get(_BATCH_SETTING) == SPARK_BATCH:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def in_pandas(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """df.mapInPandas in small batches."""
    small_batches(df.sparkSession)
    return df.mapInPandas(run, schema)

"""Incremental ingestion as a stream: the checkpoint is the set of what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def record_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """New JSON-lines files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def unseen_stream(rows: DataFrame, key: str = "pdf_url", time: str | None = None, horizon: str = "30 days") -> DataFrame:
    """The first row of each key; with an event time, keys are forgotten past the horizon, so state stays bounded."""
    if time:
        return rows.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def resume(run: Callable[[], None], done: Callable[[], int], most: int = 5, pause: Callable[[], None] = lambda: None) -> tuple[str, int, int]:
    """(status, attempts, gained) of a job that is run again after a failure as long as it gets on.

    done counts what is finished. A failed run that finished something is run again, up to `most` runs in all (then:
    gave-up); the first failure gets a second run in any case, later ones without progress end it (stuck).
    """
    began = before = done()
    for attempt in range(1, most + 1):
        try:
            run()
            return "ok", attempt, done() - began
        except Exception as e:  # whatever ended it, what counts is whether it gets on
            print(f"attempt {attempt} failed: {e}")
        now = done()
        if now <= before and attempt >= 2:
            return "stuck", attempt, now - began
        before = now
        if attempt < most:
            pause()
    return "gave-up", most, before - began


def run_batches(rows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Processes what is there in batches and stops; a batch is handed to the sink again if its commit was lost."""
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

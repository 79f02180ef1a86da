"""Change feeds and event-time aggregation with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from keylake.operators.log import KEY
from keylake.sources.log_table import COMMIT_SCHEMA, RecordLog, change_rows


def commit_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Commits of a record log as they come; each is one file, seen whole and once."""
    return spark.readStream.schema(COMMIT_SCHEMA).option("maxFilesPerTrigger", per_trigger).json(f"{path}/_commits")


def follow(spark: SparkSession, path: str, handle: Callable[[DataFrame, int], None], schemas: list[str] | None = None, per_trigger: int = 100) -> DataStreamWriter:
    """A writer that hands the changes of each micro-batch's commits to handle(changes, batch id).

    A micro-batch names at most per_trigger batches of the log; compactions bring no changes and are passed over. Who follows
    a log compares its epoch(): a new one means that it was restored. After a failure a batch comes again with the same id.
    """

    def batch(commits: DataFrame, batch_id: int) -> None:
        batches = [r[0] for r in commits.where("base IS NULL").select("batch").collect()]
        if batches:
            rows = change_rows(RecordLog(spark, path), batches, ["seq", *KEY, "deleted"])
            handle(rows.where(F.col("schema").isin(schemas)) if schemas else rows, batch_id)

    return commit_stream(spark, path, per_trigger).writeStream.foreachBatch(batch)


def every(spark: SparkSession, period: str, job: Callable[[int], None]) -> DataStreamWriter:
    """A writer that runs job(run number) once a period, as an expiry sweep does; the first run is at once."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: job(n)).trigger(processingTime=period)


def distinct_entries(entries: DataFrame, time: str, delay: str) -> DataFrame:
    """Entries once each: the same hash again within the watermark is a duplicate and goes."""
    return entries.withWatermark(time, delay).dropDuplicatesWithinWatermark(["entry_hash"])


def windowed(events: DataFrame, time: str, size: str, keys: list[str], delay: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums of `value` per time window and keys; with a delay, late rows beyond it are dropped in a stream."""
    rows = events.withWatermark(time, delay) if delay else events
    return rows.groupBy(F.window(time, size, slide), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], delay: str | None = None) -> DataFrame:
    """Sessions of keys: events closer than the gap belong together."""
    rows = events.withWatermark(time, delay) if delay else events
    return rows.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))

"""Change events of files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What may happen to a path. Fixed values.
KINDS = ["opened", "created", "changed", "deleted", "rescan"]


def stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Change events from Parquet files that arrive in a folder; a pattern with a wildcard watches the files it matches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def latest(events: DataFrame, key: str, at: str, values: list[str], late: str | None = None) -> DataFrame:
    """The last event of each key by time, ties by the values; works on batches and, with complete or update output, on streams.

    ``late``: events that come later than this after the newest may be forgotten (streams).
    """
    known = events.withWatermark(at, late) if late else events
    return known.groupBy(key).agg(F.max(F.struct(at, *values)).alias("e")).select(key, f"e.{at}", *[f"e.{v}" for v in values])


def sessions(events: DataFrame, key: str, at: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of changes of a key: a burst ends after ``gap`` without an event."""
    grouped = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(df: DataFrame, folder: str, checkpoint: str, mode: str = "complete") -> None:
    """Take all that has arrived, write the state to a Parquet folder, and stop."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()

"""Ambiguous deletions told apart by what is known of a path when they happen: as a stream with state, and as one batch.

An event has key, seq, at and kind: ``created_file``, ``created_folder``, ``changed``, ``deleted`` (of what, the watcher does not say) or ``rescan`` (events of this path were lost).
A deletion becomes ``deleted_file`` or ``deleted_folder`` if the path's last creation is known, else ``deleted_unknown``. What is known ends with a deletion, a rescan, or when no event of the path came
for ``ttl`` seconds: that is judged by the events' own times, so a result does not depend on how a stream was cut into batches; the timer only frees the state of paths
that the watermark has left behind.

The stream needs each path's events in order of (at, seq) from batch to batch; within a batch they may stand in any order. An event that comes more than ``late`` behind the newest
one of all paths is dropped, as by any watermark: ``late`` has to exceed the disorder between paths. Events with a null key are one path; null kinds count as ``changed``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.shipping import ship

CREATED = {"created_file": "deleted_file", "created_folder": "deleted_folder"}
REFINED = "key string, seq long, kind string"


def batch(events: DataFrame, ttl: int) -> DataFrame:
    """(key, seq, kind) of all events, by windows: runs without a long gap, and in a run the last event that tells or ends what is known."""
    lane = Window.partitionBy("key").orderBy("at", "seq")
    at = F.unix_micros(F.col("at").cast("timestamp"))
    gap = F.coalesce(at - F.lag(at).over(lane) > ttl * 1_000_000, F.lit(False))
    runs = events.withColumn("_gap", gap).withColumn("_run", F.sum(F.col("_gap").cast("int")).over(lane.rowsBetween(Window.unboundedPreceding, 0)))
    telling = F.when(F.col("kind").isin("created_file", "created_folder", "deleted", "rescan"), F.col("kind"))
    before = Window.partitionBy("key", "_run").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(telling, ignorenulls=True).over(before)
    told = F.when(known == "created_file", "deleted_file").when(known == "created_folder", "deleted_folder").otherwise("deleted_unknown")
    return runs.select("key", "seq", F.when(F.col("kind") == "deleted", told).otherwise(F.coalesce("kind", F.lit("changed"))).alias("kind"))


class Refiner(StatefulProcessor):
    """State by path: the last creation's kind if it still holds, and the time of the last event, in microseconds."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "kind string, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kind, last = self.known.get() if self.known.exists() else (None, None)
        events = pd.concat(list(rows)).sort_values(["micros", "seq"])
        out = []
        for seq, at, what in zip(events["seq"], events["micros"], events["kind"], strict=True):
            kind = None if last is not None and at - last > self.ttl * 1_000_000 else kind
            last, told = int(at), what or "changed"
            if told == "deleted":
                told = CREATED.get(kind, "deleted_unknown")
                kind = None
            elif told == "rescan":
                kind = None
            elif told in CREATED:
                kind = told
            out.append(told)
        self.known.update((kind, last))
        # One timer per path: the earlier one ends where a later event moves it.
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(last // 1000 + self.ttl * 1000 + 1)
        yield pd.DataFrame({"key": [key[0]] * len(out), "seq": events["seq"].to_numpy(), "kind": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.known.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "seq": pd.Series([], dtype="int64"), "kind": pd.Series([], dtype=str)})

    def close(self) -> None:
        pass


def refined(events: DataFrame, ttl: int, late: str = "7 days") -> DataFrame:
    """(key, seq, kind) of a stream of events; ``late``: the disorder allowed between paths; their state is freed ``ttl`` later."""
    ship(events.sparkSession)
    timed = events.select("key", "seq", F.col("at").cast("timestamp").alias("at"), "kind").withWatermark("at", late)
    columns = timed.withColumn("micros", F.unix_micros("at"))
    return columns.groupBy("key").transformWithStateInPandas(Refiner(ttl), REFINED, "Append", "EventTime")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that such state needs, for the streams started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def run_once(events: DataFrame, ttl: int, folder: str, checkpoint: str, late: str = "7 days") -> None:
    """Take all that has arrived, add the refined events to a Parquet folder exactly once, and stop."""
    with state_store(events.sparkSession):
        stream = refined(events, ttl, late).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()

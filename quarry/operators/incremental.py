"""Results kept by digest: only files that changed are analysed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refresh(files: DataFrame, known: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results (path, digest, ...) for ``files`` (path, text): those of ``known`` with the same path and digest, else new ones.

    Files that are gone lose their results. Results of one file may be many rows; a file without results is analysed again.
    """
    now = files.withColumn("digest", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    same = known.join(now.select("path", "digest"), ["path", "digest"], "left_semi")
    stale = now.join(known.select("path", "digest").distinct(), ["path", "digest"], "left_anti")
    fresh = analyse(stale.select("path", "text")).join(stale.select("path", "digest"), "path")
    return same.unionByName(fresh.select(same.columns))


def normalised(events: DataFrame) -> DataFrame:
    """Change events with a rename as a deletion and a creation; ``events`` has seq, kind, path, target."""
    parts = F.when(
        F.col("kind") == "renamed",
        F.array(F.struct(F.lit(0).alias("part"), F.lit("deleted").alias("kind"), F.col("path")), F.struct(F.lit(1).alias("part"), F.lit("created").alias("kind"), F.col("target").alias("path"))),
    ).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.col("kind"), F.col("path"))))
    return events.select("seq", F.explode(parts).alias("e")).select("seq", "e.part", "e.kind", "e.path")


def state(events: DataFrame) -> DataFrame:
    """Per path the last event's kind, and whether a later rescan makes it uncertain."""
    rescan = events.filter("kind = 'rescan'").agg(F.max("seq")).first()[0]
    last = events.filter("kind <> 'rescan'").groupBy("path").agg(F.max(F.struct("seq", "part", "kind")).alias("e"))
    return last.select("path", "e.kind", (F.col("e.seq") < F.lit(-1 if rescan is None else rescan)).alias("uncertain"))

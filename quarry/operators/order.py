"""Ordered event lanes: bags of events whose order is the information."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lane(events: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """``events`` with ``seq`` from 0 within each scope; nothing is sorted by value or de-duplicated."""
    window = Window.partitionBy(scope).orderBy(*order)
    return events.withColumn("seq", F.row_number().over(window) - 1)


def relation(events: DataFrame, scope: list[str], name: str, seq: str, a: str, b: str) -> DataFrame:
    """Per scope whether all ``a`` stand before all ``b``, after them, or neither (missing, equal names or interleaved)."""
    places = events.filter(F.col(name).isin(a, b)).groupBy(*scope).agg(
        *[f(F.when(F.col(name) == x, F.col(seq))).alias(f"{n}_{k}") for k, x in (("a", a), ("b", b)) for n, f in (("min", F.min), ("max", F.max))]
    )
    said = F.when(F.lit(a == b), "unknown").when(F.col("max_a") < F.col("min_b"), "before").when(F.col("max_b") < F.col("min_a"), "after").otherwise("unknown")
    scopes = events.select(*scope).distinct()
    return scopes.join(places, scope, "left").select(*scope, said.alias("relation"))


def per_lane(events: DataFrame, lanes: DataFrame) -> DataFrame:
    """Events by lane; lanes without events count 0."""
    counted = events.groupBy("lane").agg(F.count(F.lit(1)).alias("n"))
    return lanes.join(counted, "lane", "left").select("lane", F.coalesce("n", F.lit(0)).alias("n"))

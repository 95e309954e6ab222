"""Prefixes as intervals of ordered keys: every prefix of a table at once, of any length.

The keys that begin with p are those from p up to the least text behind all of them. Distinct keys and both ends of every prefix's interval are dealt in ranges and counted in order, so that an end becomes
the number of distinct keys (and of rows) before it: two subtractions count a prefix, whatever it holds, and nested prefixes cost nothing more. For the rows themselves the
intervals over numbers are joined to the numbered keys in buckets, which is an equi-join.

Texts are compared by their UTF-8 bytes. The empty prefix begins every key. Null keys and prefixes are left out; equal prefixes are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.rel import cut, range_join

#: Distinct keys that a bucket of the join holds.
WIDTH = 1024


def _numbered(keys: DataFrame, prefixes: DataFrame, key: str, prefix: str) -> DataFrame:
    """Distinct keys and interval ends (text, side, n, before, rows): ``before`` distinct keys and ``rows`` rows stand in front of each."""
    # Hex digits keep the order of bytes, and G follows all of them.
    distinct = keys.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    ends = prefixes.where(F.col(prefix).isNotNull()).select(F.col(prefix).alias("text")).distinct()
    at = F.hex(F.col("text").cast("binary"))
    lows = ends.select("text", F.lit(0).alias("side"), F.lit(None).cast("long").alias("n"), at.alias("_at"))
    highs = ends.select("text", F.lit(1).alias("side"), F.lit(None).cast("long").alias("n"), F.concat(at, F.lit("G")).alias("_at"))
    both = distinct.select("text", F.lit(2).alias("side"), "n", at.alias("_at")).unionByName(lows).unionByName(highs)
    ranged = cut(both.repartitionByRange("_at", "side").withColumn("_block", F.spark_partition_id()))
    # One row per block of the range partitioning.
    blocks = ranged.groupBy("_block").agg(F.count("n").alias("_keys"), F.sum("n").alias("_rows"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("_block", F.sum("_keys").over(earlier).alias("_keys"), F.sum("_rows").over(earlier).alias("_rows"))
    inside = Window.partitionBy("_block").orderBy("_at", "side").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.count("n").over(inside), F.lit(0)) + F.coalesce("_keys", F.lit(0))
    rows = F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.coalesce("_rows", F.lit(0))
    return ranged.join(carried, "_block").select("text", "side", "n", before.alias("before"), rows.alias("rows"))


def _intervals(numbered: DataFrame) -> DataFrame:
    """(text, low, high, n): the numbers of the distinct keys of each prefix, and how many rows they are."""
    pick = lambda side, name: F.max(F.when(F.col("side") == side, F.col(name)))
    found = numbered.where("side < 2").groupBy("text").agg(pick(0, "before").alias("low"), pick(1, "before").alias("high"), pick(0, "rows").alias("_from"), pick(1, "rows").alias("_to"))
    return found.select("text", "low", "high", (F.col("_to") - F.col("_from")).alias("n"))


def counts(keys: DataFrame, prefixes: DataFrame, key: str = "key", prefix: str = "prefix") -> DataFrame:
    """(prefix, n_keys, n): how many distinct keys and how many rows begin with each distinct prefix, 0 where none does."""
    return _intervals(_numbered(keys, prefixes, key, prefix)).select(F.col("text").alias(prefix), (F.col("high") - F.col("low")).alias("n_keys"), "n")


def members(keys: DataFrame, prefixes: DataFrame, key: str = "key", prefix: str = "prefix") -> DataFrame:
    """(prefix, columns of ``keys``): each distinct prefix with the rows whose key begins with it."""
    numbered = cut(_numbered(keys, prefixes, key, prefix))
    points = numbered.where("side = 2").select(F.col("text").alias("_key"), "before")
    intervals = _intervals(numbered).where("low < high").select(F.col("text").alias("_prefix"), "low", "high")
    held = range_join(points, intervals, [], "before", "low", "high", WIDTH)
    return held.select("_prefix", "_key").join(keys, F.col("_key") == F.col(key)).select(F.col("_prefix").alias(prefix), *keys.columns)

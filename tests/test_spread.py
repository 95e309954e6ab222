"""Operators that must not put one key's rows into one task."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import fixes, rel


@pytest.fixture(autouse=True)
def small_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def greedy(edits):
    taken, last = [], {}
    for key, start, end, content in sorted(edits, key=lambda e: (e[0] or "", *e[1:])):
        if key not in last or start >= last[key]:
            taken.append((key, start, end, content))
            last[key] = end
    return sorted(taken, key=str)


def test_fixes_of_a_hot_key(spark):
    dice = random.Random(3)
    edits = [(dice.choice(["hot", "hot", "hot", "a", "b", None]), at := dice.randrange(30_000), at + dice.choice([0, 1, 5, 60]), dice.choice("xy")) for _ in range(4000)]
    edits += [("chain", i, i + 2, "z") for i in range(3000)] + edits[:50]
    rows = spark.createDataFrame(edits, "k string, start long, end long, content string")
    found = fixes.non_overlapping(rows, "k")
    assert sorted(map(tuple, found.collect()), key=str) == greedy(edits)
    # The edits of one text lie in several partitions.
    assert found.filter("k = 'hot'").select(F.spark_partition_id()).distinct().count() > 1


def test_ranks_of_one_group(spark):
    rows = spark.range(5000).select(F.lit("one").alias("g"), ((F.col("id") * 7919) % 5000).alias("v"))
    found = rel.ranked(rows, ["g"], ["v"], "place")
    assert found.filter("place <> v + 1").isEmpty() and found.count() == 5000
    assert found.select(F.spark_partition_id()).distinct().count() > 1

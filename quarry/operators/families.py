"""Families of like members: distributions, common and missing parts, collisions, indices, nearest names."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.rel import cut

#: Shares of the distribution of a measure in a family.
SHARES = [0.25, 0.5, 0.75, 0.95, 0.99]


def distribution(members: DataFrame, family: str, value: str) -> DataFrame:
    """Quartiles, p95, p99 and maximum of a measure per family, each a value that occurs."""
    picked = [F.expr(f"percentile_disc({s}) within group (order by {value})").alias(f"p{round(s * 100)}") for s in SHARES]
    return members.groupBy(family).agg(*picked, F.max(value).alias("max"))


def common_parts(parts: DataFrame, family: str, member: str, part: str) -> DataFrame:
    """(family, part) of parts that every member of the family has."""
    size = parts.groupBy(family).agg(F.countDistinct(member).alias("size"))
    held = parts.groupBy(family, part).agg(F.countDistinct(member).alias("held"))
    return held.join(size, family).filter("held = size").select(family, part)


def deviations(parts: DataFrame, family: str, member: str, part: str, most: float = 0.5) -> DataFrame:
    """(family, member, extra): how many parts of a member fewer than ``most`` of its family have."""
    size = parts.groupBy(family).agg(F.countDistinct(member).alias("size"))
    held = parts.groupBy(family, part).agg(F.countDistinct(member).alias("held"))
    rare = held.join(size, family).filter(F.col("held") < F.col("size") * most).select(family, part)
    return parts.distinct().join(rare, [family, part]).groupBy(family, member).agg(F.count(F.lit(1)).alias("extra"))


def collisions(members: DataFrame, digest: str) -> DataFrame:
    """Digests that several members share, with their number and least and greatest member."""
    grouped = members.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("first"), F.max("member").alias("last"))
    return grouped.filter("n > 1")


def histogram(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def top(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return histogram(rows, value).orderBy(F.desc("n"), value).limit(k)


#: Names longer than this have too many shortened forms for the second round.
LONGEST = 32


def _shortened(value: Column, times: int) -> Column:
    """Digests of the distinct forms of a text with at most ``times`` characters left out."""
    held = F.array(value)
    for _ in range(times):
        one_less = F.flatten(
            F.transform(held, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))
        )
        held = F.array_distinct(F.concat(held, one_less))
    return F.array_distinct(F.transform(held, lambda s: F.xxhash64(s)))


def _within(asked: DataFrame, listed: DataFrame, most: int) -> DataFrame:
    """(a, best) of the names that some candidate is at most ``most`` edits from; every candidate that near is compared.

    Two texts at most k edits apart have a form in common with at most k characters left out of each, so an equi-join of these forms loses
    none, and what meets there is at most 2k edits apart: a group holds near texts alone, however frequent a part of a name is.
    """
    left, right = (df.select(c, F.explode(_shortened(F.col(c), most)).alias("form")) for df, c in ((asked, "a"), (listed, "c")))
    met = left.join(right, "form").withColumn("d", F.levenshtein("a", "c", most)).filter("d >= 0")
    return met.groupBy("a").agg(F.min(F.struct("d", "c")).alias("best"))


def _nearer(best: Column, c: Column) -> Column:
    # With a bound the distance is worked out only as far as it stays below, and is -1 beyond.
    d = F.call_function("levenshtein", F.col("a"), c, best.d - 1)
    return F.when((F.abs(F.length("a") - F.length(c)) < best.d) & (d >= 0), F.struct(F.levenshtein(F.col("a"), c).alias("d"), c.alias("c"))).otherwise(best)


def _by_blocks(asked: DataFrame, listed: DataFrame, n: int, block: int) -> DataFrame:
    """(a, best) over all candidates, of which a task holds one block at a time; a candidate whose length alone sets it too far off is not compared."""
    parts, found = 1 + (n - 1) // block, None
    # A name may take a block's worth of comparisons, so that few bytes of names are much work.
    asked = asked.repartition(asked.sparkSession.sparkContext.defaultParallelism * 4)
    for part in range(parts):
        held = sorted(listed.filter(F.pmod(F.xxhash64("c"), F.lit(parts)) == part).toArrow().column("c").to_pylist())
        if not held:
            continue
        # In order, so that a later candidate has to be nearer.
        start = F.struct(F.levenshtein(F.col("a"), F.lit(held[0])).alias("d"), F.lit(held[0]).alias("c"))
        # One literal, since as many as there are candidates take long to hand over.
        folded = F.reduce(F.from_json(F.lit(json.dumps(held[1:])), "array<string>"), start, _nearer)
        one = cut(asked.select("a", folded.alias("best")))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("a").agg(F.min("best").alias("best")) if parts > 1 else found


def nearest(names: DataFrame, candidates: DataFrame, name: str, candidate: str, block: int = 5_000) -> DataFrame:
    """Each distinct name with the candidate of least edit distance; ties go to the candidate that sorts first.

    Up to ``block`` candidates are compared in one narrow pass. Of more, names first meet the candidates one edit away, those that met none
    the candidates two edits away, both by joins of shortened forms; only names with nothing that near are compared with all candidates, block by block.
    A null name has no distance; without candidates, nearest and distance are null.
    """
    listed = cut(candidates.select(F.col(candidate).alias("c")).filter("c is not null").distinct())
    n = listed.count()
    rest = names.select(F.col(name).alias("a")).distinct()
    found = rest.filter("a is null" if n else "true").select("a", F.lit(None).cast("struct<d:int,c:string>").alias("best"))
    if n:
        rest = cut(rest.filter("a is not null"))
        if n > block:
            for most, longest in ((1, None), (2, LONGEST)):
                some = rest if longest is None else rest.filter(F.length("a") <= longest)
                near = listed if longest is None else listed.filter(F.length("c") <= longest + most)
                met = cut(_within(some, near, most))
                found, rest = found.unionByName(met), cut(rest.join(met, "a", "left_anti"))
        found = found.unionByName(_by_blocks(rest, listed, n, block))
    return found.select(F.col("a").alias(name), F.col("best.c").alias("nearest"), F.col("best.d").alias("distance"))

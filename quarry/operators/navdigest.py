"""What a user interface's facts say about its screens: edges, bindings, controls, parents and purposes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dock tokens and the regions they stand for. Fixed values.
REGIONS = {"top": "header", "bottom": "footer", "left": "navigation", "right": "detail", "fill": "content"}


def digest(facts: DataFrame) -> DataFrame:
    """(section, key, value) of facts s, p, o, each section sorted and without repetition when ordered by all columns.

    Sections are edges (opens), selections (selects_view), bindings (binds_concept), controls (counts of has_control per screen)
    and regions (docks; an unknown token stays, marked as unmapped).
    """
    pick = lambda p, name: facts.filter(F.col("p") == p).select(F.lit(name).alias("section"), F.col("s").alias("key"), F.col("o").alias("value")).distinct()
    token = F.lower("o")
    region = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair]), token), F.concat(F.lit("unmapped:"), token))
    regions = facts.filter("p = 'docks'").select(F.lit("regions").alias("section"), F.col("s").alias("key"), region.alias("value")).distinct()
    controls = facts.filter("p = 'has_control'").groupBy("s").agg(F.count(F.lit(1)).alias("n")).select(F.lit("controls").alias("section"), F.col("s").alias("key"), F.col("n").cast("string").alias("value"))
    parts = [pick("opens", "edges"), pick("selects_view", "selections"), pick("binds_concept", "bindings"), controls, regions]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def parents(opens: DataFrame) -> DataFrame:
    """(screen, parent): the first that opens each screen; ``opens`` has opener, screen, pos."""
    return opens.groupBy("screen").agg(F.min_by("opener", F.struct("pos", "opener")).alias("parent"))


def purposes(controls: DataFrame) -> DataFrame:
    """(screen, purpose) by what its controls are mostly for; ``controls`` has screen, kind."""
    counted = controls.groupBy("screen").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("grid", "input", "button", "chart")])
    purpose = F.when(F.col("chart") > 0, "report").when((F.col("grid") > 0) & (F.col("input") <= F.col("grid")), "list").when(F.col("input") > 0, "form").when(F.col("button") > 0, "menu").otherwise("empty")
    return counted.select("screen", purpose.alias("purpose"))


def provenance(facts: DataFrame, through: str = "emitted_by", reads: str = "reads_field") -> DataFrame:
    """(target, function, sources): which fields a field comes from, and through which function.

    A field is emitted by a function, which reads others: two joins on the fact table, by function.
    """
    made = facts.filter(F.col("p") == through).select(F.col("s").alias("target"), F.col("o").alias("function")).distinct()
    read = facts.filter(F.col("p") == reads).select(F.col("s").alias("function"), F.col("o").alias("source")).distinct()
    return made.join(read, "function").groupBy("target", "function").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def group_census(functions: DataFrame, groups: dict[str, list[str]], column: str) -> DataFrame:
    """How many functions touch each group: once for a group, however many of its members a function has."""
    counted = functions.agg(*[F.count_if(F.arrays_overlap(column, F.array(*map(F.lit, members)))).alias(name) for name, members in groups.items()])
    rows = ", ".join(f"'{name}', `{name}`" for name in groups)
    return counted.selectExpr(f"stack({len(groups)}, {rows}) as (name, n)")

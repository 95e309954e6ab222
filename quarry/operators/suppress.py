"""Suppression comments and fixes as data changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.fixes import APPLICABILITY


def add_noqa(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, text, n): files with a suppression comment at every line that has findings, and how many lines changed."""
    codes = found.groupBy("path", F.col("row").alias("r")).agg(F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("codes"))
    by_file = codes.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("r", "codes"))).alias("codes"))
    joined = files.join(by_file, "path", "left")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(F.col("codes")[i + 1].isNotNull(), F.concat(F.rtrim(x), F.lit("  # noqa: "), F.col("codes")[i + 1])).otherwise(x))
    text = F.when(F.col("codes").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return joined.select("path", text.alias("text"), F.coalesce(F.when(F.col("codes").isNotNull(), F.size("codes")), F.lit(0)).alias("n"))


def applicable(fixes: DataFrame, least: str) -> DataFrame:
    """Fixes at least as safe as ``least``."""
    rank = F.create_map(*[F.lit(x) for pair in APPLICABILITY.items() for x in pair])
    return fixes.filter(rank[F.col("applicability")] >= APPLICABILITY[least])


def one_per_group(fixes: DataFrame) -> DataFrame:
    """Of fixes of a file that share an isolation group the first by start; others pass."""
    window = Window.partitionBy("path", "isolation").orderBy("start", "end", "fix_id")
    ranked = fixes.withColumn("_n", F.row_number().over(window))
    return ranked.filter("isolation is null or _n = 1").drop("_n")


def shifted(edits: DataFrame) -> DataFrame:
    """``edits`` (path, start, end, content) with ``new_start``: where each edit's text begins after all edits before it."""
    window = Window.partitionBy("path").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    delta = F.length(F.coalesce("content", F.lit(""))) - (F.col("end") - F.col("start"))
    return edits.withColumn("new_start", F.col("start") + F.coalesce(F.sum(delta).over(window), F.lit(0)))


def edit_kind(edits: DataFrame) -> DataFrame:
    empty = F.coalesce(F.col("content"), F.lit("")) == ""
    kind = F.when((F.col("start") == F.col("end")), "insertion").when(empty, "deletion").otherwise("replacement")
    return edits.withColumn("kind", kind)

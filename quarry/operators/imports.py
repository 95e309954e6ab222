"""Import blocks: merged, put in sections and in order."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import natural_key

SECTIONS = ["future", "standard", "third_party", "first_party", "local"]


def section(module: Column, level: Column, first_party: list[str]) -> Column:
    """The section of an imported module, by its first part."""
    head = F.split(module, "[.]")[0]
    return (
        F.when(level > 0, "local").when(module == "__future__", "future").when(head.isin(sorted(sys.stdlib_module_names)), "standard")
        .when(head.isin(first_party) if first_party else F.lit(False), "first_party").otherwise("third_party")
    )


def normalised(imports: DataFrame) -> DataFrame:
    """One row per module and form: members (name, asname) merged; ``imports`` has path, module, name, asname, level."""
    form = F.when(F.col("name").isNull(), "import").when(F.col("name") == "*", "star").otherwise("from")
    members = F.array_sort(F.collect_set(F.struct("name", "asname")))
    return imports.withColumn("form", form).groupBy("path", "module", "level", "form").agg(members.alias("members"))


def member_order(name: Column) -> Column:
    """Members sort by kind (constants, classes, others), then by natural lower-case name, then by name."""
    kind = F.when(name.rlike("^[A-Z0-9_]{2,}$"), 0).when(name.rlike("^[A-Z]"), 1).otherwise(2)
    return F.struct((name != "*").alias("star"), kind.alias("kind"), F.lower(natural_key(name)).alias("natural"), name.alias("name"))


def ordered(imports: DataFrame, first_party: list[str] | None = None) -> DataFrame:
    """(path, place, section, text): the imports of a file as they should stand."""
    merged = normalised(imports).withColumn("section", section(F.col("module"), F.col("level"), first_party or []))
    names = F.transform(F.array_sort(F.transform("members", lambda m: F.struct(member_order(F.coalesce(m["name"], F.lit(""))).alias("k"), m.alias("m")))), lambda x: F.concat(x["m"]["name"], F.coalesce(F.concat(F.lit(" as "), x["m"]["asname"]), F.lit(""))))
    plain = F.concat(F.lit("import "), "module", F.coalesce(F.concat(F.lit(" as "), F.element_at("members", 1)["asname"]), F.lit("")))
    text = F.when(F.col("form") == "import", plain).otherwise(F.concat(F.lit("from "), F.expr("repeat('.', level)"), "module", F.lit(" import "), F.array_join(names, ", ")))
    rank = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    window = Window.partitionBy("path").orderBy(rank, F.when(F.col("form") == "import", 0).otherwise(1), F.desc("level"), F.lower(natural_key(F.col("module"))), "module", "form")
    return merged.withColumn("place", F.row_number().over(window)).select("path", "place", "section", text.alias("text"))

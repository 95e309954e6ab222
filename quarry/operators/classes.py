"""Class hierarchies: ancestors, overrides and the checks that need them, as joins and one fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.navigate import type_edges
from quarry.operators.rel import fixpoint


def ancestors(edges: DataFrame) -> DataFrame:
    """(sub, super) of all levels; ``edges`` has sub, super. Cycles end, as every pair is found once."""
    direct = edges.select("sub", "super").distinct()
    up = direct.select(F.col("sub").alias("super"), F.col("super").alias("next"))
    return fixpoint(direct, lambda fresh: fresh.join(up, "super").select("sub", F.col("next").alias("super")), ["sub", "super"])


def cyclic(closure: DataFrame) -> DataFrame:
    """Classes that are their own ancestor."""
    return closure.filter("sub = super").select(F.col("sub").alias("name"))


def methods(nodes: DataFrame) -> DataFrame:
    """(class, method, row, path, final, abstract) of functions that stand in a class."""
    classes = nodes.filter("kind = 'ClassDef'").select("path", F.col("node").alias("parent"), F.col("name").alias("class"))
    functions = nodes.filter("kind in ('FunctionDef', 'AsyncFunctionDef')").select("path", "parent", F.col("name").alias("method"), "row", F.coalesce(F.col("attrs")["decorators"], F.lit("")).alias("d"))
    flag = lambda name: F.col("d").rlike(f"(^|,)([A-Za-z_]+[.])?{name}(,|$)").alias(name.removesuffix("method"))
    return functions.join(classes, ["path", "parent"]).select("path", "class", "method", "row", flag("final"), flag("abstractmethod"))


def overrides(found: DataFrame, closure: DataFrame) -> DataFrame:
    """(class, method, row, path, over): methods with the ancestors whose method they replace."""
    above = found.select(F.col("class").alias("super"), "method", F.col("final").alias("over_final"), F.col("abstract").alias("over_abstract"))
    joined = found.join(closure.withColumnRenamed("sub", "class"), "class").join(above, ["super", "method"])
    return joined.select("path", "class", "method", "row", F.col("super").alias("over"), "over_final", "over_abstract")


def override_sets(found: DataFrame, closure: DataFrame) -> DataFrame:
    """Per class the sorted methods that replace an ancestor's."""
    return overrides(found, closure).groupBy("class").agg(F.array_sort(F.collect_set("method")).alias("methods"))


def override_of_final(found: DataFrame, closure: DataFrame) -> DataFrame:
    return overrides(found, closure).filter("over_final").select("path", "row", "class", "method", "over")


def abstract_and_final(found: DataFrame) -> DataFrame:
    return found.filter("abstract and final").select("path", "row", "class", "method")


def unimplemented(found: DataFrame, closure: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, method): abstract methods of ancestors that a class of ``classes`` (class) does not get from anyone nearer.

    A method counts as implemented if the class or any of its ancestors defines it without the abstract mark.
    """
    lines = closure.select(F.col("sub").alias("class"), F.col("super").alias("at")).unionByName(classes.select("class", F.col("class").alias("at"))).distinct()
    held = lines.join(found.select(F.col("class").alias("at"), "method", "abstract"), "at")
    return held.groupBy("class", "method").agg(F.bool_and("abstract").alias("open")).filter("open").join(classes.select("class"), "class").select("class", "method")


def subclass_of_final(nodes: DataFrame) -> DataFrame:
    """(path, sub, super): classes whose base is marked final."""
    final = nodes.filter("kind = 'ClassDef' and attrs['decorators'] rlike '(^|,)([A-Za-z_]+[.])?final(,|$)'").select(F.col("name").alias("super")).distinct()
    return type_edges(nodes).join(final, "super").select("path", "sub", "super")

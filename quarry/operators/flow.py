"""Control flow of functions from the syntax nodes: which statement may follow which."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.rel import cut

#: The kinds of nodes that stand in blocks.
KINDS = sorted({x.__name__ for x in ast.stmt.__subclasses__()} | {"ExceptHandler"})
_BLOCKS = ["body", "orelse", "finalbody", "handlers"]


def statements(nodes: DataFrame) -> DataFrame:
    """Statements with ``after``: what follows when they end, a sibling or what follows the statement around.

    The walk outwards ends with the deepest statement, one level a step.
    """
    found = nodes.filter(F.col("field").isin(_BLOCKS) & F.col("func").isNotNull()).select("path", "func", "node", "parent", "field", "kind")
    window = Window.partitionBy("path", "parent", "field").orderBy("node")
    with_next = found.withColumn("after", F.when(F.col("field") != "handlers", F.lead("node").over(window)))
    around = with_next.select("path", F.col("node").alias("outer"), F.col("after").alias("outer_after"), F.col("kind").alias("outer_kind"), F.col("parent").alias("next_outer"))
    open_ = with_next.withColumn("outer", F.col("parent"))
    unsettled, settled, loop = "after is null and outer is not null and outer <> func", "after is not null or outer is null or outer = func", F.col("outer_kind").isin("For", "AsyncFor", "While")
    done, rest = open_.filter(settled), cut(open_.filter(unsettled))
    while not rest.isEmpty():
        moved = rest.join(around, ["path", "outer"], "left").withColumn("after", F.when(loop, F.col("outer")).otherwise(F.col("outer_after"))).withColumn("outer", F.col("next_outer")).select(open_.columns)
        # Only what is not settled goes on, and no step reads an earlier one's plan again.
        moved = cut(moved)
        done, rest = done.unionByName(moved.filter(settled)), moved.filter(unsettled)
    return done.select("path", "func", "node", "kind", "after")


def edges(nodes: DataFrame) -> DataFrame:
    """(path, func, src, dst): flow between statements; ``dst`` -1 is the end of the function."""
    found = statements(nodes)
    first = nodes.filter(F.col("field").isin(_BLOCKS) & F.col("func").isNotNull()).groupBy("path", F.col("parent").alias("node"), "field").agg(F.min("node").alias("dst"))
    entered = found.join(first, ["path", "node"]).select("path", "func", F.col("node").alias("src"), "dst")
    has_else = first.filter("field = 'orelse'").select("path", "node", F.lit(True).alias("has_else"))
    ended = found.join(has_else, ["path", "node"], "left").filter(
        "kind not in ('Return', 'Raise', 'Break', 'Continue') and not (kind in ('If', 'Try', 'With') and coalesce(has_else, kind <> 'If'))"
    ).select("path", "func", F.col("node").alias("src"), F.coalesce("after", F.lit(-1)).alias("dst"))
    left = found.filter("kind in ('Return', 'Raise')").select("path", "func", F.col("node").alias("src"), F.lit(-1).alias("dst"))
    return entered.unionByName(ended).unionByName(left).distinct()


def unreachable(nodes: DataFrame) -> DataFrame:
    """Statements right after one that always leaves its block."""
    found = nodes.filter(F.col("field").isin(_BLOCKS[:3]))
    window = Window.partitionBy("path", "parent", "field").orderBy("node")
    return found.withColumn("before", F.lag("kind").over(window)).filter("before in ('Return', 'Raise', 'Break', 'Continue')").select("path", "row", "kind")

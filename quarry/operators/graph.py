"""Edges between files, functions and models: maps in both directions, dangling and stale rows, fixpoints, fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.rel import fixpoint


def dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, targets): the sorted targets of every node, empty for nodes without edges; ``edges`` has src, dst."""
    lists = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    return nodes.join(lists.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("targets", F.array().cast(lists.schema["targets"].dataType)).alias("targets"))


def dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same against the direction of the edges."""
    return dependencies(nodes, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def dangling(calls: DataFrame, defined: DataFrame, callee: str, subject: str) -> DataFrame:
    """Calls whose callee nothing defines."""
    return calls.join(defined.select(F.col(subject).alias(callee)).distinct(), callee, "left_anti").select(calls.columns)


def stale(stored: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state) of rows whose digest changed, that are missing now, or that are new."""
    old, new = stored.select(key, F.col(digest).alias("old")), current.select(key, F.col(digest).alias("new"))
    state = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "new").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, key, "full_outer").withColumn("state", state).filter("state is not null").select(key, "state")


def tainted(calls: DataFrame, direct: DataFrame) -> DataFrame:
    """Heads that reach a direct taint by calls: ``calls`` has caller, callee, ``direct`` has head."""
    back = calls.select(F.col("callee").alias("head"), "caller").distinct()
    return fixpoint(direct.select("head"), lambda fresh: fresh.join(back, "head").select(F.col("caller").alias("head")), ["head"])


def named_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls of a method on self, resolved if exactly one function of the model bears the name."""
    found = functions.groupBy("model", "name").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n") == 1, "CALLS_NAMED").otherwise("UNRESOLVED_CALL")
    return calls.join(found, ["model", "name"], "left").withColumn("kind", kind).drop("n")


def longest_prefix(names: DataFrame, modules: DataFrame, name: str = "name", module: str = "module", least: int = 1) -> DataFrame:
    """Dotted names with the longest dotted prefix that is a module and has at least ``least`` parts; null if none is."""
    parts = F.split(name, "[.]")
    cut = F.transform(F.sequence(F.lit(least), F.size(parts)), lambda i: F.struct(i.alias("k"), F.array_join(F.slice(parts, 1, i), ".").alias(module)))
    tried = names.select(name).distinct().filter(F.size(parts) >= least).select(name, F.explode(cut).alias("t")).select(name, "t.*")
    best = tried.join(modules.select(module).distinct(), module).groupBy(name).agg(F.max_by(module, "k").alias(module))
    return names.join(best, name, "left")


def first_on_path(requests: DataFrame, files: DataFrame, key: str, rank: str) -> DataFrame:
    """Each request with the file of the least rank among those that answer it."""
    best = files.groupBy(key).agg(F.min_by(F.struct(*[c for c in files.columns if c != key]), rank).alias("f"))
    return requests.join(best, key, "left").select(*requests.columns, "f.*")


def paths(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, parent, level, path) of a forest from its roots down, at any depth or ``depth`` levels; ``edges`` has child, parent.

    A cycle ends where it would come back to a node of its path.
    """
    from quarry.operators.rel import cut

    level = roots.select(F.col("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), F.col("node").alias("path"), F.array("node").alias("seen"))
    found, k = level, 1
    while depth is None or k < depth:
        step = level.select(F.col("node").alias("parent"), "path", "seen").join(edges, "parent").filter(~F.array_contains("seen", F.col("child")))
        level = cut(step.select(
            F.col("child").alias("node"), "parent", F.lit(k).alias("level"), F.concat_ws("/", "path", "child").alias("path"), F.concat("seen", F.array("child")).alias("seen")
        ))
        if level.isEmpty():
            break
        found, k = found.unionByName(level), k + 1
    return found.drop("seen")


def sibling_ranks(nodes: DataFrame, most: int = 255) -> DataFrame:
    """``nodes`` (parent, name) with the rank among siblings from 1, and whether the tier overflows ``most``."""
    window = Window.partitionBy("parent").orderBy("name")
    ranked = nodes.withColumn("rank", F.dense_rank().over(window))
    return ranked.withColumn("truncated", F.col("rank") > most)

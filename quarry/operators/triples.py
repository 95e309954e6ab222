"""Subject-predicate-object facts: vocabulary, census, folds per function and codebook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.names import concept_key

TRIPLE = "s string, p string, o string, f double, c double"

#: The closed vocabulary: predicate, provenance, roles. Fixed values.
PREDICATES = [
    ("rdf:type", "structural", ["type"]),
    ("has_field", "structural", ["structure"]),
    ("has_function", "structural", ["structure"]),
    ("depends_on", "authoritative", ["data_flow"]),
    ("emitted_by", "authoritative", ["data_flow"]),
    ("reads_field", "inferred", ["data_flow", "read"]),
    ("writes_field", "inferred", ["data_flow", "write"]),
    ("guarded_write", "inferred", ["write", "control_flow"]),
    ("calls", "inferred", ["control_flow"]),
    ("raises", "authoritative", ["control_flow"]),
    ("traverses_relation", "inferred", ["navigation"]),
    ("inherits_from", "structural", ["type", "navigation"]),
]


def predicates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PREDICATES, "p string, provenance string, roles array<string>")


def census(triples: DataFrame) -> DataFrame:
    """How often each predicate occurs."""
    return triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def role_census(triples: DataFrame, dimension: DataFrame) -> DataFrame:
    """Triples by role, once for each role of the predicate; roles that do not occur count 0."""
    counted = census(triples)
    roles = dimension.select("p", F.explode("roles").alias("role"))
    joined = roles.join(counted, "p", "left")
    return joined.groupBy("role").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def absent_roles(triples: DataFrame, dimension: DataFrame) -> DataFrame:
    return role_census(triples, dimension).filter("n = 0").select("role")


def unknown(triples: DataFrame, dimension: DataFrame) -> DataFrame:
    """Triples whose predicate is not in the vocabulary."""
    return triples.join(F.broadcast(dimension.select("p")), "p", "left_anti").select(triples.columns)  # a fixed vocabulary


def group_functions(facts: DataFrame) -> DataFrame:
    """One row per subject with the sorted objects of each kind of fact; ``facts`` has s, p, o."""
    kinds = [("reads", "reads_field"), ("writes", "writes_field"), ("guarded", "guarded_write"), ("calls", "calls"), ("raises", "raises"), ("traverses", "traverses_relation")]
    objects = lambda p: F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o"))))
    return facts.groupBy("s").agg(*[objects(p).alias(name) for name, p in kinds])


def recipe(function: dict[str, Column]) -> Column:
    """The recipe of a function: the first rung of the ladder that its facts meet."""
    some = {k: F.size(v) > 0 for k, v in function.items()}
    writes, reads, guarded = function["writes"], function["reads"], function["guarded"]
    return (
        F.when(some["calls"] & some["raises"], "Compensate")
        .when(some["calls"], "Cascade")
        .when(some["raises"] & ~some["writes"], "Guard")
        .when(some["raises"], "WriteRaise")
        .when(some["writes"] & (writes == guarded), "Default")
        .when(some["writes"] & (F.size(F.array_except(writes, reads)) > 0), "Compute")
        .when(some["writes"], "Normalize")
        .when(some["reads"], "Observe")
        .otherwise("Empty")
    )


def classified(functions: DataFrame) -> DataFrame:
    return functions.withColumn("recipe", recipe({k: F.col(k) for k in ("reads", "writes", "guarded", "calls", "raises")}))


def band(functions: DataFrame) -> DataFrame:
    """Share of recoverable functions and its verdict by the thresholds 85 and 50; without functions the share is 0."""
    good = F.col("recipe").isin("Default", "Compute", "Normalize", "Guard")
    counted = functions.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_good"))
    share = F.coalesce(F.try_divide(F.col("n_good") * 100.0, F.col("n")), F.lit(0.0))
    verdict = F.when(share >= 85, "strong").when(share >= 50, "partial").otherwise("weak")
    return counted.select("n", "n_good", F.round(share, 4).alias("share"), verdict.alias("verdict"))


def recipe_census(functions: DataFrame, examples: int = 3) -> DataFrame:
    """Functions by recipe, with the first subjects of each.

    Examples come from a rank per recipe on partitions of subjects first, so no list of all subjects is built.
    """
    from pyspark.sql import Window

    near = Window.partitionBy("recipe", F.pmod(F.xxhash64("s"), F.lit(64))).orderBy("s")
    few = functions.select("recipe", "s").withColumn("k", F.row_number().over(near)).filter(F.col("k") <= examples)
    shown = few.groupBy("recipe").agg(F.array_join(F.slice(F.array_sort(F.collect_list("s")), 1, examples), ",").alias("examples"))
    return functions.groupBy("recipe").agg(F.count(F.lit(1)).alias("n")).join(shown, "recipe")


def codebook(models: DataFrame, book: DataFrame, name: str = "name") -> DataFrame:
    """``models`` with ``concept`` and ``class_id``, null where the book has no such concept.

    Of a repeated concept the entry first in the book counts, by its ``position``; a book without one by the least class.
    """
    keyed = models.withColumn("concept", concept_key(F.col(name)))
    first = book.groupBy("concept").agg(F.min_by("class_id", "position" if "position" in book.columns else "class_id").alias("class_id"))
    return keyed.join(first, "concept", "left")


def support(rows: DataFrame, what: list[str], corpus: str, corpora: int, least: int) -> DataFrame:
    """Whether a finding is generic (enough support in every corpus) or scoped to some; rows with no such support are left out."""
    each = rows.groupBy(*what, corpus).agg(F.count(F.lit(1)).alias("n"))
    whole = each.groupBy(*what).agg(F.count_if(F.col("n") >= least).alias("n_corpora"), F.sum("n").alias("n"))
    kind = F.when(F.col("n_corpora") == corpora, "generic").otherwise("corpus_scoped")
    return whole.filter("n_corpora > 0").withColumn("kind", kind)

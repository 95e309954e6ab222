"""Mixing sources to target weights by iterative proportional fitting (operator 7, DataFrame functions only).

Documents fall into cells by source, language and topic. Every cell starts at its tokens; the fit
rakes the cell weights to the source, language and topic marginals in turn, ``ROUNDS`` times. A document's inclusion probability is its cell's weight over its cell's tokens, scaled
so that the expected tokens are ``share`` of all tokens, at most 1; what full cells cannot give, the others make up
(``SCALINGS`` times). A document is sampled if a hash of its id, uniform in [0, 1), is below it: repeatable,
independent of order and partitions, and equal for repeated rows.

Only the cell table is raked; it has a row per cell, never per document, and each round writes it to the shared folder,
so that plans do not grow with the rounds (or a few rounds of windows at once). Up to ``WINDOWED`` cells, counted first, a marginal's sums are windows over
the cells; above that each is a sum per value, combined on the map side and joined to the cells, so that no language
or topic gathers its cells in one task. ``residuals`` tells how far each marginal is from its targets, and ``rake`` may stop by it. Cells are summed on the map side, so a source with a third of all
rows reaches one reducer as a row per task. Documents are joined with the cells' probabilities; if the
cells are few the planner broadcasts them by their written size, else it may split a hot cell's rows.

Targets default to the tokens' own marginals, tempered by ``ALPHA``; a table (value, weight) per dimension
overrides them. Values without a positive target get weight 0.

Defined results: null source and lang are values of their own, written as empty text; null text counts 0
tokens and topic ``none``; a cell without tokens has probability 0. Rows with null ids share one hash.
An empty table gives an empty result, and very long texts are counted whole. Other columns, whatever their names, are not
read (but kept as ``row``). ``keep`` judges repeated rows alike, so they stay or go together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import save, table

DIMS = ["source", "lang", "topic"]
#: Power of the observed marginals that makes the default targets: 1 keeps them, 0 evens them out.
ALPHA = 0.7
SHARE = 0.5
ROUNDS = 6
SCALINGS = 4
#: Cells up to which a marginal's sums are windows; a window holds all cells of a value in one task.
WINDOWED = 100_000
#: Rounds of windows in one plan.
STEPS = 3
SEED = "mix-1"

#: Topic rules, the first that matches counts: (topic, plain pieces of which one must stand in the text, pattern).
#: The plain search spares most texts the pattern.
TOPICS = [
    ("legal", ["icense", "icence", "opyright", "ights reserved", "LICENSE", "COPYRIGHT"], None),
    ("contact", ["@"], "[A-Za-z0-9]@[A-Za-z0-9-]+[.][a-z]"),
    ("tabular", [" | "], " [|] [^|]* [|] "),
    ("numeric", [], "[0-9]{3}"),
]


def topic(text: Column) -> Column:
    def hit(pieces: list[str], pattern: str | None) -> Column:
        tests = [reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in pieces])] if pieces else []
        return reduce(lambda a, b: a & b, tests + ([text.rlike(pattern)] if pattern else []))

    first = reduce(lambda rest, rule: F.when(hit(*rule[1:]), rule[0]).otherwise(rest), reversed(TOPICS), F.lit("prose"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "none").otherwise(first)


def token_count(text: Column) -> Column:
    """Words between ASCII white space: the runs, counted by collapsing each to one character."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return (F.length(gaps) - F.length(F.translate(gaps, "w", ""))).cast("long")


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens`` per row; with ``carry`` the input row as ``row``."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in docs.columns else F.lit("").alias(c) for c in ("source", "lang")]
    row = [F.struct("*").alias("row")] if carry else []
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *named, topic(F.col(text_col)).alias("topic"),
        token_count(F.col(text_col)).alias("n_tokens"), *row,
    )


def tempered(cells: DataFrame, dim: str, alpha: float = ALPHA) -> DataFrame:
    """Default targets of a dimension: its tokens to the power ``alpha``."""
    return cells.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(alpha)).alias("weight"))


def shares(targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables (dim, goal): weights as shares of their dimension's sum. One job reads all sums."""
    sums = [t.agg(F.sum("weight").alias("total")).select(F.lit(dim).alias("dim"), "total") for dim, t in targets.items()]
    totals = {r["dim"]: r["total"] for r in reduce(DataFrame.unionByName, sums).collect()}
    return {dim: t.select(dim, (F.col("weight") / F.lit(totals[dim])).alias("goal")) for dim, t in targets.items()}


def residuals(fitted: DataFrame, targets: dict[str, DataFrame]) -> dict[str, float]:
    """Per dimension the greatest distance of a value's share of the weight from its goal (0 without cells).

    Values that have a goal but no cell, which no weight can reach, are left out.
    """
    found = {}
    for dim in DIMS:
        sums = fitted.groupBy(dim).agg(F.sum("weight").alias("have")).join(targets[dim], dim, "left")
        found[dim] = sums.agg(F.max(F.abs(F.col("have") - F.coalesce("goal", F.lit(0.0))))).first()[0] or 0.0
    return found


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """Cells with ``weight``, fitted to the targets (dim, goal) of each dimension.

    At most ``rounds`` rounds; with ``tolerance`` the fit ends after the round that leaves no greater residual.
    """
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dim in DIMS:
        fitted = fitted.join(targets[dim].withColumnRenamed("goal", f"goal_{dim}"), dim, "left")
    few = cells.count() <= WINDOWED
    for i in range(1, rounds + 1):
        for dim in DIMS:
            fitted = _windowed(fitted, dim) if few else save(_joined(fitted, dim), "cells")
        if few and (i % STEPS == 0 or i == rounds or tolerance is not None):
            fitted = save(fitted, "cells")
        if tolerance is not None and max(residuals(fitted, targets).values()) <= tolerance:
            break
    return fitted.select(*DIMS, "tokens", "weight")


def _windowed(cells: DataFrame, dim: str) -> DataFrame:
    """One raking step, a marginal's sums as a window over the cells."""
    have = F.sum("weight").over(Window.partitionBy(dim))
    return cells.withColumn("weight", F.coalesce(F.when(have > 0, F.col("weight") * (F.col(f"goal_{dim}") / have)), F.lit(0.0)))


def _joined(cells: DataFrame, dim: str) -> DataFrame:
    """The same step, the sums as a table of the dimension's values."""
    sums = cells.groupBy(dim).agg(F.sum("weight").alias("have"), F.max(f"goal_{dim}").alias("goal"))
    factor = sums.select(dim, F.coalesce(F.when(F.col("have") > 0, F.col("goal") / F.col("have")), F.lit(0.0)).alias("factor"))
    return cells.join(factor, dim).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")


def probabilities(fitted: DataFrame, share: float = SHARE, scalings: int = SCALINGS) -> DataFrame:
    """Cells with ``p``, at most 1, such that the expected tokens are ``share`` of all."""
    cells = fitted.withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    factor = most = 0.0
    for _ in range(scalings):
        # Open cells, which no factor so far has filled, are scaled to the tokens that full cells leave.
        full = F.col("rate") * F.lit(most) >= 1
        found = cells.agg(
            F.sum("tokens").alias("all"), F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("rest"),
        ).first()
        factor = (found["all"] * share - found["full"]) / found["rest"] if found["rest"] else 0.0
        most = max(most, factor)
    p = F.when(F.col("rate") * F.lit(most) >= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("rate") * F.lit(factor)))
    return cells.withColumn("p", p)


def uniform(id_col: str = "doc_id", seed: str = SEED) -> Column:
    """A number in [0, 1) from the md5 of seed and id: 13 hex digits, exact as a double."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, carry: bool = False) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, p, u, kept`` per row of ``docs``.

    ``weight`` is the cell's share of the mixture, ``targets`` maps a dimension to a table (dimension, weight).
    """
    # Without the rows' texts the description is small enough to keep; with them the texts are read again.
    slim = described(docs) if carry else save(described(docs), "described")
    rows = described(docs, carry=True) if carry else slim
    cells = save(slim.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    given = shares({dim: (targets or {}).get(dim, tempered(cells, dim)) for dim in DIMS})
    mixed = probabilities(rake(cells, given), share)
    joined = rows.join(mixed.select(*DIMS, "weight", "p"), DIMS, "left").withColumn("u", uniform())
    return joined.withColumn("kept", F.coalesce(F.col("u") < F.col("p"), F.lit(False)))


def keep(docs: DataFrame) -> DataFrame:
    """The sampled rows of ``docs``, with their columns as they were."""
    return mix(docs, carry=True).filter("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("p", 6).alias("p"), "kept")


def _oracle() -> str:
    """The same fit as DuckDB common table expressions, one per raking step."""
    def hit(pieces: list[str], pattern: str | None) -> str:
        tests = ["(" + " OR ".join(f"contains(x, '{p}')" for p in pieces) + ")"] if pieces else []
        return " AND ".join(tests + ([f"regexp_matches(x, '{pattern}')"] if pattern else []))

    topics = " ".join(f"WHEN {hit(*rule)} THEN '{name}'" for name, *rule in TOPICS)
    steps = [
        "t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS x FROM documents)",
        "d AS (SELECT doc_id, source, lang, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, "
        f"CASE WHEN x = '' THEN 'none' {topics} ELSE 'prose' END AS topic FROM t)",
        "c0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS weight FROM d GROUP BY ALL)",
    ]
    for dim in DIMS:
        steps.append(f"g_{dim} AS (SELECT {dim}, pow(sum(tokens), {ALPHA}) / sum(pow(sum(tokens), {ALPHA})) OVER () AS goal FROM c0 GROUP BY {dim})")
    last = "c0"
    for i in range(ROUNDS * len(DIMS)):
        dim = DIMS[i % len(DIMS)]
        have = f"sum(weight) OVER (PARTITION BY {dim})"
        steps.append(
            f"c{i + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, coalesce(CASE WHEN {have} > 0 THEN weight * goal / {have} END, 0) AS weight FROM {last} JOIN g_{dim} USING ({dim}))"
        )
        last = f"c{i + 1}"
    steps.append(f"p0 AS (SELECT *, 0.0::DOUBLE AS p, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS rate FROM {last})")
    for i in range(SCALINGS):
        factor = f"coalesce(({SHARE} * sum(tokens) OVER () - sum(CASE WHEN p < 1 THEN 0 ELSE tokens END) OVER ()) / nullif(sum(CASE WHEN p < 1 THEN weight ELSE 0 END) OVER (), 0), 0)"
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (p), CASE WHEN p < 1 THEN least(1.0, greatest(0.0, rate * {factor})) ELSE p END AS p FROM p{i})")
    uniform = f"('0x' || substr(md5('{SEED}' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / {1 << 52}"
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, source, lang, topic, n_tokens, round(weight, 9) AS weight, "
        f"round(p, 6) AS p, {uniform} < p AS kept FROM d LEFT JOIN p{SCALINGS} USING (source, lang, topic)"
    )


ORACLE_SQL = _oracle()

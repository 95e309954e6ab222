"""Top-level atoms of rule files: what each is, what it calls, and what is known of its purity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classified(atoms: DataFrame) -> DataFrame:
    """``atoms`` (path, pos, text) with ``head`` and ``kind``: rule, type, query (marked by a ``!`` before it) or fact; the marks go."""
    window = Window.partitionBy("path").orderBy("pos")
    marked = atoms.withColumn("asked", F.coalesce(F.lag("text").over(window) == "!", F.lit(False))).filter("text <> '!'")
    head = F.regexp_extract("text", r"^\(\s*([^\s()]+)", 1)
    kind = F.when(F.col("asked"), "query").when(head == "=", "rule").when(head == ":", "type").otherwise("fact")
    return marked.withColumn("head", head).withColumn("kind", kind)


def rule_heads(found: DataFrame) -> DataFrame:
    """(path, pos, name) of what rules define: the head of their left side."""
    name = F.regexp_extract("text", r"^\(\s*=\s*\(\s*([^\s()]+)", 1)
    return found.filter("kind = 'rule'").select("path", "pos", name.alias("name")).filter("name <> ''")


def calls(found: DataFrame, heads: DataFrame) -> DataFrame:
    """(caller, callee): heads inside the right side of a rule that some rule defines; others build data."""
    body = F.regexp_replace("text", r"^\(\s*=\s*\([^()]*\)\s*", "")
    used = found.filter("kind = 'rule'").select("path", "pos", F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\(\s*([^\s()]+)"), F.lit(1)))).alias("callee"))
    named = used.join(heads, ["path", "pos"]).select(F.col("name").alias("caller"), "callee")
    return named.join(heads.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi").select("caller", "callee").distinct()


def census(heads: DataFrame, tainted: DataFrame, reasons: DataFrame) -> DataFrame:
    """Rules by whether they can be lowered: tainted heads (head) stay interpreted, by the first of their ``reasons`` (head, reason)."""
    first = reasons.groupBy(F.col("head").alias("name")).agg(F.min("reason").alias("reason"))
    marked = heads.select("name").distinct().join(tainted.select(F.col("head").alias("name"), F.lit(True).alias("tainted")).distinct(), "name", "left").join(first, "name", "left")
    kind = F.when(F.col("tainted"), F.coalesce("reason", F.lit("calls an interpreted rule"))).otherwise("lowerable")
    return marked.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))

"""Lint of Python sources that are generated from the part table, so that SQL knows the findings."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quarry.operators import lint
from quarry.plans.base import query, table
from quarry.plans.lintcases import CASES
from quarry.sources import python_source

#: The source of a part: an unused import, a mutable default for small parts, a comparison to None for cheap ones.
BODY = "import os\nimport sys\n\n\ndef part_{k}(x{default}):\n    if x {op} None:\n        return {size}\n    return sys.path\n"
SMALL, CHEAP = "p_size <= 10", "p_retailprice < 1000"


def files(spark, sf):
    part = table(spark, sf, "part")
    text = F.lit(BODY)
    for piece, value in (
        ("{k}", F.col("p_partkey").cast("string")), ("{size}", F.col("p_size").cast("string")),
        ("{default}", F.when(F.expr(SMALL), "=[]").otherwise("")), ("{op}", F.when(F.expr(CHEAP), "==").otherwise("is")),
    ):
        text = F.replace(text, F.lit(piece), value)
    return part.select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


EXPECTED = f"""SELECT 'parts/' || p_partkey || '.py' AS path, 1 AS row, 'F401' AS code FROM part
UNION ALL SELECT 'parts/' || p_partkey || '.py', 5, 'B006' FROM part WHERE {SMALL}
UNION ALL SELECT 'parts/' || p_partkey || '.py', 6, 'E711' FROM part WHERE {CHEAP}"""


@query(EXPECTED)
def lint_generated(spark, sf):
    """Findings of some rules over all generated files."""
    return lint.check(files(spark, sf), {"F401", "B006", "E711", "F821", "F841", "E722"}).select("path", "row", "code")


@query(f"WITH f AS ({EXPECTED}) SELECT code, count(*) AS n, count(DISTINCT path) AS n_files FROM f GROUP BY code")
def lint_statistics(spark, sf):
    return lint.statistics(lint.check(files(spark, sf), {"F401", "B006", "E711"}))


@query("SELECT 'parts/' || p_partkey || '.py' AS path, m AS module FROM part, (VALUES ('os'), ('sys')) v(m)")
def import_scan(spark, sf):
    return python_source.imports(python_source.nodes(files(spark, sf), ["Import", "ImportFrom"])).select("path", "module")


@query(f"SELECT CASE WHEN {SMALL} THEN 37 ELSE 34 END AS n_tokens, count(*) AS n_files FROM part GROUP BY 1")
def token_scan(spark, sf):
    """How many tokens the generated files have."""
    each = python_source.tokens(files(spark, sf)).groupBy("path").agg(F.count(F.lit(1)).alias("n_tokens"))
    return each.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_files"))


#: Queries over the rules by family: name, codes.
FAMILIES = {
    "lint_names": "F[0-9]", "lint_layout": "[EW][0-9]", "lint_bugs": "B[0-9]|BLE|A[0-9]|ASYNC", "lint_comprehensions": "C4|PERF|FURB", "lint_docstrings": "D[0-9]|DTZ|TD|FIX|ERA",
    "lint_naming": "N[0-9]|NPY|PD[0-9]|ANN|FA[0-9]|FBT", "lint_errors": "PL[CE]", "lint_refactoring": "PL[RW]|C9", "lint_upgrades": "UP|YTT|TC|TID|I[0-9]|ICN", "lint_security": "S[0-9]",
    "lint_simplification": "SIM|RET|PIE|RSE|TRY|EM|SLF|SLOT", "lint_paths": "PTH|EXE|CPY", "lint_tests": "PT[0-9]|PGH|LOG|G[0-9]|T[12]|INT|ISC|Q0|COM|FLY|ARG|AIR|DJ|FAST", "lint_rust_named": "RUF", "lint_stubs": "PYI",
}


def family_files(spark, sf, cases):
    """A file per part, in turn the source that meets a rule and the one that does not; its folder is the rule's code."""
    known = spark.createDataFrame([(2 * i + j, code, text, ".pyi" if code.startswith("PYI") else ".py") for i, (code, *both) in enumerate(cases) for j, text in enumerate(both)], "case int, code string, source string, ending string")
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("k"), (F.col("p_partkey") % (2 * len(cases))).cast("int").alias("case"))
    return part.join(F.broadcast(known), "case").select(F.concat("code", F.lit("/"), "k", "ending").alias("path"), F.replace("source", F.lit("{k}"), F.col("k")).alias("text"))


def _family(name, pattern):
    cases = [c for c in CASES if re.match(f"({pattern})", c[0])]
    values = ", ".join(f"({2 * i}, '{code}')" for i, (code, *_) in enumerate(cases))
    sql = f"""SELECT v.code || '/' || p_partkey || CASE WHEN v.code LIKE 'PYI%' THEN '.pyi' ELSE '.py' END AS path, v.code AS code
FROM part JOIN (VALUES {values}) v(i, code) ON p_partkey % {2 * len(cases)} = v.i"""

    def run(spark, sf):
        found = lint.check(family_files(spark, sf, cases), {code for code, *_ in cases})
        return found.filter(F.col("code") == F.split("path", "/")[0]).select("path", "code").distinct()

    run.__name__ = name
    run.__doc__ = f"Which files meet the rule they were made for, for the {len(cases)} rules {pattern}."
    return query(sql)(run)


for _name, _pattern in FAMILIES.items():
    _family(_name, _pattern)

"""Work on files grows with the files, over all cores: a table of one small file is parsed by many tasks, once, and no step reads all earlier ones again."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.operators import dataflow, exports, flow, globs, lint, treepatterns
from quarry.plans import base, editor, further, patterns
from quarry.sources import python_source


def _one_partition(spark, n=64):
    text = F.concat(F.lit("import os\n\n\ndef f"), F.col("id").cast("string"), F.lit("(x):\n    if x:\n        return os\n    return x\n"))
    return spark.range(n).coalesce(1).select(F.concat(F.lit("a/"), F.col("id").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


@pytest.mark.parametrize("parse", [python_source.nodes, python_source.tokens, dataflow.flow, treepatterns.tree, exports.facts])
def test_files_of_one_partition_are_parsed_by_many_tasks(spark, parse):
    rows = parse(_one_partition(spark)).select("path", F.spark_partition_id().alias("task"))
    assert rows.select("path").distinct().count() == 64
    assert rows.select("task").distinct().count() > 4


def test_asked_kinds_are_the_rows_of_all_nodes(spark):
    files = _one_partition(spark, 3)
    kinds = ["Import", "FunctionDef", "Name"]
    told = lambda of: sorted(map(str, of.select("path", "node", "parent", "scope", "kind", "name", "row", F.to_json("attrs").alias("a"), "around", "parent_test", "params_around").collect()))
    assert told(python_source.nodes(files, kinds)) == told(python_source.nodes(files).filter(F.col("kind").isin(kinds)))
    broken = spark.createDataFrame([("b", "def")], "path string, text string")
    assert [r.kind for r in python_source.nodes(broken, kinds).collect()] == ["SyntaxError"]


@pytest.mark.parametrize("query", [editor.definitions, editor.document_symbols, editor.semantic_tokens, further.control_flow, further.outgoing_calls, further.symbol_references])
def test_files_are_parsed_once(spark, sf, query):
    # What is parsed is written; the query reads that, and does not parse again.
    assert "InArrow" not in query(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_flow_out_of_deep_nesting(spark):
    depth = 12
    text = "def f(x):\n" + "".join("    " * (i + 1) + "if x:\n" for i in range(depth)) + "    " * (depth + 1) + "x = 1\n    return x\n"
    nodes = python_source.nodes(spark.createDataFrame([("a", text)], "path string, text string"), flow.KINDS)
    found = flow.edges(nodes)
    rows = {r.node: r.row for r in nodes.collect()}
    assert sorted((rows[e.src], rows.get(e.dst, -1)) for e in found.collect()) == sorted(
        [(i, i + 1) for i in range(2, depth + 2)] + [(i, depth + 3) for i in range(2, depth + 2)] + [(depth + 2, depth + 3), (depth + 3, -1)]
    )


def test_functions_are_solved_whole_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        of = dataflow.flow(_one_partition(spark, 40))
        found = dataflow.solved(of)
        assert found.where("kind = 'idom'").count() == 40 * 4
        assert found.where("kind = 'reach' and text = 'x'").count() == 40 * 2
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_only_files_with_the_word_are_read_for_suppressions(spark, monkeypatch):
    rows = [("a.py", "import os\n"), ("b.py", "import os  # NoQA\n"), ("c.py", "import os  # noqa: F401\n"), ("d.py", "import os  # noqa: E501\n"), ("e.py", "import os\nx = '# noqa'\n"), ("f.py", None)]
    asked = []
    plain = python_source.tokens
    monkeypatch.setattr(python_source, "tokens", lambda files: asked.append(files) or plain(files))
    found = lint.check(spark.createDataFrame(rows, "path string, text string"), {"F401"})
    assert sorted(r.path for r in found.collect()) == ["a.py", "d.py", "e.py"]
    assert sorted(r.path for r in asked[-1].collect()) == ["b.py", "c.py", "d.py", "e.py"]


@pytest.fixture
def repeated(spark, tmp_path):
    """Customers twice under other keys, so that their paths repeat, and parts three times, so that their patterns do."""
    for name, key, times, shift in (("customer", "c_custkey", 2, 150), ("part", "p_partkey", 3, 3000), ("nation", None, 1, 0), ("region", None, 1, 0)):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if key:
            rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(key, F.col(key) + shift * F.col("_i")).drop("_i")
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _by_sql(name, folder):
    con = duckdb.connect()
    for table in ("customer", "part", "nation", "region"):
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return sorted(con.execute(base.ORACLES[name]).fetchall())


def _compiled(monkeypatch):
    asked, plain = [], globs.compiled
    monkeypatch.setattr(globs, "compiled", lambda patterns, *a: asked.append(patterns) or plain(patterns, *a))
    return asked


def test_glob_matches_tries_a_text_once_and_counts_every_file(spark, repeated, monkeypatch):
    asked = _compiled(monkeypatch)
    found = patterns.glob_matches(spark, repeated)
    assert sorted(map(tuple, found.collect())) == _by_sql("glob_matches", repeated)
    assert asked[0].count() == patterns._globs(spark, repeated).select("glob").distinct().count() < 600


def test_globs_wait_under_the_whole_beginning_of_a_name():
    # 'Customer' alone would lead every pattern to every file of the folder.
    assert "h:Customer#000000005." in globs.parsed("*/*/BUILDING/Customer#000000005.*")[1]
    assert "e:a_long_ending_of_a_name.py" in globs.parsed("x/*a_long_ending_of_a_name.py")[1]


def test_glob_overrides_tries_a_text_once_and_takes_its_last_part(spark, repeated, monkeypatch):
    asked = _compiled(monkeypatch)
    found = patterns.glob_overrides(spark, repeated)
    assert sorted(map(tuple, found.collect())) == _by_sql("glob_overrides", repeated)
    assert asked[0].count() == patterns._globs(spark, repeated).select("glob").distinct().count() < 600


def test_last_match_of_equal_globs_and_values(spark):
    of = spark.createDataFrame([("*.py", 1, "a"), ("*.py", 1, "b"), ("{x,*}.py", 1, "c"), ("*.py", None, "z"), ("b.*", 0, "q"), (None, 9, "n")], "glob string, at int, v string")
    paths = spark.createDataFrame([("x.py",), ("x.py",), ("b.txt",), (None,)], "path string")
    assert sorted(map(tuple, globs.last_match(paths, of, "at", ["v"]).collect())) == [("b.txt", 0, "q"), ("x.py", 1, "c")]


def test_unused_imports_are_parsed_once_and_no_side_is_broadcast(spark, sf):
    # Tables by file grow with the files, whatever the bytes read say of them.
    plan = further.imports_removed(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 5


def test_all_patterns_are_not_broadcast_to_join_their_counts(spark, sf):
    plan = patterns.glob_matches(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\w+Join\b", plan)[0] == "SortMergeJoin"

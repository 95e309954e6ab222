"""Class hierarchies, control flow, import blocks, editor questions and models."""

from pyspark.sql import functions as F

from quarry.operators import classes, flow, imports, incremental, models, navigate, reports, suppress
from quarry.sources import python_source

TEXT = """from abc import abstractmethod
from typing import final
class A:
    @abstractmethod
    def f(self):
        pass
    @final
    def g(self):
        pass
class B(A):
    def g(self):
        return 1
class C(B):
    def f(self):
        return self.g()
@final
class D(D2):
    pass
class D2(D):
    pass
"""


def nodes_of(spark, *texts):
    return python_source.nodes(spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, text string"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_classes(spark):
    nodes = nodes_of(spark, TEXT).cache()
    closure = classes.ancestors(navigate.type_edges(nodes))
    assert ("C", "A") in rows(closure) and rows(classes.cyclic(closure)) == [("D",), ("D2",)]
    found = classes.methods(nodes)
    assert rows(classes.override_sets(found, closure)) == [("B", ["g"]), ("C", ["f"])]
    assert rows(classes.override_of_final(found, closure).select("class", "method")) == [("B", "g")]
    wanted = spark.createDataFrame([("B",), ("C",)], "class string")
    assert rows(classes.unimplemented(found, closure, wanted)) == [("B", "f")]
    assert rows(classes.subclass_of_final(nodes).select("sub", "super")) == [("D2", "D")]


def test_flow(spark):
    text = "def f(a):\n    if a:\n        x = 1\n    else:\n        return 2\n    while a:\n        a = 0\n    return 3\n    b = 1\n"
    nodes = nodes_of(spark, text).cache()
    row = {r.node: r.row for r in nodes.collect()} | {-1: "end"}
    got = {(row[r.src], row[r.dst]) for r in flow.edges(nodes).collect()}
    assert got >= {(2, 3), (2, 5), (3, 6), (5, "end"), (6, 7), (7, 6), (6, 8), (8, "end")} and (5, 6) not in got
    assert rows(flow.unreachable(nodes).select("row")) == [(9,)]
    assert reports.mermaid(flow.edges(nodes), "func").first().text.startswith("graph TD\n")


def test_import_blocks(spark):
    text = "import b10\nimport b9 as c\nfrom __future__ import annotations\nfrom os import path, PATH, Path\nfrom os import sep as s\nfrom . import y\nimport mine.x\nimport sys\n"
    found = imports.ordered(python_source.imports(nodes_of(spark, text)), ["mine"])
    assert [(r.section, r.text) for r in found.orderBy("place").collect()] == [
        ("future", "from __future__ import annotations"), ("standard", "import sys"), ("standard", "from os import PATH, Path, path, sep as s"),
        ("third_party", "import b9 as c"), ("third_party", "import b10"), ("first_party", "import mine.x"), ("local", "from . import y"),
    ]


def test_navigation(spark):
    text = "import os\ndef f(a):\n    return g(a)\ndef g(b):\n    'doc'\n    return os.sep + b\nf(1)\n"
    nodes = nodes_of(spark, text).cache()
    assert rows(navigate.definitions(nodes).filter("name = 'os'").select("row", "def_row", "def_kind")) == [(6, 1, "import")]
    assert rows(navigate.incoming(nodes)) == [("f", ["p0::<module>"]), ("g", ["p0::f"])]
    assert rows(navigate.outgoing(nodes).select("caller", "callees")) == [("<module>", ["f"]), ("f", ["g"])]
    assert rows(navigate.hover(nodes).select("signature", "doc").fillna("")) == [("def f(a)", ""), ("def g(b)", "doc")]
    assert navigate.workspace_symbols(nodes, "").count() == 0
    places = spark.createDataFrame([("p0", 3, 13)], "path string, place_row int, place_col int")
    assert [r.kind for r in navigate.selection_ranges(nodes, places).orderBy("depth").collect()][:4] == ["Name", "Call", "Return", "FunctionDef"]
    scope = nodes.filter("kind = 'FunctionDef' and name = 'f'").first().node
    assert rows(navigate.rename_edits(nodes, "p0", scope, "a", "z").select("row", "col")) == [(2, 6), (3, 13)]


def test_suppressions_and_positions(spark):
    of = spark.createDataFrame([("a", "x\ny  \nz"), ("b", "w")], "path string, text string")
    found = spark.createDataFrame([("a", 2, "E1"), ("a", 2, "F1"), ("a", 3, "E1")], "path string, row int, code string")
    assert rows(suppress.add_noqa(of, found)) == [("a", "x\ny  # noqa: E1, F1\nz  # noqa: E1", 2), ("b", "w", 0)]
    edits = spark.createDataFrame([("a", 1, 3, "wxyz"), ("a", 5, 5, "q"), ("a", 9, 11, None)], "path string, start int, end int, content string")
    assert [r.new_start for r in suppress.shifted(edits).orderBy("start").collect()] == [1, 7, 12]
    assert [r.kind for r in suppress.edit_kind(edits).orderBy("start").collect()] == ["replacement", "insertion", "deletion"]
    fixes = spark.createDataFrame([("a", 1, 2, 1, 7, "safe"), ("a", 3, 4, 2, 7, "unsafe"), ("a", 5, 6, 3, None, "display_only")], "path string, start int, end int, fix_id int, isolation int, applicability string")
    assert rows(suppress.applicable(fixes, "unsafe").select("fix_id")) == [(1,), (2,)]
    assert rows(suppress.one_per_group(fixes).select("fix_id")) == [(1,), (3,)]


def test_models(spark):
    cols = [("T", "name", "String", False, None, None), ("T", "at", "DateTime", None, None, None), ("T", "id", "Integer", None, True, None), ("T", "b", "LargeBinary", None, None, None), ("T", "sheet_id", "Integer", None, None, "sheets.id")]
    found = models.columns(spark.createDataFrame(cols, "model string, name string, ctor string, nullable boolean, primary_key boolean, foreign_key string"))
    assert {r.name: (r.type, r.not_null) for r in found.collect()} == {"name": ("string", True), "at": ("datetime", None), "id": ("integer", True), "b": (None, None), "sheet_id": ("integer", None)}
    rel = spark.createDataFrame([("T", "sheet", None, "rows"), ("T", "parts", True, None), ("T", "x", False, None)], "model string, name string, uselist boolean, backref string")
    assert {r.name: (r.kind, r.key) for r in models.associations(rel, found).collect()} == {"sheet": ("BelongsTo", "sheet_id"), "parts": ("HasMany", None), "x": ("BelongsTo", None)}
    functions = spark.createDataFrame([("p", "f", [("app.route", ["POST"])]), ("p", "g", [("x", None), ("bp.route", None)]), ("p", "h", [])], "path string, name string, decorators array<struct<name:string,methods:array<string>>>")
    assert rows(models.routes(functions).select("name", "methods", "action")) == [("f", ["POST"], "mutation"), ("g", ["GET"], "read")]
    assert spark.createDataFrame([("a/b/mod.py",)], "p string").select(models.family(F.col("p"))).first()[0] == "mod"
    rules = spark.createDataFrame([("any", "*", "class", 0), ("dc", "dataclass", "class", 1)], "rule string, selector string, kind string, least_args int")
    defs = spark.createDataFrame([("p", "A", "class", [("dataclass", 1)]), ("p", "B", "class", [("x", 0)]), ("p", "f", "function", [("dataclass", 1)])], "path string, name string, kind string, decorators array<struct<name:string,n_args:int>>")
    assert rows(models.matched(defs, rules).select("name", "rule")) == [("A", "any"), ("A", "dc"), ("B", "any")]


def test_incremental_results(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "y2"), ("c", "z")], "path string, text string")
    analyse = lambda of: of.select("path", F.length("text").alias("n"), F.lit("new").alias("origin"))
    known = spark.createDataFrame([("a", "x"), ("b", "y"), ("gone", "q")], "path string, text string").select("path", F.lit(1).alias("n"), F.lit("old").alias("origin"), F.md5(F.col("text").cast("binary")).alias("digest"))
    assert rows(incremental.refresh(files, known, analyse).select("path", "n", "origin")) == [("a", 1, "old"), ("b", 2, "new"), ("c", 1, "new")]
    events = spark.createDataFrame([(1, "created", "a", None), (2, "rescan", None, None), (3, "renamed", "b", "c")], "seq int, kind string, path string, target string")
    assert rows(incremental.state(incremental.normalised(events))) == [("a", "created", True), ("b", "deleted", False), ("c", "created", False)]

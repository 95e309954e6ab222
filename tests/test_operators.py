"""Fact, graph, range, order and source operators on small tables."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import names
from quarry.operators import families, graph, lines, order, rel, reports, triples
from quarry.sources import files, triples as store
from quarry.streaming import changes


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, expression, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(expression.alias("r")).first().r


@pytest.mark.parametrize("name, key", [("OrderLine", "order_line"), ("shop:Basket", "basket"), ("in_stock", "in_stock"), ("XMLFeed", "xmlfeed"), ("v2Price", "v2_price")])
def test_concept_key(spark, name, key):
    assert one(spark, names.concept_key(F.col("v")), name) == key


def test_codebook_splits(spark):
    models = spark.createDataFrame([("OrderLine",), ("Basket",), ("Weather",)], "name string")
    book = spark.createDataFrame([(2, "basket", 7), (1, "basket", 9), (3, "order_line", 4), (4, "voucher", 5)], "position int, concept string, class_id int")
    found = triples.codebook(models, book)
    assert rows(found.filter("class_id is not null").select("class_id")) == [(4,), (9,)]
    assert rows(found.filter("class_id is null").select("name")) == [("Weather",)]


@pytest.mark.parametrize("text, digest", [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")])
def test_fnv_known_answers(spark, text, digest):
    assert one(spark, names.fnv_hex(F.col("v")), text) == digest


@pytest.mark.parametrize("name, fine", [("", False), ("a\tb", False), ("a\nb", False), ("shop::?::x", False), ("shop::valid?", True), ("bell\x07", False)])
def test_names(spark, name, fine):
    assert one(spark, names.is_name(F.col("v")), name) is fine


def test_escapes_paths_and_widths(spark):
    assert one(spark, names.escaped(F.col("v")), "a\tb\nc\\d") == "a\\tb\\nc\\\\d"
    assert one(spark, names.escaped(F.col("v")), "") == "-"
    assert one(spark, names.inside(F.col("v")), "./a//b/") == "a/b" and one(spark, names.inside(F.col("v")), "../a") is None
    assert one(spark, names.display_width(F.col("v")), "'亜'") == 4 and names.text_width("a\tb") == 5
    assert one(spark, names.is_plural(F.col("v")), "s") is True and one(spark, names.is_plural(F.col("v")), "class") is False
    assert one(spark, names.natural_key(F.col("v")), "a10") > one(spark, names.natural_key(F.col("v")), "a9")


@pytest.mark.parametrize("comment, pragma", [("# type: ignore", True), ("# noqa: F401", True), ("# NoQA", True), ("# nosec B602, B607", True), ("# isort: off", True), ("# just a comment", False)])
def test_pragmas(spark, comment, pragma):
    assert one(spark, names.is_pragma(F.col("v")), comment) is pragma


RECIPES = [
    ("open_shop", [], ["hours"], ["hours"], [], [], "Default"), ("trim", ["label"], ["label"], [], [], [], "Normalize"), ("add_up", ["price", "tax"], ["total"], [], [], [], "Compute"),
    ("restock", ["level"], ["level"], [], ["order_goods"], [], "Cascade"), ("check_age", ["age"], [], [], [], ["TooYoung"], "Guard"), ("refund", [], ["paid"], [], ["pay_out"], ["NoMoney"], "Compensate"),
    ("sell", ["stock"], ["stock"], [], [], ["SoldOut"], "WriteRaise"), ("idle", [], [], [], [], [], "Empty"), ("peek", ["stock", "price"], [], [], [], [], "Observe"),
]


def test_recipes(spark):
    schema = "s string, reads array<string>, writes array<string>, guarded array<string>, calls array<string>, raises array<string>, want string"
    assert all(r.recipe == r.want for r in triples.classified(spark.createDataFrame(RECIPES, schema)).collect())


def test_triples_refuse_bad_lines(spark, tmp_path):
    good = '{"s":"a","p":"rdf:type","o":"ogit:ObjectType","f":1.0,"c":1.0}'
    for bad, says in (("NOT JSON", "not a JSON"), (good.replace("rdf:type", "depend_on"), "unknown predicate depend_on"), (good[:-1] + ',"x":42}', "unknown field x"), ('{"s":"a"}', "missing field")):
        path = tmp_path / f"{abs(hash(says))}.json"
        path.write_text(f"\n{good}\n\n{bad}\n")
        with pytest.raises(Exception, match=f"line 4: {says}"):
            store.read_triples(spark, str(path)).collect()
    fine = tmp_path / "fine.json"
    fine.write_text(f"\n{good}\n\n")
    assert store.read_triples(spark, str(fine)).count() == 1


def test_order_of_declarations(spark):
    found = spark.createDataFrame([("t", 0, "a"), ("t", 1, "b"), ("u", 0, "b"), ("u", 1, "a"), ("v", 0, "a"), ("v", 1, "b"), ("v", 2, "a"), ("w", 0, "a")], "scope string, seq int, name string")
    assert rows(order.relation(found, ["scope"], "name", "seq", "a", "b")) == [("t", "before"), ("u", "after"), ("v", "unknown"), ("w", "unknown")]
    assert {r.relation for r in order.relation(found, ["scope"], "name", "seq", "a", "a").collect()} == {"unknown"}


def test_import_maps(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("i",)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    assert rows(graph.dependencies(nodes, edges)) == [("a", ["b", "c"]), ("b", ["c"]), ("c", []), ("i", [])]
    assert rows(graph.dependents(nodes, edges)) == [("a", []), ("b", ["a"]), ("c", ["a", "b"]), ("i", [])]
    given = spark.createDataFrame([('{"a.rb":["b.rb","c.rb","b.rb"],"b.rb":[]}',)], "json string")
    assert rows(store.import_edges(given)) == [("a.rb", "b.rb"), ("a.rb", "c.rb")]


@pytest.mark.parametrize("calls, direct, tainted", [([("a", "b")], ["b"], ["a", "b"]), ([("a", "b"), ("b", "c")], ["c"], ["a", "b", "c"]), ([("a", "a")], [], []), ([("e", "o"), ("o", "e")], ["o"], ["e", "o"])])
def test_taint(spark, calls, direct, tainted):
    found = graph.tainted(spark.createDataFrame(calls, "caller string, callee string"), spark.createDataFrame([(d,) for d in direct], "head string"))
    assert [r.head for r in found.orderBy("head").collect()] == tainted


def test_asof(spark):
    left = spark.createDataFrame([("x", 1), ("x", 5), ("y", 5)], "k string, at int")
    right = spark.createDataFrame([("x", 1, "p"), ("x", 3, "q"), ("x", 5, "r"), ("y", 6, "s")], "k string, at int, v string")
    assert rows(rel.asof_backward(left, right, ["k"], "at", ["v"])) == [("x", 1, "p"), ("x", 5, "r"), ("y", 5, None)]
    assert [r.v for r in rel.asof_backward(left, right, ["k"], "at", ["v"], strict=True).orderBy("k", "at").collect()] == [None, "q", None]


def test_range_join_and_smallest_cover(spark):
    points = spark.createDataFrame([("f", 1, 5), ("f", 2, 10), ("g", 3, 5)], "k string, p int, at int")
    ranges = spark.createDataFrame([("f", "wide", 0, 100), ("f", "near", 4, 10), ("f", "none", 7, 7)], "k string, r string, a int, b int")
    for width in (1, 3, 1000):
        held = rel.range_join(points, ranges, ["k"], "at", "a", "b", width)
        assert rows(held.select("p", "r")) == [(1, "near"), (1, "wide"), (2, "wide")]
        assert rows(rel.smallest_cover(held, ["p"], "a", "b", ["r"]).select("p", "r")) == [(1, "near"), (2, "wide")]
        closed = rel.range_join(points, ranges, ["k"], "at", "a", "b", width, closed=True)
        assert rows(closed.select("p", "r")) == [(1, "near"), (1, "wide"), (2, "near"), (2, "wide")]


def test_balance_and_diff(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "f string, v int")
    right = spark.createDataFrame([("a", 1), ("c", 1)], "f string, v int")
    found = rel.balance(left, right, ["f"])
    assert rows(found) == [("a", 2, 1, False), ("b", 1, 0, False), ("c", 0, 1, False)]
    with pytest.raises(Exception, match="not conserved: a has 2 and 1"):
        rel.assert_balanced(found.filter("f = 'a'"), ["f"]).collect()
    assert rows(rel.set_diff(left, right)) == [("a", 2, "left"), ("b", 1, "left"), ("c", 1, "right")]


def test_prefixes_paths_and_ranks(spark):
    modules = spark.createDataFrame([("a",), ("a.b",)], "module string")
    wanted = spark.createDataFrame([("a.b.c",), ("a.x",), ("z",)], "name string")
    assert rows(graph.longest_prefix(wanted, modules)) == [("a.b.c", "a.b"), ("a.x", "a"), ("z", None)]
    assert graph.longest_prefix(wanted, modules, least=2).filter("name = 'a.x'").first().module is None
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "x")], "child string, parent string")
    found = graph.paths(edges, spark.createDataFrame([("a",)], "node string"))
    assert sorted(r.path for r in found.collect()) == ["a", "a/b", "a/b/c"]


def test_lines_and_comments(spark):
    text = "x = 1  # one\n# a\n# b\n\n#\n#\n  # c\n"
    of = lines.lines(spark.createDataFrame([("p", text)], "path string, text string"))
    assert [(r.line_no, r.start) for r in of.orderBy("line_no").collect()][:3] == [(1, 0), (2, 13), (3, 17)]
    assert of.count() == 7
    found = lines.comments(of)
    assert found.filter("own_line").count() == 5
    assert rows(lines.comment_blocks(found, "path")) == [("p", 2, 3)]


def test_families(spark):
    parts = spark.createDataFrame([("f", 1, "a"), ("f", 1, "b"), ("f", 2, "a"), ("g", 3, "c")], "family string, member int, part string")
    assert rows(families.common_parts(parts, "family", "member", "part")) == [("f", "a"), ("g", "c")]
    wanted = spark.createDataFrame([("tst",), ("other",)], "n string")
    known = spark.createDataFrame([("test",), ("toast",), ("tests",)], "c string")
    assert rows(families.nearest(wanted, known, "n", "c"))[1] == ("tst", "test", 1)


def test_renderers_escape(spark):
    found = spark.createDataFrame([("a,b:c.py", 3, 1, "E1", "error", 'x < "y" %\n')], "path string, row int, col int, code string, severity string, message string")
    assert reports.github(found).first().text == '::error title=E1,file=a%2Cb%3Ac.py,line=3,col=1::x < "y" %25%0A'
    assert "&lt; &quot;y&quot;" in reports.junit(found).first().text
    twice = found.unionByName(found.withColumn("row", F.lit(9)))
    assert reports.gitlab(twice).select("fingerprint").distinct().count() == 2


def test_store_round_trip_and_header(spark, tmp_path):
    table = spark.createDataFrame([("CRATE", "x", None), ("A", "tab\there", "o"), ("A", "tab\there", "o")], "predicate string, subject string, object string")
    columns = ["predicate", "subject", "object"]
    store.write_rows(table, columns, str(tmp_path / "s"), "rows")
    assert rows(store.read_rows(spark, str(tmp_path / "s"), columns, "rows").fillna("?")) == [("A", "tab\\there", "o"), ("CRATE", "x", "?")]
    with pytest.raises(ValueError):
        store.read_rows(spark, str(tmp_path / "s"), columns, "rows", version=2)


def test_tree_scan_globs_notebooks_and_scripts(spark, tmp_path):
    (tmp_path / "tests").mkdir()
    (tmp_path / "a.py").write_text("# /// script\n# x = 1\n# ///\nprint(1)\n")
    (tmp_path / "tests" / "b.py").write_text("no")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    found = files.read_tree(spark, str(tmp_path))
    assert rows(found.select("path", "error").fillna("")) == [("a.py", ""), ("bad.py", "not UTF-8")]
    assert found.filter("path = 'a.py'").select(files.script_metadata(F.col("text"))).first()[0] == "x = 1\n"
    assert len(files.snapshot(found.filter("error is null")).first().digest) == 16
    book = '{"cells":[{"cell_type":"code","source":["a\\n","b"]},{"cell_type":"markdown","source":["t"]},{"cell_type":"code","source":["c"]}]}'
    cells = files.notebook_cells(spark.createDataFrame([("n", book)], "path string, text string"))
    assert [(r.cell, r.text, r.start_row) for r in cells.orderBy("cell").collect()] == [(0, "a\nb", 1), (2, "c", 3)]
    path = spark.createDataFrame([("src/a/b.py",), ("src/t/x.py",), ("b.txt",)], "path string")
    assert rows(path.filter(files.included(F.col("path"), ["**/*.py"], ["src/t/**"]))) == [("src/a/b.py",)]


def test_change_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:01:00", "b"), (2, "2024-01-01 00:00:30", "c")], "k int, ts string, v string").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    live = changes.latest(changes.stream(spark, str(tmp_path / "in"), "k int, ts timestamp, v string", per_trigger=1), "k", "ts", ["v"])
    changes.run_once(live, str(tmp_path / "out"), str(tmp_path / "check"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(changes.latest(events, "k", "ts", ["v"]))
    assert rows(changes.sessions(events, "k", "ts").select("k", "n")) == [(1, 2), (2, 1)]

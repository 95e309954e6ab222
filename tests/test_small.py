"""Addresses, atoms and facts of the language."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import stdlib
from quarry.operators import addresses, atoms, graph

OPS = "block int, idx int, op string, dst_space string, dst_offset bigint, a_space string, a_offset bigint, b_space string, b_offset bigint, addr_space string, addr_offset bigint"


@pytest.mark.parametrize(
    "ops, found",
    [
        ([(1, 0, "IntAdd", "Unique", 7936, "Const", 0xCE00, "Unique", 7680, None, None), (1, 1, "Copy", "Register", 1, None, None, None, None, None, None), (1, 2, "Store", None, None, None, None, None, None, "Unique", 7936)], [0xCE00]),
        ([(1, 0, "IntAdd", "Unique", 5, "Const", 1, "Unique", 2, None, None), (1, 1, "IntAdd", "Unique", 5, "Const", 0x1234, "Unique", 2, None, None), (1, 2, "Store", None, None, None, None, None, None, "Unique", 5)], [0x1234]),
        ([(1, 0, "IntSub", "Unique", 5, "Const", 1, "Unique", 2, None, None), (1, 1, "Store", None, None, None, None, None, None, "Unique", 5)], []),
        ([(1, 0, "Load", "Unique", 1, None, None, None, None, "Const", 0xFFFE)], [0xFFFE]),
        ([(1, 0, "Store", None, None, None, None, None, None, "Unique", 9)], []),
        ([(1, 0, "Load", "Unique", 1, None, None, None, None, "Register", 3)], []),
        ([(2, 0, "IntAdd", "Unique", 5, "Const", 1, "Unique", 2, None, None), (1, 1, "Store", None, None, None, None, None, None, "Unique", 5)], []),
        ([(1, 0, "IntAdd", "Unique", 5, "Const", 0xFFFFFFFF, "Const", 2, None, None), (1, 1, "Load", "Unique", 6, None, None, None, None, "Unique", 5)], [1]),
    ],
)
def test_addresses(spark, ops, found):
    assert [r.address for r in addresses.resolved(spark.createDataFrame(ops, OPS)).collect()] == found


def test_atoms(spark):
    texts = ["(= (f $x) (g $x))", "(= (g $x) (println! $x))", "(: f (-> A B))", "!", "(f 1)", "(Fact a)", "(= (h $x) (Pair $x (f $x)))"]
    found = atoms.classified(spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "path string, pos int, text string"))
    assert [r.kind for r in found.orderBy("pos").collect()] == ["rule", "rule", "type", "query", "fact", "rule"]
    heads = atoms.rule_heads(found)
    edges = atoms.calls(found, heads)
    assert sorted(tuple(r) for r in edges.collect()) == [("f", "g"), ("h", "f")]
    direct = spark.createDataFrame([("g", "println!")], "head string, reason string")
    tainted = graph.tainted(edges, direct)
    assert sorted(r.head for r in tainted.collect()) == ["f", "g", "h"]
    assert sorted(tuple(r) for r in atoms.census(heads, tainted, direct).collect()) == [("calls an interpreted rule", 2), ("println!", 1)]


@pytest.mark.parametrize(
    "function, value, result",
    [
        (stdlib.log_level, "warning", 30), (stdlib.log_level, "nothing", None), (stdlib.open_mode, "rb+", 1 | 16 | 64), (stdlib.open_mode, "rw", None), (stdlib.open_mode, "rr", None),
        (stdlib.open_mode, "U", 128), (stdlib.open_mode, "bt", None), (stdlib.reduced_mode, "rt", ""), (stdlib.reduced_mode, "rb", "rb"), (stdlib.is_identifier, "été", True),
        (stdlib.is_identifier, "class", False), (stdlib.is_identifier, "1a", False), (stdlib.is_module_name, "a_b1", True), (stdlib.is_migration_name, "0001_x", True),
        (stdlib.is_mangled_private, "__x", True), (stdlib.is_mangled_private, "__x__", False),
    ],
)
def test_language_facts(spark, function, value, result):
    assert spark.createDataFrame([(value,)], "v string").select(function(F.col("v"))).first()[0] == result


def test_navigation_digest(spark):
    from quarry.operators import navdigest

    facts = [("s1", "opens", "s2"), ("s1", "opens", "s2"), ("s1", "docks", "Left"), ("s2", "docks", "odd"), ("s1", "has_control", "a"), ("s1", "has_control", "b"), ("s2", "binds_concept", "patient")]
    got = sorted(tuple(r) for r in navdigest.digest(spark.createDataFrame(facts, "s string, p string, o string")).collect())
    assert got == [("bindings", "s2", "patient"), ("controls", "s1", "2"), ("edges", "s1", "s2"), ("regions", "s1", "navigation"), ("regions", "s2", "unmapped:odd")]
    opens = spark.createDataFrame([("m", "x", 2), ("k", "x", 1), ("z", "y", 1)], "opener string, screen string, pos int")
    assert sorted(tuple(r) for r in navdigest.parents(opens).collect()) == [("x", "k"), ("y", "z")]
    functions = spark.createDataFrame([(["a", "b"],), (["a"],), ([],)], "reads array<string>")
    assert sorted(tuple(r) for r in navdigest.group_census(functions, {"one": ["a", "b"], "two": ["b"]}, "reads").collect()) == [("one", 2), ("two", 1)]

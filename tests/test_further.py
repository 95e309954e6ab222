"""Resolution, bundles, trivia and graphs on small tables, beyond what the registered queries show."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import names, trivia
from quarry.operators import bundles, families, graph, lines, rel, resolve


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression.alias("r")).first().r


def test_paths_go_to_any_depth_and_end_at_cycles(spark):
    chain = [(f"n{i + 1}", f"n{i}") for i in range(40)] + [("n0", "n40"), ("n2", "n40")]
    edges = spark.createDataFrame(chain, "child string, parent string")
    found = graph.paths(edges, spark.createDataFrame([("n0",)], "node string"))
    assert found.agg(F.max("level")).first()[0] == 40 and found.count() == 41


def test_nearest_compares_every_candidate(spark):
    held = [f"word{i:03d}" for i in range(60)]
    asked = ["word01", "wrd059", "zzz", "word000"]
    ask, known = spark.createDataFrame([(a,) for a in asked], "n string"), spark.createDataFrame([(h,) for h in held] * 2 + [(None,)], "c string")
    whole = rows(families.nearest(ask, known, "n", "c"))
    assert whole == rows(families.nearest(ask, known, "n", "c", block=7))
    assert {r[0]: r[1] for r in whole}["word000"] == "word000"
    assert rows(families.nearest(ask, known.limit(0), "n", "c")) == sorted(((a, None, None) for a in asked), key=repr)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
    return row[-1]


@pytest.mark.parametrize("block", [9, 5_000])
def test_nearest_equals_brute_force(spark, block):
    """Names none, one, two and more edits away, shared beginnings, texts of no and of many characters, characters beyond ASCII, a null."""
    rng = random.Random(3)
    held = {"common" + "".join(rng.choices("abß𝄞", k=rng.randint(0, 6))) for _ in range(60)} | {"", "a", "x" * 33, "x" * 34, "y" * 60}
    asked = {"", "b", "zz", "x" * 30, "x" * 31, "x" * 32, "x" * 35, "x" * 36, "y" * 58, "q" * 50, None}
    for word in sorted(held):
        for edits in range(4):
            letters = list(word)
            for _ in range(edits):
                at = rng.randint(0, len(letters))
                letters[at : at + rng.randint(0, 1)] = rng.choices("abß𝄞c", k=rng.randint(0, 1))
            asked.add("".join(letters))
    ask, known = spark.createDataFrame([(a,) for a in asked], "n string"), spark.createDataFrame([(h,) for h in held] * 2 + [(None,)], "c string")
    got = {r[0]: r[1:] for r in rows(families.nearest(ask, known, "n", "c", block=block))}
    wanted = {a: min((distance(a, h), h) for h in held) if a is not None else (None, None) for a in asked}
    assert got == {a: (h, d) for a, (d, h) in wanted.items()}


def test_lines_have_their_offsets(spark):
    """Long and empty texts, every kind of line end, and several texts of one key."""
    texts = [(1, "\n".join("é" * (i % 7) for i in range(3_000))), (1, "a\n"), (2, ""), (3, "é\r\nb\r\r\n\n"), (4, "\n" * 256), (5, "\n" * 127), (6, None)]
    wanted = []
    for key, text in texts:
        parts, start = re.sub("\r\n?", "\n", text).split("\n") if text is not None else [], 0
        for i, line in enumerate(parts):
            if line or i < len(parts) - 1:
                wanted.append((key, i + 1, start, line, i == len(parts) - 1))
            start += len(line.encode()) + 1
    found = lines.lines(spark.createDataFrame(texts, "k int, t string"), "k", "t")
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert "Exchange" not in found._jdf.queryExecution().toString()


def test_imports_prefer_members_and_sources(spark):
    files = spark.createDataFrame([("a/__init__.py",), ("a/b.py",), ("a/b.pyi",), ("c.pyi",)], "path string")
    asked = spark.createDataFrame([("a", "b"), ("a", "x"), ("c", None), ("d", None)], "module string, name string")
    assert rows(resolve.resolved(asked, files)) == sorted([("a", "b", "a/b.py", "member"), ("a", "x", "a/__init__.py", "parent"), ("c", None, "c.pyi", "member"), ("d", None, None, "unresolved")], key=repr)


def test_digits_and_pairs(spark):
    ranks = spark.createDataFrame([(1,), (255,), (256,), (511,)], "r int").select(bundles.digits(F.col("r")).alias("d"))
    assert [r.d for r in ranks.collect()] == ["1", "255", "1.1", "2.1"]
    held = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "c"), (2, "b"), (3, "c")], "m int, p string")
    assert rows(bundles.together(held, "m", "p")) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def test_trivia(spark):
    assert one(spark, trivia.expand_tabs(F.col("v")), "a\tbc\td") == "a\tbc\td".expandtabs(8)
    assert one(spark, trivia.indentation_at(F.col("v"), F.lit(6)), "ab\n  \tx") == "  \t"
    assert one(spark, trivia.indentation_at(F.col("v"), F.lit(5)), "ab\n c d") is None
    assert [one(spark, trivia.suppression_kind(F.col("v")), c) for c in ("# fmt: off", "# fmt:on", "#fmt: skip", "# yapf: enable", "# format")] == ["off", "on", "skip", "on", None]
    assert one(spark, trivia.raw_contents(F.col("v")), "rb'''a'b'''") == "a'b" and one(spark, trivia.raw_contents(F.col("v")), "abc") is None
    assert [one(spark, trivia.origin(F.col("v")), c) for c in ("PTH118", "PT011", "S101", "SIM102", "C401", "X1")] == ["paths", "pytest", "security", "simplification", "comprehensions", None]
    assert one(spark, trivia.builtin_module(F.col("v"), F.lit(10), {"tomllib": 11, "json": 0}), "tomllib") is False


def test_digests_of_a_batch():
    texts = pd.Series(["", "a", "foobar", None, "é" * 50, "a" * 1000])
    want = [None if t is None else f"{names.fnv64(t.encode()):016x}" for t in texts]
    assert names._fnv_all(texts).tolist() == want
    assert names._fnv_all(pd.Series([], dtype=object)).tolist() == [] and isinstance(np.uint64(1), np.uint64)


def test_widest_cover_and_points_in_ranges(spark):
    points = spark.createDataFrame([("f", 1, 5), ("g", 2, 5)], "k string, p int, at int")
    ranges = spark.createDataFrame([("f", "wide", 0, 100), ("f", "near", 4, 10), ("f", "late", 6, 9), ("g", "none", 6, 9)], "k string, r string, a int, b int")
    held = rel.range_join(points, ranges, ["k"], "at", "a", "b", 3)
    assert rows(rel.widest_cover(held, ["p"], "a", "b", ["r"]).select("p", "r")) == [(1, "wide")]
    assert rows(rel.with_points(ranges, points, ["k"], "at", "a", "b").select("k", "r")) == [("f", "near"), ("f", "wide")]

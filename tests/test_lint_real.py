"""Lint on sources that are not planted for a rule: ordinary files, generated ones, and names as Python has them."""

import ast
from pathlib import Path

from quarry.operators import lint

STDLIB = sorted(Path(ast.__file__).parent.glob("*.py"))
HARD = {
    "deep.py": "x = " + " + ".join(["1"] * 600) + "\n", "chain.py": "a = 1\nx = a" + ".f()" * 300 + "\n", "big.py": "n = " + "9" * 5000 + "\n", "minus.py": "y = " + "-" * 1500 + "1\n", "none.py": None,
    "keys.py": "import rsa\nsize = f = x = 1\nrsa.generate_private_key(65537, size)\nf()(1, 'key')\nx[0](1, 'key')\ny = (1, 2)[99999999999]\n",
}


def found(spark, texts, codes=None):
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    return {(r.path, r.row, r.code) for r in lint.check(files, codes).collect()}


def test_all_rules_over_ordinary_files(spark):
    texts = {p.name: p.read_text(encoding="utf-8", errors="replace") for p in STDLIB[10:16]} | HARD
    rows = found(spark, texts)
    assert len({code for _, _, code in rows}) > 40
    assert {p for p, _, code in rows if code == "F821"} == set()


def test_names_that_are_bound_in_less_usual_ways(spark):
    text = """import os, sys, re, json
from typing import List

class Stack[T]:
    __marker = 1
    def pop(self, default=__marker) -> T:
        return default

def first[K](x: List[K]) -> K:
    match x:
        case {'a': y, **rest}:
            return y, rest
        case [z, *others]:
            return z, others
        case _ as whole:
            return whole
    return [last := i for i in x], last

type Pair[P] = tuple[P, P]
names = ['os']

def quoted(x: "re.Pattern"):
    import sys
    return sys.path

def later():
    import json
    width: int = 3
    unset: int
    with open("f") as handle:
        pass
    return missing
"""
    rows = found(spark, {"m.py": text}, {"F821", "F401", "F841"})
    at = {line: i for i, line in enumerate(text.splitlines(), 1)}
    assert {r for _, r, c in rows if c == "F821"} == {at["    return missing"]}
    # os is only named by an ordinary list; the outer sys and both json are never read.
    assert sorted((r for _, r, c in rows if c == "F401")) == [1, at["    import json"]]
    assert {r for _, r, c in rows if c == "F841"} == {at["    width: int = 3"], at['    with open("f") as handle:']}


def test_exports_are_uses(spark):
    rows = found(spark, {"m.py": "import a, b, c, d\n__all__ = ['a']\n__all__ += ['b']\n__all__.extend(['c'])\n"}, {"F401"})
    assert rows == {("m.py", 1, "F401")}

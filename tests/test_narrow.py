"""Lint reads only what the enabled rules ask for; that must not change a finding."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.operators import lint, lint_files, lint_more, lint_rules
from quarry.plans.lintcases import CASES
from quarry.plans.sourcecode import FAMILIES
from quarry.sources import python_source

LIBRARY = Path(python_source.ast.__file__).parent
TABLE = [*lint.NODE_RULES, *lint_more.NODE_RULES, *lint_rules.NODE_RULES]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(f"{code}/{i}{'.pyi' if code.startswith('PYI') else '.py'}", text.replace("{k}", "7")) for code, *both in CASES for i, text in enumerate(both)]
    rows += [(f"lib/{n}.py", (LIBRARY / f"{n}.py").read_text()) for n in ("abc", "bisect", "copy", "dis", "functools", "typing")]
    rows += [("odd/exports.py", "import a, b, c\n__all__ = ['a']\n__all__ += ['b']\n__all__.append('c')\n"), ("odd/wide.py", "import a\n__ａｌｌ__ = ['a']\n"), ("odd/broken.py", "x = (\n")]
    return spark.createDataFrame(rows, "path string, text string").repartition(4)


@pytest.fixture(scope="module")
def everything(files):
    return {tuple(r) for r in lint.check(files).select("path", "row", "col", "code", "message").collect()}


@pytest.mark.parametrize("family", ["lint_naming", "lint_errors", "lint_stubs", "lint_paths", "lint_docstrings", "lint_names"])
def test_a_family_finds_what_all_rules_find(files, everything, family):
    codes = {c for c, *_ in CASES if re.match(f"({FAMILIES[family]})", c)}
    own = {tuple(r) for r in lint.check(files, codes).select("path", "row", "col", "code", "message").collect()}
    assert own == {r for r in everything if r[3] in codes} and own


def test_only_what_is_asked_for_is_made():
    text = "import os\nx = os.path.join('a', f(1))\n"
    whole = list(python_source.node_rows("p", text))
    calls = list(python_source.node_rows("p", text, frozenset({"Call"}), frozenset({"n_args"})))
    assert [(r[1], r[13]) for r in calls] == [(r[1], {"n_args": r[13]["n_args"]}) for r in whole if r[6] == "Call"]
    asked = lint.read_by(TABLE, {"D100"})
    assert asked["kinds"] == {"Module"} and asked["attrs"] == {"doc"} and "full" not in asked["columns"]


def test_a_teller_gives_only_what_it_is_named_for():
    texts = [text.replace("{k}", "7") for _, *both in CASES for text in both] + [(LIBRARY / f"{n}.py").read_text() for n in ("dis", "functools", "typing")]
    for text in texts:
        try:
            tree = python_source.ast.parse(text)
        except SyntaxError:
            continue
        for node in python_source.ast.walk(tree):
            for classes, tell, gives in python_source.TELLERS:
                if isinstance(node, classes):
                    tell(node, python_source.Texts(text), found := {})
                    assert [k for k in found if not gives.fullmatch(k)] == []


@pytest.mark.parametrize("pattern", FAMILIES.values(), ids=FAMILIES)
def test_narrow_rows_are_those_of_the_whole_walk(pattern):
    codes = {c for c, *_ in CASES if re.match(f"({pattern})", c)}
    asked = {k: frozenset(v) for k, v in lint.read_by(TABLE, codes).items()}
    texts = [text.replace("{k}", "7") for code, *both in CASES if code in codes for text in both] + [(LIBRARY / f"{n}.py").read_text() for n in ("dis", "functools")]
    texts += ["def f(a, b=lambda x=[i for i in y]: x, *c: 'q', d=1) -> 'r s':\n    for i in z:\n        pass\n    else:\n        x = {**{}, 'a': 1 < 2 < 3}\n", "match x:\n    case {'a': 1, **r}: pass\n    case A(b=c, d=[*e]): pass\n"]
    names = [part.split()[0] for part in python_source.NODE.split(", ")]
    kept = [i for i, n in enumerate(names) if n in asked["columns"]]
    for text in texts:
        whole = [r for r in python_source.node_rows("p", text) if "kinds" not in asked or r[6] in {*asked["kinds"], "SyntaxError"}]
        told = [[{k: v for k, v in r[i].items() if k in asked["attrs"]} if i == 13 else r[i] for i in kept] for r in whole]
        assert [[r[i] for i in kept] for r in python_source.node_rows("p", text, **asked)] == told


def test_attributes_that_are_not_asked_for_cost_nothing(monkeypatch):
    """what no rule reads is not made, then thrown away."""
    monkeypatch.setattr(python_source.ast, "get_docstring", lambda *_, **__: pytest.fail("a docstring was read"))
    rows = list(python_source.node_rows("p", "def f(x: int): ...\n", frozenset({"FunctionDef"}), frozenset({"n_params"})))
    assert [r[13] for r in rows] == [{"n_params": "1"}]


def test_nodes_that_nothing_is_asked_of_get_no_place(monkeypatch):
    """nodes of one field share their place, and leaves that no rule reads are not walked where rows carry no numbers."""
    made, plain = [], python_source.Place.inside
    monkeypatch.setattr(python_source.Place, "inside", lambda self, **changes: made.append(1) or plain(self, **changes))
    rows = list(python_source.node_rows("p", f"f({', '.join(['x'] * 500)})\n", frozenset({"Call"}), frozenset(), frozenset({"path", "kind", "row", "col", "name", "full"})))
    assert [(r[6], r[11]) for r in rows] == [("Call", "f")] and len(made) < 10


def test_docstrings_are_read_without_the_shapes_around(monkeypatch):
    """of a function whose docstring is asked for nothing else is told."""
    monkeypatch.setattr(python_source, "_kinds", lambda _: pytest.fail("a body was listed"))
    rows = list(python_source.node_rows("p", "def f(x):\n    'Doc.'\n    return x\n", frozenset({"FunctionDef"}), frozenset({"doc"})))
    assert [r[13] for r in rows] == [{"doc": "Doc."}]


def test_conditions_alone_need_no_copy_of_the_nodes(files):
    joins = {"F401", *lint_more.JOINED, *lint_files.JOINED}
    nodes = lint.parsed(files, {"PTH100"}, TABLE, joins)
    assert nodes.columns == ["path", "kind", "row", "col", "name", "attrs", "full"] and nodes.inputFiles() == []
    assert len(lint.parsed(files, {"PLE0115"}, TABLE, joins).inputFiles()) > 0


def test_lines_of_one_small_file_are_checked_by_many_tasks(spark):
    rows = spark.range(400).coalesce(1).select(F.concat("id", F.lit(".py")).alias("path"), F.lit("x = 1 \n").alias("text"))
    assert lint.check_lines(rows, {"W291"}).select(F.spark_partition_id()).distinct().count() > 4

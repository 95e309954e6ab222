"""Lint rules on small sources of our own."""

import pytest

from quarry.operators import fixes, lint
from quarry.sources import python_source

CASES = [
    ("x = 1\nif x == None:\n    pass\n", {"E711"}),
    ("try:\n    f()\nexcept:\n    pass\n", {"E722", "S110", "SIM105", "F821"}),
    ("def f(a=[]):\n    return a\n", {"B006"}),
    ("import os\nimport sys\nprint(sys.path)\n", {"F401", "T201"}),
    ("from os import path as p, sep\n__all__ = ['sep']\nprint(p)\n", {"T201"}),
    ("from subprocess import run\nrun('ls', shell=True)\n", {"S602"}),
    ("import random as r\nr.randint(1, 2)\n", {"S311"}),
    ("def f():\n    x = 1\n    return 2\n", {"F841"}),
    ("def f():\n    x = 1\n    def g():\n        return x\n    return g\n", set()),
    ("def f(): return 1\n", {"E701"}),
    ("class a: \n    y = y2\n", {"N801", "F821", "W291"}),
    ("def f():\n    pass\ndef f():\n    pass\n", {"F811"}),
    ("def f():\n    pass\nf()\ndef f():\n    pass\n", set()),
    ("x = [1,2]\nif not 1 in x: y = 1;\n", {"E231", "E713", "E701", "E703"}),
    ("d = {'a': 1, 'a': 2}\nassert (d, 'x')\n", {"F601", "F631", "S101"}),
    ("f = lambda: 0\nprint(f'x')  # noqa: T201\n", {"E731", "F541"}),
    ("print(1)  # noqa\n", set()),
    ("x = (\n", {"E999"}),
    ("y = [i for i in range(3) if i]\nclass A:\n    b = 1\n    def m(self):\n        return b\n", {"F821"}),
    ("import b\nimport a\nprint(a, b)\n", {"I001", "T201"}),
    ("q = 'select a from t where b = ' + x2\n", {"S608", "F821"}),
    ("try:\n    f = 1\nexcept ValueError as e:\n    raise KeyError('k')\n", {"B904", "EM101"}),
    ("x = 1\t\nif x :\n\ty = 1\n", {"W291", "W191"}),
    ("# TODO fix\nx = 1", {"FIX002", "TD002", "W292"}),
]
#: Style rules that most cases would hit beside the one meant.
IGNORED = {"D100", "D101", "D103", "Q000", "PLR2004", "PTH123", "D400", "D403", "PIE790"}


def test_rules(spark):
    files = spark.createDataFrame([(f"f{i}.py", text) for i, (text, _) in enumerate(CASES)], "path string, text string")
    found = {}
    own = set(lint.RULES) | {"F401", "F811", "F821", "F841", "I001"}
    for r in lint.check(files, own).collect():
        found.setdefault(r.path, set()).add(r.code)
    wrong = {text: (found.get(f"f{i}.py", set()) - IGNORED, codes) for i, (text, codes) in enumerate(CASES) if found.get(f"f{i}.py", set()) - IGNORED != codes}
    assert not wrong


def test_enabled_rules_only(spark):
    files = spark.createDataFrame([("a.py", "import os\nprint(1)\nx = 1;\n")], "path string, text string")
    assert {r.code for r in lint.check(files, {"T201"}).collect()} == {"T201"}
    assert {r.code for r in lint.check(files, {"F401", "E703"}).collect()} == {"F401", "E703"}
    assert lint.check(files.limit(0)).count() == 0


def test_unused_suppression(spark):
    files = spark.createDataFrame([("a.py", "print(1)  # noqa: T201\nx = 1  # noqa: T201\n")], "path string, text string")
    nodes, tokens = python_source.nodes(files), python_source.tokens(files)
    rest, unused = lint.suppressed(lint.check_nodes(nodes, {"T201"}), lint.suppressions(tokens))
    assert rest.count() == 0 and [r.row for r in unused.collect()] == [2]


def test_nodes_know_scope_and_parent(spark):
    rows = list(python_source.node_rows("a", "def f(x=y):\n    return [z for z in x]\n"))
    by = {r[0 + 1]: r for r in rows}
    names = {r[11]: r for r in rows if r[6] == "Name"}
    assert by[names["z"][3]][6] == "ListComp" and by[names["x"][3]][6] in ("ListComp", "FunctionDef")
    assert [r[6] for r in python_source.node_rows("b", "x = (")] == ["SyntaxError"]


def test_imports_resolve(spark):
    files = spark.createDataFrame([("a.py", "import os.path as p\nfrom a.b import c\nimport x.y\np.join(c.d, x.y.z)\n")], "path string, text string")
    nodes = python_source.nodes(files)
    full = python_source.qualified(nodes.filter("kind = 'Call'"), python_source.imports(nodes), "name").first().full
    assert full == "os.path.join"


@pytest.mark.parametrize("edits, text", [([(0, 1, "X"), (2, 4, None)], "Xb"), ([(1, 1, "--")], "a--bcd"), ([], "abcd")])
def test_edits_apply(spark, edits, text):
    files = spark.createDataFrame([("a", "abcd")], "path string, text string")
    rows = spark.createDataFrame([("a", *e) for e in edits], "path string, start int, end int, content string")
    assert fixes.apply_edits(files, rows, "path").first().text == text


def test_overlapping_edits_are_left(spark):
    rows = spark.createDataFrame([("a", 0, 5, "x"), ("a", 3, 8, "y"), ("a", 5, 6, "z"), ("b", 1, 2, None)], "path string, start int, end int, content string")
    assert sorted((r.path, r.start) for r in fixes.non_overlapping(rows, "path").collect()) == [("a", 0), ("a", 5), ("b", 1)]

"""Further lint rules, each on a small source that meets it."""

from quarry.operators import lint, lint_more
from quarry.sources import python_source

CASES = [
    ("import time\nasync def f():\n    time.sleep(1)\n", {"ASYNC251", "ANN201"}),
    ("import os\nos.path.join('a', 'b').x\n", set()),
    ("import os.path\nos.path.basename('x')\n", {"PTH119"}),
    ("from os import listdir as ls\nls('.')\n", {"PTH208"}),
    ("import datetime\ndatetime.datetime.now()\n", {"DTZ005"}),
    ("import logging\nlogging.info('x')\n", {"LOG015"}),
    ("class A:\n    def f(x):\n        return x\n", {"N805", "D102", "ANN201", "ANN001"}),
    ("class A:\n    b = []\n", {"RUF012"}),
    ("class A:\n    b = 1\n    b = 2\n", {"PIE794"}),
    ("def f(a, b):\n    return a\n", {"ARG001", "ANN001", "ANN201"}),
    ("list = 1\n", {"A001"}),
    ("__all__ = ['a', 'b']\na = 1\n", {"F822"}),
    ("for i in range(3):\n    print(1)\n", {"B007"}),
    ("if 1 == 2:\n    pass\n", {"PLR0133"}),
    ("x = 1\nif 3 == x:\n    pass\n", {"SIM300"}),
    ("import typing\nx: typing.Optional[int] = None\n", {"UP007"}),
    ("def f(x):\n    if x:\n        return 1\n    else:\n        return 2\n", {"RET505", "ANN001", "ANN201"}),
    ("x = ', '.join(['a', 'b'])\n", {"FLY002"}),
    ("import subprocess\nsubprocess.run(['ls'])\n", {"S404", "PLW1510", "S607"}),
    ("def f(xs):\n    for x in xs:\n        yield x\n", {"UP028", "ANN001", "ANN201"}),
    ("try:\n    f = 1\nexcept ValueError:\n    raise\n", {"TRY203"}),
    ("break\n", {"F701"}),
    ("while True:\n    break\n", set()),
    ("from functools import lru_cache\n@lru_cache()\ndef f() -> int:\n    return 1\n", {"UP011"}),
    ("x = [i for i in range(3)]\n", {"C416"}),
    ("f = open('a', 'rw')\n", {"PLW1501"}),
    ("zip([1], [2])\n", {"B905"}),
    ("def f(a) -> int:\n" + "".join(f"    if a == {i}:\n        return {i}\n" for i in range(12)), {"C901", "PLR0911", "ANN001"}),
]


def test_rules(spark):
    files = spark.createDataFrame([(f"f{i}.py", text) for i, (text, _) in enumerate(CASES)], "path string, text string")
    found = {}
    for r in lint_more.check(python_source.nodes(files).cache()).collect():
        found.setdefault(r.path, set()).add(r.code)
    wrong = {text: (found.get(f"f{i}.py", set()), codes) for i, (text, codes) in enumerate(CASES) if found.get(f"f{i}.py", set()) != codes}
    assert not wrong


def test_codes_are_given_once():
    codes = [r[0] for table in (lint.NODE_RULES, lint.LINE_RULES, lint.TOKEN_RULES, lint_more.NODE_RULES) for r in table]
    assert len(codes) == len(set(codes))


def test_measures(spark):
    text = "def f(a):\n    if a:\n        return 1\n    for x in a:\n        pass\n    return 2\n"
    got = lint_more.measures(python_source.nodes(spark.createDataFrame([("p", text)], "path string, text string"))).first()
    assert (got.returns, got.branches, got.complexity) == (2, 2, 3)

"""Every lint rule on a source that meets it and on one that does not."""

import re

from quarry.operators import lines, lint, lint_files, lint_more, lint_rules
from quarry.plans import sourcecode
from quarry.plans.lintcases import CASES


def test_cases(spark):
    ending = lambda code: ".pyi" if code.startswith("PYI") else ".py"
    rows = [(f"{code}/{kind}{ending(code)}", text.replace("{k}", "7")) for code, *both in CASES for kind, text in zip(("bad", "good"), both, strict=True)]
    files = spark.createDataFrame(rows, "path string, text string").repartition(4)
    found = {(r.path.split(".")[0], r.code) for r in lint.check(files).collect()}
    assert [c for c, *_ in CASES if (f"{c}/bad", c) not in found] == []
    assert [c for c, *_ in CASES if (f"{c}/good", c) in found] == []


def test_rules_of_folders_and_places(spark):
    rows = [("p/__init__.py", ""), ("p/a.py", "x = 1\n"), ("q/b.py", "x = 1\n"), ("json.py", "import json\n"), ("q/bad-Name.py", "x = 1\n"), ("q/c.py", "if x:\n  \f  y = 1\n")]
    files = spark.createDataFrame(rows, "path string, text string")
    found = {(r.path, r.code) for r in lint.check(files, {"INP001", "A005", "N999", "PLW0406", "RUF054"}).collect()}
    assert found == {("q/b.py", "INP001"), ("q/bad-Name.py", "INP001"), ("q/c.py", "INP001"), ("json.py", "A005"), ("json.py", "PLW0406"), ("q/bad-Name.py", "N999"), ("q/c.py", "RUF054")}


def test_every_rule_has_a_case():
    tables = (lint.NODE_RULES, lint.LINE_RULES, lint.TOKEN_RULES, lint_more.NODE_RULES)
    codes = {r[0] for t in tables for r in t} | set(lint_rules.CODES) | set(lint_files.CODES) | {c for c, *_ in lint_more.LIMITS} | {"F401", "F811", "F821", "F841", "I001", "ARG001", "A001", "A002", "F822", "B007", "PIE794"}
    known = {c for c, *_ in CASES}
    left = {"A005", "INP001", "N999", "PLW0406", "RUF054"}  # in the test above
    odd = {"B013", "PGH004", "PLE2502", "PLE2510", "PLE2512", "PLE2513", "PLE2515", "RUF003", "S313"}
    assert codes - known - left == odd
    families = {c: [n for n, p in sourcecode.FAMILIES.items() if re.match(f"({p})", c)] for c in known}
    assert all(len(v) == 1 for v in families.values()), {c: v for c, v in families.items() if len(v) != 1}


def test_odd_characters(spark):
    rows = [("PLE2510", "x = 'a\b'\n"), ("PLE2512", "x = 'a\x1a'\n"), ("PLE2513", "x = 'a\x1b'\n"), ("PLE2515", "x = 'a\u200b'\n"), ("PLE2502", "x = 'a\u202e'\n"), ("RUF003", f"# {next(iter(lines.CONFUSABLE))}\n"), ("PGH004", "import os  # noqa\n"), ("none", "x = 'a'\n")]
    files = spark.createDataFrame(rows, "path string, text string")
    own = {c for c, _ in rows[:-1]}
    found = {(r.path, r.code) for r in lint.check_lines(files, own, [*lint.LINE_RULES, *lint_rules.LINE_RULES]).collect()}
    assert found == {(c, c) for c in own}

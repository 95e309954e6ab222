"""White space, comments, quotes and other trivia of source text as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rule families by the letters of their codes. Fixed values.
ORIGINS = {
    "A": "builtins", "B": "bugbear", "C4": "comprehensions", "D": "docstrings", "DTZ": "datetimes", "E": "style", "F": "names", "FURB": "refurbishment", "I": "imports", "N": "naming",
    "PIE": "misc", "PL": "pylint", "PT": "pytest", "PTH": "paths", "PYI": "stubs", "RET": "returns", "RUF": "own", "S": "security", "SIM": "simplification", "UP": "upgrades", "W": "style",
}
#: Binding strength of operators, loosest first. Fixed values.
PRECEDENCE = [
    [":="], ["lambda"], ["if-else"], ["or"], ["and"], ["not"], ["in", "not in", "is", "is not", "<", "<=", ">", ">=", "!=", "=="], ["|"], ["^"], ["&"], ["<<", ">>"], ["+", "-"],
    ["*", "@", "/", "//", "%"], ["unary +", "unary -", "~"], ["**"], ["await"],
]


def leading_indentation(line: Column) -> Column:
    """The white space that a line starts with."""
    return F.regexp_extract(line, r"^[ \t\f]*", 0)


def indentation_at(text: Column, offset: Column) -> Column:
    """The indentation before an offset, null where something else stands before it on its line."""
    before = F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)
    return F.when(F.trim(F.translate(before, "\t\f", "  ")) == "", before)


def tab_offset(column: Column, tab: int = 8) -> Column:
    """Columns from a place to the next tab stop."""
    return F.lit(tab) - F.pmod(column, F.lit(tab))


def expand_tabs(line: Column, tab: int = 8) -> Column:
    """A line with its tabs replaced by blanks up to the next stop."""
    parts = F.split(line, "\t", -1)
    joined = F.aggregate(F.slice(parts, 2, F.size(parts)), F.get(parts, F.lit(0)), lambda a, x: F.concat(F.rpad(a, F.length(a) + tab_offset(F.length(a), tab), F.lit(" ")), x))
    return joined


def suppression_kind(comment: Column) -> Column:
    """What a comment asks of a formatter: off, on or skip; null for other comments."""
    body = F.trim(F.regexp_replace(comment, "^#+", ""))
    return (
        F.when(body.rlike(r"^(fmt: ?off|yapf: ?disable)$"), "off")
        .when(body.rlike(r"^(fmt: ?on|yapf: ?enable)$"), "on").when(body.rlike(r"^fmt: ?skip$"), "skip")
    )


def leading_quote(literal: Column) -> Column:
    """Prefix and opening quotes of a string literal."""
    return F.nullif(F.regexp_extract(literal, "^([A-Za-z]{0,2}('''|\"\"\"|'|\"))", 1), F.lit(""))


def trailing_quote(literal: Column) -> Column:
    return F.nullif(F.regexp_extract(literal, "('''|\"\"\"|'|\")$", 1), F.lit(""))


def raw_contents(literal: Column) -> Column:
    """What stands between the quotes of a string literal; null if it is none."""
    head, tail = leading_quote(literal), trailing_quote(literal)
    inner = F.substring(literal, F.length(head) + 1, F.length(literal) - F.length(head) - F.length(tail))
    return F.when(head.isNotNull() & tail.isNotNull() & (F.length(literal) >= F.length(head) + F.length(tail)), inner)


def precedence(operator: Column) -> Column:
    """The rank of an operator, 1 the loosest; null for others."""
    pairs = [F.lit(x) for rank, names in enumerate(PRECEDENCE, 1) for name in names for x in (name, rank)]
    return F.try_element_at(F.create_map(*pairs), operator)


def origin(code: Column) -> Column:
    """The family of a rule by the longest letters of its code that have one."""
    found = F.lit(None).cast("string")
    for prefix in sorted(ORIGINS, key=len):
        letters = "[CERW]" if prefix == "PL" else ""
        found = F.when(code.rlike(f"^{re.escape(prefix)}{letters}[0-9]+$"), ORIGINS[prefix]).otherwise(found)
    return found


def builtin_module(name: Column, minor: Column, since: dict[str, int]) -> Column:
    """Whether a module is part of Python 3.``minor``; ``since`` has the minor version that each came with."""
    pairs = [F.lit(x) for pair in since.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name) <= minor, F.lit(False))

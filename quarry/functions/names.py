"""Scalar functions over names and texts, as Column expressions unless a table of values needs Python."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarry.shipping import ship

#: 64-bit FNV-1a: offset basis and prime.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def concept_key(name: Column) -> Column:
    """What follows the last colon, in snake case: a separator goes between a lower-case letter or digit and a capital."""
    return F.lower(F.regexp_replace(F.substring_index(name, ":", -1), r"([\p{Ll}0-9])(\p{Lu})", "$1_$2"))


def is_name(value: Column) -> Column:
    """Whether a cell may stand as a name: not empty, no control character, no segment that is only a question mark."""
    segments = F.split(value, "::")
    return (value != "") & ~value.rlike(r"\p{Cc}") & ~F.array_contains(segments, "?")


def escaped(value: Column) -> Column:
    """Free text as one cell: control characters escaped, empty as a dash."""
    text = F.replace(F.coalesce(value, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for raw, written in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return F.when(text == "", "-").otherwise(text)


def inside(path: Column) -> Column:
    """A relative path without empty and dot segments; null if it leaves its folder or is absolute."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    return F.when(~path.startswith("/") & ~F.array_contains(parts, "..") & (F.size(parts) > 0), F.array_join(parts, "/"))


def identifier(name: Column) -> Column:
    """A name made fit to be an identifier: other characters become underscores, a leading digit gets one."""
    plain = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(plain == "", "_").otherwise(F.regexp_replace(plain, "^([0-9])", "_$1"))


def is_plural(name: Column) -> Column:
    return name.endswith("ies") | (name.endswith("s") & ~name.endswith("ss"))


def natural_key(name: Column) -> Column:
    """A key under which numbers inside names sort by value: every run of digits is padded to 12."""
    padded = F.regexp_replace(name, r"(\d+)", "000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{12})(?!\d)", "$1")


def is_lowercase(text: Column) -> Column:
    return F.lower(text) == text


def is_uppercase(text: Column) -> Column:
    return F.upper(text) == text


def is_cased_lowercase(text: Column) -> Column:
    return is_lowercase(text) & (F.upper(text) != text)


def is_cased_uppercase(text: Column) -> Column:
    return is_uppercase(text) & (F.lower(text) != text)


def is_pragma(comment: Column) -> Column:
    """Comments that speak to tools: type checkers, linters, formatters, coverage."""
    body = F.ltrim(F.regexp_replace(comment, "^#+", ""))
    return body.rlike(r"^(?i:noqa)\b|^(type:|pyright:|pylint:|mypy:|flake8:|nosec\b|isort:|fmt:|yapf:|pragma:)|^[a-z]+: *(ignore|noqa|disable|enable)\b")


def fuzzy_pattern(query: str) -> str:
    """A case-insensitive pattern that the letters of ``query`` match in order, with anything between."""
    return "(?i)" + ".*".join("\\" + c if not c.isalnum() else c for c in query)


def fnv64(data: bytes) -> int:
    digest = FNV_BASIS
    for byte in data:
        digest = ((digest ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return digest


def _fnv_all(values: pd.Series) -> pd.Series:
    """Digests of a batch, a byte position of all its texts at a time."""
    texts = [None if x is None else x.encode() for x in values]
    sizes = np.array([0 if t is None else len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8).astype(np.uint64)
    starts = (np.cumsum(sizes) - sizes)[order]
    digests = np.full(len(texts), FNV_BASIS, np.uint64)
    ends = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if len(sizes) else 0) + 1), side="right")
    with np.errstate(over="ignore"):
        for at, alive in enumerate(ends.tolist()):  # the texts longer than ``at`` come first
            digests[:alive] = (digests[:alive] ^ data[starts[:alive] + at]) * np.uint64(FNV_PRIME)
    whole = np.empty(len(texts), np.uint64)
    whole[order] = digests
    return pd.Series([None if t is None else f"{d:016x}" for t, d in zip(texts, whole.tolist(), strict=True)], dtype=object, index=values.index)


def fnv_hex(value: Column) -> Column:
    """16 hex digits of the FNV-1a digest of a text's UTF-8 bytes; null stays null."""
    ship(SparkSession.active())
    return F.pandas_udf(_fnv_all, "string")(value)


def text_width(text: str, tab: int = 4) -> int:
    """Columns that a text takes: tabs go to the next stop, wide characters take two, combining ones none."""
    width = 0
    for char in text:
        if char in "\n\r":
            width = 0
        elif char == "\t":
            width += tab - width % tab
        elif not unicodedata.combining(char):
            width += 2 if unicodedata.east_asian_width(char) in "WF" else 1
    return width


def _widths(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else text_width(x)).astype("Int32")


def display_width(value: Column) -> Column:
    ship(SparkSession.active())
    return F.pandas_udf(_widths, "int")(value)

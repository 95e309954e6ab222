"""Small facts of the language: log levels, open modes, keywords, identifiers."""

from __future__ import annotations

import keyword

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Methods of a logger and their levels. Fixed values.
LOG_LEVELS = {"debug": 10, "info": 20, "warning": 30, "warn": 30, "error": 40, "exception": 40, "critical": 50, "fatal": 50}
#: Letters of an open mode and their bits. Fixed values.
MODE_BITS = {"r": 1, "w": 2, "a": 4, "x": 8, "b": 16, "t": 32, "+": 64, "U": 128}


def log_level(method: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LOG_LEVELS.items() for x in pair]), method)


def open_mode(mode: Column) -> Column:
    """The bits of an open mode; null if letters repeat, are unknown, or contradict each other."""
    bits = sum((F.when(F.contains(mode, F.lit(c)), F.lit(b)).otherwise(0) for c, b in MODE_BITS.items()), F.lit(0))
    letters = F.length(mode)
    distinct = F.size(F.array_distinct(F.split(mode, "")))
    actions = sum((F.when(F.contains(mode, F.lit(c)), 1).otherwise(0) for c in "rwax"), F.lit(0))
    universal = F.contains(mode, F.lit("U"))
    fine = mode.rlike("^[rwaxbtU+]+$") & (letters == distinct) & ((actions == 1) | (universal & (actions == 0))) & ~(F.contains(mode, F.lit("b")) & F.contains(mode, F.lit("t")))
    return F.when(fine & ~(universal & mode.rlike("[wax+]")), bits)


def reduced_mode(mode: Column) -> Column:
    """An open mode without what it would be anyway: text is the default, and so is reading."""
    plain = F.regexp_replace(mode, "[tU]", "")
    return F.when(plain.isin("r", ""), "").otherwise(plain)


def is_keyword(name: Column) -> Column:
    return name.isin(keyword.kwlist)


def is_identifier(name: Column) -> Column:
    """ASCII identifiers that are no keyword; others with letters of any script."""
    return name.rlike(r"^[\p{L}_][\p{L}\p{N}\p{Mn}_]*$") & ~is_keyword(name)


def is_module_name(name: Column) -> Column:
    return name.rlike("^[a-z_][a-z0-9_]*$") & ~is_keyword(name)


def is_migration_name(name: Column) -> Column:
    return name.rlike("^[0-9][a-z0-9_]*$") | is_module_name(name)


def is_mangled_private(name: Column) -> Column:
    return name.startswith("__") & ~name.endswith("__")


def visibility(name: Column, kind: Column) -> Column:
    """public, private or special, by the underscores of a name."""
    return F.when(name.rlike("^__.*__$"), "special").when(name.startswith("_"), "private").otherwise("public")

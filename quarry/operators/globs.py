"""Patterns of paths as tables: which of thousands of globs hold for which paths.

A glob is cut into its alternatives (``{a,b}``), and the fixed parts of each alternative are its keys: the whole path, the folders before the first
wildcard, the names after the last one, whole names between wildcards, and up to ``KEY`` characters that the last name begins or ends with. A path has as keys all its folders, names and
trailing names and the beginnings and endings of its last name: the nodes that a trie of prefixes and one of suffixes would lead it through. The paths under each
key are counted, and an alternative waits under its rarest one; if one of its keys has no path it holds nowhere. Paths and globs
meet by an equi-join on these keys, so that a path is tried only against globs whose rarest fixed part it has; the regular expression of the glob decides.
``last_match`` and ``counts`` try each text of a glob once, however many rows have it, and form no pairs of paths and rows.

Globs: ``*`` and ``?`` stay within a name, ``**`` spans folders, ``[ab]`` and ``[!ab]`` are classes, ``{a,b}`` alternatives, a backslash makes the next character plain. A glob without a slash is tried
on the last name. A glob without any fixed part meets every path, as it must. Null paths and null or empty globs match nothing.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.rel import spread, written
from quarry.shipping import ship

#: Characters of a last name's beginning or ending that a key holds at most.
KEY = 32
#: Parts that the rows of one key are dealt to; globs, the smaller side, are repeated for each.
SALT = 32


def alternatives(glob: str) -> list[str]:
    """The globs that ``{a,b}`` stands for, innermost braces first; an unclosed brace is plain."""
    found = re.search(r"(?<!\\)\{([^{}]*)\}", glob)
    if not found:
        return [glob]
    before, after = glob[: found.start()], glob[found.end() :]
    return list(dict.fromkeys(x for part in found.group(1).split(",") for x in alternatives(before + part + after)))


def parsed(glob: str) -> tuple[str, list[str]]:
    """(regular expression over the whole path, keys) of a glob without alternatives."""
    if "/" not in glob:
        glob = "**/" + glob
    # Pieces: plain text, or a wildcard's expression. '**/' ends at a name's beginning.
    pieces: list[tuple[bool, str]] = []
    i, n = 0, len(glob)
    while i < n:
        at_name = i == 0 or glob[i - 1] == "/"
        close = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^"))) if glob[i] == "[" else -1
        if at_name and glob.startswith("**/", i):
            pieces, i = [*pieces, (False, "(?:.*/)?")], i + 3
        elif glob.startswith("**", i):
            pieces, i = [*pieces, (False, ".+" if at_name and i + 2 == n and i else ".*")], i + 2
        elif glob[i] in "*?":
            pieces, i = [*pieces, (False, "[^/]*" if glob[i] == "*" else "[^/]")], i + 1
        elif close > 0:
            inside = glob[i + 1 : close]
            negated = inside[0] in "!^"
            pieces, i = [*pieces, (False, "[" + ("^/" if negated else "") + re.sub(r"([\\\[\]^&~|])", r"\\\1", inside[negated:]) + "]")], close + 1
        else:
            i += glob[i] == "\\" and i + 1 < n
            pieces, i = [*pieces, (True, glob[i])], i + 1
    expression = "(?s)^" + "".join(re.escape(p) if plain else p for plain, p in pieces) + "$"
    wild = [k for k, (plain, _) in enumerate(pieces) if not plain]
    text = lambda some: "".join(p for _, p in some)
    if not wild:
        return expression, ["x:" + text(pieces)]
    head, tail, last = text(pieces[: wild[0]]), text(pieces[wild[-1] + 1 :]), pieces[wild[-1]][1]
    keys = [("d:", head.rpartition("/")[0])]
    if last == "(?:.*/)?":
        keys.append(("t:", tail))
    elif "/" in tail:
        keys.append(("t:", tail.partition("/")[2]))
    else:
        keys.append(("e:", tail[-KEY:]))
    # What stands between the last name's beginning and the next wildcard, if no wildcard after it leaves the name.
    begins = max((k + 1 for k, (plain, p) in enumerate(pieces) if p == "/" and plain or p == "(?:.*/)?"), default=0)
    name = pieces[begins:]
    if begins and all(plain or not p.startswith(".") for plain, p in name):
        opening = next((k for k, (plain, _) in enumerate(name) if not plain), len(name))
        keys.append(("h:", text(name[:opening])[:KEY]))
    # Names without a wildcard, wherever they stand.
    name, whole = "", True
    for plain, p in [*pieces, (True, "/")]:
        if p == "(?:.*/)?" or plain and p == "/":
            keys += [("c:", name)] if whole else []
            name, whole = "", True
        else:
            name, whole = name + p, whole and plain
    return expression, list(dict.fromkeys(kind + key for kind, key in keys if key)) or ["n:"]


def compiled(patterns: DataFrame, glob_col: str = "glob") -> DataFrame:
    """``patterns`` with ``_alternative``, ``_keys`` and ``_regex``, a row per alternative, as a written table."""
    ship(patterns.sparkSession)

    @F.pandas_udf("array<struct<_alternative:int,_keys:array<string>,_regex:string>>")
    def parts(globs: pd.Series) -> pd.Series:
        return globs.map(lambda g: [{"_alternative": i, "_keys": k, "_regex": r} for i, (r, k) in enumerate(map(parsed, alternatives(g)))] if g else [])

    each = spread(patterns).withColumn("_p", F.explode(parts(F.coalesce(F.col(glob_col), F.lit("")))))
    return written(each.select(*patterns.columns, "_p.*"))


def path_keys(path: Column, openings: list[int], endings: list[int]) -> Column:
    """All keys under which a glob that holds for the path may stand; of the last name's beginnings and endings those of the lengths that some glob asks for."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    n = F.size(parts)
    with_kind = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(kind), x))
    folders = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    trailing = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))
    ends = [F.concat(F.lit("e:"), F.right(name, F.lit(i))) for i in endings] + [F.concat(F.lit("h:"), F.left(name, F.lit(i))) for i in openings]
    return F.array_distinct(F.concat(F.array(F.lit("n:"), F.concat(F.lit("x:"), path), *ends), with_kind("d:", folders), with_kind("t:", trailing), with_kind("c:", parts)))


def _held(paths: DataFrame, patterns: DataFrame, glob_col: str) -> DataFrame:
    """``paths`` (distinct, in ``_path``) with the rows of ``patterns`` (and their ``_row``) whose glob holds, once for each alternative that does."""
    of = compiled(patterns.withColumn("_row", F.monotonically_increasing_id()), glob_col)
    asked = of.select(F.explode("_keys").alias("_key")).distinct()
    # At most KEY lengths of each kind.
    lengths = asked.select(F.left("_key", F.lit(2)).alias("kind"), (F.length("_key") - 2).alias("n")).where("kind in ('h:', 'e:')").distinct().collect()
    openings, endings = (sorted(r.n for r in lengths if r.kind == kind) for kind in ("h:", "e:"))
    keyed = written(spread(paths).withColumn("_key", F.explode(path_keys(F.col("_path"), openings, endings))).join(asked, "_key"))
    rarity = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    each = of.select("_row", "_alternative", F.size("_keys").alias("_all"), F.explode("_keys").alias("_key")).join(rarity, "_key")
    rarest = each.groupBy("_row", "_alternative", "_all").agg(F.min_by("_key", F.struct("_n", "_key")).alias("_key"), F.count(F.lit(1)).alias("_found")).where("_found = _all")
    placed = of.join(rarest.select("_row", "_alternative", "_key"), ["_row", "_alternative"]).drop("_keys")
    salted = placed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = keyed.withColumn("_salt", F.pmod(F.xxhash64("_path"), F.lit(SALT)).cast("int"))
    # A merge join goes through the paths of a key glob by glob, so that an expression is compiled once a key and part; the parts are many, as few bytes make many pairs.
    parts = 4 * paths.sparkSession.sparkContext.defaultParallelism
    return salted.repartition(parts, "_key", "_salt").hint("merge").join(dealt.repartition(parts, "_key", "_salt"), ["_key", "_salt"]).where(F.rlike("_path", F.col("_regex")))


def _distinct(paths: DataFrame, path_col: str) -> DataFrame:
    """(_path, _times): each path once, with how often it stands in ``paths``."""
    return paths.where(F.col(path_col).isNotNull()).groupBy(F.col(path_col).alias("_path")).agg(F.count(F.lit(1)).alias("_times"))


def matches(paths: DataFrame, patterns: DataFrame, glob_col: str = "glob", path_col: str = "path") -> DataFrame:
    """(path, columns of ``patterns``): each distinct path with each row of ``patterns`` whose glob holds for it, once."""
    found = _held(_distinct(paths, path_col).select("_path"), patterns, glob_col)
    # A row can hold by several alternatives.
    return found.dropDuplicates(["_path", "_row"]).select(F.col("_path").alias(path_col), *patterns.columns)


def counts(paths: DataFrame, patterns: DataFrame, glob_col: str = "glob", path_col: str = "path") -> DataFrame:
    """``patterns`` with ``n``, how many rows of ``paths`` their glob holds for; those that hold for none have no row."""
    found = _held(_distinct(paths, path_col), patterns.select(glob_col).distinct(), glob_col)
    once = found.groupBy(glob_col, "_path").agg(F.max("_times").alias("_times"))
    # Patterns may be many while the bytes they are read from are few; merged, they are not broadcast through the driver.
    return patterns.join(once.groupBy(glob_col).agg(F.sum("_times").alias("n")).hint("merge"), glob_col).select(*patterns.columns, "n")


def last_match(paths: DataFrame, patterns: DataFrame, at: str, values: list[str], glob_col: str = "glob", path_col: str = "path") -> DataFrame:
    """(path, at, values): for each path the matching row of ``patterns`` with the greatest ``at`` (of equal ones the greatest values); paths without a match have no row."""
    # Of rows with one glob only the last can be the last of a path.
    last = patterns.groupBy(glob_col).agg(F.max(F.struct(at, *values)).alias("_m"))
    found = _held(_distinct(paths, path_col).select("_path"), last, glob_col)
    return found.groupBy(F.col("_path").alias(path_col)).agg(F.max("_m").alias("_m")).select(path_col, f"_m.{at}", *[f"_m.{v}" for v in values])


def not_ignored(findings: DataFrame, ignores: DataFrame, path_col: str = "path", code_col: str = "code") -> DataFrame:
    """``findings`` but for those switched off by ``ignores`` (glob, code): a glob switches its code off in the files it holds for, one with a leading ``!`` in all others."""
    negated = F.col("glob").startswith("!")
    rows = ignores.select(F.when(negated, F.expr("substring(glob, 2)")).otherwise(F.col("glob")).alias("glob"), F.col("code").alias("_code"), negated.alias("_not")).where("glob <> ''").distinct()
    found = matches(findings, rows, path_col=path_col)
    per_path = found.groupBy(F.col(path_col).alias("_path"), "_code").agg(F.max(~F.col("_not")).alias("_on"), F.sum(F.col("_not").cast("int")).alias("_held"))
    per_code = rows.where("_not").groupBy("_code").agg(F.count(F.lit(1)).alias("_all"))
    placed = findings.join(per_path, (F.col(path_col) == F.col("_path")) & (F.col(code_col) == F.col("_code")), "left").drop("_path", "_code")
    counted = placed.join(per_code, F.col(code_col) == F.col("_code"), "left").drop("_code")
    off = F.coalesce("_on", F.lit(False)) | (F.coalesce("_all", F.lit(0)) > F.coalesce("_held", F.lit(0)))
    return counted.where(~off).select(*findings.columns)


def ranked_matches(paths: DataFrame, patterns: DataFrame, at: str, glob_col: str = "glob", path_col: str = "path") -> DataFrame:
    """``matches`` with ``rank``, the number of the match from the last ``at`` backwards, for settings that are merged rather than replaced."""
    found = matches(paths, patterns, glob_col, path_col)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(path_col).orderBy(F.col(at).desc(), F.col(glob_col).desc())))

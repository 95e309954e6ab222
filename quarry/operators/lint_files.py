"""Lint rules that join the relations of a file, or files with each other."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import lint
from quarry.sources import python_source as source


def _finding(of: DataFrame, code: str, message: str) -> DataFrame:
    return of.select("path", F.coalesce("row", F.lit(1)).alias("row"), F.lit(0).alias("col"), F.lit(code).alias("code"), F.lit(message).alias("message"))


def _used(nodes: DataFrame) -> DataFrame:
    """(path, scope, name): names that a scope or one inside it reads."""
    return source.references(nodes).join(lint._scope_chain(nodes), ["path", "scope"]).select("path", F.col("at").alias("scope"), "name").distinct()


def star_names(nodes: DataFrame) -> DataFrame:
    """F405: names that only a star import can bind."""
    missing = lint.undefined_names(nodes, stars=True)
    return missing.select("path", "row", "col", F.lit("F405").alias("code"), F.concat("name", F.lit(" may come from a star import")).alias("message"))


def loops_over_imports(nodes: DataFrame) -> DataFrame:
    """F402: imported names that a loop of the same scope binds again."""
    loops = nodes.filter("kind = 'Name' and field = 'target' and parent_kind in ('For','AsyncFor')").select("path", "scope", "name", "row")
    known = source.imports(nodes).select("path", "scope", F.col("bound").alias("name"), F.col("row").alias("first")).distinct()
    return _finding(loops.join(known, ["path", "scope", "name"]).filter("row > first"), "F402", "loop hides an import")


def unused_annotations(nodes: DataFrame) -> DataFrame:
    """F842: local names that are annotated, never assigned and never read."""
    told = nodes.filter("kind = 'Name' and field = 'target' and parent_kind = 'AnnAssign' and func is not null and func = scope")
    bare = nodes.filter("kind = 'AnnAssign' and attrs['value'] is null").select("path", F.col("node").alias("parent"))
    return _finding(told.join(bare, ["path", "parent"]).join(_used(nodes), ["path", "scope", "name"], "left_anti"), "F842", "annotated but never used")


def global_statements(nodes: DataFrame) -> DataFrame:
    """PLW0603: names that a function declares global and assigns; PLW0602: that it declares and never assigns."""
    declared = nodes.filter("kind = 'Global' and func is not null").select("path", "scope", "row", F.explode(F.split(F.col("attrs")["names_src"], ",")).alias("name"))
    bound = source.bindings(nodes).select("path", "scope", "name", F.lit(True).alias("bound")).distinct()
    marked = declared.join(bound, ["path", "scope", "name"], "left")
    code = F.when(F.col("bound"), "PLW0603").otherwise("PLW0602")
    return marked.select("path", "row", F.lit(0).alias("col"), code.alias("code"), F.concat("name", F.lit(" is declared global")).alias("message"))


def both_declared(nodes: DataFrame) -> DataFrame:
    """PLE0115: names that a scope declares global and nonlocal."""
    declared = nodes.filter("kind in ('Global', 'Nonlocal')").select("path", "scope", "row", "kind", F.explode(F.split(F.col("attrs")["names_src"], ",")).alias("name"))
    twice = declared.groupBy("path", "scope", "name").agg(F.countDistinct("kind").alias("n"), F.max("row").alias("row")).filter("n = 2")
    return _finding(twice, "PLE0115", "both global and nonlocal")


def methods_without_self(nodes: DataFrame) -> DataFrame:
    """PLR6301: methods that never read their first parameter; stubs, special and decorated methods are left out."""
    methods = nodes.filter("kind in ('FunctionDef', 'AsyncFunctionDef') and parent_kind = 'ClassDef' and coalesce(attrs['decorators'], '') = '' and name not like '!_!_%' escape '!' and split(attrs['params'], ',')[0] = 'self'")
    methods = methods.filter("not (attrs['body'] in ('Pass', 'Raise') or attrs['body_only'] = '...')").select("path", F.col("node").alias("scope"), F.lit("self").alias("name"), "row")
    return _finding(methods.join(_used(nodes), ["path", "scope", "name"], "left_anti"), "PLR6301", "method does not use self")


def needless_async(nodes: DataFrame) -> DataFrame:
    """RUF029: async functions that await nothing."""
    functions = nodes.filter("kind = 'AsyncFunctionDef'").select("path", F.col("node").alias("func"), "row")
    awaiting = nodes.filter("kind in ('Await', 'AsyncFor', 'AsyncWith', 'Yield') or (kind = 'comprehension' and attrs['is_async'] = '1')").select("path", "func").distinct()
    return _finding(functions.join(awaiting, ["path", "func"], "left_anti"), "RUF029", "async function awaits nothing")


def future_annotations(nodes: DataFrame) -> DataFrame:
    """FA100: old generics or unions of typing, FA102: unions by |, in annotations of files without the future import."""
    told = source.imports(nodes).filter("module = '__future__' and name = 'annotations'").select("path").distinct()
    old = nodes.filter("kind = 'Subscript' and attrs['value_name'] rlike '^(typing[.])?(Optional|Union|List|Dict|Set|Tuple)$' and field in ('annotation', 'returns')").withColumn("code", F.lit("FA100"))
    new = nodes.filter("kind = 'BinOp' and attrs['op'] = 'BitOr' and field in ('annotation', 'returns')").withColumn("code", F.lit("FA102"))
    found = old.unionByName(new).join(told, "path", "left_anti")
    return found.select("path", "row", F.lit(0).alias("col"), "code", F.lit("annotations need the future import").alias("message"))


def names_that_hide(nodes: DataFrame) -> DataFrame:
    """A005: modules named like one of the standard library; E741 and the like are conditions of nodes."""
    modules = sorted(m for m in sys.stdlib_module_names if not m.startswith("_"))
    name = F.regexp_extract("path", r"([^/]*)\.py$", 1)
    return _finding(nodes.filter("kind = 'Module'").withColumn("row", F.lit(1)).filter(name.isin(modules)), "A005", "module hides one of the standard library")


def packages(files: DataFrame) -> DataFrame:
    """INP001: Python files in folders without ``__init__.py``."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    python = files.filter("path like '%.py'").select("path", folder.alias("folder"))
    whole = python.filter("path like '%/__init__.py' or path = '__init__.py'").select("folder").distinct()
    return _finding(python.filter("folder <> ''").join(whole, "folder", "left_anti").withColumn("row", F.lit(1)), "INP001", "folder is no package")


def endings(files: DataFrame) -> DataFrame:
    """W391: blank lines at the end of a file."""
    return _finding(files.filter(F.col("text").rlike(r"\n[ \t]*\n[ \t\n]*$")).withColumn("row", F.size(F.split(F.rtrim(F.regexp_replace("text", r"\s+$", "")), "\n")) + 1), "W391", "blank lines at the end")


def notices(files: DataFrame) -> DataFrame:
    """CPY001: no copyright notice in the first 4096 characters."""
    return _finding(files.filter(~F.substring("text", 1, 4096).rlike(r"(?i)copyright\s+((\(c\)|©)\s+)?[0-9]{4}") & (F.length("text") > 0)).withColumn("row", F.lit(1)), "CPY001", "no copyright notice")


NODE_JOINS = {
    ("F405",): star_names, ("F402",): loops_over_imports, ("F842",): unused_annotations, ("PLW0602", "PLW0603"): global_statements, ("PLE0115",): both_declared,
    ("PLR6301",): methods_without_self, ("RUF029",): needless_async, ("FA100", "FA102"): future_annotations, ("A005",): names_that_hide,
}
FILE_RULES = {("INP001",): packages, ("W391",): endings, ("CPY001",): notices}
JOINED = {c for codes in NODE_JOINS for c in codes}
CODES = [c for table in (NODE_JOINS, FILE_RULES) for codes in table for c in codes]


def check(files: DataFrame, nodes: DataFrame, tokens: DataFrame, enabled: set[str] | None = None) -> DataFrame:
    """(path, row, col, code, message) of these rules."""
    found = nodes.selectExpr("path", "row", "col", "'' as code", "'' as message").limit(0)
    for table, of in ((NODE_JOINS, nodes), (FILE_RULES, files)):
        for codes, rule in table.items():
            if enabled is None or enabled & set(codes):
                own = rule(of)
                found = found.unionByName(own if enabled is None else own.filter(F.col("code").isin(sorted(enabled))))
    return found

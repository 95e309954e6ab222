"""Editor questions in bulk: for all symbols of all files at once, as joins over nodes, bindings and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import fuzzy_pattern
from quarry.operators.lint import _scope_chain
from quarry.sources import python_source as source


#: The kinds of nodes that blocks to fold and symbols are read from.
FOLDED = ["FunctionDef", "AsyncFunctionDef", "ClassDef", "If", "For", "While", "With", "Try", "Dict", "List", "Set", "Call", "Import", "ImportFrom"]
SYMBOLS = ["Module", *[x.__name__ for x in source.SCOPES]]
DEFINED = ["FunctionDef", "AsyncFunctionDef", "ClassDef"]


def document_symbols(nodes: DataFrame) -> DataFrame:
    """(path, name, kind, row, end_row, container): functions and classes with the definition they stand in."""
    outer = nodes.select("path", F.col("node").alias("scope"), F.col("name").alias("container"))
    found = nodes.filter("kind in ('FunctionDef', 'AsyncFunctionDef', 'ClassDef')").join(outer, ["path", "scope"], "left")
    kind = F.when(F.col("kind") == "ClassDef", "class").when(F.col("container").isNotNull(), "member").otherwise("function")
    return found.select("path", "name", kind.alias("kind"), "row", "end_row", "container")


def workspace_symbols(nodes: DataFrame, query: str) -> DataFrame:
    """Symbols of all files that the letters of ``query`` match in order; no letters match nothing."""
    found = document_symbols(nodes)
    return found.filter(F.col("name").rlike(fuzzy_pattern(query))) if query else found.limit(0)


def definitions(nodes: DataFrame) -> DataFrame:
    """(path, name, row, col, scope, def_row, def_kind): every read with the first binding in the nearest scope that has one."""
    bound = source.bindings(nodes).groupBy("path", F.col("scope").alias("at"), "name").agg(F.min(F.struct("row", "kind")).alias("b"))
    chain = _scope_chain(nodes)
    reads = source.references(nodes)
    seen = reads.join(chain, ["path", "scope"]).join(bound, ["path", "at", "name"])
    # Scopes are numbered from the outside in, so the greatest is the nearest.
    best = seen.groupBy("path", "name", "row", "col", "scope").agg(F.max_by(F.struct("b", "at"), "at").alias("d"))
    return best.select("path", "name", "row", "col", F.col("d.at").alias("scope"), F.col("d.b.row").alias("def_row"), F.col("d.b.kind").alias("def_kind"))


def references(nodes: DataFrame) -> DataFrame:
    """(path, scope, name, rows): the sorted rows that read each binding; a symbol's places fit one row."""
    return definitions(nodes).groupBy("path", "scope", "name").agg(F.array_sort(F.collect_set("row")).alias("rows"))


def rename_edits(nodes: DataFrame, path: str, scope: int, old: str, new: str) -> DataFrame:
    """(path, row, col, length, content): the places that a rename of one binding changes."""
    reads = definitions(nodes).filter((F.col("path") == path) & (F.col("scope") == scope) & (F.col("name") == old)).select("path", "row", "col")
    stores = nodes.filter((F.col("path") == path) & (F.col("scope") == scope) & (F.col("name") == old) & F.col("kind").isin("Name", "arg")).select("path", "row", "col")
    return reads.union(stores).distinct().select("path", "row", "col", F.lit(len(old)).alias("length"), F.lit(new).alias("content"))


def calls(nodes: DataFrame) -> DataFrame:
    """(path, caller, callee, row): calls by name from inside functions; the module calls as ``<module>``."""
    callers = nodes.filter("kind in ('FunctionDef', 'AsyncFunctionDef')").select("path", F.col("node").alias("func"), F.col("name").alias("caller"))
    found = nodes.filter("kind = 'Call' and name is not null").select("path", "func", F.col("name").alias("callee"), "row")
    return found.join(callers, ["path", "func"], "left").select("path", F.coalesce("caller", F.lit("<module>")).alias("caller"), "callee", "row")


def incoming(nodes: DataFrame) -> DataFrame:
    return calls(nodes).groupBy("callee").agg(F.array_sort(F.collect_set(F.concat_ws("::", "path", "caller"))).alias("callers"))


def outgoing(nodes: DataFrame) -> DataFrame:
    return calls(nodes).groupBy("path", "caller").agg(F.array_sort(F.collect_set("callee")).alias("callees"))


def type_edges(nodes: DataFrame) -> DataFrame:
    """(path, sub, super): classes and the bases they name, resolved through imports."""
    classes = nodes.filter("kind = 'ClassDef' and attrs['base_names'] <> ''").select("path", F.col("name").alias("sub"), F.explode(F.split(F.col("attrs")["base_names"], ",")).alias("base"))
    return source.qualified(classes.filter("base <> '?'"), source.imports(nodes), "base").select("path", "sub", F.col("full").alias("super"))


def folding_ranges(nodes: DataFrame) -> DataFrame:
    """(path, row, end_row, kind) of blocks over several rows; of ranges from one row the longest."""
    found = nodes.filter("end_row > row").filter(F.col("kind").isin(FOLDED))
    return found.groupBy("path", "row").agg(F.max("end_row").alias("end_row"), F.max_by("kind", "end_row").alias("kind"))


def selection_ranges(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """(path, place_row, place_col, depth, kind): the nodes around each place (path, place_row, place_col), the smallest first."""
    near = places.join(nodes.filter("row is not null"), "path")
    start, end = F.struct(F.col("row"), F.col("col")), F.struct(F.col("end_row"), F.col("end_col"))
    at = F.struct(F.col("place_row"), F.col("place_col"))
    window = Window.partitionBy("path", "place_row", "place_col").orderBy(F.desc("row"), F.desc("col"), "end_row", "end_col", F.desc("node"))
    return near.filter((start <= at) & (at <= end)).withColumn("depth", F.row_number().over(window)).select("path", "place_row", "place_col", "depth", "kind")


def semantic_tokens(nodes: DataFrame) -> DataFrame:
    """(path, row, col, name, token): what each name stands for, by the binding it resolves to."""
    kind = F.when(F.col("def_kind") == "ClassDef", "class").when(F.col("def_kind").isin("FunctionDef", "AsyncFunctionDef"), "function").when(F.col("def_kind") == "import", "namespace").when(F.col("def_kind") == "argument", "parameter").otherwise("variable")
    return definitions(nodes).select("path", "row", "col", "name", kind.alias("token"))


def hover(nodes: DataFrame) -> DataFrame:
    """(path, name, signature, doc) of functions and classes."""
    found = nodes.filter("kind in ('FunctionDef', 'AsyncFunctionDef', 'ClassDef')")
    head = F.when(F.col("kind") == "ClassDef", F.concat(F.lit("class "), "name")).otherwise(F.concat(F.lit("def "), "name", F.lit("("), F.replace(F.coalesce(F.col("attrs")["params"], F.lit("")), F.lit(","), F.lit(", ")), F.lit(")")))
    return found.select("path", "name", head.alias("signature"), F.col("attrs")["doc"].alias("doc"))

"""What modules export, through star imports and ``__all__`` of other modules, over any chain or cycle of files.

``facts`` reads files one by one. What a module binds, and what it exports, are the least sets closed under its star imports, found as a fixpoint over
(module, name): in a round only names found in the round before go along the import edges, so cycles end by themselves, and each round is an equi-join, whatever the
number of modules. A module's own binding wins over an imported one, an earlier round over a later, then the last import of the file.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.rel import cut, spread
from quarry.shipping import ship

FACT = "path string, module string, kind string, name string, target string, row int"


def module_name(path: str) -> tuple[str, str]:
    """(dotted module, the package its relative imports start from)."""
    parts = path.removesuffix(".pyi").removesuffix(".py").strip("/").split("/")
    if parts[-1] == "__init__":
        return ".".join(parts[:-1]), ".".join(parts[:-1])
    return ".".join(parts), ".".join(parts[:-1])


def absolute(package: str, module: str | None, level: int) -> str:
    """The absolute name of an import: a level takes one package off after the first."""
    if not level:
        return module or ""
    base = package.split(".") if package else []
    base = base[: len(base) - level + 1] if level - 1 <= len(base) else []
    return ".".join([*base, *([module] if module else [])])


INNER = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def _elements(value: ast.expr | None, modules: dict[str, str]) -> Iterator[tuple[str, str]]:
    """('all', name) and ('all_of', module) of an expression for __all__; ('dynamic', '') for what cannot be read."""
    stack = [value]
    while stack:
        at = stack.pop()
        if isinstance(at, (ast.List, ast.Tuple, ast.Set)):
            for x in at.elts:
                if isinstance(x, ast.Starred):
                    stack.append(x.value)
                else:
                    yield ("all", x.value) if isinstance(x, ast.Constant) and isinstance(x.value, str) else ("dynamic", "")
        elif isinstance(at, ast.BinOp) and isinstance(at.op, ast.Add):
            stack += [at.right, at.left]
        elif isinstance(at, ast.Call) and isinstance(at.func, ast.Name) and at.func.id in ("list", "tuple", "set", "sorted") and len(at.args) == 1:
            stack.append(at.args[0])
        elif isinstance(at, ast.Attribute) and at.attr == "__all__":
            name, rest = at.value, []
            while isinstance(name, ast.Attribute):
                rest, name = [name.attr, *rest], name.value
            yield ("all_of", ".".join([modules.get(name.id, name.id), *rest])) if isinstance(name, ast.Name) else ("dynamic", "")
        elif not (isinstance(at, ast.Name) and at.id == "__all__"):
            yield "dynamic", ""


def fact_rows(path: str, text: str) -> Iterator[tuple]:
    """Facts of one file: ``bind`` a name at module level; ``import`` a name with the dotted target; ``star`` a module; ``all``, ``all_of``, ``removed``,
    ``has_all``, ``dynamic`` of __all__; ``read`` a name that nothing in the file binds; ``error`` for a file that does not parse."""
    module, package = module_name(path)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        yield path, module, "error", None, str(error), None
        return
    modules: dict[str, str] = {}
    exports: list[tuple[str, str | None, str | None, int]] = []
    bound: set[str] = set()
    read: dict[str, int] = {}
    stack: list[tuple[ast.AST, bool, bool]] = [(tree, True, True)]
    while stack:
        node, outer, top = stack.pop()
        names: list[tuple[str, str | None]] = []
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            names.append((node.name, None))
        elif isinstance(node, ast.Import):
            for x in node.names:
                target = x.name if x.asname else x.name.split(".")[0]
                names.append((x.asname or target, target))
                modules[x.asname or target] = target
        elif isinstance(node, ast.ImportFrom):
            origin = absolute(package, node.module, node.level)
            for x in node.names:
                if x.name == "*":
                    if outer:
                        yield path, module, "star", None, origin, node.lineno
                else:
                    names.append((x.asname or x.name, f"{origin}.{x.name}" if origin else x.name))
                    modules[x.asname or x.name] = names[-1][1]
        elif isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Load):
                read.setdefault(node.id, node.lineno)
            else:
                names.append((node.id, None))
        elif isinstance(node, (ast.MatchAs, ast.MatchStar, ast.ExceptHandler)) and node.name:
            names.append((node.name, None))
        elif isinstance(node, ast.MatchMapping) and node.rest:
            names.append((node.rest, None))
        elif isinstance(node, ast.arg):
            names.append((node.arg, None))
        elif isinstance(node, (ast.TypeVar, ast.ParamSpec, ast.TypeVarTuple)):
            names.append((node.name, None))
        elif isinstance(node, ast.Global):
            for name in node.names:
                yield path, module, "bind", name, None, node.lineno
        for name, target in names:
            bound.add(name)
            if outer and not isinstance(node, (ast.arg, ast.TypeVar, ast.ParamSpec, ast.TypeVarTuple)):
                yield path, module, "bind" if target is None else "import", name, target, getattr(node, "lineno", None)
        if outer:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, (ast.AnnAssign, ast.AugAssign)) else []
            if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and node.value is not None:
                if top and not isinstance(node, ast.AugAssign) and not any(isinstance(x, ast.Name) and x.id == "__all__" for x in ast.walk(node.value)):
                    exports.clear()
                exports.append(("has_all", None, None, node.lineno))
                exports += [(k, n if k == "all" else None, n if k == "all_of" else None, node.lineno) for k, n in _elements(node.value, modules)]
            call = node.value if isinstance(node, ast.Expr) else None
            if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and isinstance(call.func.value, ast.Name) and call.func.value.id == "__all__" and len(call.args) == 1:
                given = ast.List([call.args[0]]) if call.func.attr in ("append", "remove") else call.args[0]
                if call.func.attr in ("append", "extend", "remove"):
                    kind = "removed" if call.func.attr == "remove" else "all"
                    exports += [(kind if k == "all" else k, n if k == "all" else None, n if k == "all_of" else None, node.lineno) for k, n in _elements(given, modules)]
        inside = isinstance(node, INNER)
        for field, child in ast.iter_fields(node):
            for x in reversed(child) if isinstance(child, list) else [child]:
                if isinstance(x, ast.AST):
                    # Decorators, bases and annotations belong to the scope around; a walrus in a comprehension does too.
                    stack.append((x, outer and (not inside or field in ("decorator_list", "bases", "keywords")), top and isinstance(node, ast.Module)))
    removed = {n for k, n, _, _ in exports if k == "removed"}
    for kind, name, target, row in exports:
        if kind != "all" or name not in removed:
            yield path, module, kind, name, target, row
    for name, row in read.items():
        if name not in bound:
            yield path, module, "read", name, None, row


def facts(files: DataFrame) -> DataFrame:
    """Facts (path, module, kind, name, target, row) of files (path, text); a null text is an empty module."""
    ship(files.sparkSession)
    types = [pa.string()] * 5 + [pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.extend(fact_rows(path, text or "") if path else ())
                if len(held) >= 20_000:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], ["path", "module", "kind", "name", "target", "row"])

    return spread(files.select("path", "text")).mapInArrow(run, FACT)


def closure(seed: DataFrame, step, key: list[str], order: list[str]) -> DataFrame:
    """Rows found from ``seed`` by ``step`` over the rows found last, until none is new; of a round's rows with one key the least by ``order`` stays.

    Each round's rows are cut on their own, so what is known is never written again.
    """
    rest = [c for c in seed.columns if c not in key and c not in order]

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*key, *[f"_r.{c}" for c in rest]) if order or rest else rows.select(*key).distinct()

    known = fresh = cut(least(seed))
    while True:
        fresh = cut(least(step(fresh)).join(known.select(*key), key, "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)


def listed(of: DataFrame) -> DataFrame:
    """(module, name): what each module's __all__ lists, with the lists it takes from other modules."""
    own = of.where("kind = 'all'").select("module", "name")
    taken = of.where("kind = 'all_of'").select(F.col("target").alias("from"), F.col("module").alias("to")).distinct()

    def step(fresh: DataFrame) -> DataFrame:
        return fresh.withColumnRenamed("module", "from").join(taken, "from").select(F.col("to").alias("module"), "name")

    found = closure(own, step, ["module", "name"], [])
    removed = of.where("kind = 'removed'").select("module", "name").distinct()
    return found.join(removed, ["module", "name"], "left_anti")


def names(of: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(module, name, origin, exported): everything a module binds, the module that binds it first hand, and whether a star import takes it.

    A name that an __all__ lists and only a submodule of that name stands for has the submodule as its origin.
    """
    lists = cut(listed(of)) if lists is None else lists
    has = of.where("kind = 'has_all'").select("module").distinct().withColumn("_has", F.lit(True))
    own = of.where("kind in ('bind', 'import')").select("module", "name", F.col("module").alias("origin"))
    modules = of.select(F.col("module").alias("origin")).distinct()
    parts = lists.withColumn("origin", F.concat_ws(".", "module", "name")).join(modules, "origin").join(own, ["module", "name"], "left_anti")
    edges = of.where("kind = 'star'").groupBy(F.col("target").alias("from"), F.col("module").alias("to")).agg(F.max("row").alias("_row"))
    marked = lists.withColumn("_listed", F.lit(True))

    def exported(rows: DataFrame) -> DataFrame:
        flagged = rows.join(has, "module", "left").join(marked, ["module", "name"], "left")
        public = F.when(F.coalesce("_has", F.lit(False)), F.coalesce("_listed", F.lit(False))).otherwise(~F.col("name").startswith("_"))
        return flagged.withColumn("exported", public).drop("_has", "_listed")

    def step(fresh: DataFrame) -> DataFrame:
        sent = exported(fresh.select("module", "name", "origin")).where("exported").withColumnRenamed("module", "from")
        return sent.join(edges, "from").select(F.col("to").alias("module"), "name", "origin", (-F.col("_row")).alias("_late"))

    seed = own.unionByName(parts.select("module", "name", "origin")).distinct().withColumn("_late", F.lit(0))
    return exported(closure(seed, step, ["module", "name"], ["_late"]).select("module", "name", "origin"))


def resolved_reads(of: DataFrame, known: DataFrame, builtin: list[str]) -> DataFrame:
    """(path, module, name, row, origin): names that a file reads and does not bind, with the module that a star import brings them from; null if none does.

    ``builtin`` names are left out unless a star import brings them. Where a star import leads to a module without facts, nothing is said about the file's other names.
    """
    stars = of.where("kind = 'star'").select("module", "target").distinct()
    outside = stars.join(of.select(F.col("module").alias("target")).distinct(), "target", "left_anti").select("module").distinct().withColumn("_open", F.lit(True))
    reads = of.where("kind = 'read'").select("path", "module", "name", "row")
    joined = reads.join(known.select("module", "name", "origin"), ["module", "name"], "left").join(outside, "module", "left")
    kept = F.col("origin").isNotNull() | (F.col("_open").isNull() & ~F.col("name").isin(builtin))
    return joined.where(kept).select("path", "module", "name", "row", "origin")

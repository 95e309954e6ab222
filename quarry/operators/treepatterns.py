"""Tree patterns over syntax nodes: patterns are rows of a table, and all of them are matched at once by structural joins.

``tree`` numbers a file's nodes in pre-order, with the last number below each, so that 'below' is an interval and 'child' an equality. A pattern is a tree of steps; a step
tells a node's kind, the field it stands in, and names, qualified names or values it may have, and how it hangs on its parent step: as child or anywhere ``inside``. Matching goes
from the leaves of the patterns to their roots, a level of all patterns at a time: nodes meet steps by kind; a node holds if each child step is met by a node below it,
found by an equi-join for children and by a bucketed interval join for descendants. The work is a few joins per level, whatever the number of patterns and the depth of sources.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.rel import cut, range_join, spread, written
from quarry.shipping import ship

TREE = "path string, node int, last int, parent int, field string, position int, kind string, name string, full string, value string, row int"
STEP = "pattern string, step int, up int, level int, axis string, field string, kinds array<string>, names string, fulls array<string>, values array<string>, absent boolean"


def _imported(tree: ast.AST) -> dict[str, str]:
    """What imports bind each name to; the last one wins."""
    found: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found |= {x.asname or x.name.split(".")[0]: x.name if x.asname else x.name.split(".")[0] for x in node.names}
        elif isinstance(node, ast.ImportFrom):
            found |= {x.asname or x.name: "." * node.level + ".".join(filter(None, [node.module, x.name])) for x in node.names}
    return found


def _full(node: ast.AST, imported: dict[str, str]) -> str | None:
    """The dotted name of an attribute chain whose head is imported; of a call that of what is called."""
    parts: list[str] = []
    node = node.func if isinstance(node, ast.Call) else node
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([imported[node.id], *reversed(parts)]) if isinstance(node, ast.Name) and node.id in imported else None


def _name(node: ast.AST) -> str | None:
    for field in ("name", "id", "attr", "arg", "module"):
        if isinstance(found := getattr(node, field, None), str):
            return found
    if isinstance(node, ast.Compare):
        return " ".join(type(x).__name__ for x in node.ops)
    return type(node.op).__name__ if hasattr(node, "op") else None


def tree_rows(path: str, text: str) -> Iterator[tuple]:
    """A row per node in pre-order; nodes of operators and contexts have none, an operator is its expression's name. A file that does not parse has no rows."""
    try:
        root = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    imported = _imported(root)
    rows: list[list] = []
    stack: list[tuple[ast.AST | int, int | None, str | None, int]] = [(root, None, None, 0)]
    while stack:
        node, parent, field, position = stack.pop()
        if isinstance(node, int):
            rows[node][2] = len(rows) - 1
            continue
        own = len(rows)
        value = repr(node.value) if isinstance(node, ast.Constant) else None
        rows.append([path, own, own, parent, field, position, type(node).__name__, _name(node), _full(node, imported), value, getattr(node, "lineno", None)])
        stack.append((own, None, None, 0))
        children = []
        for name, child in ast.iter_fields(node):
            for i, x in enumerate(child if isinstance(child, list) else [child]):
                if isinstance(x, ast.AST) and not isinstance(x, (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)):
                    children.append((x, own, name, i))
        stack += reversed(children)
    yield from map(tuple, rows)


def tree(files: DataFrame) -> DataFrame:
    """Nodes of files (path, text)."""
    ship(files.sparkSession)
    names = [part.split()[0] for part in TREE.split(", ")]
    types = [pa.int32() if part.split()[1] == "int" else pa.string() for part in TREE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for row in tree_rows(path, text or ""):
                    held.append(row)
                    if len(held) >= 20_000:
                        yield packed(held)
                        held = []
        if held:
            yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return spread(files.select("path", "text")).mapInArrow(run, TREE)


def step(kind: str, *below: dict, field: str | None = None, name: str | None = None, full: str | None = None, value: str | None = None, inside: bool = False, absent: bool = False) -> dict:
    """A step of a pattern. ``kind``, ``full`` and ``value``: one or several, separated by blanks (``value`` by |); ``name``: a regular expression for the whole name;
    ``inside``: at any depth below the step before; ``absent``: no such node may be there."""
    return {"kinds": kind.split(), "field": field, "names": name, "fulls": full.split() if full else None, "values": value.split("|") if value else None, "axis": "inside" if inside else "child", "absent": absent, "below": below}


def pattern_table(spark: SparkSession, patterns: list[tuple[str, dict]]) -> DataFrame:
    """Patterns (name, root step) as rows; a name may stand for several patterns, of which one has to hold."""
    rows: list[tuple] = []
    for name, root in patterns:
        stack = [(root, None, 0)]
        while stack:
            at, up, level = stack.pop()
            number = len(rows)
            rows.append((name, number, up, level, at["axis"], at["field"], at["kinds"], at["names"], at["fulls"], at["values"], at["absent"]))
            stack += [(x, number, level + 1) for x in at["below"]]
    return spark.createDataFrame(rows, STEP)


def matches(nodes: DataFrame, patterns: DataFrame, width: int = 256) -> DataFrame:
    """(pattern, path, node, row): the nodes at which each pattern holds. ``width``: the usual extent of a node, for the interval join."""
    steps = written(patterns.withColumn("kind", F.explode("kinds")).drop("kinds"))
    needs = patterns.where("up is not null").groupBy(F.col("up").alias("step")).agg(F.sum((~F.col("absent")).cast("int")).alias("_needed"))
    labelled = nodes.alias("n").join(steps.alias("s"), "kind").where(
        "(s.field is null or s.field = n.field) and (s.names is null or regexp_like(n.name, concat('^(?:', s.names, ')$'))) and (s.fulls is null or array_contains(s.fulls, n.full)) "
        "and (s.values is null or array_contains(s.values, n.value))"
    ).select("path", "node", "last", "parent", "row", "pattern", "step", "up", "level", "axis", "absent")
    labelled = written(labelled.join(needs, "step", "left").withColumn("_needed", F.coalesce("_needed", F.lit(0))))
    with_steps = patterns.where("up is not null").select("up").distinct().withColumnRenamed("up", "step")
    deepest = patterns.agg(F.max("level")).first()[0]
    held = None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = labelled.where(F.col("level") == level)
        if held is not None:
            branches, leaves = here.join(F.broadcast(with_steps), "step", "left_semi"), here.join(F.broadcast(with_steps), "step", "left_anti")
            children = held.where("axis = 'child'").select("path", F.col("parent").alias("node"), F.col("up").alias("step"), F.col("step").alias("_met"), "absent")
            direct = branches.select("path", "node", "step").join(children, ["path", "node", "step"])
            below = held.where("axis = 'inside'").select("path", F.col("up").alias("step"), F.col("node").alias("_at"), F.col("step").alias("_met"), "absent")
            extents = branches.select("path", "step", "node", (F.col("node") + 1).alias("_from"), "last")
            deep = range_join(below, extents, ["path", "step"], "_at", "_from", "last", width, closed=True)
            met = direct.unionByName(deep.select("path", "node", "step", "_met", "absent")).distinct()
            told = met.groupBy("path", "node", "step").agg(F.sum((~F.col("absent")).cast("int")).alias("_found"), F.max("absent").alias("_barred"))
            full = branches.join(told, ["path", "node", "step"], "left").where("coalesce(_found, 0) = _needed and not coalesce(_barred, false)")
            here = leaves.unionByName(full.select(leaves.columns))
        held = cut(here)
    if held is None:
        return nodes.where("false").select(F.lit("").alias("pattern"), "path", "node", "row")
    return held.select("pattern", "path", "node", "row").distinct()


LISTS = "append insert extend remove pop clear reverse sort".split()
MAPS = "update pop clear setdefault popitem".split()


def _call(full: str) -> dict:
    return step("Expr", step("Call", field="value", full=full))


def _target(kinds: str, full: str, field: str) -> list[dict]:
    """Statements whose target is a name or an item of it."""
    return [step(kinds, step("Attribute Name", field=field, full=full)), step(kinds, step("Subscript", step("Attribute Name", field="value", full=full), field=field))]


#: What statements do to the state of the interpreter, and calls of loggers. Fixed values.
STATEMENTS: list[tuple[str, dict]] = [
    ("sys_path", _call(" ".join(f"sys.path.{m}" for m in LISTS))),
    *[("sys_path", p) for p in _target("AugAssign", "sys.path", "target")],
    ("os_environ", _call(" ".join(["os.putenv", "os.unsetenv", *[f"os.environ.{m}" for m in MAPS]]))),
    *[("os_environ", p) for p in [*_target("Delete Assign", "os.environ", "targets"), *_target("AnnAssign AugAssign", "os.environ", "target")]],
    ("matplotlib_use", _call("matplotlib.use")),
    ("importorskip", _call("pytest.importorskip")),
    ("site_dir", _call("site.addsitedir")),
    ("logger", step("Call", step("Attribute", step("Call", field="value", full="logging.getLogger logging.Logger"), field="func"))),
    ("logger", step("Call", step("Attribute", step("Attribute Name", field="value", full="logging flask.current_app.logger"), field="func"))),
    ("logger_name", step("Call", step("Attribute", step("Attribute Name", field="value", name="log.*|.*logger|.*logging|LOG.*|.*LOGGER|.*LOGGING"), field="func"))),
    ("exc_info", step("Call", step("keyword", step("Constant", field="value", value="True"), field="keywords", name="exc_info"))),
    ("exc_info", step("Call", step("keyword", step("Call", field="value", full="sys.exc_info"), field="keywords", name="exc_info"))),
]


def statement_patterns(spark: SparkSession) -> DataFrame:
    return pattern_table(spark, STATEMENTS)


def logger_calls(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(path, node, row): calls of loggers: made in place, imported, or by a name that is usual for them where the name is not an imported one."""
    imported = nodes.where("kind in ('Attribute', 'Name') and field = 'value' and full is not null").select("path", F.col("parent").alias("node"))
    attributes = nodes.where("kind = 'Attribute' and field = 'func'").select("path", "node", "parent")
    of_imported = attributes.join(imported, ["path", "node"], "left_semi").select("path", F.col("parent").alias("node"))
    by_name = found.where("pattern = 'logger_name'").join(of_imported, ["path", "node"], "left_anti")
    return found.where("pattern = 'logger'").unionByName(by_name).select("path", "node", "row").distinct()

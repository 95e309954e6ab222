"""Data flow in functions: reaching definitions, unbound uses, dead stores and dominators over the graph of their statements.

``flow`` reads files and writes each function's graph as rows; statement 0 is the function's entry, -1 its end. The analyses group these rows by function, so functions are spread
over all tasks and a group is never larger than one function's source. In a group definitions are the bits of integers: a statement's in-set is the union of its
predecessors' out-sets, its out-set ``gen | in & ~kill``, repeated in flow order until nothing changes; dominators are an intersection of the same kind. Everything asked
of the result (unbound, dead, loops) is a join over rows.

What may raise: every statement in a ``try`` body may leave for its handlers, nothing else is taken to raise. ``while True`` ends by ``break`` alone. Names of ``global`` and
``nonlocal``, and those that inner functions read or bind, may change elsewhere: they have no dead stores and no unbound uses. Files that do not parse have no rows.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.rel import spread
from quarry.shipping import ship

ENTRY, END = 0, -1
#: kind: 'stmt' (src, text its kind), 'edge' (src, dst), 'def', 'use' and 'del' (src, text the name), 'shared' (text).
FLOW = "path string, func int, kind string, src int, dst int, text string, row int, dst_row int"


class Graph:
    """One function's statements while they are walked."""

    def __init__(self, function: ast.FunctionDef | ast.AsyncFunctionDef):
        self.kinds: list[tuple[str, int]] = [("entry", function.lineno)]
        self.edges: set[tuple[int, int]] = set()
        self.names: list[tuple[str, int, str]] = []
        self.shared: set[str] = set()
        #: Around the place: ('loop', head, breaks) and ('finally', jumps).
        self.around: list[tuple] = []
        a = function.args
        for arg in [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]:
            self.names.append(("def", ENTRY, arg.arg))
        for end in self.block(function.body, {ENTRY}):
            self.edges.add((end, END))

    def statement(self, kind: str, row: int, before: set[int]) -> int:
        self.kinds.append((kind, row))
        number = len(self.kinds) - 1
        self.edges |= {(b, number) for b in before}
        return number

    def read(self, at: int, *parts: ast.AST | None) -> None:
        """Names that expressions read and bind at a statement."""
        bound = {x.target.id for p in parts if p is not None for x in ast.walk(p) if isinstance(x, ast.NamedExpr)}
        stack: list[tuple[ast.AST, frozenset[str]]] = [(p, frozenset()) for p in parts if p is not None]
        while stack:
            node, own = stack.pop()
            if isinstance(node, ast.Name):
                if node.id not in own and isinstance(node.ctx, ast.Load) and node.id not in bound:
                    self.names.append(("use", at, node.id))
                elif node.id not in own and isinstance(node.ctx, (ast.Store, ast.Del)):
                    self.names.append(("def" if isinstance(node.ctx, ast.Store) else "del", at, node.id))
                    if isinstance(node.ctx, ast.Del):
                        self.names.append(("use", at, node.id))
            elif isinstance(node, ast.Lambda):
                self.shared |= {x.id for x in ast.walk(node) if isinstance(x, ast.Name)}
                stack += [(d, own) for d in [*node.args.defaults, *node.args.kw_defaults] if d is not None]
                continue
            elif isinstance(node, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
                own = own | {x.id for g in node.generators for x in ast.walk(g.target) if isinstance(x, ast.Name)}
            stack += [(x, own) for x in ast.iter_child_nodes(node)]

    def jump(self, kind: str, froms: set[int]) -> None:
        """Leave by return, raise, break or continue, through the finally blocks between."""
        for frame in reversed(self.around):
            if frame[0] == "finally":
                frame[1].append((kind, froms))
                return
            if frame[0] == "handlers" and kind == "raise":
                frame[1].update(froms)
                if frame[2]:
                    return
            if frame[0] == "loop" and kind == "continue":
                self.edges |= {(f, frame[1]) for f in froms}
                return
            if frame[0] == "loop" and kind == "break":
                frame[2].update(froms)
                return
        self.edges |= {(f, END) for f in froms}

    def block(self, body: list[ast.stmt], ends: set[int]) -> set[int]:
        for node in body:
            ends = self.walk(node, ends)
        return ends

    def walk(self, node: ast.stmt, before: set[int]) -> set[int]:
        """Add a statement and what it holds; the statements after which flow goes on behind it."""
        if isinstance(node, ast.Try | ast.TryStar):
            return self.try_(node, before)
        at = self.statement(type(node).__name__, node.lineno, before)
        if isinstance(node, ast.If):
            self.read(at, node.test)
            return self.block(node.body, {at}) | (self.block(node.orelse, {at}) if node.orelse else {at})
        if isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            breaks: set[int] = set()
            inside = at
            if isinstance(node, ast.While):
                self.read(at, node.test)
            else:
                self.read(at, node.iter)
                inside = self.statement("target", node.lineno, {at})
                self.read(inside, node.target)
            self.around.append(("loop", at, breaks))
            self.edges |= {(end, at) for end in self.block(node.body, {inside})}
            self.around.pop()
            endless = isinstance(node, ast.While) and isinstance(node.test, ast.Constant) and bool(node.test.value)
            return breaks | (set() if endless else self.block(node.orelse, {at}))
        if isinstance(node, (ast.With, ast.AsyncWith)):
            for i, item in enumerate(node.items):
                # A later item reads what an earlier one binds.
                at = self.statement("item", item.context_expr.lineno, {at}) if i else at
                self.read(at, item.context_expr, item.optional_vars)
            return self.block(node.body, {at})
        if isinstance(node, ast.Match):
            self.read(at, node.subject)
            ends, open_ = set(), {at}
            for case in node.cases:
                test = self.statement("case", case.pattern.lineno, open_)
                self.read(test, *[x for x in ast.walk(case.pattern) if isinstance(x, ast.expr)])
                taken = self.statement("capture", case.pattern.lineno, {test})
                for x in ast.walk(case.pattern):
                    name = getattr(x, "rest" if isinstance(x, ast.MatchMapping) else "name", None)
                    if name:
                        self.names.append(("def", taken, name))
                open_ = set() if isinstance(case.pattern, ast.MatchAs) and case.pattern.pattern is None else {test}
                if case.guard is not None:
                    guard = self.statement("guard", case.guard.lineno, {taken})
                    self.read(guard, case.guard)
                    taken, open_ = guard, open_ | {guard}
                ends |= self.block(case.body, {taken})
            return ends | open_
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            outer = [*node.decorator_list, *([*node.bases, *node.keywords] if isinstance(node, ast.ClassDef) else [*node.args.defaults, *[d for d in node.args.kw_defaults if d]])]
            self.read(at, *outer)
            self.names.append(("def", at, node.name))
            inner = [x for part in node.body for x in ast.walk(part)]
            self.shared |= {x.id for x in inner if isinstance(x, ast.Name)} | {n for x in inner if isinstance(x, ast.Nonlocal) for n in x.names}
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            self.names += [("def", at, x.asname or x.name.split(".")[0]) for x in node.names if x.name != "*"]
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            self.shared |= set(node.names)
        elif isinstance(node, ast.AugAssign):
            self.read(at, node.value, node.target)
            if isinstance(node.target, ast.Name):
                self.names.append(("use", at, node.target.id))
        elif isinstance(node, ast.AnnAssign):
            self.read(at, node.annotation, node.value, node.target if node.value is not None or not isinstance(node.target, ast.Name) else None)
        else:
            self.read(at, *ast.iter_child_nodes(node))
        leaves = {ast.Return: "return", ast.Raise: "raise", ast.Break: "break", ast.Continue: "continue"}.get(type(node))
        if leaves:
            self.jump(leaves, {at})
            return set()
        return {at}

    def try_(self, node: ast.Try, before: set[int]) -> set[int]:
        at = self.statement("Try", node.lineno, before)
        jumps: list[tuple[str, set[int]]] = []
        if node.finalbody:
            self.around.append(("finally", jumps))
        every = any(h.type is None or isinstance(h.type, ast.Name) and h.type.id in ("Exception", "BaseException") for h in node.handlers)
        raised: set[int] = {at}
        if node.handlers:
            self.around.append(("handlers", raised, every))
        ends = self.block(node.body, {at})
        if node.handlers:
            self.around.pop()
        raised |= set(range(at, len(self.kinds)))
        ends = self.block(node.orelse, ends)
        for handler in node.handlers:
            caught = self.statement("ExceptHandler", handler.lineno, raised)
            self.read(caught, handler.type)
            if handler.name:
                self.names.append(("def", caught, handler.name))
            left = self.block(handler.body, {caught})
            if handler.name and left:
                # The name is unbound when the handler ends.
                left = {self.statement("unbind", handler.end_lineno, left)}
                self.names.append(("del", *left, handler.name))
            ends |= left
        if node.finalbody:
            self.around.pop()
            uncaught = set() if every else raised
            start = len(self.kinds)
            last = self.block(node.finalbody, ends | uncaught | {f for _, froms in jumps for f in froms})
            for kind in dict.fromkeys(["raise"] * bool(uncaught) + [k for k, _ in jumps]):
                self.jump(kind, set(last) or {start})
            return last if ends else set()
        return ends


def flow_rows(path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    functions = sorted((x for x in ast.walk(tree) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))), key=lambda x: (x.lineno, x.col_offset))
    for number, function in enumerate(functions):
        try:
            graph = Graph(function)
        except RecursionError:
            continue
        row = lambda s: graph.kinds[s][1] if s > 0 else None
        for s, (kind, at) in enumerate(graph.kinds):
            yield path, number, "stmt", s, None, function.name if s == ENTRY else kind, at, None
        for a, b in sorted(graph.edges):
            yield path, number, "edge", a, b, None, row(a), row(b)
        for kind, s, name in dict.fromkeys(graph.names):
            yield path, number, kind, s, None, name, row(s), None
        for name in sorted(graph.shared):
            yield path, number, "shared", None, None, name, None, None


def flow(files: DataFrame) -> DataFrame:
    """The graphs of all functions of files (path, text), as rows of several kinds."""
    ship(files.sparkSession)
    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
    names = [part.split()[0] for part in FLOW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.extend(flow_rows(path, text or ""))
                if len(held) >= 20_000:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return spread(files.select("path", "text")).mapInArrow(run, FLOW)


def in_order(edges: dict[int, list[int]]) -> list[int]:
    """Statements reachable from the entry, each before those that only follow it (reverse of the order in which a depth-first walk leaves them)."""
    seen, left, stack = {ENTRY}, [], [(ENTRY, iter(edges.get(ENTRY, ())))]
    while stack:
        node, rest = stack[-1]
        following = next((x for x in rest if x not in seen), None)
        if following is None:
            left.append(node)
            stack.pop()
        else:
            seen.add(following)
            stack.append((following, iter(edges.get(following, ()))))
    return left[::-1]


def solve(edges: list[tuple[int, int]], names: list[tuple[str, int, str]]) -> tuple[list[tuple], dict[int, int]]:
    """(use statement, name, defining statement or None for unbound) by reaching definitions, and each reachable statement's immediate dominator."""
    after: dict[int, list[int]] = {}
    before: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    order = in_order(after)
    local = {n for kind, _, n in names if kind in ("def", "del")}
    # Bit by definition; the unbound state of a name counts as one.
    definitions: list[tuple[int | None, str]] = [(None, n) for n in sorted(local)] + [(s, n) for kind, s, n in names if kind == "def"]
    bit = {d: 1 << i for i, d in enumerate(definitions)}
    of_name: dict[str, int] = {}
    for d, b in bit.items():
        of_name[d[1]] = of_name.get(d[1], 0) | b
    gen: dict[int, int] = {}
    kill: dict[int, int] = {}
    for kind, s, n in sorted(names, key=lambda x: x[0] == "def"):
        if kind != "use":
            gen[s] = gen.get(s, 0) & ~of_name[n] | bit[(s, n) if kind == "def" else (None, n)]
            kill[s] = kill.get(s, 0) | of_name[n]
    unbound = sum(bit[(None, n)] for n in local)
    into: dict[int, int] = dict.fromkeys(order, 0)
    out: dict[int, int] = dict.fromkeys(order, 0)
    dominators: dict[int, int] = dict.fromkeys(order, -1)
    place = {s: i for i, s in enumerate(order)}
    changed = True
    while changed:
        changed = False
        for s in order:
            reached, common = (unbound, 0) if s == ENTRY else (0, -1)
            for p in before.get(s, ()):
                if p in place:
                    reached |= out[p]
                    common &= dominators[p]
            new = gen.get(s, 0) | reached & ~kill.get(s, 0)
            common |= 1 << place[s]
            if new != out[s] or reached != into[s] or common != dominators[s]:
                into[s], out[s], dominators[s], changed = reached, new, common, True
    chains = [
        (s, n, definitions[i][0]) for kind, s, n in dict.fromkeys(names) if kind == "use" and n in local and s in place
        for i in range(len(definitions)) if into[s] >> i & 1 and definitions[i][1] == n
    ]
    # All dominators of a statement but itself dominate its immediate one, which is the last of them in order.
    return chains, {s: order[(dominators[s] & ~(1 << place[s])).bit_length() - 1] for s in order if s != ENTRY}


SOLVED = "path string, func int, kind string, src int, dst int, text string, row int, dst_row int"


def solved(of: DataFrame) -> DataFrame:
    """(path, func, kind, src, dst, text, row, dst_row): 'reach' from a use (src) of a name (text) to a statement that defines it (dst, null if unbound), and
    'idom' from a statement to its immediate dominator. Rows are the statements' lines, null for the entry and the end."""
    ship(of.sparkSession)

    names, types = [part.split()[0] for part in SOLVED.split(", ")], [pa.int32() if part.split()[1] == "int" else pa.string() for part in SOLVED.split(", ")]

    def answers(path: str, func: int, rows: list[tuple]) -> Iterator[tuple]:
        line = {src: row for kind, src, _, _, row in rows if kind == "stmt" and src != ENTRY}
        edges = sorted({(src, dst) for kind, src, dst, _, _ in rows if kind == "edge"})
        told = sorted({(kind, src, text) for kind, src, _, text, _ in rows if kind in ("def", "use", "del")})
        chains, dominators = solve(edges, told)
        for s, n, d in chains:
            yield path, func, "reach", s, d, n, line.get(s), line.get(d)
        for s, d in dominators.items():
            yield path, func, "idom", s, d, None, line.get(s), line.get(d)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Each function's rows, which lie side by side."""
        key, rows = None, []
        for batch in batches:
            for path, func, *row in zip(*[batch.column(c).to_pylist() for c in ("path", "func", "kind", "src", "dst", "text", "row")], strict=True):
                if key != (path, func) and rows:
                    yield *key, rows
                    rows = []
                key = path, func
                rows.append(row)
        if rows:
            yield *key, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for path, func, rows in functions(batches):
            held.extend(answers(path, func, rows))
            if len(held) >= 20_000:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    # One sorted pass instead of a table a function: functions are many and small.
    dealt = spread(of.where("kind <> 'shared'"), "path", "func").sortWithinPartitions("path", "func")
    return dealt.mapInArrow(run, SOLVED)


def _not_shared(rows: DataFrame, of: DataFrame) -> DataFrame:
    return rows.join(of.where("kind = 'shared'").select("path", "func", "text").distinct(), ["path", "func", "text"], "left_anti")


def unbound_uses(of: DataFrame, found: DataFrame) -> DataFrame:
    """(path, func, name, row, certain): uses that a name's unbound state reaches; certain where nothing else does."""
    uses = _not_shared(found.where("kind = 'reach'"), of).groupBy("path", "func", F.col("text").alias("name"), "src", "row").agg(
        F.max(F.col("dst").isNull()).alias("unbound"), F.max(F.col("dst").isNotNull()).alias("bound")
    )
    return uses.where("unbound").select("path", "func", "name", "row", (~F.col("bound")).alias("certain"))


def dead_stores(of: DataFrame, found: DataFrame) -> DataFrame:
    """(path, func, name, row): definitions that reach no use; parameters and names with a leading underscore are left out."""
    stored = _not_shared(of.where(f"kind = 'def' and src <> {ENTRY} and text not like '\\\\_%'"), of)
    used = found.where("kind = 'reach' and dst is not null").select("path", "func", "text", F.col("dst").alias("src")).distinct()
    return stored.join(used, ["path", "func", "text", "src"], "left_anti").select("path", "func", F.col("text").alias("name"), "row")


def dominators(found: DataFrame) -> DataFrame:
    """(path, func, row, by): each reachable statement and the one that every way to it passes last; null for the entry."""
    return found.where("kind = 'idom' and src <> -1").select("path", "func", "src", "row", F.col("dst_row").alias("by"))

"""Python files as relations: nodes, tokens, and from them calls, imports, bindings, references.

A small helper walks the standard library's syntax tree of one file and writes a row per node; all analysis is
done on those rows with DataFrame operations. A file that cannot be parsed gives one row of kind ``SyntaxError``. Paths name files:
rows of one path are taken for one file, so a table with a path twice gives each finding of a join for both.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.rel import spread
from quarry.shipping import ship

NODE = (
    "path string, node int, parent int, scope int, func int, field string, kind string, row int, col int, end_row int, end_col int, name string, value string, attrs map<string,string>, "
    # What rules ask about the place of a node, so that they need no join: calls by their imported name, the node around, the
    # innermost handler, loop and function, and for scopes the scopes that see what is bound here.
    "full string, parent_kind string, parent_test string, siblings int, in_handler boolean, handler_name string, in_loop boolean, in_async boolean, "
    "in_function string, in_class string, last_in_function boolean, around string, "
    # The place among its siblings, the kinds before it (distinct) and right before it; parameters, bases and decorators of what is around.
    "position int, before string, prev_kind string, params_around string, class_bases string, class_decorators string, parent_name string"
)
TOKEN = (
    "path string, seq int, kind string, text string, row int, col int, end_row int, end_col int, depth int, p_kind string, p_text string, p_end_row int, p_end_col int, "
    "n_kind string, n_text string, n_row int, n_col int, n_end_row int"
)
SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def dotted(node: ast.AST) -> str | None:
    """a.b.c for a chain of attributes on a name."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id])) if isinstance(node, ast.Name) else None


def constant(value: object) -> str:
    """A constant as Python writes it; an integer of more digits than that allows in hexadecimal ones."""
    try:
        return repr(value)
    except ValueError:
        return hex(value)


def _kinds(body: list) -> str:
    return ",".join(type(x).__name__ for x in body)


def _name(node: ast.AST, fields: tuple[str, ...]) -> str | None:
    for field in fields:
        value = getattr(node, field, None)
        if isinstance(value, str):
            return value
    return dotted(node.func) if isinstance(node, ast.Call) else None


class Texts(dict):
    """Source of nodes as the parser writes it back, each made once; of nodes too deep for that, as it stands in the file."""

    def __init__(self, source: str = ""):
        self.source = source
        self.lines: list[bytes] | None = None
        #: Whether some name may be ``__all__``; names of other than plain characters are normalised.
        self.exports = "__all__" in source or not source.isascii()

    def __missing__(self, node: ast.AST) -> str:
        try:
            text = ast.unparse(node)
        except (RecursionError, ValueError):
            text = self.sliced(node)
        self[node] = text
        return text

    def sliced(self, node: ast.AST) -> str:
        if getattr(node, "end_lineno", None) is None:
            return ""
        if self.lines is None:
            self.lines = [x.encode() for x in re.split("(?<=\n)|(?<=\r)(?!\n)", self.source)]
        rows = self.lines[node.lineno - 1 : node.end_lineno]
        rows[-1] = rows[-1][: node.end_col_offset]
        rows[0] = rows[0][node.col_offset :]
        return b"".join(rows).decode(errors="replace")

    def later(self, node: ast.AST) -> Callable[[], str]:
        """The text of a node, made when it is asked for."""
        return partial(self.__getitem__, node)


#: Nodes of which the rows below tell something: tests, parameters, bases.
TOLD = (ast.If, ast.IfExp, ast.While, ast.Assert, ast.Return, ast.Raise, ast.UnaryOp, ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)
#: Nodes that only their fields tell of, such that have no nodes below, and what is no node of its own.
PLAIN = (ast.arguments, ast.alias, ast.withitem, ast.Tuple, ast.List)
LEAVES = (ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal)
SIGNS = (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)
SIMPLE = (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Expr, ast.Return, ast.Raise, ast.Delete, ast.Assert, ast.Pass, ast.Break, ast.Continue)
WRITTEN = (ast.Compare, ast.BoolOp, ast.BinOp, ast.Subscript, ast.Call, ast.IfExp, ast.Attribute, ast.comprehension, ast.DictComp, ast.Lambda, *SIMPLE)


def _told(found: Found, attrs: frozenset[str] | None) -> dict[str, str]:
    """The attributes that are asked for, all without ``attrs``; what is not asked for is not written."""
    return {k: v() if callable(v) else v for k, v in found.items() if attrs is None or k in attrs}


def _repeated(nodes: list[ast.AST], texts: Texts) -> str:
    written = [texts[x] for x in nodes]
    return ",".join(sorted({x for x in written if written.count(x) > 1}))


def _below(node: ast.AST, texts: Texts) -> Found:
    """What a node tells the rows below it: its test, parameters, bases and decorators."""
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
        a = node.args
        return {"params": ",".join([x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]])}
    if isinstance(node, ast.ClassDef):
        return {"base_names": ",".join([dotted(b.value if isinstance(b, ast.Subscript) else b) or "?" for b in node.bases]), "decorators": _decorators(node)}
    part = getattr(node, "test", None) or getattr(node, "value", None) or getattr(node, "exc", None) or getattr(node, "operand", None)
    return {"src": texts.later(part) if part is not None else ""}


def _decorators(node: ast.AST) -> str:
    return ",".join([dotted(d.func if isinstance(d, ast.Call) else d) or "?" for d in getattr(node, "decorator_list", [])])


Found = dict[str, str | Callable[[], str]]
#: (classes of nodes, function that adds what it tells of such a node, pattern of the attributes it may add).
TELLERS: list[tuple[tuple[type[ast.AST], ...], Callable, re.Pattern]] = []


def _tells(*classes: type[ast.AST], gives: str) -> Callable:
    def register(function: Callable) -> Callable:
        TELLERS.append((classes, function, re.compile(gives)))
        return function

    return register


@_tells(*WRITTEN, gives="text|exports")
def _text(node: ast.AST, texts: Texts, found: Found) -> None:
    found["text"] = texts.later(node)
    if texts.exports:
        found["exports"] = texts.later(node)


@_tells(ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Module, gives="doc|decorators|first")
def _heading(node: ast.AST, texts: Texts, found: Found) -> None:
    if (doc := ast.get_docstring(node, clean=False)) is not None:
        found["doc"] = doc
    found["decorators"] = _decorators(node)
    if node.body and isinstance(node.body[0], ast.Expr):
        found["first"] = type(node.body[0].value).__name__


@_tells(ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, gives="params|n_params|defaults|n_positional|default_calls|param_(defaults|types)|positional_(defaults|types)|returns_src|none_defaults")
def _parameters(node: ast.AST, texts: Texts, found: Found) -> None:
    a = node.args
    names = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
    found |= {"params": ",".join(names), "n_params": str(len(names)), "defaults": _kinds([*a.defaults, *[d for d in a.kw_defaults if d]])}
    found["n_positional"] = str(len(a.posonlyargs) + len(a.args))
    found["default_calls"] = ",".join(dotted(d.func) or "?" for d in [*a.defaults, *a.kw_defaults] if isinstance(d, ast.Call))
    plain = [*a.posonlyargs, *a.args]
    defaults = [*[None] * (len(plain) - len(a.defaults)), *a.defaults]
    found["param_defaults"] = lambda: ";".join(f"{x.arg}={texts[d]}" for x, d in zip([*plain, *a.kwonlyargs], [*defaults, *a.kw_defaults], strict=True) if d is not None)
    found["param_types"] = lambda: ";".join(f"{x.arg}:{texts[x.annotation]}" for x in [*plain, *a.kwonlyargs] if x.annotation is not None)
    found["positional_types"] = lambda: ";".join(f"{x.arg}:{texts[x.annotation]}" for x in plain if x.annotation is not None)
    found["positional_defaults"] = lambda: ";".join(f"{x.arg}={texts[d]}" for x, d in zip(plain, defaults, strict=True) if d is not None)
    if getattr(node, "returns", None) is not None:
        found["returns_src"] = texts.later(node.returns)
    none = [(x, d) for x, d in zip([*plain, *a.kwonlyargs], [*defaults, *a.kw_defaults], strict=True) if isinstance(d, ast.Constant) and d.value is None]
    found["none_defaults"] = lambda: ";".join(texts[x.annotation] for x, _ in none if x.annotation is not None)


@_tells(ast.ClassDef, gives="base_names|decorators|bases_src|class_kw|methods|fields|inner_classes")
def _class(node: ast.AST, texts: Texts, found: Found) -> None:
    found |= _below(node, texts)
    found["bases_src"] = lambda: ",".join(texts[b] for b in node.bases)
    found["class_kw"] = lambda: ",".join(f"{k.arg}={texts[k.value]}" for k in node.keywords)
    found["methods"] = ",".join(x.name for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)))
    assigned = [t.id for x in node.body if isinstance(x, ast.Assign) for t in x.targets if isinstance(t, ast.Name)]
    found["fields"] = ",".join([*assigned, *(x.target.id for x in node.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name))])
    found["inner_classes"] = ",".join(x.name for x in node.body if isinstance(x, ast.ClassDef))


@_tells(ast.Call, gives=r"kw|kw_.*|arg\d+(_src)?|method|on|on_kind")
def _call(node: ast.AST, texts: Texts, found: Found) -> None:
    found["kw"] = ",".join(k.arg or "**" for k in node.keywords)
    found |= {f"kw_{k.arg}": texts.later(k.value) for k in node.keywords if k.arg}
    for i, x in enumerate(node.args):
        found[f"arg{i}"] = type(x).__name__
        found[f"arg{i}_src"] = texts.later(x)
    if isinstance(node.func, ast.Attribute):
        found |= {"method": node.func.attr, "on": texts.later(node.func.value), "on_kind": type(node.func.value).__name__}


@_tells(ast.Compare, gives="n_ops|op|left|right|left_src|right_src")
def _compared(node: ast.AST, texts: Texts, found: Found) -> None:
    found |= {"n_ops": str(len(node.ops)), **_link(node.left, node.ops[0], node.comparators[0], texts)}


@_tells(ast.Constant, gives="type|chars")
def _constant(node: ast.AST, texts: Texts, found: Found) -> None:
    found["type"] = type(node.value).__name__
    found["chars"] = str(len(node.value)) if isinstance(node.value, (str, bytes)) else ""


@_tells(ast.Dict, gives="repeated|spread_empty")
def _dict(node: ast.AST, texts: Texts, found: Found) -> None:
    found["repeated"] = lambda: _repeated([k for k in node.keys if isinstance(k, (ast.Constant, ast.Name))], texts)
    found["spread_empty"] = str(int(any(k is None and isinstance(v, ast.Dict) for k, v in zip(node.keys, node.values, strict=True))))


@_tells(ast.Set, gives="repeated")
def _set(node: ast.AST, texts: Texts, found: Found) -> None:
    found["repeated"] = lambda: _repeated([k for k in node.elts if isinstance(k, ast.Constant)], texts)


@_tells(ast.If, ast.IfExp, ast.While, ast.Assert, ast.Return, ast.Raise, ast.UnaryOp, gives="src")
def _tested(node: ast.AST, texts: Texts, found: Found) -> None:
    found |= _below(node, texts)


@_tells(ast.IfExp, gives="body_src|orelse_src")
def _choice(node: ast.AST, texts: Texts, found: Found) -> None:
    found |= {"body_src": texts.later(node.body), "orelse_src": texts.later(node.orelse)}


@_tells(ast.BoolOp, gives="parts")
def _parts(node: ast.AST, texts: Texts, found: Found) -> None:
    found["parts"] = lambda: " ; ".join(texts[v] for v in node.values)


@_tells(ast.Import, ast.ImportFrom, gives="names")
def _import(node: ast.AST, texts: Texts, found: Found) -> None:
    found["names"] = ",".join(f"{x.name} {x.asname or ''}".strip() for x in node.names)


@_tells(ast.Global, ast.Nonlocal, gives="names_src")
def _global(node: ast.AST, texts: Texts, found: Found) -> None:
    found["names_src"] = ",".join(node.names)


@_tells(ast.Assign, gives="target_names|targets_src|value_src")
def _assigned(node: ast.AST, texts: Texts, found: Found) -> None:
    found["target_names"] = ",".join(dotted(t) or "" for t in node.targets)
    found["targets_src"] = lambda: ",".join(texts[t] for t in node.targets)
    found["value_src"] = texts.later(node.value)


@_tells(ast.AnnAssign, ast.AugAssign, gives="target_src|value_src|annotation_src")
def _annotated(node: ast.AST, texts: Texts, found: Found) -> None:
    found["target_src"] = texts.later(node.target)
    found |= {"value_src": texts.later(node.value)} if node.value is not None else {}
    found |= {"annotation_src": texts.later(node.annotation)} if isinstance(node, ast.AnnAssign) else {}


@_tells(ast.Try, gives="handler_body")
def _handled(node: ast.AST, texts: Texts, found: Found) -> None:
    if node.handlers:
        found["handler_body"] = _kinds(node.handlers[0].body)


@_tells(ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, gives="decorator_calls")
def _decorator_calls(node: ast.AST, texts: Texts, found: Found) -> None:
    found["decorator_calls"] = lambda: ",".join(texts[d] for d in node.decorator_list if isinstance(d, ast.Call))


@_tells(ast.Try, gives="handler_types")
def _handler_types(node: ast.AST, texts: Texts, found: Found) -> None:
    found["handler_types"] = lambda: ",".join(texts[h.type] if h.type else "" for h in node.handlers)


@_tells(ast.ExceptHandler, gives="type_src|reraise")
def _handler(node: ast.AST, texts: Texts, found: Found) -> None:
    found["type_src"] = texts.later(node.type) if node.type else ""
    first = node.body[0]
    found["reraise"] = str(int(isinstance(first, ast.Raise) and (first.exc is None or (node.name is not None and dotted(first.exc) == node.name))))


@_tells(ast.ListComp, ast.SetComp, gives="same")
def _comprehended(node: ast.AST, texts: Texts, found: Found) -> None:
    g = node.generators[0]
    found["same"] = str(int(not g.ifs and dotted(node.elt) is not None and dotted(node.elt) == dotted(g.target)))


@_tells(ast.For, ast.AsyncFor, ast.comprehension, gives="target_src|iter_src")
def _looped(node: ast.AST, texts: Texts, found: Found) -> None:
    found |= {"target_src": texts.later(node.target), "iter_src": texts.later(node.iter)}


@_tells(ast.With, gives="items_src")
def _with(node: ast.AST, texts: Texts, found: Found) -> None:
    found["items_src"] = lambda: ",".join(texts[i.context_expr] for i in node.items)


@_tells(ast.Call, gives="join_literal|split_literal")
def _literal_method(node: ast.AST, texts: Texts, found: Found) -> None:
    if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Constant):
        found |= {f"{node.func.attr}_literal": "1"} if node.func.attr in ("join", "split") else {}


@_tells(ast.Call, gives="star_after_keyword|spread_literal")
def _spread(node: ast.AST, texts: Texts, found: Found) -> None:
    stars = [(x.lineno, x.col_offset) for x in node.args if isinstance(x, ast.Starred)]
    named = [(k.value.lineno, k.value.col_offset) for k in node.keywords if k.arg]
    found["star_after_keyword"] = str(int(bool(stars and named) and max(stars) > min(named)))
    found["spread_literal"] = str(int(any(k.arg is None and isinstance(k.value, ast.Dict) for k in node.keywords)))


@_tells(ast.Lambda, gives="empty_body|body_src")
def _lambda(node: ast.AST, texts: Texts, found: Found) -> None:
    found["empty_body"] = str(int(isinstance(node.body, (ast.List, ast.Dict)) and not getattr(node.body, "elts", getattr(node.body, "keys", None))))
    found["body_src"] = texts.later(node.body)


@_tells(ast.If, gives="else_nested")
def _else_nested(node: ast.AST, texts: Texts, found: Found) -> None:
    if len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If):
        found["else_nested"] = str(int(node.orelse[0].col_offset > node.col_offset))


@_tells(ast.For, gives="yields_target")
def _yields(node: ast.AST, texts: Texts, found: Found) -> None:
    if len(node.body) == 1 and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Yield):
        given = node.body[0].value.value
        found["yields_target"] = str(int(given is not None and dotted(given) is not None and dotted(given) == dotted(node.target)))


@_tells(ast.Subscript, gives="value_len")
def _literal_length(node: ast.AST, texts: Texts, found: Found) -> None:
    if isinstance(node.value, (ast.List, ast.Tuple)):
        found["value_len"] = str(len(node.value.elts))


@_tells(ast.JoinedStr, gives="placeholders")
def _placeholders(node: ast.AST, texts: Texts, found: Found) -> None:
    found["placeholders"] = str(sum(isinstance(v, ast.FormattedValue) for v in node.values))


@_tells(ast.JoinedStr, ast.BinOp, gives="constants")
def _constants(node: ast.AST, texts: Texts, found: Found) -> None:
    parts = node.values if isinstance(node, ast.JoinedStr) else [node.left, node.right]
    found["constants"] = "\n".join(repr(x.value) for x in parts if isinstance(x, ast.Constant) and isinstance(x.value, str))


#: Attributes that ``_attrs`` adds by itself.
OWN = frozenset({"body_only", "orelse_only", "call_name", "msg_call", "bad_annotation"})


class Asked(dict):
    """For each class of nodes (its fields, tellers, whether ``OWN``) that the attributes asked for are made from, all without ``attrs``; None where nothing is."""

    def __init__(self, attrs: frozenset[str] | None):
        self.attrs = attrs

    def __missing__(self, cls: type[ast.AST]) -> tuple | None:
        attrs = self.attrs
        fields = tuple(f for f in cls._fields if attrs is None or attrs & {f, f"n_{f}", f"{f}_name", f"{f}_value"})
        tellers = tuple(tell for classes, tell, gives in TELLERS if issubclass(cls, classes) and (attrs is None or any(map(gives.fullmatch, attrs))))
        own = attrs is None or bool(attrs & OWN)
        self[cls] = made = (fields, tellers, own) if fields or tellers or own else None
        return made


#: By the attributes asked for, kept from file to file.
ASKED: dict[frozenset[str] | None, Asked] = {}


def _attrs(node: ast.AST, texts: Texts, asked: Asked) -> Found:
    """What rules ask of a node beside its place: shapes and sources of children, flags as 1; always whole, texts as functions that write them."""
    made = asked[type(node)]
    if made is None:
        return {}
    if isinstance(node, ast.Name):
        return {"ctx": type(node.ctx).__name__}
    fields, tellers, own = made
    found: Found = {}
    for field in fields:
        value = getattr(node, field, None)
        if isinstance(value, list) and value and isinstance(value[0], ast.AST):
            found[field] = _kinds(value)
            found[f"n_{field}"] = str(len(value))
        elif isinstance(value, ast.AST):
            found[field] = type(value).__name__
            if (name := dotted(value)) is not None:
                found[f"{field}_name"] = name
            elif isinstance(value, ast.Constant):
                found[f"{field}_value"] = constant(value.value)
        elif isinstance(value, (int, str)) and field not in ("id", "name", "lineno"):
            found[field] = str(value)
    if isinstance(node, PLAIN):
        return found
    for tell in tellers:
        tell(node, texts, found)
    if not own:
        return found
    for part in ("body", "orelse"):
        block = getattr(node, part, None)
        if isinstance(block, list) and len(block) == 1 and isinstance(block[0], SIMPLE):
            found[f"{part}_only"] = texts.later(block[0])
    for field in ("value", "msg"):
        if isinstance(getattr(node, field, None), ast.Call):
            found["call_name" if field == "value" else "msg_call"] = dotted(getattr(node, field).func) or ""
    annotation = (getattr(node, "annotation", None) or getattr(node, "returns", None)) if asked.attrs is None or "bad_annotation" in asked.attrs else None
    if isinstance(annotation, ast.Constant) and isinstance(annotation.value, str):
        try:
            ast.parse(annotation.value.strip(), mode="eval")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            found["bad_annotation"] = "1"
    return found


def _link(left: ast.AST, op: ast.AST, right: ast.AST, texts: Texts) -> Found:
    """One comparison of a chain."""
    return {
        "op": type(op).__name__, "left": type(left).__name__, "right": type(right).__name__, "left_src": texts.later(left), "right_src": texts.later(right),
    }


def _step(node: ast.AST, place: int) -> str:
    """The kind of a statement, with a name of its own for docstrings and for assignments to special names."""
    if isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str) and place == 0:
        return "Doc"
    if isinstance(node, ast.Assign) and (dotted(node.targets[0]) or "").startswith("__"):
        return "Dunder"
    return type(node).__name__


class Place:
    """Where nodes of one field stand: what the nodes around tell them."""

    def __init__(self):
        self.parent = self.parent_kind = self.parent_test = self.scope = self.func = self.handler = self.in_function = self.in_class = self.func_end = None
        self.in_handler, self.in_loop, self.in_async = False, False, False
        self.around: tuple[int, ...] = ()
        self.params, self.bases, self.decorators, self.parent_name = None, None, None, None
        self.outer: tuple | None = None

    def inside(self) -> Place:
        new = Place.__new__(Place)
        new.__dict__ = self.__dict__.copy()
        return new


def _imported(tree: ast.AST) -> dict[str, str]:
    """What the file's imports bind each name to; of several the greatest."""
    found: dict[str, str] = {}
    # Imports are statements, and these stand in blocks only.
    blocks = [tree.body]
    for block in blocks:
        for node in block:
            if isinstance(node, ast.Import):
                pairs = [(x.asname or x.name.split(".")[0], x.name if x.asname else x.name.split(".")[0]) for x in node.names]
            elif isinstance(node, ast.ImportFrom) and not node.level:
                pairs = [(x.asname or x.name, f"{node.module or ''}.{x.name}") for x in node.names]
            else:
                blocks += [below for field in BLOCKS if isinstance(below := getattr(node, field, None), list) and below]
                continue
            for bound, target in pairs:
                found[bound] = max(found.get(bound, ""), target)
    return found


#: Fields that hold statements, or what holds such.
BLOCKS = ("body", "orelse", "finalbody", "handlers", "cases")
#: Fields that hold no nodes with rows of their own.
BARE = frozenset("ctx op ops id attr arg module level kind type_comment conversion simple is_async".split())


#: Fields in which a node may be missing between others, and fields that belong to the scope around a function.
SPARSE = ("keys", "kw_defaults")
DEFAULTS = ("defaults", "kw_defaults", "annotation")
#: Columns that number nodes; without them nodes that nothing is asked of need no number.
NUMBERED = frozenset({"node", "parent", "scope", "func", "around"})


class Shape:
    """What the class of a node alone tells."""

    def __init__(self, cls: type[ast.AST]):
        self.kind = cls.__name__
        self.function = issubclass(cls, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda))
        self.scope = issubclass(cls, (*SCOPES, ast.Module))
        self.leaf = issubclass(cls, LEAVES)
        self.tested = issubclass(cls, TOLD) and not self.function and cls is not ast.ClassDef
        self.named_below = self.function or issubclass(cls, (ast.ClassDef, ast.ExceptHandler))
        self.loop, self.argument = issubclass(cls, (ast.For, ast.AsyncFor, ast.While)), issubclass(cls, (ast.arguments, ast.arg))
        self.fields = tuple(f for f in cls._fields if f not in BARE)
        self.names = tuple(f for f in ("name", "id", "attr", "arg", "module") if f in cls._fields)
        self.outside = ("decorator_list", "bases", "keywords", "returns", "type_params") if issubclass(cls, SCOPES[:4]) else ()


class Shapes(dict):
    def __missing__(self, cls: type[ast.AST]) -> Shape:
        self[cls] = shape = Shape(cls)
        return shape


SHAPES = Shapes()


def node_rows(path: str, text: str, kinds: frozenset[str] | None = None, attrs: frozenset[str] | None = None, columns: frozenset[str] | None = None) -> Iterator[tuple]:
    """A row per node, parents first; ``scope`` is the scope a name belongs to, ``func`` the nearest function. With ``kinds`` only rows of these, with ``attrs`` only these
    attributes; without one of ``columns``, what it costs to fill it is saved.

    A chained comparison has a row of kind ``Compare`` for each link: its own for the first, further ones with field ``link``.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        place = (None, None, None, None, False, None, False, False, None, None, False, None, 0, "", None, None, None, None, None)
        yield (path, 0, None, None, None, None, "SyntaxError", getattr(error, "lineno", None), getattr(error, "offset", None), None, None, None, str(error), {}, *place)
        return
    texts, imported = Texts(text), None
    if (told_of := ASKED.get(attrs)) is None:
        told_of = ASKED[attrs] = Asked(attrs)
    full_asked, test_asked, params_asked, before_asked, parent_named = (columns is None or c in columns for c in ("full", "parent_test", "params_around", "before", "parent_name"))
    class_asked = columns is None or not columns.isdisjoint(("class_bases", "class_decorators"))
    # The leaves that have to be walked: all, where nodes are numbered.
    leaves = None if kinds is None or columns is None or not columns.isdisjoint(NUMBERED) else kinds
    # A node, the place of its field, and its own place in there.
    stack: list[tuple] = [(tree, Place(), None, 1, 0, "", None, False)]
    number = 0
    while stack:
        node, at, field, siblings, position, before, prev_kind, last = stack.pop()
        own, number = number, number + 1
        shape = SHAPES[type(node)]
        kind, function = shape.kind, shape.function
        asked = kinds is None or kind in kinds
        name = _name(node, shape.names) if asked or shape.named_below else None
        where = (getattr(node, "lineno", None), getattr(node, "col_offset", None), getattr(node, "end_lineno", None), getattr(node, "end_col_offset", None)) if asked or function else ()
        around = (own, *at.around) if shape.scope else None
        if asked:
            value = constant(node.value) if kind == "Constant" else None
            full = name
            if full_asked and kind == "Call" and name is not None:
                imported = _imported(tree) if imported is None else imported
                head, _, rest = name.partition(".")
                full = imported[head] + ("." + rest if rest else "") if head in imported else name
            test = at.parent_test() if callable(at.parent_test) else at.parent_test
            place = (
                full, at.parent_kind, test, siblings, at.in_handler, at.handler, at.in_loop, at.in_async, at.in_function, at.in_class, last and where[2] == at.func_end,
                ",".join(map(str, around)) if around else None, position, before, prev_kind, at.params, at.bases, at.decorators, at.parent_name,
            )
            yield (path, own, at.parent, at.scope, at.func, field, kind, *where, name, value, _told(_attrs(node, texts, told_of), attrs), *place)
        if kind == "Compare":
            for k in range(1, len(node.ops)):
                if asked:
                    link = {"n_ops": "1", **_link(node.comparators[k - 1], node.ops[k], node.comparators[k], texts)}
                    yield (path, number, own, at.scope, at.func, "link", kind, *where, None, None, _told(link, attrs), *place)
                number += 1
        if shape.leaf:
            continue
        # What the rows below tell of this one.
        inner = at.inside()
        inner.parent, inner.parent_kind = own, kind
        inner.parent_test = _below(node, texts)["src"] if test_asked and shape.tested else None
        if parent_named:
            inner.parent_name = name if asked else _name(node, shape.names)
        if around is not None:
            # A class's names are not seen from inside its functions.
            inner.scope, inner.around = own, at.around if kind == "ClassDef" else around
        if function:
            inner.func, inner.in_loop, inner.in_async = own, False, kind == "AsyncFunctionDef"
            if name is not None:
                inner.in_function, inner.func_end, inner.in_handler, inner.handler = name, where[2], False, None
            if params_asked:
                inner.params = _below(node, texts)["params"]
        elif kind == "ClassDef":
            inner.in_class, inner.in_loop = name, False
            if class_asked:
                told = _below(node, texts)
                inner.bases, inner.decorators = told["base_names"], told["decorators"]
        elif kind == "ExceptHandler":
            inner.in_handler, inner.handler = True, name
        children = []
        for part in shape.fields:
            child = getattr(node, part, None)
            if not child or isinstance(child, str):
                continue
            below = inner
            # Decorators, defaults, bases and annotations belong to the scope around.
            if part in shape.outside:
                below = inner.inside()
                below.scope, below.func, below.around = at.scope, at.func, at.around
            elif shape.argument and part in DEFAULTS:
                below = inner.inside()
                below.scope, below.func, below.around = at.outer
            elif function and part == "args":
                below = inner.inside()
                below.outer = (at.scope, at.func, at.around)
            elif shape.loop and part == "body":
                below = inner.inside()
                below.in_loop = True
            ends = function and part == "body"
            if not isinstance(child, list):
                if isinstance(child, ast.AST) and (leaves is None or (of := SHAPES[type(child)]).kind in leaves or not of.leaf):
                    children.append((child, below, part, 1, 0, "", None, ends))
                continue
            count = sum(isinstance(x, ast.AST) for x in child) if part in SPARSE else len(child)
            seen: set[str] = set()
            told, last_kind = "", None
            for k, x in enumerate(child):
                if isinstance(x, ast.AST):
                    of = SHAPES[type(x)]
                    if leaves is None or of.kind in leaves or not of.leaf:
                        children.append((x, below, part, count, k, told, last_kind, ends))
                    last_kind = of.kind
                    if before_asked and len(child) > 1 and (what := _step(x, k)) not in seen:
                        seen.add(what)
                        told = ",".join(sorted(seen))
        children.reverse()
        stack += children


def token_rows(path: str, text: str) -> Iterator[tuple]:
    """A row per token with its neighbours and the depth of brackets (and of replacement fields in f-strings) it stands in."""
    found, broken = [], None
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            found.append((tokenize.tok_name[t.exact_type], t))
    except (tokenize.TokenError, SyntaxError, IndentationError) as error:
        broken = str(error)
    depth = 0
    for seq, (kind, t) in enumerate(found):
        depth -= kind in ("RPAR", "RSQB", "RBRACE")
        before = found[seq - 1] if seq else (None, None)
        after = found[seq + 1] if seq + 1 < len(found) else (None, None)
        p = (before[0], before[1].string, *before[1].end) if before[1] else (None, None, None, None)
        n = (after[0], after[1].string, *after[1].start, after[1].end[0]) if after[1] else (None, None, None, None, None)
        yield (path, seq, kind, t.string, *t.start, *t.end, depth, *p, *n)
        depth += kind in ("LPAR", "LSQB", "LBRACE")
    if broken is not None:
        yield (path, -1, "ERRORTOKEN", broken, *[None] * 14)


def _mapped(files: DataFrame, rows, schema: str, only: Iterable[str] | None = None) -> DataFrame:
    """The rows of every file; of their columns ``only`` some."""
    ship(files.sparkSession)
    parts = schema.split(", ")
    taken = [i for i, part in enumerate(parts) if only is None or part.split()[0] in only]
    schema = ", ".join(parts[i] for i in taken)
    names = [parts[i].split()[0] for i in taken]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for row in rows(path, text or ""):
                    held.append(row)
                    if len(held) >= 20_000:
                        yield packed(held)
                        held = []
            if held:
                yield packed(held)

    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "map": pa.map_(pa.string(), pa.string())}
    types = dict(part.split() for part in schema.replace("map<string,string>", "map").split(", "))

    def packed(held: list[tuple]) -> pa.RecordBatch:
        every = list(zip(*held, strict=True))
        columns = [every[i] for i in taken]
        arrays = [pa.array([list(x.items()) for x in c] if n == "attrs" else c, kinds[types[n]]) for n, c in zip(names, columns, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    return spread(files.select("path", "text")).mapInArrow(run, schema)


#: The kinds of nodes that scopes, bindings and references are read from.
NAMED = frozenset({x.__name__ for x in SCOPES} | set("Module Name arg ExceptHandler MatchAs MatchStar MatchMapping TypeVar ParamSpec TypeVarTuple Import ImportFrom".split()))


def nodes(files: DataFrame, kinds: Iterable[str] | None = None, attrs: Iterable[str] | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """Syntax nodes of files (path, text); with ``kinds``, ``attrs`` and ``columns`` only these, so that no others are made where a question asks for a few. Files that do not parse always have their row."""
    asked = {k: frozenset(v) for k, v in (("kinds", kinds), ("attrs", attrs), ("columns", columns)) if v is not None}
    return _mapped(files, partial(node_rows, **asked), NODE, asked.get("columns"))


def tokens(files: DataFrame) -> DataFrame:
    """Tokens of files (path, text)."""
    return _mapped(files, token_rows, TOKEN)


def imports(of: DataFrame) -> DataFrame:
    """(path, node, scope, row, module, name, asname, level, bound): one row per imported name."""
    found = of.filter("kind in ('Import', 'ImportFrom')")
    each = found.withColumn("alias", F.explode(F.split(F.col("attrs")["names"], ",")))
    name = F.split("alias", " ")[0]
    asname = F.when(F.size(F.split("alias", " ")) > 1, F.split("alias", " ")[1])
    plain = F.col("kind") == "Import"
    return each.select(
        "path", "node", "scope", "func", "row", F.when(plain, name).otherwise(F.coalesce("name", F.lit(""))).alias("module"), F.when(~plain, name).alias("name"), asname.alias("asname"),
        F.coalesce(F.col("attrs")["level"].cast("int"), F.lit(0)).alias("level"), F.coalesce(asname, F.when(plain, F.split(name, "[.]")[0]).otherwise(name)).alias("bound"),
    )


def qualified(of: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """``of`` with ``full``: a dotted name with its head replaced by what the file's imports bind it to."""
    head = F.split(column, "[.]")[0]
    target = F.when(F.col("name").isNotNull(), F.concat_ws(".", "module", "name")).when(F.col("asname").isNotNull(), F.col("module")).otherwise(F.col("bound"))
    known = found.filter("level = 0").groupBy("path", F.col("bound").alias("_head")).agg(F.max(target).alias("_target"))
    joined = of.withColumn("_head", head).join(known, ["path", "_head"], "left")
    rest = F.expr(f"substring({column}, length(_head) + 1)")
    return joined.withColumn("full", F.when(F.col("_target").isNotNull(), F.concat("_target", rest)).otherwise(F.col(column))).drop("_head", "_target")


def bindings(of: DataFrame) -> DataFrame:
    """(path, scope, name, kind, row, node): where names are bound. A walrus in a comprehension binds in the function around, type parameters where their function or class stands."""
    stored = of.filter("kind = 'Name' and attrs['ctx'] in ('Store', 'Del')").select("path", "scope", "name", F.lit("assignment").alias("kind"), "row", "node")
    walrus = of.filter("kind = 'Name' and attrs['ctx'] = 'Store' and parent_kind = 'NamedExpr'").select("path", F.coalesce("func", F.lit(0)).alias("scope"), "name", F.lit("assignment").alias("kind"), "row", "node")
    defined = of.filter("kind in ('FunctionDef', 'AsyncFunctionDef', 'ClassDef')").select("path", "scope", "name", F.col("kind"), "row", "node")
    params = of.filter("kind = 'arg'").select("path", "scope", "name", F.lit("argument").alias("kind"), "row", "node")
    handlers = of.filter("kind = 'ExceptHandler' and name is not null").select("path", "scope", "name", F.lit("exception").alias("kind"), "row", "node")
    captured = of.filter("kind in ('MatchAs', 'MatchStar') and name is not null").select("path", "scope", "name", F.lit("capture").alias("kind"), "row", "node")
    rest = of.filter("kind = 'MatchMapping' and attrs['rest'] is not null").select("path", "scope", F.col("attrs")["rest"].alias("name"), F.lit("capture").alias("kind"), "row", "node")
    generic = of.filter("kind in ('TypeVar', 'ParamSpec', 'TypeVarTuple')").select("path", "scope", "name", F.lit("type parameter").alias("kind"), "row", "node")
    imported = imports(of).filter("coalesce(name, '') <> '*'").select("path", "scope", F.col("bound").alias("name"), F.lit("import").alias("kind"), "row", "node")
    every = [walrus, defined, params, handlers, captured, rest, generic, imported]
    return reduce(DataFrame.unionByName, every, stored)


def references(of: DataFrame) -> DataFrame:
    """(path, scope, name, row, col): names that are read."""
    return of.filter("kind = 'Name' and attrs['ctx'] = 'Load'").select("path", "scope", "name", "row", "col")

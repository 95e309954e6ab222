"""Globs, exports, data flow, tree patterns, import codemods and the change stream against plain versions, on input not planted for them."""

import ast
import datetime
import importlib
import random
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.functions.names import fnv64
from quarry.operators import bundles, codemods, dataflow, exports, globs, namefilter, prefixes, treepatterns
from quarry.sources import files as file_sources
from quarry.streaming import changes, refine

STDLIB = sorted(Path(ast.__file__).parent.glob("*.py"))


def plain_glob(glob, path):
    """Whether a glob holds for a path, character by character; without braces."""
    if glob == "":
        return path == ""
    if glob.startswith("**/"):
        return plain_glob(glob[3:], path) or any(plain_glob(glob[3:], path[i + 1 :]) for i, c in enumerate(path) if c == "/")
    if glob.startswith("*"):
        return plain_glob(glob[1:], path) or path[:1] not in ("", "/") and plain_glob(glob, path[1:])
    if glob[0] == "?":
        return path[:1] not in ("", "/") and plain_glob(glob[1:], path[1:])
    if glob[0] == "[":
        inside, rest = glob[1:].split("]", 1)
        negated = inside[0] == "!"
        return path != "" and path[0] != "/" and (path[0] in inside[negated:]) != negated and plain_glob(rest, path[1:])
    return path[:1] == glob[0] and plain_glob(glob[1:], path[1:])


def globs_and_paths(n):
    r = random.Random(n)
    names = ["a", "ab", "test_a.py", "b.py", "a.b.py", "c", "É#1.txt"]
    paths = list({"/".join(r.choice(names) for _ in range(r.randint(1, 4))) for _ in range(n)})
    pieces = [*names, "*", "?", "*.py", "test_*", "*_a.*", "[ab]", "[!a]*", "a?", "**", "É*.txt", "*.{py,txt}"]
    patterns = ["/".join(r.choice(pieces) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return paths, [p for p in patterns if not p.endswith("**") and "**/**" not in p]


def test_globs_match_as_a_plain_matcher(spark):
    paths, patterns = globs_and_paths(150)
    want = sorted((p, i) for i, g in enumerate(patterns) for p in paths if any(plain_glob(a if "/" in a else "**/" + a, p) for a in globs.alternatives(g)))
    of = spark.createDataFrame(list(enumerate(patterns)), "i int, glob string")
    given = spark.createDataFrame([(p,) for p in [*paths, *paths[:5], None]], "path string")
    found = globs.matches(given, of)
    assert sorted((r.path, r.i) for r in found.collect()) == want
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    last = {p: max(i for q, i in want if q == p) for p, _ in want}
    assert {r.path: r.i for r in globs.last_match(given, of, "i", []).collect()} == last
    assert globs.matches(given.limit(0), of).count() == globs.matches(given, of.limit(0)).count() == 0


def test_not_ignored_takes_negated_globs(spark):
    found = spark.createDataFrame([(p, c) for p in ("a/x.py", "b/x.py", "b/y.pyi") for c in ("E1", "E2", "E3")], "path string, code string")
    off = spark.createDataFrame([("*.py", "E1"), ("!b/*", "E2"), ("{a,b}/x.py", "E9"), (None, "E3")], "glob string, code string")
    assert sorted(map(tuple, globs.not_ignored(found, off).collect())) == [("a/x.py", "E3"), ("b/x.py", "E2"), ("b/x.py", "E3"), ("b/y.pyi", "E1"), ("b/y.pyi", "E2"), ("b/y.pyi", "E3")]


def package(r, n):
    """Modules that import from earlier ones, so that Python itself can say what they export."""
    for i in range(n):
        lines = [f"f{i} = {i}", f"_p{i} = 1"]
        for j in r.sample(range(i), min(i, r.randint(0, 2))):
            lines.append(r.choice([f"from .m{j} import *", f"from . import m{j}", f"from .m{j} import f{j} as g{j}_{i}", f"if True:\n    from .m{j} import *"]))
        if i and r.random() < 0.5:
            j = r.randrange(i)
            lines += [f"from .m{j} import *", f"from . import m{j} as base", "try:\n    theirs = base.__all__\nexcept AttributeError:\n    pass"]
            lines.append(r.choice([f"__all__ = ['f{i}']", f"__all__ = ['f{i}']\n__all__ += ['_p{i}']", f"__all__ = ['f{i}'] + ['base']\n__all__.remove('base')\n__all__.append('_p{i}')"]))
        yield f"m{i}", "\n".join(lines) + "\n"


def test_star_exports_are_python_s_own(spark, tmp_path):
    name = "quarry_star_case"
    (tmp_path / name).mkdir()
    (tmp_path / name / "__init__.py").write_text("")
    modules = dict(package(random.Random(6), 25))
    for module, text in modules.items():
        (tmp_path / name / f"{module}.py").write_text(text)
    sys.path.insert(0, str(tmp_path))
    try:
        want = set()
        for module in modules:
            space: dict = {}
            exec(f"from {name}.{module} import *", space)
            want |= {(f"{name}.{module}", x) for x in space if x != "__builtins__"}
            importlib.import_module(f"{name}.{module}")
    finally:
        sys.path.remove(str(tmp_path))
    files = spark.createDataFrame([(f"{name}/__init__.py", "")] + [(f"{name}/{m}.py", t) for m, t in modules.items()], "path string, text string")
    of = exports.facts(files).cache()
    assert {(r.module, r.name) for r in exports.names(of).where("exported").collect()} == want


def test_star_imports_in_a_cycle_submodules_and_lists_of_others(spark):
    texts = {
        "p/__init__.py": "__all__ = ['sub', 'x']\nfrom .a import *\n", "p/sub.py": "y = 1\n", "p/a.py": "from .b import *\nx = 1\n_h = 2\n", "p/b.py": "from .a import *\nfrom p import c\n__all__ = ('z', 'x')\n__all__.extend(c.__all__)\nz = 3\n",
        "p/c.py": "__all__ = ['w']\n__all__ += ['v']\n__all__.remove('w')\nv = w = 1\n", "q.py": "from p import *\nfrom .nowhere import *\nprint(sub, x, gone)\n", "r.py": "from p import *\nprint(sub, x, gone)\n", "bad.py": "def (:\n", "none.py": None,
    }
    of = exports.facts(spark.createDataFrame(list(texts.items()), "path string, text string")).cache()
    got = {(r.module, r.name, r.origin) for r in exports.names(of).where("exported").collect()}
    assert {g for g in got if g[0] == "p"} == {("p", "sub", "p.sub"), ("p", "x", "p.a")}
    assert {g for g in got if g[0] == "p.a"} == {("p.a", "x", "p.a"), ("p.a", "z", "p.b")}
    assert {g for g in got if g[0] == "p.b"} == {("p.b", "x", "p.a"), ("p.b", "z", "p.b")}
    assert {g for g in got if g[0] == "p.c"} == {("p.c", "v", "p.c")}
    reads = exports.resolved_reads(of, exports.names(of), ["print"]).collect()
    assert {(r.path, r.name, r.origin) for r in reads} == {("q.py", "sub", "p.sub"), ("q.py", "x", "p.a"), ("r.py", "sub", "p.sub"), ("r.py", "x", "p.a"), ("r.py", "gone", None)}
    assert exports.names(of.limit(0)).count() == 0


def plain_flow(edges, names):
    """Reaching definitions by walking from each definition, dominators by leaving statements out."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(starts, without=None):
        seen, stack = set(), [s for s in starts if s != without]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += [y for y in after.get(x, ()) if y != without]
        return seen

    everything = reach([0])
    local = {n for k, _, n in names if k in ("def", "del")}
    sets = {(s, n) for k, s, n in names if k in ("def", "del")}
    chains = set()
    for n in local:
        sources = [(s, s) for k, s, m in names if k == "def" and m == n] + [(None, s) for k, s, m in names if k == "del" and m == n and ("def", s, n) not in names]
        starts = [(d, y) for d, s in sources if s in everything for y in after.get(s, ())] + ([(None, 0)] if (0, n) not in sets else [])
        for d, start in starts:
            seen, stack = set(), [start]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    if (x, n) not in sets:
                        stack += after.get(x, ())
            chains |= {(s, n, d) for k, s, m in names if k == "use" and m == n and s in seen}
    if ("use", 0, "x") in names and (0, "x") in sets:
        chains.add((0, "x", None))
    above = {s: {d for d in everything if d != s and s not in reach([0], d)} for s in everything - {0}}
    return chains, {s: max(ds, key=lambda d: len(above.get(d, ()))) for s, ds in above.items()}


def test_reaching_definitions_and_dominators_on_random_graphs():
    r = random.Random(8)
    for _ in range(300):
        n = r.randint(2, 9)
        edges = sorted({(r.randrange(n), r.randint(1, n - 1)) for _ in range(2 * n)})
        names = sorted({(r.choice(["def", "use", "del", "use"]), r.randint(1, n - 1), r.choice("xyz")) for _ in range(n)} | {("def", 0, "x")})
        chains, dominators = dataflow.solve(edges, names)
        want = plain_flow(edges, names)
        assert set(chains) == want[0] and len(chains) == len(set(chains))
        assert dominators == want[1]


FLOWS = {
    "try:\n  x = 1\nexcept E:\n  y = 1\nelse:\n  z = 1\nfinally:\n  w = 1\n": {(1, 2), (2, 3), (1, 4), (2, 4), (4, 5), (3, 6), (5, 6), (1, 6), (2, 6), (6, -1)},
    "for i in a:\n  if i:\n    break\n  continue\nelse:\n  x = 1\nreturn x\n": {(1, 2), (2, 3), (3, 4), (3, 5), (4, 7), (5, 1), (1, 6), (6, 7), (7, -1)},
    "while True:\n  try:\n    return 1\n  finally:\n    f()\n": {(1, 2), (2, 3), (2, 4), (3, 4), (4, -1)},
    "match a:\n  case 1: x = 1\n  case {'k': v, **r} if v: x = 2\n  case _: x = 3\n": None,
}


def test_graphs_of_statements():
    for body, want in FLOWS.items():
        source = "def f(a):\n" + "".join(f"  {line}\n" for line in body.splitlines())
        graph = dataflow.Graph(ast.parse(source).body[0])
        kinds = [k for k, _ in graph.kinds]
        assert all(b == -1 or b < len(kinds) for _, b in graph.edges)
        if want and "target" not in kinds:
            assert {(a, b) for a, b in graph.edges if a} == want, body
    # A loop's target is a statement of its own, taken only when there is an item.
    graph = dataflow.Graph(ast.parse("def f(a):\n  for i in a:\n    g(i)\n  return i\n").body[0])
    chains, _ = dataflow.solve(sorted(graph.edges), sorted(set(graph.names)))
    assert (4, "i", None) in chains and (3, "i", None) not in chains


def test_flow_of_real_functions(spark):
    """Each function of the standard library has an entry that reaches its end or a loop, and parameters are bound at their uses unless rebound."""
    files = spark.createDataFrame([(p.name, p.read_text(encoding="utf-8", errors="replace")) for p in STDLIB[:60]], "path string, text string")
    of = dataflow.flow(files).cache()
    found = dataflow.solved(of).cache()
    assert found.where("kind = 'idom'").count() > 10_000
    certain = dataflow.unbound_uses(of, found).where("certain").collect()
    assert certain == [], certain[:5]


def plain_matches(node, step, imported):
    """Whether a step and all below it hold at a node."""
    if type(node).__name__ not in step["kinds"]:
        return False
    if step["names"] and not (isinstance(n := treepatterns._name(node), str) and re.fullmatch(step["names"], n)):
        return False
    if step["fulls"] and treepatterns._full(node, imported) not in step["fulls"]:
        return False
    if step["values"] and not (isinstance(node, ast.Constant) and repr(node.value) in step["values"]):
        return False
    for below in step["below"]:
        at = ((f, x) for f, c in ast.iter_fields(node) for x in (c if isinstance(c, list) else [c]) if isinstance(x, ast.AST))
        if below["axis"] == "inside":
            at = ((f, x) for parent in ast.walk(node) for f, c in ast.iter_fields(parent) for x in (c if isinstance(c, list) else [c]) if isinstance(x, ast.AST))
        held = any(below["field"] in (None, f) and plain_matches(x, below, imported) for f, x in at)
        if held == below["absent"]:
            return False
    return True


def test_tree_patterns_match_as_a_plain_walk(spark):
    s = treepatterns.step
    patterns = [
        *treepatterns.STATEMENTS, ("deep", s("FunctionDef", s("Try", s("Raise", inside=True), inside=True), s("Return", inside=True, absent=True))), ("twice", s("If", s("If", field="body"), s("If", field="orelse"))),
        ("none", s("Return", s("Constant", value="None"))), ("nested", s("For", s("For", s("Call", inside=True), inside=True))),
    ]
    texts = {p.name: p.read_text(encoding="utf-8", errors="replace") for p in STDLIB[:40]} | {"bad.py": "def (", "none.py": None, "long.py": "x = " + " + ".join(["1"] * 500) + "\n"}
    want = set()
    for path, text in texts.items():
        if path == "bad.py":
            continue
        root = ast.parse(text or "")
        imported = treepatterns._imported(root)
        want |= {(name, path, node.lineno) for node in ast.walk(root) for name, pattern in patterns if hasattr(node, "lineno") and plain_matches(node, pattern, imported)}
    nodes = treepatterns.tree(spark.createDataFrame(list(texts.items()), "path string, text string")).cache()
    got = treepatterns.matches(nodes, treepatterns.pattern_table(spark, patterns)).collect()
    assert {(r.pattern, r.path, r.row) for r in got} == want
    assert {"deep", "nested", "logger_name"} <= {w[0] for w in want}
    assert treepatterns.matches(nodes, treepatterns.pattern_table(spark, [])).count() == 0


def applied(text, names, keep=False):
    for start, end, content in reversed(codemods.edits_of(text, names, keep)):
        text = text[:start] + content + text[end:]
    return text


def bound_imports(text):
    found = [x for x in ast.walk(ast.parse(text)) if isinstance(x, (ast.Import, ast.ImportFrom))]
    return sorted(str((getattr(x, "module", None), a.name, a.asname)) for x in found for a in x.names), [a.asname or (a.name.split(".")[0] if isinstance(x, ast.Import) else a.name) for x in found for a in x.names]


def test_import_codemods_leave_the_rest_of_real_files_alone():
    r = random.Random(1)
    for path in STDLIB[:120]:
        text = path.read_text(encoding="utf-8", errors="replace")
        names = sorted(set(bound_imports(text)[1]) - {"*"})
        some = set(r.sample(names, len(names) // 2))
        done = applied(text, some)
        assert set(bound_imports(done)[1]) & some <= {"annotations"}
        dump = lambda t: [ast.dump(x) for x in ast.walk(ast.parse(t)) if isinstance(x, ast.expr)]
        assert dump(done) == dump(text)
        assert [x for x in re.findall(r"(?m)^[ \t]*#.*$", text) if x not in done] == []
        kept = applied(text, some, keep=True)
        assert set(bound_imports(kept)[1]) - {"*", "annotations"} == some


@pytest.mark.parametrize("text, want", [
    ("import os; import b\nx\n", "x\n"), ("if t: import os; import b\nx\n", "if t: pass\nx\n"), ("é = 'é'; import os, sys  # é\n", "é = 'é'; import sys  # é\n"), ("from x import (\n    a,\n    b\n)\n", "from x import (\n    a\n)\n"),
    ("from x import (\n    # why\n    b,\n)\n", "    # why\n"[4:]), ("def (\n", "def (\n"), ("", ""), ("import os", ""), ("from __future__ import b\n", "from __future__ import b\n"), ("x = 1\r\nimport os\r\ny = 2\r\n", "x = 1\r\ny = 2\r\n"),
])
def test_import_codemods(text, want):
    assert applied(text, {"os", "b"}) == want


def events(n):
    r = random.Random(11)
    start = datetime.datetime(2024, 1, 1)
    kinds = ["created_file", "created_folder", "changed", "deleted", "deleted", "rescan", None]
    at = 0
    for seq in range(n):
        at += r.choice([0, 1, 5, 40])
        yield r.choice(["a", "b", "c", None]), seq, start + datetime.timedelta(seconds=at), r.choice(kinds)


@pytest.mark.parametrize("cuts", [[], [3, 4, 50, 120]])
def test_the_stream_says_what_the_batch_says(spark, tmp_path, cuts):
    rows, schema = list(events(160)), "key string, seq long, at timestamp, kind string"
    want = sorted(map(tuple, refine.batch(spark.createDataFrame(rows, schema), 60).collect()), key=repr)
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # Each part is taken by a new start from the checkpoint of the last one.
        refine.run_once(changes.stream(spark, str(tmp_path / "in"), schema), 60, str(tmp_path / "out"), str(tmp_path / "state"), late="1 second" if i % 2 else "1 hour")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr) == want


def test_prefixes_count_and_hold_what_begins_with_them(spark):
    r = random.Random(12)
    texts = ["".join(r.choice(["a", "b", "é", "漢", "\U0010ffff", "~"]) for _ in range(r.randint(0, 6))) for _ in range(400)]
    some = ["", "zzz", *[t[: r.randint(0, 5)] for t in texts[:120]]]
    keys = spark.createDataFrame([(t, i) for i, t in enumerate([*texts, *texts[:50], None])], "key string, i int").repartition(5)
    asked = spark.createDataFrame([(p,) for p in [*some, None]], "prefix string")
    want = {p: [i for i, t in enumerate([*texts, *texts[:50]]) if t.startswith(p)] for p in some}
    assert {(r.prefix, r.n, r.n_keys) for r in prefixes.counts(keys, asked).collect()} == {(p, len(ids), len({t for t in texts if t.startswith(p)})) for p, ids in want.items()}
    assert sorted(map(tuple, prefixes.members(keys, asked).select("prefix", "i").collect())) == sorted((p, i) for p, ids in want.items() for i in ids)
    assert prefixes.counts(keys.limit(0), asked.limit(1)).first().n == 0 and prefixes.members(keys, asked.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_snapshot_is_the_sequential_digest(spark, parts):
    r = random.Random(13)
    rows = [("".join(r.choice("ab/é漢") for _ in range(r.randint(0, 40))) + str(i), r.choice(["", "text", "ß" * i])) for i in range(1200)]
    lines = sorted(f"{p}\t{fnv64(t.encode()):016x}\n".encode() for p, t in rows)
    files = spark.createDataFrame([*rows, (None, "x"), ("y", None)], "path string, text string").repartition(parts)
    assert file_sources.snapshot(files).first().digest == f"{fnv64(b''.join(lines)):016x}"
    assert file_sources.snapshot(files.limit(0)).first().digest == f"{fnv64(b''):016x}"


def test_name_filters_miss_nothing_and_skip_most(spark):
    texts = {p.name: p.read_text(encoding="utf-8", errors="replace") for p in STDLIB} | {"none.py": None, "word.py": "über = größe1"}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    stored = namefilter.filters(files).cache()
    names = ["asyncio", "subprocess", "größe1", "Fraction", "nowhere_to_be_found"]
    holds = {(p, n) for p, t in texts.items() for n in names if re.search(rf"(?<!\w){n}(?!\w)", t or "")}
    found = {(r.path, n) for r in namefilter.candidates(stored, names).collect() for n in r.names}
    assert holds <= found and len(found - holds) <= 0.02 * len(texts) * len(names)
    changed = files.withColumn("text", F.when(F.col("path") == "abc.py", "changed = 1").otherwise(F.col("text")))
    kept = {r.path for r in namefilter.files_to_parse(changed, stored, ["größe1"]).collect()}
    assert {"word.py", "abc.py"} <= kept and len(kept) < 0.1 * len(texts)


def test_addresses_of_any_rank(spark):
    def plain(rank):
        return plain((rank - 1) // 255) + [(rank - 1) % 255 + 1] if rank else []

    ranks = [1, 254, 255, 256, 510, 511, 65280, 65281, 65282, 16_646_655, 16_646_656, 2**62]
    got = spark.createDataFrame([(r,) for r in [*ranks, None]], "r long").select("r", bundles.digits(F.col("r")).alias("a")).collect()
    assert {r.r: r.a for r in got} == {r: ".".join(map(str, plain(r))) for r in ranks} | {None: None}

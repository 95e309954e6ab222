"""Globs, exports, data flow, tree patterns, codemods and stores over rows and sources derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import codemods, dataflow, exports, globs, namefilter, prefixes, rel, treepatterns
from quarry.plans.base import query, table
from quarry.sources import files as file_sources

#: Customers as files; a pattern per part, of six shapes, in the part's order; SQL compares the parts of the paths instead.
GLOB_SQL = """p AS (SELECT r_name AS r, n_name AS n, c_mktsegment AS s, c_name AS c, CASE c_custkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.pyi' ELSE '.txt' END AS ext,
r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name || ext AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT path, p_partkey FROM p, part WHERE CASE p_partkey % 6
WHEN 0 THEN ext = '.py' AND ends_with(c, lpad((p_partkey % 100)::VARCHAR, 2, '0'))
WHEN 1 THEN ext = '.pyi' AND ends_with(c, lpad((p_partkey % 1000)::VARCHAR, 3, '0'))
WHEN 2 THEN n = 'NATION_' || (p_partkey % 25)
WHEN 3 THEN n = 'NATION_' || (p_partkey % 25) AND ext <> '.pyi' AND right(c, 1) NOT IN ('1', '2', '3', '4', (p_partkey % 10)::VARCHAR)
WHEN 4 THEN r = 'ASIA' AND ext = '.txt' AND substr(c, length(c) - 1, 1) = (p_partkey % 10)::VARCHAR
ELSE s = 'BUILDING' AND c = 'Customer#' || lpad((p_partkey % 1500)::VARCHAR, 9, '0') END)"""


def _paths(spark, sf):
    named = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ending = F.element_at(F.array(F.lit(".py"), F.lit(".pyi"), F.lit(".txt")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return named.select("c_custkey", F.concat(F.concat_ws("/", "r_name", "n_name", "c_mktsegment", "c_name"), ending).alias("path"))


def _globs(spark, sf):
    k = F.col("p_partkey")
    digits = lambda of, n: F.lpad((k % of).cast("string"), n, "0")
    text = lambda of: (k % of).cast("string")
    shapes = [
        F.concat(F.lit("*"), digits(100, 2), F.lit(".py")),
        F.concat(F.lit("**/Customer#*"), digits(1000, 3), F.lit(".pyi")),
        F.concat(F.lit("*/NATION_"), text(25), F.lit("/**")),
        F.concat(F.lit("*/NATION_"), text(25), F.lit("/*/*[!1-4"), text(10), F.lit("].{txt,py}")),
        F.concat(F.lit("ASIA/**/*"), text(10), F.lit("?.txt")),
        F.concat(F.lit("*/*/BUILDING/Customer#"), digits(1500, 9), F.lit(".*")),
    ]
    return table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*shapes), (k % 6 + 1).cast("int")).alias("glob"))


@query(f"WITH {GLOB_SQL} SELECT path, max(p_partkey) AS p_partkey FROM m GROUP BY path")
def glob_overrides(spark, sf):
    """For each customer's file the last of all parts' patterns that holds."""
    return globs.last_match(_paths(spark, sf), _globs(spark, sf), "p_partkey", []).select("path", "p_partkey")


@query(f"WITH {GLOB_SQL} SELECT p_partkey, count(*) AS n FROM m GROUP BY p_partkey")
def glob_matches(spark, sf):
    """How many files each pattern holds for."""
    return globs.counts(_paths(spark, sf), _globs(spark, sf)).groupBy("p_partkey").agg(F.sum("n").alias("n"))


@query(f"""WITH {GLOB_SQL}, f AS (SELECT path, code FROM p, range(7) v(code)), i AS (SELECT path, p_partkey % 7 AS code FROM m WHERE p_partkey % 50 = 0)
SELECT path, code::INT AS code FROM f ANTI JOIN i USING (path, code) WHERE code <> 6 OR path IN (SELECT path FROM m WHERE p_partkey = 20)""")
def ignored_by_glob(spark, sf):
    """Findings of seven codes in every customer's file, without those that a fiftieth of the patterns switches off, and one pattern everywhere but where it holds."""
    k = F.col("p_partkey")
    off = _globs(spark, sf).where("p_partkey % 50 = 0 or p_partkey = 20").select(F.concat(F.when(k == 20, "!").otherwise(""), "glob").alias("glob"), (k % 7).cast("int").alias("code"))
    found = _paths(spark, sf).select("path", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("code"))
    return globs.not_ignored(found, off)


#: A module per part that takes all names from the module of half its number; modules 1 and 2 take from each other, some list what they export.
HALF = "CASE WHEN k = 1 THEN 2 ELSE k // 2 END"
EXPORTS = f"""RECURSIVE m AS (SELECT p_partkey AS k, {HALF.replace("k", "p_partkey")} AS h, CASE WHEN p_partkey % 5 = 0 THEN 'own' WHEN p_partkey % 7 = 3 THEN 'more' END AS listing FROM part WHERE p_partkey > 0),
l AS (SELECT k, 'f' || k AS name FROM m WHERE listing IS NOT NULL UNION SELECT k, 'f' || h FROM m WHERE listing = 'own' UNION SELECT m.k, l.name FROM l JOIN m ON m.h = l.k WHERE m.listing = 'more'),
b AS (SELECT k, 'f' || k AS name, k AS origin FROM m UNION SELECT k, '_g' || k, k FROM m UNION
SELECT m.k, b.name, b.origin FROM b JOIN m ON m.h = b.k JOIN m AS s ON s.k = b.k LEFT JOIN l ON l.k = b.k AND l.name = b.name WHERE b.name <> 'f' || m.k AND CASE WHEN s.listing IS NULL THEN b.name NOT LIKE '@_%' ESCAPE '@' ELSE l.name IS NOT NULL END),
e AS (SELECT b.* FROM b JOIN m USING (k) LEFT JOIN l USING (k, name) WHERE CASE WHEN listing IS NULL THEN b.name NOT LIKE '@_%' ESCAPE '@' ELSE l.name IS NOT NULL END)"""


def _modules(spark, sf):
    k, half = F.col("p_partkey"), F.when(F.col("p_partkey") == 1, 2).otherwise(F.floor(F.col("p_partkey") / 2)).cast("string")
    own = k.cast("string")
    listing = F.when(k % 5 == 0, F.concat(F.lit("__all__ = ['f"), own, F.lit("', 'f"), half, F.lit("']\n"))).when(
        k % 7 == 3, F.concat(F.lit("from pkg import m"), half, F.lit(" as base\n__all__ = ['f"), own, F.lit("']\n__all__ += base.__all__\n"))
    ).otherwise("")
    text = F.concat(F.lit("from .m"), half, F.lit(" import *\n"), listing, F.lit("def f"), own, F.lit("(x):\n    return f"), half, F.lit("(x) + missing\n\n_g"), own, F.lit(" = 1\n"))
    return table(spark, sf, "part").where("p_partkey > 0").select(F.concat(F.lit("pkg/m"), own, F.lit(".py")).alias("path"), text.alias("text"))


@query(f"WITH {EXPORTS} SELECT DISTINCT 'pkg.m' || k AS module, name, 'pkg.m' || origin AS origin FROM e")
def star_exports(spark, sf):
    """What each module exports and where it comes from, through chains of star imports and a cycle."""
    return exports.names(rel.written(exports.facts(_modules(spark, sf)))).where("exported").select("module", "name", "origin")


@query(f"""WITH {EXPORTS}, r AS (SELECT k, 'f' || h AS name FROM m UNION ALL SELECT k, 'missing' FROM m)
SELECT DISTINCT 'pkg.m' || r.k AS module, r.name, 'pkg.m' || b.origin AS origin FROM r LEFT JOIN b ON b.k = r.k AND b.name = r.name""")
def star_reads(spark, sf):
    """Names that modules read without binding them, with the module a star import brings them from."""
    of = rel.written(exports.facts(_modules(spark, sf)))
    return exports.resolved_reads(of, exports.names(of), []).select("module", "name", "origin")


#: A function per part; what stands in lines 4, 7, 9 and 10 depends on the part.
def _functions(spark, sf):
    k = F.col("p_partkey")
    own, size = k.cast("string"), F.col("p_size").cast("string")
    choose = lambda of, *cases: F.element_at(F.array(*map(F.lit, cases)), (k % of + 1).cast("int"))
    text = F.concat(
        F.lit("def f"), own, F.lit("(a, b):\n    if a > "), size, F.lit(":\n        x = 1\n    "), choose(2, "elif", "if"), F.lit(" b:\n        x = 2\n    y = "), size, F.lit("\n    "),
        choose(3, "y = a", "y += a", "print(y)"), F.lit("\n    while b:\n        "), F.when(k % 5 == 0, "break").otherwise("b -= 1"), F.lit("\n    "),
        F.when(k % 7 == 0, "return x").otherwise("del a"), F.lit("\n    return x + y\n"),
    )
    return table(spark, sf, "part").select(F.concat(F.lit("f/"), own, F.lit(".py")).alias("path"), text.alias("text"))


def _union(columns, *parts):
    """SQL over parts: rows of values where a condition on the key holds."""
    return "\nUNION ALL ".join(f"SELECT 'f/' || p_partkey || '.py' AS path, {columns} FROM part, (VALUES {values}) v({names}) WHERE {where}" for where, names, values in [(w, _names(columns), v) for w, v in parts])


def _names(columns):
    return ", ".join(c.split(" AS ")[0] for c in columns.split(", "))


@query(_union("row, dst_row", (
    "true", "(0, 2), (2, 3), (2, 4), (4, 5), (4, 6), (5, 6), (6, 7), (7, 8), (8, 9), (8, 10), (11, -1)"), ("p_partkey % 2 = 0", "(3, 6)"), ("p_partkey % 2 = 1", "(3, 4)"),
    ("p_partkey % 5 = 0", "(9, 10)"), ("p_partkey % 5 <> 0", "(9, 8)"), ("p_partkey % 7 = 0", "(10, -1)"), ("p_partkey % 7 <> 0", "(10, 11)")))
def flow_edges(spark, sf):
    """Which line may follow which in each function; 0 is its entry and -1 its end."""
    edges = dataflow.flow(_functions(spark, sf)).where("kind = 'edge'")
    return edges.select("path", F.coalesce("row", F.lit(0)).alias("row"), F.coalesce("dst_row", F.lit(-1)).alias("dst_row"))


def _solved(spark, sf):
    of = rel.written(dataflow.flow(_functions(spark, sf)))
    return of, dataflow.solved(of)


@query(_union("name, row, dst_row, bound", (
    "true", "('a', 2, 0, true), ('b', 4, 0, true), ('b', 8, 0, true)"), ("p_partkey % 5 <> 0", "('b', 8, 9, true), ('b', 9, 0, true), ('b', 9, 9, true)"),
    ("p_partkey % 3 <> 2", "('a', 7, 0, true)"), ("p_partkey % 3 <> 0", "('y', 7, 6, true)"), ("p_partkey % 7 = 0", "('x', 10, 3, true), ('x', 10, 5, true), ('x', 10, 0, false)"),
    ("p_partkey % 7 <> 0", "('a', 10, 0, true), ('x', 11, 3, true), ('x', 11, 5, true), ('x', 11, 0, false)"),
    ("p_partkey % 7 <> 0 AND p_partkey % 3 <> 2", "('y', 11, 7, true)"), ("p_partkey % 7 <> 0 AND p_partkey % 3 = 2", "('y', 11, 6, true)")))
def reaching_definitions(spark, sf):
    """The lines whose definitions reach each use of a local name; bound with line 0 is a parameter."""
    _, found = _solved(spark, sf)
    return found.where("kind = 'reach'").select("path", F.col("text").alias("name"), "row", F.coalesce("dst_row", F.lit(0)).alias("dst_row"), F.col("dst").isNotNull().alias("bound"))


@query("SELECT 'f/' || p_partkey || '.py' AS path, 'x' AS name, CASE WHEN p_partkey % 7 = 0 THEN 10 ELSE 11 END AS row, false AS certain FROM part")
def unbound_uses(spark, sf):
    """Uses of names that may not be bound yet."""
    return dataflow.unbound_uses(*_solved(spark, sf)).select("path", "name", "row", "certain")


@query(_union("name, row", ("p_partkey % 3 = 0", "('y', 6)"), ("p_partkey % 7 = 0 AND p_partkey % 3 <> 2", "('y', 7)")))
def dead_stores(spark, sf):
    """Values that no use ever reads."""
    return dataflow.dead_stores(*_solved(spark, sf)).select("path", "name", "row")


@query(_union("row, \"by\"", (
    "true", "(2, 0), (3, 2), (4, 2), (5, 4), (7, 6), (8, 7), (9, 8), (10, 8)"), ("p_partkey % 2 = 0", "(6, 2)"), ("p_partkey % 2 = 1", "(6, 4)"), ("p_partkey % 7 <> 0", "(11, 10)")))
def dominators(spark, sf):
    """The line that every way to a line passes last, 0 for the entry."""
    _, found = _solved(spark, sf)
    return dataflow.dominators(found).select("path", "row", F.coalesce("by", F.lit(0)).alias("by"))


#: What stands in the function of a part, by the part's number, and what it is. The last is nested.
ACTIONS = [
    ("sys.path.append('x')", "sys_path"), ("os.environ['A'] = '1'", "os_environ"), ("log.error('x')", "logger"), ("self.logger.info('x', exc_info=True)", "logger"), ("foo.error('x', exc_info=1)", None),
    ("getLogger('a').warning('x')", "logger"), ("log_of.path.append('x')", None), ("del os.environ['A']", "os_environ"), ("for i in x:\n        with i:\n            sys.path += ['x']", "sys_path"),
    ("return lambda: [getLogger(y).info(y) for y in x]", "logger"), ("x.sys.path.append('y')", None),
]


def _actions(spark, sf):
    text = F.element_at(F.array(*[F.lit(a) for a, _ in ACTIONS]), (F.col("p_partkey") % len(ACTIONS) + 1).cast("int"))
    head = F.lit("import sys, os\nimport logging as log\nfrom logging import getLogger\nfrom other import log_of\n\n\ndef f(self, x, foo):\n    ")
    return table(spark, sf, "part").select(F.concat(F.lit("a/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.concat(head, text, F.lit("\n")).alias("text"))


_ACTION_SQL = f"""a AS (SELECT 'a/' || p_partkey || '.py' AS path, p_partkey % {len(ACTIONS)} AS i, CASE WHEN p_partkey % {len(ACTIONS)} = 8 THEN 10 ELSE 8 END AS row FROM part),
v(i, pattern) AS (VALUES {", ".join(f"({i}, '{p}')" for i, (_, p) in enumerate(ACTIONS) if p)})"""


@query(f"WITH {_ACTION_SQL} SELECT path, row, pattern FROM a JOIN v USING (i) WHERE pattern <> 'logger'")
def statement_patterns(spark, sf):
    """Statements that change sys.path or os.environ, at any depth."""
    found = treepatterns.matches(rel.written(treepatterns.tree(_actions(spark, sf))), treepatterns.statement_patterns(spark))
    return found.where("pattern in ('sys_path', 'os_environ')").select("path", "row", "pattern")


@query(f"WITH {_ACTION_SQL} SELECT path, row FROM a JOIN v USING (i) WHERE pattern = 'logger'")
def logger_candidates(spark, sf):
    nodes = rel.written(treepatterns.tree(_actions(spark, sf)))
    return treepatterns.logger_calls(nodes, treepatterns.matches(nodes, treepatterns.statement_patterns(spark))).select("path", "row")


@query(f"WITH {_ACTION_SQL} SELECT path, row FROM a WHERE i = 9")
def nested_patterns(spark, sf):
    """Functions whose body has a call inside a comprehension inside a lambda, and no loop statement; the pattern's steps lie at any distance."""
    call = treepatterns.step("Call", field=None, full="logging.getLogger", inside=True)
    comprehension = treepatterns.step("ListComp", call, inside=True)
    pattern = treepatterns.step("FunctionDef", treepatterns.step("Return", treepatterns.step("Lambda", comprehension, inside=True)), treepatterns.step("For While", inside=True, absent=True))
    nodes = rel.written(treepatterns.tree(_actions(spark, sf)))
    found = treepatterns.matches(nodes, treepatterns.pattern_table(spark, [("nested", pattern)]))
    return found.select("path", (F.col("row") + 1).alias("row"))


#: Sources with imports of which os and b go, and what is left, by the part's number.
IMPORTS = [
    ("import os, sys\n", "import sys\n"),
    ("from x import (\n    a,  # keep a\n    b,  # drop b\n    # own line\n    c,\n)\n", "from x import (\n    a,  # keep a\n    # own line\n    c,\n)\n"),
    ("if t:\n    import os\nelse:\n    import os; y = 1\n", "if t:\n    pass\nelse:\n    y = 1\n"),
    ("from x import a, \\\n    b\n", "from x import a\n"),
    ("from x import (a, b)\n", "from x import (a)\n"),
    ("try:\n    import os\nexcept E:\n    x = 1; import os\n", "try:\n    pass\nexcept E:\n    x = 1\n"),
    ("from x import (\n    b,\n)\nd = 'é'\n", "d = 'é'\n"),
    ("def f():\n    from x import b as os, b as c\n", "def f():\n    from x import b as c\n"),
    ("import os; import os.path\nfrom b import *\n", "from b import *\n"),
]


@query(f"""WITH v(i, text) AS (VALUES {", ".join(f"({i}, '{left.replace(chr(39), chr(39) * 2)}')" for i, (_, left) in enumerate(IMPORTS))})
SELECT 'i/' || p_partkey || '.py' AS path, '# é ' || p_partkey || chr(10) || text AS text FROM part JOIN v ON p_partkey % {len(IMPORTS)} = i""")
def import_members_removed(spark, sf):
    """Sources of parts without the imports of two names, over several lines, blocks and statements of one line."""
    text = F.element_at(F.array(*[F.lit(t) for t, _ in IMPORTS]), (F.col("p_partkey") % len(IMPORTS) + 1).cast("int"))
    own = F.col("p_partkey").cast("string")
    of = table(spark, sf, "part").select(F.concat(F.lit("i/"), own, F.lit(".py")).alias("path"), F.concat(F.lit("# é "), own, F.lit("\n"), text).alias("text"))
    return codemods.without_imports(of, of.select("path", F.explode(F.array(F.lit("os"), F.lit("b"))).alias("name")))


#: Beginnings of customers' paths, of every length, some of which begin nothing.
BEGINNINGS = "b AS (SELECT DISTINCT left(path, c_custkey % 41) || CASE WHEN c_custkey % 50 = 7 THEN '~' ELSE '' END AS prefix FROM p)"
PREFIX_SQL = f"""p AS (SELECT c_custkey, r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name || CASE c_custkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.pyi' ELSE '.txt' END AS path
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), {BEGINNINGS}"""


def _beginnings(paths):
    return paths.select(F.concat(F.expr("left(path, cast(c_custkey % 41 as int))"), F.when(F.col("c_custkey") % 50 == 7, "~").otherwise("")).alias("prefix"))


@query(f"WITH {PREFIX_SQL} SELECT prefix, count(path) AS n FROM b LEFT JOIN p ON starts_with(path, prefix) GROUP BY prefix")
def prefix_counts(spark, sf):
    """How many paths begin with each of a table of prefixes."""
    paths = _paths(spark, sf)
    return prefixes.counts(paths, _beginnings(paths), "path").select("prefix", "n")


@query(f"WITH {PREFIX_SQL} SELECT prefix, c_custkey FROM b JOIN p ON starts_with(path, prefix) WHERE length(prefix) > 12")
def prefix_members(spark, sf):
    """The customers behind each prefix of more than twelve characters."""
    paths = _paths(spark, sf)
    return prefixes.members(paths, _beginnings(paths).where("length(prefix) > 12"), "path").select("prefix", "c_custkey")


_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@query(f"""WITH d AS (SELECT 'p/' || p_partkey AS path, lpad(lower(to_hex({_FNV.format("p_name || ' ' || p_brand")}::UBIGINT)), 16, '0') AS digest FROM part),
l AS (SELECT string_agg(path || chr(9) || digest || chr(10), '' ORDER BY path || chr(9) || digest) AS lines FROM d) SELECT lpad(lower(to_hex({_FNV.format("lines")}::UBIGINT)), 16, '0') AS digest FROM l""")
def snapshot_digest(spark, sf):
    """One digest over all parts as files, equal to the one of a sequential reader."""
    of = table(spark, sf, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    return file_sources.snapshot(of)


WANTED = ["password", "license", "apache", "Theron", "über", "x9z"]


@query(f"""WITH n(name) AS (VALUES {", ".join(f"('{n}')" for n in WANTED)}) SELECT doc_id, name FROM documents, n WHERE list_contains(regexp_extract_all(text, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*'), name)""")
def filtered_names(spark, sf):
    """Which documents hold which of some names, read only where the stored filters allow for one."""
    of = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text").withColumn("path", F.col("path").cast("string"))
    kept = namefilter.files_to_parse(of, rel.written(namefilter.filters(of)), WANTED)
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}_][\p{L}\p{N}_]*"), F.lit(0)))
    return kept.select(F.col("path").cast("long").alias("doc_id"), F.explode(F.array_intersect(words, F.array(*map(F.lit, WANTED)))).alias("name"))

"""Further operators on the star schema, each beside its SQL: bundles, resolution, models, atoms, addresses, ranges, trivia."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import stdlib, trivia
from quarry.operators import addresses, atoms, bundles, classes, flow, graph, imports, lint, models, navdigest, navigate, rel, resolve, suppress
from quarry.plans.base import query, table
from quarry.plans.lintcases import CASES
from quarry.plans.sourcecode import CHEAP, SMALL, files
from quarry.sources import python_source


def _parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", F.monotonically_increasing_id().alias("seq"))


@query("""SELECT 'p_brand' AS "index", p_brand AS key, count(DISTINCT p_partkey) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY p_brand
UNION ALL SELECT 'p_type', p_type, count(DISTINCT p_partkey), min(p_partkey), max(p_partkey) FROM part GROUP BY p_type
UNION ALL SELECT 'p_size', p_size::VARCHAR, count(DISTINCT p_partkey), min(p_partkey), max(p_partkey) FROM part GROUP BY p_size""")
def bundle_indices(spark, sf):
    return bundles.indices(_parts(spark, sf), ["p_brand", "p_type", "p_size"], "p_partkey")


@query("SELECT p_brand AS family, count(*) AS n FROM part GROUP BY 1")
def bundle_manifest(spark, sf):
    return bundles.manifest(_parts(spark, sf).withColumnRenamed("p_brand", "family"), "family", "p_partkey")


@query("SELECT p_brand AS family, p_size, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS place FROM part")
def bundle_order(spark, sf):
    """Members of each family by line; of equal lines by the order they came in."""
    members = table(spark, sf, "part").select(F.col("p_brand").alias("family"), "p_size", "p_partkey", F.col("p_partkey").alias("seq"))
    return bundles.ordered(members, "family", "p_size").select("family", "p_size", "p_partkey", F.col("place").cast("long").alias("place"))


@query("""WITH h AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS p FROM orders)
SELECT x.p AS a, y.p AS b, count(*) AS n FROM h x JOIN h y ON x.c = y.c AND x.p < y.p GROUP BY ALL""")
def mark_cooccurrence(spark, sf):
    """Order priorities as marks of customers."""
    return bundles.together(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def first_declarations(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return bundles.first_seen(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT l_linestatus, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS n_kept, round(count(*) FILTER (l_returnflag = 'N') / count(*), 4) AS ratio FROM lineitem GROUP BY 1""")
def preservation_ratio(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("kept", F.col("l_returnflag") == "N")
    return bundles.preservation(lines, "kept", "l_linestatus")


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'ratified' ELSE 'proposed' END AS state FROM customer""")
def ratification(spark, sf):
    known = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return bundles.ratified(table(spark, sf, "customer").select("c_custkey"), known, ["c_custkey"])


@query("""WITH r AS (SELECT l_suppkey AS parent, l_partkey AS child, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS k FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem))
SELECT parent, child, CASE WHEN k > 255 THEN ((k - 1) // 255)::VARCHAR || '.' || ((k - 1) % 255 + 1)::VARCHAR ELSE k::VARCHAR END AS address FROM r""")
def minted_addresses(spark, sf):
    """Ranks among siblings as digits of base 255."""
    pairs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("parent"), F.col("l_partkey").alias("name")).distinct()
    ranked = graph.sibling_ranks(pairs)
    return ranked.select("parent", F.col("name").alias("child"), bundles.digits(F.col("rank")).alias("address"))


# --- resolution


def _tree(spark, sf):
    """Suppliers as modules of nations: sources for all, stubs for every third, packages for every second nation."""
    s = table(spark, sf, "supplier")
    base = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string"))
    source = s.filter("s_suppkey % 5 <> 0").select(F.concat(base, F.lit(".py")).alias("path"))
    stub = s.filter("s_suppkey % 3 = 0").select(F.concat(base, F.lit(".pyi")).alias("path"))
    package = table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("/__init__.py")).alias("path"))
    return source.unionByName(stub).unionByName(package)


TREE = """f AS (SELECT 'n' || s_nationkey || '/s' || s_suppkey || '.py' AS path FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 'n' || s_nationkey || '/s' || s_suppkey || '.pyi' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'n' || n_nationkey || '/__init__.py' FROM nation WHERE n_nationkey % 2 = 0)"""


@query(f"""WITH {TREE}, m AS (SELECT replace(regexp_replace(regexp_replace(path, '\\.pyi?$', ''), '/__init__$', ''), '/', '.') AS m, arg_min(path, (path LIKE '%.pyi', path)) AS path FROM f GROUP BY 1),
i AS (SELECT DISTINCT 'n' || s_nationkey AS module, 's' || s_suppkey AS name FROM supplier)
SELECT module, name, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NOT NULL THEN 'member' WHEN b.path IS NOT NULL THEN 'parent' ELSE 'unresolved' END AS how
FROM i LEFT JOIN m a ON a.m = module || '.' || name LEFT JOIN m b ON b.m = module""")
def resolved_imports(spark, sf):
    asked = table(spark, sf, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("module"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name")).distinct()
    return resolve.resolved(asked, _tree(spark, sf))


@query(f"WITH {TREE} SELECT a.path AS stub, b.path AS source FROM f a LEFT JOIN f b ON b.path = left(a.path, len(a.path) - 1) WHERE a.path LIKE '%.pyi'")
def stub_sources(spark, sf):
    return resolve.stub_sources(_tree(spark, sf))


@query("""WITH p AS (SELECT 'r' || r_regionkey || '/n' || n_nationkey || '/s' || s_suppkey AS folder, n_nationkey % 2 = 0 AS n_is, s_suppkey % 3 > 0 AS s_is, r_regionkey % 2 = 0 AS r_is,
'r' || r_regionkey AS r, 'r' || r_regionkey || '/n' || n_nationkey AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT folder || '/a.py' AS path, CASE WHEN s_is AND n_is AND r_is THEN r WHEN s_is AND n_is THEN n ELSE folder END AS root FROM p""")
def package_roots(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    path = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    region, nation = tag("r", "r_regionkey"), F.concat_ws("/", tag("r", "r_regionkey"), tag("n", "n_nationkey"))
    folder = F.concat_ws("/", nation, tag("s", "s_suppkey"))
    init = lambda c: F.concat(c, F.lit("/__init__.py")).alias("path")
    there = path.select(F.concat(folder, F.lit("/a.py")).alias("path"))
    there = there.unionByName(path.filter("r_regionkey % 2 = 0").select(init(region)).distinct()).unionByName(path.filter("n_nationkey % 2 = 0").select(init(nation)).distinct()).unionByName(path.filter("s_suppkey % 3 > 0").select(init(folder)))
    return resolve.package_root(there).filter("path like '%/a.py'")


@query(f"WITH {TREE} SELECT 'n' || n_nationkey AS prefix, (SELECT count(*) FROM f WHERE path LIKE 'n' || n_nationkey || '/%') AS n FROM nation")
def folder_listing(spark, sf):
    return resolve.under(table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("prefix")), _tree(spark, sf))


@query("""SELECT event_id, CASE WHEN event_type <> 'purchase' THEN event_type WHEN u IS NULL THEN 'rescan' WHEN u % 2 = 0 THEN 'deleted_folder' ELSE 'deleted_file' END AS kind
FROM events LEFT JOIN (SELECT DISTINCT o_custkey AS u FROM orders) ON u = user_id""")
def refined_deletes(spark, sf):
    """Purchases as deletes, customers with orders as the cached paths."""
    events = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "purchase", "deleted").otherwise(F.col("event_type")).alias("kind"))
    state = table(spark, sf, "orders").select(F.col("o_custkey").alias("u")).distinct().select(F.col("u").cast("string").alias("path"), (F.col("u") % 2 == 0).alias("is_folder"))
    return resolve.refined(events, state).select("event_id", "kind")


@query("""WITH RECURSIVE c AS (SELECT DISTINCT 's' || s_suppkey AS caller, 1 AS pos, 'n' || s_nationkey AS callee FROM supplier UNION SELECT 'n' || n_nationkey, 1, 'r' || n_regionkey FROM nation),
d AS (SELECT 'r' || r_regionkey AS head, 'region ' || r_name AS reason FROM region WHERE r_regionkey < 2 UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation WHERE n_nationkey % 7 = 0),
t AS (SELECT head FROM d UNION SELECT caller FROM c JOIN t ON callee = head)
SELECT t.head, coalesce((SELECT min(reason) FROM d WHERE d.head = t.head), 'calls ' || (SELECT min(callee) FROM c JOIN t u ON callee = u.head WHERE caller = t.head)) AS reason FROM t""")
def taint_reasons(spark, sf):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    calls = s.select(tag("s", "s_suppkey").alias("caller"), F.lit(1).alias("pos"), tag("n", "s_nationkey").alias("callee"))
    calls = calls.unionByName(n.select(tag("n", "n_nationkey").alias("caller"), F.lit(1).alias("pos"), tag("r", "n_regionkey").alias("callee")))
    direct = r.filter("r_regionkey < 2").select(tag("r", "r_regionkey").alias("head"), F.lit(0).alias("pos"), F.concat(F.lit("region "), "r_name").alias("reason"))
    direct = direct.unionByName(n.filter("n_nationkey % 7 = 0").select(tag("n", "n_nationkey").alias("head"), F.lit(0).alias("pos"), F.lit("nation").alias("reason")))
    return resolve.taint_reasons(calls, direct)


@query(f"SELECT 'parts/' || p_partkey || '.py' AS path, 'import sys' AS first, CASE WHEN {CHEAP} THEN 7 ELSE 7 END AS n_lines FROM part")
def imports_removed(spark, sf):
    """Generated files without their unused import."""
    of = files(spark, sf)
    unused = lint.unused_imports(lint.parsed(of, {"F401"}, [], {"F401"})).select("path", "row")
    lines = F.split("text", "\n", -1)
    return resolve.without_unused_imports(of, unused).select("path", F.get(lines, F.lit(0)).alias("first"), (F.size(lines) - 1).alias("n_lines"))


# --- models


@query("""SELECT c_custkey, (c_mktsegment = 'BUILDING' OR c_nationkey % 3 = 0) AS is_model FROM customer""")
def model_filter(spark, sf):
    """Customers as classes: a segment as base, a nation as what they assign."""
    bases = F.array(F.when(F.col("c_mktsegment") == "BUILDING", "models.Model").otherwise("object"))
    assigned = F.array(F.when(F.col("c_nationkey") % 3 == 0, "_inherit").otherwise("x"))
    return table(spark, sf, "customer").select("c_custkey", models.is_model(bases, assigned).alias("is_model"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'BelongsTo' WHEN s_suppkey % 4 = 1 THEN 'HasMany' WHEN s_suppkey % 4 = 2 THEN 'BelongsTo' ELSE 'HasMany' END AS kind,
CASE WHEN s_nationkey % 2 = 0 THEN 'nation_id' END AS key FROM supplier""")
def relationship_keys(spark, sf):
    """Suppliers with a relationship to their nation, whose key column every second one has."""
    s = table(spark, sf, "supplier")
    m = F.col("s_suppkey") % 4
    told = s.select(F.col("s_suppkey").alias("model"), F.lit("nation").alias("name"), F.when(m == 0, False).when(m == 1, True).alias("uselist"), F.when(m == 2, "suppliers").when(m == 3, "supplier").alias("backref"))
    cols = s.filter("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("model"), F.lit("nation_id").alias("name"), F.lit("nation.id").alias("foreign_key"))
    return models.associations(told, cols).select(F.col("model").alias("s_suppkey"), "kind", "key")


@query("""WITH r(rule, selector, kind, least) AS (VALUES ('big', 'URGENT', 'f', 2), ('any', '*', 'f', 0), ('class', '*', 'c', 0))
SELECT o_orderkey, rule FROM orders JOIN r ON kind = CASE WHEN o_orderstatus = 'F' THEN 'c' ELSE 'f' END AND (selector = '*' OR selector = split_part(o_orderpriority, '-', 2)) AND o_custkey % 4 >= least""")
def matched_rules(spark, sf):
    """Orders as definitions whose priority is a decorator."""
    orders = table(spark, sf, "orders")
    mark = F.array(F.struct(F.get(F.split("o_orderpriority", "-"), F.lit(1)).alias("name"), (F.col("o_custkey") % 4).cast("int").alias("n_args")))
    told = orders.select(F.col("o_orderkey").alias("path"), F.lit("x").alias("name"), F.when(F.col("o_orderstatus") == "F", "c").otherwise("f").alias("kind"), mark.alias("decorators"))
    rules = spark.createDataFrame([("big", "URGENT", "f", 2), ("any", "*", "f", 0), ("class", "*", "c", 0)], "rule string, selector string, kind string, least_args int")
    return models.matched(told, rules).select(F.col("path").alias("o_orderkey"), "rule")


# --- atoms and addresses


def _atoms(spark, sf):
    """Every nation as a rule that calls its region; each region as a fact, or as a rule that calls nothing, and one query."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rule = n.select(F.lit("a").alias("path"), F.col("n_nationkey").alias("pos"), F.format_string("(= (n%d $x) (r%d $x))", "n_nationkey", "n_regionkey").alias("text"))
    base = r.select(F.lit("a").alias("path"), (F.col("r_regionkey") + 100).alias("pos"), F.when(F.col("r_regionkey") % 2 == 0, F.format_string("(= (r%d $x) 1)", "r_regionkey")).otherwise(F.format_string("(fact r%d)", "r_regionkey")).alias("text"))
    asked = spark.createDataFrame([("a", 200, "!"), ("a", 201, "(n1 2)"), ("a", 202, "(: n1 Type)")], "path string, pos int, text string")
    return rule.unionByName(base).unionByName(asked)


@query("""SELECT kind, count(*) AS n FROM (SELECT 'rule' AS kind FROM nation UNION ALL SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'rule' ELSE 'fact' END FROM region UNION ALL VALUES ('query'), ('type')) GROUP BY 1""")
def atom_kinds(spark, sf):
    return atoms.classified(_atoms(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'n' || n_nationkey AS caller, 'r' || n_regionkey AS callee FROM nation WHERE n_regionkey % 2 = 0")
def atom_calls(spark, sf):
    found = atoms.classified(_atoms(spark, sf))
    return atoms.calls(found, atoms.rule_heads(found))


@query("""WITH t AS (SELECT 'r0' AS h UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 0),
h AS (SELECT 'n' || n_nationkey AS name FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region WHERE r_regionkey % 2 = 0)
SELECT CASE WHEN name = 'r0' THEN 'reads a file' WHEN h IS NOT NULL THEN 'calls an interpreted rule' ELSE 'lowerable' END AS kind, count(*) AS n FROM h LEFT JOIN t ON h = name GROUP BY 1""")
def rule_head_census(spark, sf):
    found = atoms.classified(_atoms(spark, sf))
    heads = atoms.rule_heads(found)
    reasons = spark.createDataFrame([("r0", "reads a file")], "head string, reason string")
    return atoms.census(heads, graph.tainted(atoms.calls(found, heads), reasons.select("head")), reasons)


@query("""WITH o AS (SELECT l_orderkey AS block, l_linenumber AS idx, min(l_partkey) AS p, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2),
w AS (SELECT block, idx, p % 3 AS temp, CASE WHEN q % 2 = 0 THEN p END AS address FROM o WHERE idx % 2 = 1),
m AS (SELECT block, idx, p % 3 AS temp FROM o WHERE idx % 2 = 0)
SELECT block, idx, address FROM (SELECT m.block, m.idx, arg_max(coalesce(address, -1), w.idx) AS address FROM m JOIN w ON w.block = m.block AND w.temp = m.temp AND w.idx < m.idx GROUP BY ALL) WHERE address >= 0""")
def block_addresses(spark, sf):
    """Lines of orders as operations: odd ones write a temporary, by an addition of a constant or not, even ones load from one."""
    line = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"))
    line = line.withColumn("odd", F.col("l_linenumber") % 2 == 1).withColumn("even", F.col("l_quantity").cast("long") % 2 == 0)
    temp, none = (F.col("l_partkey") % 3).cast("long"), F.lit(None)
    ops = line.select(
        F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("idx"), F.when(~F.col("odd"), "Load").when(F.col("even"), "IntAdd").otherwise("Copy").alias("op"),
        F.when(F.col("odd"), "Unique").alias("dst_space"), F.when(F.col("odd"), temp).alias("dst_offset"), F.when(F.col("odd"), "Const").alias("a_space"), F.when(F.col("odd"), F.col("l_partkey").cast("long")).alias("a_offset"),
        F.when(F.col("odd"), "Unique").alias("b_space"), none.cast("long").alias("b_offset"), F.when(~F.col("odd"), "Unique").alias("addr_space"), F.when(~F.col("odd"), temp).alias("addr_offset"),
    )
    return addresses.resolved(ops).select("block", "idx", "address")


# --- ranges and trivia


@query("""WITH p AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day FROM orders),
r AS (SELECT o_orderkey AS k, o_custkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) - 200 AS a, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + (o_orderkey % 400) AS b FROM orders)
SELECT p.o_orderkey, arg_min(k, (a - b, k)) AS widest FROM p JOIN r ON p.o_custkey = r.o_custkey AND day >= a AND day < b GROUP BY 1""")
def outermost_range(spark, sf):
    """Orders with the widest span of their customer's orders that holds their day."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    points = table(spark, sf, "orders").select("o_orderkey", "o_custkey", day.alias("at"))
    ranges = points.select("o_custkey", F.col("o_orderkey").alias("k"), (F.col("at") - 200).alias("a"), (F.col("at") + F.col("o_orderkey") % 400).alias("b"))
    held = rel.range_join(points, ranges, ["o_custkey"], "at", "a", "b", 300)
    return rel.widest_cover(held, ["o_orderkey"], "a", "b", ["k"]).select("o_orderkey", F.col("k").alias("widest"))


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey % 50 AND value >= 10 AND value < 20)""")
def multiline_containment(spark, sf):
    """Orders of whose user some event lies in a range over several rows."""
    points = table(spark, sf, "events").select(F.col("user_id").alias("k"), "value")
    ranges = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("k"), F.lit(10).alias("a"), F.lit(20).alias("b"))
    return rel.with_points(ranges, points, ["k"], "value", "a", "b").select("o_orderkey")


@query(f"SELECT 'parts/' || p_partkey || '.py' AS path, CASE WHEN {SMALL} THEN 2 ELSE 1 END AS depth FROM part")
def bracket_depth(spark, sf):
    """The deepest brackets of generated files."""
    inside = F.col("depth") + F.when(F.col("kind").isin("LPAR", "LSQB", "LBRACE"), 1).otherwise(0)
    return python_source.tokens(files(spark, sf)).groupBy("path").agg(F.max(inside).alias("depth"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n, max(len(regexp_extract(chr(9) || '  ' || line, '^[ \t\f]*', 0)))::BIGINT AS deepest FROM l GROUP BY 1""".replace("\t", "\\t").replace("\f", "\\f"))
def line_indents(spark, sf):
    """The deepest indentation of each document's lines, each set in by a tab and two blanks."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    depth = F.length(trivia.leading_indentation(F.concat(F.lit("\t  "), "line"))).cast("long")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(depth).alias("deepest"))


@query("""SELECT p_partkey, rpad(left(p_brand, p_size % 9), ((p_size % 9) // 8 + 1) * 8, ' ') || 'x' AS line FROM part WHERE len(p_brand) >= p_size % 9""")
def expanded_tabs(spark, sf):
    part = table(spark, sf, "part").withColumn("n", F.col("p_size") % 9).filter(F.length("p_brand") >= F.col("n"))
    return part.select("p_partkey", trivia.expand_tabs(F.concat(F.substring("p_brand", F.lit(1), F.col("n")), F.lit("\tx"))).alias("line"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'on' WHEN 2 THEN 'skip' WHEN 3 THEN 'off' END AS kind FROM events""")
def formatter_comments(spark, sf):
    text = F.element_at(F.array(*map(F.lit, ["# fmt: off", "#fmt:on", "# fmt: skip", "# yapf: disable", "# fmt"])), (F.col("event_id") % 5).cast("int") + 1)
    return table(spark, sf, "events").select("event_id", trivia.suppression_kind(text).alias("kind"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '''' WHEN 1 THEN 'rb"' ELSE 'f\"\"\"' END AS opening, p_name AS inner FROM part""")
def string_quotes(spark, sf):
    """Part names as string literals with one of three kinds of quotes."""
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_size") % 3).cast("int") + 1)
    literal = F.concat(pick("'", 'rb"', 'f"""'), "p_name", pick("'", '"', '"""'))
    return table(spark, sf, "part").select("p_partkey", trivia.leading_quote(literal).alias("opening"), trivia.raw_contents(literal).alias("inner"))


OPERATORS = ["or", "and", "not", "==", "|", "+", "*", "**", "?"]


@query("SELECT p_partkey, op, rank FROM part JOIN (VALUES (0, 'or', 4), (1, 'and', 5), (2, 'not', 6), (3, '==', 7), (4, '|', 8), (5, '+', 12), (6, '*', 13), (7, '**', 15), (8, '?', 0)) v(i, op, rank) ON p_size % 9 = i")
def operator_precedence(spark, sf):
    """The rank of an operator that a part's size picks, 0 for what is none."""
    op = F.element_at(F.array(*map(F.lit, OPERATORS)), (F.col("p_size") % 9 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", op.alias("op")).withColumn("rank", F.coalesce(trivia.precedence(F.col("op")), F.lit(0)))


@query("SELECT p_partkey, code, CASE WHEN regexp_matches(code, '^PLW?[0-9CERW]') THEN 'pylint' WHEN regexp_matches(code, '^FURB') THEN 'refurbishment' WHEN regexp_matches(code, '^UP[0-9]') THEN 'upgrades' WHEN regexp_matches(code, '^SIM') THEN 'simplification' WHEN regexp_matches(code, '^S[0-9]') THEN 'security' ELSE 'other' END AS origin FROM part JOIN (VALUES " + ", ".join(f"({i}, '{c}')" for i, (c, *_) in enumerate(CASES)) + f") v(i, code) ON p_partkey % {len(CASES)} = i")
def rule_origins(spark, sf):
    """The family of a rule that a part's number picks."""
    code = F.element_at(F.array(*[F.lit(c) for c, *_ in CASES]), (F.col("p_partkey") % len(CASES) + 1).cast("int"))
    of = table(spark, sf, "part").select("p_partkey", code.alias("code"))
    found = trivia.origin(F.col("code"))
    return of.select("p_partkey", "code", F.when(found.isin("pylint", "refurbishment", "upgrades", "simplification", "security"), found).otherwise("other").alias("origin"))


# --- editor questions and classes on generated sources


def _nodes(spark, sf, kinds):
    """Nodes for questions that read them more than once: files are parsed once."""
    return rel.written(python_source.nodes(files(spark, sf), kinds))


@query("SELECT 'parts/' || p_partkey || '.py' AS path, name, rows FROM part, (VALUES ('x', '6'), ('sys', '8')) v(name, rows)")
def symbol_references(spark, sf):
    return navigate.references(_nodes(spark, sf, python_source.NAMED)).select("path", "name", F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"))


@query("SELECT 'parts/' || p_partkey || '.py' AS path, 'part_' || p_partkey AS caller, 'g' AS callee FROM part UNION ALL SELECT 'parts/' || p_partkey || '.py', '<module>', 'part_' || p_partkey FROM part")
def outgoing_calls(spark, sf):
    calling = files(spark, sf).select("path", F.concat(F.replace("text", F.lit("return sys.path"), F.lit("return g(sys.path)")), F.regexp_extract("text", "def ([a-z_0-9]+)", 1), F.lit("(1)\n")).alias("text"))
    return navigate.outgoing(rel.written(python_source.nodes(calling, ["Call", *navigate.DEFINED]))).select("path", "caller", F.explode("callees").alias("callee"))


def _classes(spark, sf):
    """A class per supplier below the class of its nation, nations below regions."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.select(tag("S", "s_suppkey").alias("sub"), tag("N", "s_nationkey").alias("super")).unionByName(n.select(tag("N", "n_nationkey").alias("sub"), tag("R", "n_regionkey").alias("super")))


@query("""SELECT 'S' || s_suppkey AS sub, 'N' || s_nationkey AS super FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
UNION ALL SELECT 'S' || s_suppkey, 'R' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def class_ancestors(spark, sf):
    return classes.ancestors(_classes(spark, sf))


@query("""SELECT 'S' || s_suppkey AS class, CASE WHEN s_suppkey % 2 = 0 AND n_regionkey < 3 THEN 'f,g' WHEN s_suppkey % 2 = 0 THEN 'f' ELSE 'g' END AS methods FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0 OR n_regionkey < 3""")
def override_sets(spark, sf):
    """Nations define f, regions below 3 define g; suppliers define both, odd ones only g."""
    edges = _classes(spark, sf)
    named = edges.select(F.col("sub").alias("class")).union(edges.select("super")).distinct()
    number = F.substring("class", 2, 20).cast("int")
    f = named.filter(F.col("class").startswith("N") | (F.col("class").startswith("S") & (number % 2 == 0))).select("class", F.lit("f").alias("method"))
    g = named.filter((F.col("class").startswith("R") & (number < 3)) | F.col("class").startswith("S")).select("class", F.lit("g").alias("method"))
    found = f.unionByName(g).select(F.lit("p").alias("path"), "class", "method", F.lit(1).alias("row"), F.lit(False).alias("final"), F.lit(False).alias("abstract"))
    return classes.override_sets(found, classes.ancestors(edges)).filter("class like 'S%'").select("class", F.array_join("methods", ",").alias("methods"))


@query("SELECT 'parts/' || p_partkey || '.py' AS path, count(*) AS n_edges FROM part, (VALUES (1), (2), (3), (4)) v(i) GROUP BY 1")
def control_flow(spark, sf):
    """A condition leads into its branch and past it, both returns lead out."""
    return flow.edges(_nodes(spark, sf, flow.KINDS)).groupBy("path").agg(F.count(F.lit(1)).alias("n_edges"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 3 = 0 THEN 'insertion' WHEN l_quantity % 3 = 1 THEN 'deletion' ELSE 'replacement' END AS kind FROM lineitem""")
def edit_kinds(spark, sf):
    m = F.col("l_quantity").cast("int") % 3
    edits = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit(5).alias("start"), F.when(m == 0, 5).otherwise(9).alias("end"), F.when(m != 1, "x").alias("content"))
    return suppress.edit_kind(edits).select("l_orderkey", "l_linenumber", "kind")


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey, l_linenumber) AS k FROM lineitem WHERE l_linestatus = 'O') WHERE l_returnflag <> 'N' OR k = 1
UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE false""")
def isolated_fixes(spark, sf):
    """Open lines as safe fixes of their order; those not returned share an isolation group."""
    line = table(spark, sf, "lineitem")
    fixes = line.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("fix_id"), F.col("l_partkey").alias("start"), F.col("l_partkey").alias("end"), F.when(F.col("l_returnflag") == "N", "N").alias("isolation"), F.when(F.col("l_linestatus") == "O", "safe").otherwise("display").alias("applicability"))
    return suppress.one_per_group(suppress.applicable(fixes, "safe")).select(F.col("path").alias("l_orderkey"), F.col("fix_id").alias("l_linenumber"))


@query("""SELECT 'm' || user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY k, v) AS place, text FROM (
SELECT DISTINCT user_id, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS k, event_type AS v, 'import ' || CASE WHEN event_type = 'click' THEN 'json' WHEN event_type = 'view' THEN 'os' ELSE 'zz_' || event_type END AS text FROM events)""")
def import_blocks(spark, sf):
    """What users did as imports: two of the standard library, the others of third parties."""
    module = F.when(F.col("event_type") == "click", "json").when(F.col("event_type") == "view", "os").otherwise(F.concat(F.lit("zz_"), "event_type"))
    told = table(spark, sf, "events").select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("path"), module.alias("module"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("asname"), F.lit(0).alias("level"))
    return imports.ordered(told.distinct()).select("path", F.col("place").cast("long").alias("place"), "text")


@query("""WITH f AS (SELECT 'c' || conv_id AS screen, turn, role FROM conversations)
SELECT 'controls' AS section, screen AS key, count(*)::VARCHAR AS value FROM f GROUP BY screen
UNION ALL SELECT DISTINCT 'bindings', screen, role FROM f WHERE role = 'user'""")
def navigation_digest(spark, sf):
    """Turns as controls of a conversation's screen, users as concepts bound to it."""
    c = table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("s"), "turn", "role")
    facts = c.select("s", F.lit("has_control").alias("p"), F.col("turn").cast("string").alias("o")).unionByName(c.filter("role = 'user'").select("s", F.lit("binds_concept").alias("p"), F.col("role").alias("o")))
    return navdigest.digest(facts)


@query("SELECT o_custkey AS screen, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS parent FROM orders GROUP BY 1")
def menu_parents(spark, sf):
    opens = table(spark, sf, "orders").select(F.col("o_orderkey").alias("opener"), F.col("o_custkey").alias("screen"), F.col("o_orderdate").alias("pos"))
    return navdigest.parents(opens)


@query("""SELECT 'low' AS name, count(DISTINCT user_id) FILTER (event_type IN ('view', 'click')) AS n FROM events UNION ALL SELECT 'high', count(DISTINCT user_id) FILTER (event_type = 'purchase') FROM events""")
def group_census(spark, sf):
    functions = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("touched"))
    return navdigest.group_census(functions, {"low": ["view", "click"], "high": ["purchase"]}, "touched")


@query("""SELECT o_orderkey, regexp_matches(replace(o_orderpriority, '-', ''), '^[A-Za-z_][A-Za-z0-9_]*$') AS is_identifier FROM orders""")
def identifier_tests(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", stdlib.is_identifier(F.replace("o_orderpriority", F.lit("-"), F.lit(""))).alias("is_identifier"))

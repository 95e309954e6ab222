"""Queries over references, ranges and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.names import fuzzy_pattern
from quarry.operators import fixes, graph, rel
from quarry.plans.base import query, table


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that sell parts, by every line."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"


@query(f"WITH {EDGES} SELECT s_suppkey AS node, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS targets FROM supplier LEFT JOIN e ON src = s_suppkey GROUP BY 1")
def import_dependencies(spark, sf):
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    return graph.dependencies(nodes, _edges(spark, sf)).select("node", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


@query(f"WITH {EDGES}, n AS (SELECT DISTINCT p_partkey AS node FROM part) SELECT node, coalesce(string_agg(src::VARCHAR, ',' ORDER BY src), '') AS targets FROM n LEFT JOIN e ON dst = node GROUP BY 1")
def import_dependents(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node")).distinct()
    return graph.dependents(nodes, _edges(spark, sf)).select("node", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def dangling_refs(spark, sf):
    calls = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return graph.dangling(calls, table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey")


@query("""WITH a AS (SELECT doc_id, md5(text) AS old FROM documents WHERE doc_id % 11 <> 3),
b AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS new FROM documents WHERE doc_id % 13 <> 5)
SELECT doc_id, CASE WHEN new IS NULL THEN 'missing' WHEN old IS NULL THEN 'new' ELSE 'changed' END AS state FROM a FULL JOIN b USING (doc_id) WHERE old IS DISTINCT FROM new""")
def stale_files(spark, sf):
    """The corpus against an edition of it in which texts were changed, taken away and added."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    digest = lambda text: F.md5(text.cast("binary")).alias("digest")
    stored = docs.filter("doc_id % 11 <> 3").select("doc_id", digest(F.col("text")))
    current = docs.filter("doc_id % 13 <> 5").select("doc_id", digest(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))))
    return graph.stale(stored, current, "doc_id", "digest")


CALLS = """e AS (SELECT user_id AS callee, lead(user_id) OVER (PARTITION BY strftime(ts, '%Y-%m-%d %H') ORDER BY ts, event_id) AS caller, event_type, value FROM events),
direct AS (SELECT DISTINCT callee AS head FROM e WHERE event_type = 'error' AND value > 99)"""


def _calls(spark, sf):
    window = Window.partitionBy(F.date_format("ts", "yyyy-MM-dd HH")).orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("callee"), F.lead("user_id").over(window).alias("caller"), "event_type", "value", "event_id")


@query(f"WITH RECURSIVE {CALLS}, t(head) AS (SELECT head FROM direct UNION SELECT caller FROM t JOIN e ON callee = head WHERE caller IS NOT NULL) SELECT head FROM t")
def taint_fixpoint(spark, sf):
    calls = _calls(spark, sf)
    direct = calls.filter("event_type = 'error' and value > 99").select(F.col("callee").alias("head")).distinct()
    return graph.tainted(calls.filter("caller is not null"), direct)


CELLS = """c AS (SELECT conv_id, turn, len(string_split(text, chr(10))) AS n FROM conversations),
s AS (SELECT conv_id, turn, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_row FROM c)"""


def _cells(spark, sf):
    window = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    counted = table(spark, sf, "conversations").withColumn("n", F.size(F.split("text", "\n", -1)))
    return counted.withColumn("start_row", F.coalesce(F.sum("n").over(window), F.lit(0))).select("conv_id", "turn", "n", "start_row")


@query(f"WITH {CELLS}, r AS (SELECT conv_id, unnest(range(0, sum(n)::BIGINT)) AS row FROM c GROUP BY conv_id) SELECT r.conv_id, r.row, s.turn, r.row - s.start_row AS cell_row FROM r ASOF JOIN s ON r.conv_id = s.conv_id AND r.row >= s.start_row")
def asof_cell(spark, sf):
    """Rows of a conversation, laid end to end, back to their turn and the row in it."""
    cells = _cells(spark, sf)
    rows = cells.groupBy("conv_id").agg(F.sum("n").alias("n")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("row"))
    starts = cells.select("conv_id", F.col("start_row").alias("row"), F.col("start_row").alias("first"), "turn")
    return rel.asof_backward(rows, starts, ["conv_id"], "row", ["first", "turn"]).select("conv_id", "row", "turn", (F.col("row") - F.col("first")).alias("cell_row"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
FROM events QUALIFY event_type = 'view'""")
def nearest_preceding(spark, sf):
    """The last purchase of the user before each view."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    views = events.filter("event_type = 'view'").select("user_id", "at", "event_id")
    bought = events.filter("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("previous"))
    return rel.asof_backward(views, bought, ["user_id"], "at", ["previous"], strict=True).select("event_id", "previous")


SPANS = """r AS (SELECT user_id, event_id AS range_id, epoch(ts)::BIGINT AS a, epoch(ts)::BIGINT + 600 * (1 + event_id % 50) AS b FROM events WHERE event_type = 'signup'),
p AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS pos FROM events WHERE event_type = 'click')"""


def _spans(spark, sf):
    events = table(spark, sf, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    ranges = events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("range_id"), F.col("at").alias("a"), (F.col("at") + 600 * (1 + F.col("event_id") % 50)).alias("b"))
    return events.filter("event_type = 'click'").select("user_id", "event_id", "at"), ranges


@query(f"WITH {SPANS.replace('epoch(ts)::BIGINT', 'floor(epoch(ts))::BIGINT')} SELECT p.event_id, r.range_id FROM p JOIN r USING (user_id) WHERE a <= pos AND pos < b QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY b - a, range_id) = 1")
def covering_range(spark, sf):
    points, ranges = _spans(spark, sf)
    held = rel.range_join(points, ranges, ["user_id"], "at", "a", "b", width=7200)
    return rel.smallest_cover(held, ["event_id"], "a", "b", ["range_id"]).select("event_id", "range_id")


@query(f"WITH {SPANS.replace('epoch(ts)::BIGINT', 'floor(epoch(ts))::BIGINT')} SELECT r.range_id, count(*) AS n, min(p.event_id) AS first FROM p JOIN r USING (user_id) WHERE a <= pos AND pos <= b GROUP BY 1")
def comments_in_range(spark, sf):
    points, ranges = _spans(spark, sf)
    held = rel.range_join(points, ranges, ["user_id"], "at", "a", "b", width=7200, closed=True)
    return held.groupBy("range_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("""SELECT c_custkey, r_name || '/' || n_name || '/' || c_name AS path, dense_rank() OVER (PARTITION BY n_nationkey ORDER BY c_name) AS rank, dense_rank() OVER (PARTITION BY n_nationkey ORDER BY c_name) > 255 AS truncated
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def sibling_rank(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = joined.select("c_custkey", F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), F.col("n_nationkey").alias("parent"), F.col("c_name").alias("name"))
    return graph.sibling_ranks(named).select("c_custkey", "path", F.col("rank").cast("long").alias("rank"), "truncated")


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE starts_with(r_name || '/' || n_name || '/' || c_name, (SELECT r_name || '/' FROM region WHERE r_regionkey = 2))")
def prefix_query(spark, sf):
    region = table(spark, sf, "region").filter("r_regionkey = 2").first().r_name
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.filter(F.concat_ws("/", "r_name", "n_name", "c_name").startswith(f"{region}/")).select("c_custkey")


@query("SELECT p_partkey, lag(p_partkey) OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS shadowed FROM part QUALIFY shadowed IS NOT NULL")
def shadowed_binding(spark, sf):
    window = Window.partitionBy("p_brand", "p_name").orderBy("p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.lag("p_partkey").over(window).alias("shadowed")).filter("shadowed is not null")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def unused_binding(spark, sf):
    return graph.dangling(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", "doc_id")


@query()
def non_overlapping_fixes(spark, sf):
    """Events as edits of their user's lane; the greedy choice is sequential and has no SQL form."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    edits = table(spark, sf, "events").select("user_id", at.alias("start"), (at + 60 * (F.col("event_id") % 30)).alias("end"), F.col("event_type").alias("content"))
    return fixes.non_overlapping(edits, "user_id")


@query("SELECT DISTINCT p_name AS name FROM part WHERE regexp_matches(p_name, '(?i)r.*e.*d')")
def fuzzy_symbols(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_name").rlike(fuzzy_pattern("red"))).select(F.col("p_name").alias("name")).distinct()


@query("""WITH m AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS module FROM part), n AS (SELECT p_partkey, replace(p_name, ' ', '.') || '.x' AS name FROM part)
SELECT p_partkey, module FROM n LEFT JOIN m ON split_part(name, '.', 1) = module""")
def longest_prefix_import(spark, sf):
    part = table(spark, sf, "part")
    modules = part.select(F.split("p_name", " ")[0].alias("module")).distinct()
    names = part.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".x")).alias("name"))
    return graph.longest_prefix(names, modules).select("p_partkey", "module")


@query("SELECT c_custkey, arg_min(s_suppkey, s_suppkey) AS s_suppkey FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey GROUP BY 1")
def search_path_priority(spark, sf):
    files = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey")
    return graph.first_on_path(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), files, "c_nationkey", "s_suppkey").select("c_custkey", "s_suppkey")


@query("""WITH f AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL)
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN f.n = 1 THEN 'CALLS_NAMED' ELSE 'UNRESOLVED_CALL' END AS kind FROM lineitem JOIN part p ON l_partkey = p_partkey LEFT JOIN f ON f.p_brand = 'Brand#11' AND f.p_name = p.p_name) GROUP BY 1""")
def named_calls(spark, sf):
    """Sold parts as calls of a name in one model, resolved where one part of the brand bears it."""
    part = table(spark, sf, "part")
    calls = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.lit("Brand#11").alias("model"), F.col("p_name").alias("name"))
    functions = part.select(F.col("p_brand").alias("model"), F.col("p_name").alias("name"))
    return graph.named_calls(calls, functions).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'r' || r_regionkey AS node, NULL AS parent, 0 AS level, 'r' || r_regionkey AS path FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, 'r' || n_regionkey || '/n' || n_nationkey FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 2, 'r' || n_regionkey || '/n' || s_nationkey || '/s' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def ancestor_paths(spark, sf):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf, "nation").select(tag("n", "n_nationkey").alias("child"), tag("r", "n_regionkey").alias("parent"))
    edges = edges.unionByName(table(spark, sf, "supplier").select(tag("s", "s_suppkey").alias("child"), tag("n", "s_nationkey").alias("parent")))
    return graph.paths(edges, table(spark, sf, "region").select(tag("r", "r_regionkey").alias("node")), depth=4)


@query("""WITH a AS (SELECT n_nationkey, n_name FROM nation), b AS (SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name FROM nation)
SELECT 'left' AS side, * FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'right', * FROM (FROM b EXCEPT ALL FROM a)""")
def set_parity(spark, sf):
    """A store against itself read another way, in which one region's names are written differently: only these rows stand on one side."""
    nation = table(spark, sf, "nation")
    again = nation.select("n_nationkey", F.when(F.col("n_regionkey") == 1, F.lower("n_name")).otherwise(F.col("n_name")).alias("n_name")).repartition(3, "n_name")
    return rel.set_diff(nation.select("n_nationkey", "n_name"), again)

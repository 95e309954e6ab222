"""Editor questions, suppressions, models and incremental results on generated sources and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import incremental, models, navigate, rel, suppress
from quarry.plans.base import query, table
from quarry.plans.sourcecode import SMALL, files
from quarry.sources import python_source


def _nodes(spark, sf, kinds):
    return python_source.nodes(files(spark, sf), kinds)


def _kept(spark, sf, kinds):
    """Nodes for a question that reads them more than once: files are parsed once."""
    return rel.written(_nodes(spark, sf, kinds))


@query("SELECT 'parts/' || p_partkey || '.py' AS path, 'part_' || p_partkey AS name, 'function' AS kind, 5 AS row, 8 AS end_row FROM part")
def document_symbols(spark, sf):
    return navigate.document_symbols(_kept(spark, sf, navigate.SYMBOLS)).select("path", "name", "kind", "row", "end_row")


@query("SELECT 'part_' || p_partkey AS name FROM part WHERE regexp_matches('part_' || p_partkey, '(?i)p.*1.*7')")
def workspace_symbols(spark, sf):
    return navigate.workspace_symbols(_kept(spark, sf, navigate.SYMBOLS), "p17").select("name")


@query("""SELECT 'parts/' || p_partkey || '.py' AS path, name, row, def_row, def_kind FROM part, (VALUES ('x', 6, 5, 'argument'), ('sys', 8, 2, 'import')) v(name, row, def_row, def_kind)""")
def definitions(spark, sf):
    return navigate.definitions(_kept(spark, sf, python_source.NAMED)).select("path", "name", "row", "def_row", "def_kind")


@query("SELECT 'parts/' || p_partkey || '.py' AS path, name, token FROM part, (VALUES ('x', 'parameter'), ('sys', 'namespace')) v(name, token)")
def semantic_tokens(spark, sf):
    return navigate.semantic_tokens(_kept(spark, sf, python_source.NAMED)).select("path", "name", "token")


@query("SELECT 'parts/' || p_partkey || '.py' AS path, row, end_row FROM part, (VALUES (5, 8), (6, 7)) v(row, end_row)")
def folding_ranges(spark, sf):
    return navigate.folding_ranges(_nodes(spark, sf, navigate.FOLDED)).select("path", "row", "end_row")


@query("SELECT 'part_' || p_partkey AS name, 'def part_' || p_partkey || '(x)' AS signature FROM part")
def hover_signatures(spark, sf):
    return navigate.hover(_nodes(spark, sf, navigate.DEFINED)).select("name", "signature")


@query(f"""SELECT 'parts/' || p_partkey || '.py' AS path, 'import os  # noqa: F401' AS first, CASE WHEN {SMALL} THEN 'def part_' || p_partkey || '(x=[]):  # noqa: B006' ELSE 'def part_' || p_partkey || '(x):' END AS fifth,
CASE WHEN {SMALL} THEN 2 ELSE 1 END AS n FROM part""")
def noqa_added(spark, sf):
    """Files with suppression comments for what was found, by line."""
    from quarry.operators import lint

    of = files(spark, sf)
    rewritten = suppress.add_noqa(of, lint.check(of, {"F401", "B006"}))
    lines = F.split("text", "\n")
    return rewritten.select("path", F.get(lines, F.lit(0)).alias("first"), F.get(lines, F.lit(4)).alias("fifth"), "n")


@query("""WITH e AS (SELECT user_id, event_id, value, (event_id % 17)::INT AS old, length(event_type) AS new, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 100 AS start FROM events)
SELECT user_id, event_id, start + coalesce(sum(new - old) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_start FROM e""")
def shifted_positions(spark, sf):
    """Where each edit's text begins once all edits before it are applied."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) * 100
    edits = table(spark, sf, "events").select(F.col("user_id").alias("path"), "event_id", at.alias("start"), F.col("event_type").alias("content"))
    moved = suppress.shifted(edits.withColumn("end", F.col("start") + F.col("event_id") % 17))
    return moved.select(F.col("path").alias("user_id"), "event_id", F.col("new_start").cast("long").alias("new_start"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN NULL ELSE 'datetime' END AS type, CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN true END AS not_null FROM part""")
def column_types(spark, sf):
    """Parts as columns: the type of a constructor, null for one without, and what is said about nulls."""
    ctor = F.element_at(F.array(*map(F.lit, ("String", "Integer", "LargeBinary", "DateTime"))), F.col("p_size") % 4 + 1)
    found = table(spark, sf, "part").select(
        "p_partkey", ctor.alias("ctor"), F.when(F.col("p_size") % 3 == 0, False).alias("nullable"), (F.col("p_size") % 5 == 0).alias("primary_key"), F.lit(None).cast("string").alias("foreign_key"),
    )
    return models.columns(found).select("p_partkey", "type", "not_null")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'BelongsTo' WHEN s_suppkey % 3 = 1 THEN 'HasMany' WHEN ends_with(n_name, 'S') AND false THEN 'BelongsTo' ELSE 'HasMany' END AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def relationship_kinds(spark, sf):
    uselist = F.when(F.col("s_suppkey") % 3 == 0, False).when(F.col("s_suppkey") % 3 == 1, True)
    joined = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", models.cardinality(uselist, F.col("n_name")).alias("kind"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'form' WHEN 'O' THEN 'mutation' ELSE 'read' END AS action FROM orders""")
def route_actions(spark, sf):
    methods = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("GET"), F.lit("POST"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("POST")))
    return table(spark, sf, "orders").select("o_orderkey", models.action(methods).alias("action"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '://([^./]+)[.]', 1), ''), 'none') AS family FROM pages")
def page_families(spark, sf):
    return table(spark, sf, "pages").select("page_id", models.family(F.col("url"), r"://([^./]+)[.]").alias("family"))


@query("""SELECT doc_id, length(text)::INT AS n, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 3 THEN 'again' ELSE 'kept' END AS origin FROM documents""")
def incremental_results(spark, sf):
    """Results by digest: documents that changed or are new are analysed again, the others keep what is known."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    before = docs.filter("path % 11 <> 3").withColumn("text", F.when(F.col("path") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    analyse = lambda origin: lambda of: of.select("path", F.length("text").alias("n"), F.lit(origin).alias("origin"))
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    known = analyse("kept")(before).join(before.select("path", digest.alias("digest")), "path")
    return incremental.refresh(docs, known, analyse("again")).select(F.col("path").alias("doc_id"), "n", "origin")


@query("""WITH e AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'renamed' WHEN 'error' THEN 'deleted' ELSE 'changed' END AS kind, 'u' || user_id AS path, 'v' || (event_id % 50) AS target FROM events),
n AS (SELECT seq, 0 AS part, CASE WHEN kind = 'renamed' THEN 'deleted' ELSE kind END AS kind, path FROM e UNION ALL SELECT seq, 1, 'created', target FROM e WHERE kind = 'renamed')
SELECT path, arg_max(kind, (seq, part)) AS kind, false AS uncertain FROM n GROUP BY path""")
def file_states(spark, sf):
    """The last state of each path, renames taken as a deletion and a creation."""
    kind = F.when(F.col("event_type") == "signup", "renamed").when(F.col("event_type") == "error", "deleted").otherwise("changed")
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit("v"), (F.col("event_id") % 50).cast("string")).alias("target")
    )
    return incremental.state(incremental.normalised(events))

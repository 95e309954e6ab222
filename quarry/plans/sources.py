"""Sources and sinks on the driver's tables: written, read again and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import names
from quarry.operators import lines
from quarry.plans.base import query, table
from quarry.plans.facts import STAR, star
from quarry.plans.streams import shared_folder
from quarry.sources import triples


@query(STAR + "SELECT * FROM t")
def triples_round_trip(spark, sf):
    """The star's facts as JSON lines, checked line by line when read again."""
    folder = f"{shared_folder(spark)}/triples"
    triples.write_triples(star(spark, sf), folder)
    return triples.read_folder(spark, folder)[0]


@query(STAR + "SELECT DISTINCT p AS predicate, s AS subject, o AS object FROM t")
def rows_round_trip(spark, sf):
    """The facts as a tab-separated table with header lines, read again."""
    folder, columns = f"{shared_folder(spark)}/rows", ["predicate", "subject", "object"]
    rows = star(spark, sf).select(F.col("p").alias("predicate"), F.col("s").alias("subject"), F.col("o").alias("object"))
    triples.write_rows(rows, columns, folder, " ".join(columns))
    return triples.read_rows(spark, folder, columns, " ".join(columns))


@query("SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'missing field' WHEN event_type NOT IN ('view', 'click') THEN 'unknown predicate ' || event_type END AS error FROM events")
def triple_refusals(spark, sf):
    """Events as JSON lines, of which some have a field too few or a predicate outside the vocabulary."""
    value = F.get_json_object("props", "$.k").cast("double") / 100
    kind = F.when(F.col("event_type") == "view", "reads_field").when(F.col("event_type") == "click", "writes_field").otherwise(F.col("event_type"))
    record = F.to_json(F.struct(F.col("user_id").cast("string").alias("s"), kind.alias("p"), F.lit("o").alias("o"), F.lit(1.0).alias("f"), value.alias("c")))
    given = table(spark, sf, "events").select(F.col("event_id").alias("line_no"), record.alias("value"))
    return triples.checked(given).select(F.col("line_no").alias("event_id"), "error")


@query("""WITH x AS (SELECT user_id, 'p' || (event_id % 97) AS dst FROM events) SELECT DISTINCT 'u' || user_id AS src, dst FROM x""")
def imports_json(spark, sf):
    """Import lists as JSON objects, flattened to distinct edges."""
    edges = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("p"), (F.col("event_id") % 97).cast("string")).alias("dst"), "event_id")
    packed = edges.groupBy("src", (F.col("event_id") % 7).alias("part")).agg(F.collect_list("dst").alias("targets"))
    return triples.import_edges(packed.select(F.to_json(F.map_from_arrays(F.array("src"), F.array("targets"))).alias("json")))


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def receipt_cardinalities(spark, sf):
    """The counts that a receipt states, read back from its JSON."""
    made = triples.receipt(table(spark, sf, "events"), "event_type", version=1)
    parsed = made.select(F.from_json("receipt", "cardinalities map<string,bigint>")["cardinalities"].alias("m"))
    return parsed.select(F.explode("m").alias("kind", "n"))


@query("SELECT c_name AS name, regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9_]', '_', 'g'), '^([0-9])', '_\\1') AS ident, upper(c_mktsegment) = c_mktsegment AND lower(c_mktsegment) <> c_mktsegment AS shouted, ends_with(c_name, 'ies') OR (ends_with(c_name, 's') AND NOT ends_with(c_name, 'ss')) AS plural FROM customer")
def name_tests(spark, sf):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf, "customer").select(name.alias("name"), names.identifier(name).alias("ident"), names.is_cased_uppercase(segment).alias("shouted"), names.is_plural(name).alias("plural"))


@query("""WITH p AS (SELECT page_id, regexp_replace(split_part(url, '://', 2), '[?#].*$', '') AS u FROM pages), s AS (SELECT page_id, list_filter(string_split(u, '/'), lambda x: x NOT IN ('', '.')) AS s FROM p)
SELECT page_id, CASE WHEN NOT list_contains(s, '..') AND len(s) > 0 THEN array_to_string(s, '/') END AS path FROM s""")
def inside_paths(spark, sf):
    path = F.regexp_replace(F.substring_index("url", "://", -1), "[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", names.inside(path).alias("path"))


@query()
def wide_lines(spark, sf):
    """Lines by their columns on screen; widths need a table of characters that SQL lacks."""
    found = lines.too_wide(lines.split_lines(table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("path"), "text"), "path", "text"), 320)
    return found.select("path", "line_no", "width")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, len(string_split(text, chr(10))) AS n FROM documents),
k AS (SELECT * FROM l WHERE line_no < n OR line <> '')
SELECT doc_id, line_no, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k""")
def line_index(spark, sf):
    """Lines with the byte offset at which each starts."""
    indexed = lines.lines(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return indexed.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start").cast("long").alias("start"))

"""Fact-store queries on the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.names import concept_key, fnv_hex, natural_key
from quarry.operators import families, order, rel, reports, triples
from quarry.plans.base import query, table

#: How event types stand for kinds of facts of a user's function. Fixed mapping of this demonstration.
KINDS = {"view": "reads_field", "click": "writes_field", "purchase": "calls", "error": "raises", "signup": "guarded_write"}

STAR = """
WITH t AS (
  SELECT 'r:' || r_regionkey AS s, 'rdf:type' AS p, 'Region' AS o, 1.0::DOUBLE AS f, 1.0::DOUBLE AS c FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'rdf:type', 'Nation', 1.0, 1.0 FROM nation
  UNION ALL SELECT 'n:' || n_nationkey, 'traverses_relation', 'r:' || n_regionkey, 1.0, 0.8 FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'rdf:type', 'Customer', 1.0, 1.0 FROM customer
  UNION ALL SELECT 'c:' || c_custkey, 'has_field', 'c:' || c_custkey || '.' || c_mktsegment, 1.0, 1.0 FROM customer
  UNION ALL SELECT 'c:' || c_custkey, 'traverses_relation', 'n:' || c_nationkey, 1.0, 0.8 FROM customer
  UNION ALL SELECT 'o:' || o_orderkey, 'depends_on', 'c:' || o_custkey, 1.0, 0.95 FROM orders)
"""


def star(spark: SparkSession, sf: str) -> DataFrame:
    """The star schema as facts."""

    def facts(name: str, s, p: str, o, c: float) -> DataFrame:
        return table(spark, sf, name).select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(1.0).alias("f"), F.lit(c).alias("c"))

    at = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    parts = [
        facts("region", at("r:", "r_regionkey"), "rdf:type", F.lit("Region"), 1.0),
        facts("nation", at("n:", "n_nationkey"), "rdf:type", F.lit("Nation"), 1.0),
        facts("nation", at("n:", "n_nationkey"), "traverses_relation", at("r:", "n_regionkey"), 0.8),
        facts("customer", at("c:", "c_custkey"), "rdf:type", F.lit("Customer"), 1.0),
        facts("customer", at("c:", "c_custkey"), "has_field", F.concat(at("c:", "c_custkey"), F.lit("."), "c_mktsegment"), 1.0),
        facts("customer", at("c:", "c_custkey"), "traverses_relation", at("n:", "c_nationkey"), 0.8),
        facts("orders", at("o:", "o_orderkey"), "depends_on", at("c:", "o_custkey"), 0.95),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _as_facts(events: DataFrame, subject: Column) -> DataFrame:
    """Events as facts: kind by event type, object by the tens of the value."""
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return events.select(subject.alias("s"), kinds[F.col("event_type")].alias("p"), F.concat(F.lit("v"), F.floor(F.col("value") / 10).cast("string")).alias("o"), "event_id")


def event_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as facts of users."""
    return _as_facts(table(spark, sf, "events"), F.concat(F.lit("u:"), F.col("user_id").cast("string")))


KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
FACTS = f"e AS (SELECT 'u:' || user_id AS s, {KIND_SQL} AS p, 'v' || floor(value / 10)::BIGINT AS o, event_id FROM events)"
DIMENSION = "dim(p, role) AS (VALUES " + ", ".join(f"('{p}', '{r}')" for p, _, roles in triples.PREDICATES for r in roles) + ")"


@query(STAR + "SELECT * FROM t")
def triples_star(spark, sf):
    return star(spark, sf)


@query(STAR + "SELECT p, count(*) AS n FROM t GROUP BY p")
def predicate_census(spark, sf):
    return triples.census(star(spark, sf))


@query(STAR + f", {DIMENSION} SELECT role, count(t.p) AS n FROM dim LEFT JOIN t USING (p) GROUP BY role")
def role_census(spark, sf):
    return triples.role_census(star(spark, sf), triples.predicates(spark))


@query(STAR + f", {DIMENSION} SELECT role FROM dim LEFT JOIN t USING (p) GROUP BY role HAVING count(t.p) = 0")
def absent_roles(spark, sf):
    return triples.absent_roles(star(spark, sf), triples.predicates(spark))


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def bad_triples(spark, sf):
    facts = table(spark, sf, "events").select("event_id", F.col("event_type").alias("p"))
    allowed = spark.createDataFrame([("view",), ("click",), ("purchase",)], "p string")
    return triples.unknown(facts, allowed).withColumnRenamed("p", "event_type")


@query("""SELECT DISTINCT p_type AS name, lower(regexp_replace(string_split(p_type, ':')[-1], '([\\p{Ll}0-9])(\\p{Lu})', '\\1_\\2', 'g')) AS concept FROM part
UNION SELECT DISTINCT p_brand, lower(regexp_replace(string_split(p_brand, ':')[-1], '([\\p{Ll}0-9])(\\p{Lu})', '\\1_\\2', 'g')) FROM part""")
def concept_keys(spark, sf):
    part = table(spark, sf, "part")
    names = part.select(F.col("p_type").alias("name")).union(part.select("p_brand")).distinct()
    return names.withColumn("concept", concept_key(F.col("name")))


BOOK = [(f"brand#{i}{j}", 256 * i + j) for i in (1, 3, 5) for j in range(1, 6)]
BOOK_SQL = "book(concept, class_id) AS (VALUES " + ", ".join(f"('{c}', {n})" for c, n in BOOK) + ")"


def _brands(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct()
    return triples.codebook(names, spark.createDataFrame(BOOK, "concept string, class_id int"))


@query(f"WITH {BOOK_SQL} SELECT DISTINCT p_brand AS name, class_id FROM part JOIN book ON lower(p_brand) = concept")
def codebook_bound(spark, sf):
    return _brands(spark, sf).filter("class_id is not null").select("name", "class_id")


@query(f"WITH {BOOK_SQL} SELECT DISTINCT p_brand AS name FROM part LEFT JOIN book ON lower(p_brand) = concept WHERE class_id IS NULL")
def codebook_unbound(spark, sf):
    return _brands(spark, sf).filter("class_id is null").select("name")


#: All events by user and day; a user's facts of all days hold every kind, so that the recipes of users would all be alike.
_FOLD = f"WITH {FACTS}, fn AS (SELECT s, " + ", ".join(
    f"coalesce(list_sort(list(DISTINCT o) FILTER (p = '{p}')), []) AS {name}"
    for name, p in [("reads", "reads_field"), ("writes", "writes_field"), ("guarded", "guarded_write"), ("calls", "calls"), ("raises", "raises")]
) + " FROM e GROUP BY s)"
FUNCTIONS = _FOLD.replace("'u:' || user_id AS s", "'u:' || user_id || '@' || strftime(ts, '%Y-%m-%d') AS s")
LADDER = (
    "CASE WHEN len(calls) > 0 AND len(raises) > 0 THEN 'Compensate' WHEN len(calls) > 0 THEN 'Cascade' WHEN len(raises) > 0 AND len(writes) = 0 THEN 'Guard' "
    "WHEN len(raises) > 0 THEN 'WriteRaise' WHEN len(writes) > 0 AND writes = guarded THEN 'Default' "
    "WHEN len(list_filter(writes, lambda w: NOT list_contains(reads, w))) > 0 THEN 'Compute' WHEN len(writes) > 0 THEN 'Normalize' WHEN len(reads) > 0 THEN 'Observe' ELSE 'Empty' END"
)


def _functions(spark, sf):
    """A user's day as a function of the facts of all its events."""
    day = F.concat(F.lit("u:"), F.col("user_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd"))
    return triples.classified(triples.group_functions(_as_facts(table(spark, sf, "events"), day)))


@query(FUNCTIONS + " SELECT s, " + ", ".join(f"array_to_string({c}, ',') AS {c}" for c in ("reads", "writes", "guarded", "calls", "raises")) + " FROM fn")
def group_functions(spark, sf):
    return _functions(spark, sf).select("s", *[F.array_join(c, ",").alias(c) for c in ("reads", "writes", "guarded", "calls", "raises")])


@query(FUNCTIONS + f" SELECT {LADDER} AS recipe, count(*) AS n FROM fn GROUP BY 1")
def recipe_histogram(spark, sf):
    return families.histogram(_functions(spark, sf), "recipe")


@query(FUNCTIONS + f""", r AS (SELECT {LADDER} AS recipe FROM fn),
b AS (SELECT count(*) AS n, count(*) FILTER (recipe IN ('Default', 'Compute', 'Normalize', 'Guard')) AS n_good FROM r)
SELECT n, n_good, round(n_good * 100.0 / n, 4)::DOUBLE AS share, CASE WHEN n_good * 100.0 / n >= 85 THEN 'strong' WHEN n_good * 100.0 / n >= 50 THEN 'partial' ELSE 'weak' END AS verdict FROM b""")
def recipe_band(spark, sf):
    return triples.band(_functions(spark, sf))


@query(FUNCTIONS + f", r AS (SELECT s, {LADDER} AS recipe FROM fn) SELECT recipe, count(*) AS n, array_to_string(list_sort(list(s))[1:3], ',') AS examples FROM r GROUP BY recipe")
def recipe_census(spark, sf):
    return triples.recipe_census(_functions(spark, sf))


@query("SELECT l_orderkey, bool_and(l_returnflag IN ('A', 'R')) AS pure FROM lineitem GROUP BY l_orderkey")
def purity_fold(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag").isin("A", "R")).alias("pure"))


@query("""WITH a AS (SELECT o_orderstatus, count(*) AS n_left FROM orders GROUP BY 1),
b AS (SELECT o_orderstatus, count(*) AS n_right FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderstatus, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right, coalesce(n_left, 0) = coalesce(n_right, 0) AS conserved FROM a FULL JOIN b USING (o_orderstatus)""")
def conservation(spark, sf):
    orders = table(spark, sf, "orders")
    projected = orders.join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return rel.balance(orders, projected, ["o_orderstatus"])


@query("SELECT o_orderpriority, count(*) AS n FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def not_projected(spark, sf):
    lost = table(spark, sf, "orders").join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return families.histogram(lost, "o_orderpriority")


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events")
def event_lane(spark, sf):
    return order.lane(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.col("seq").cast("long").alias("seq"))


def _days(spark, sf):
    return table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


@query("""WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS seq FROM e),
m AS (SELECT user_id, day, min(seq) FILTER (event_type = 'view') AS min_a, max(seq) FILTER (event_type = 'view') AS max_a,
  min(seq) FILTER (event_type = 'purchase') AS min_b, max(seq) FILTER (event_type = 'purchase') AS max_b FROM s GROUP BY ALL)
SELECT user_id, day, CASE WHEN max_a < min_b THEN 'before' WHEN max_b < min_a THEN 'after' ELSE 'unknown' END AS relation FROM m""")
def order_relation(spark, sf):
    window = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    return order.relation(_days(spark, sf).withColumn("seq", F.row_number().over(window)), ["user_id", "day"], "event_type", "seq", "view", "purchase")


@query("""WITH lanes(lane) AS (VALUES ('view'), ('click'), ('purchase'), ('error'), ('signup'), ('refund'), ('logout'))
SELECT lane, count(event_type) AS n FROM lanes LEFT JOIN events ON event_type = lane GROUP BY lane""")
def lane_cardinalities(spark, sf):
    lanes = spark.createDataFrame([(x,) for x in ("view", "click", "purchase", "error", "signup", "refund", "logout")], "lane string")
    return order.per_lane(table(spark, sf, "events").select(F.col("event_type").alias("lane")), lanes)


@query("""WITH w AS (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents), c AS (SELECT word, lang, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
s AS (SELECT word, count(*) FILTER (n >= 5) AS n_corpora, sum(n)::BIGINT AS n FROM c GROUP BY word)
SELECT word, n_corpora, n, CASE WHEN n_corpora = 4 THEN 'generic' ELSE 'corpus_scoped' END AS kind FROM s WHERE n_corpora > 0""")
def corpus_support(spark, sf):
    words = table(spark, sf, "documents").select("lang", F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    return triples.support(words, ["word"], "lang", 4, 5)


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_names(spark, sf):
    return families.histogram(table(spark, sf, "part"), "p_name").filter("n > 1")


DOCS = "d AS (SELECT doc_id, lang, source, md5(coalesce(text, '')) AS digest, n_chars FROM documents)"


@query("SELECT lang, " + ", ".join(f"quantile_disc(n_chars, {s}) AS p{round(s * 100)}" for s in families.SHARES) + ", max(n_chars) AS max FROM documents GROUP BY lang")
def family_percentiles(spark, sf):
    return families.distribution(table(spark, sf, "documents"), "lang", "n_chars")


@query("""WITH g AS (SELECT DISTINCT p_brand, p_type, p_size % 5 AS size FROM part), s AS (SELECT p_brand, count(DISTINCT size) AS size FROM g GROUP BY 1),
h AS (SELECT p_brand, p_type, count(DISTINCT size) AS held FROM g GROUP BY 1, 2) SELECT p_brand, p_type FROM h JOIN s USING (p_brand) WHERE held = s.size""")
def family_setalgebra(spark, sf):
    parts = table(spark, sf, "part").select("p_brand", (F.col("p_size") % 5).alias("size_class"), "p_type")
    return families.common_parts(parts, "p_brand", "size_class", "p_type")


@query(f"WITH {DOCS} SELECT digest, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM d GROUP BY digest HAVING count(*) > 1")
def hash_collisions(spark, sf):
    members = table(spark, sf, "documents").select(F.col("doc_id").alias("member"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"))
    return families.collisions(members, "digest")


@query("SELECT p_type AS decorator, count(*) AS n FROM part GROUP BY 1")
def decorator_histogram(spark, sf):
    return families.histogram(table(spark, sf, "part").select(F.col("p_type").alias("decorator")), "decorator")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20")
def top_names(spark, sf):
    return families.top(table(spark, sf, "part"), "p_name", 20)


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), c AS (SELECT DISTINCT p_type FROM part), x AS (SELECT p_name, p_type, levenshtein(p_name, p_type) AS d FROM n, c)
SELECT p_name, arg_min(p_type, (d, p_type)) AS nearest, min(d)::INT AS distance FROM x GROUP BY p_name""")
def did_you_mean(spark, sf):
    part = table(spark, sf, "part")
    return families.nearest(part, part, "p_name", "p_type")


@query("""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS known FROM conversations),
x AS (SELECT word, known, levenshtein(word, known) AS d FROM n, c)
SELECT word, arg_min(known, (d, known)) AS nearest, min(d)::INT AS distance FROM x GROUP BY word""")
def nearest_words(spark, sf):
    """Every word of the benchmark with the nearest word of the conversations: near ones by shortened forms, the rest in blocks."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    asked, known = (table(spark, sf, name).select(words.alias(column)) for name, column in (("benchmark", "word"), ("conversations", "known")))
    return families.nearest(asked, known, "word", "known")


@query("SELECT n_nationkey, '{\"source\":{\"corpus\":\"star\",\"signature\":\"n:' || n_nationkey || '\"},\"fact_name\":\"/name\",\"fact_value\":\"' || base64(encode(n_name)) || '\"}' AS entry FROM nation")
def kythe_export(spark, sf):
    facts = table(spark, sf, "nation").select(
        "n_nationkey", F.lit("star").alias("corpus"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("signature"), F.lit("name").alias("fact"), F.col("n_name").alias("value")
    )
    entries = reports.kythe(facts).select("signature", "entry")
    return entries.select(F.substring("signature", 3, 20).cast("int").alias("n_nationkey"), "entry")


@query()
def fnv_digest(spark, sf):
    """FNV-1a digests of nation names; known answers are in the tests, for SQL has no unsigned wrap."""
    return table(spark, sf, "nation").select("n_name", fnv_hex(F.col("n_name")).alias("digest"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, n_name) AS setting, coalesce(CASE WHEN c_acctbal < 0 THEN c_acctbal END, n_nationkey::DOUBLE) AS limit_value FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def settings_merge(spark, sf):
    """Scalars of the narrower settings win, else those of the wider ones."""
    own = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("own"), F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")).alias("low"))
    wide = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return own.join(wide, "c_nationkey", "left").select("c_custkey", F.coalesce("own", "n_name").alias("setting"), F.coalesce("low", F.col("c_nationkey").cast("double")).alias("limit_value"))


REDIRECTS = [("view", "V001"), ("click", "C001"), ("purchase", "P001")]


@query("WITH r(old, code) AS (VALUES ('view', 'V001'), ('click', 'C001'), ('purchase', 'P001')) SELECT coalesce(code, event_type) AS code, count(*) AS n FROM events LEFT JOIN r ON event_type = old GROUP BY 1")
def redirect_codes(spark, sf):
    lookup = spark.createDataFrame(REDIRECTS, "event_type string, code string")
    renamed = table(spark, sf, "events").join(F.broadcast(lookup), "event_type", "left")  # a fixed list of redirects
    return families.histogram(renamed.select(F.coalesce("code", "event_type").alias("code")), "code")


@query("""WITH k AS (SELECT page_id, regexp_replace(split_part(url, '://', 2), '[?#].*$', '') AS module FROM pages),
m AS (SELECT page_id, module, len(string_split(module, '/')) AS distance, lower(regexp_replace(regexp_replace(module, '([0-9]+)', '000000000000\\1', 'g'), '0*([0-9]{12})([^0-9]|$)', '\\1\\2', 'g')) AS k FROM k)
SELECT page_id, module, row_number() OVER (PARTITION BY distance ORDER BY k, module, page_id) AS place FROM m""")
def isort_order(spark, sf):
    """Modules in import order within their distance: natural lower-case name, name, then the id."""
    module = F.regexp_replace(F.substring_index("url", "://", -1), "[?#].*$", "")
    keyed = table(spark, sf, "pages").select("page_id", module.alias("module"))
    keyed = keyed.withColumn("distance", F.size(F.split("module", "/"))).withColumn("k", F.lower(natural_key(F.col("module"))))
    return rel.ranked(keyed, ["distance"], ["k", "module", "page_id"], "place").select("page_id", "module", "place")


@query("""WITH m AS (SELECT DISTINCT 'p' || l_partkey AS target, 's' || l_suppkey AS function FROM lineitem),
r AS (SELECT DISTINCT 's' || s_suppkey AS function, 'n' || s_nationkey AS source FROM supplier UNION SELECT DISTINCT 's' || s_suppkey, 'b' || (s_suppkey % 7) FROM supplier)
SELECT target, function, string_agg(source, ',' ORDER BY source) AS sources FROM m JOIN r USING (function) GROUP BY ALL""")
def field_provenance(spark, sf):
    """Parts as fields that suppliers emit from what they read."""
    return _provenance(spark, sf, table(spark, sf, "lineitem"))


def _provenance(spark: SparkSession, sf: str, lines: DataFrame) -> DataFrame:
    from quarry.operators import navdigest

    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    made = lines.select(tag("p", "l_partkey").alias("s"), F.lit("emitted_by").alias("p"), tag("s", "l_suppkey").alias("o"))
    supplier = table(spark, sf, "supplier")
    read = supplier.select(tag("s", "s_suppkey").alias("s"), F.lit("reads_field").alias("p"), tag("n", "s_nationkey").alias("o"))
    more = supplier.select(tag("s", "s_suppkey").alias("s"), F.lit("reads_field").alias("p"), F.concat(F.lit("b"), (F.col("s_suppkey") % 7).cast("string")).alias("o"))
    found = navdigest.provenance(made.unionByName(read).unionByName(more))
    return found.select("target", "function", F.array_join("sources", ",").alias("sources"))


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'system') AS s FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN s > 0 THEN 'report' WHEN a > 0 AND u <= a THEN 'list' WHEN u > 0 THEN 'form' ELSE 'empty' END AS purpose FROM c""")
def screen_purposes(spark, sf):
    """Conversations as screens, their turns as controls by role."""
    from quarry.operators import navdigest

    kind = F.when(F.col("role") == "user", "input").when(F.col("role") == "assistant", "grid").when(F.col("role") == "system", "chart")
    return navdigest.purposes(table(spark, sf, "conversations").select(F.col("conv_id").alias("screen"), kind.alias("kind"))).withColumnRenamed("screen", "conv_id")

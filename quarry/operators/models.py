"""Models, columns, relationships and routes found in class and function definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import is_plural

#: Column constructors and their field types; others have none. Fixed values.
FIELD_TYPES = {
    "String": "string", "Unicode": "string", "Text": "text", "Integer": "integer", "BigInteger": "big_integer", "Boolean": "boolean",
    "DateTime": "datetime", "Date": "date", "Numeric": "numeric", "Float": "float",
}
WRITES = ["POST", "PUT", "DELETE", "PATCH"]


def is_model(bases: Column, assigned: Column) -> Column:
    """A class is a model if a base starts with ``models.`` or is ``db.Model``, or if it sets its model name or parent."""
    return F.exists(bases, lambda b: b.startswith("models.") | (b == "db.Model")) | F.arrays_overlap(assigned, F.array(F.lit("_name"), F.lit("_inherit")))


def field_type(constructor: Column) -> Column:
    pairs = [F.lit(x) for pair in FIELD_TYPES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), constructor)


def columns(found: DataFrame) -> DataFrame:
    """``found`` (model, name, ctor, nullable, primary_key, foreign_key) with type and not_null; absence of a fact stays null."""
    not_null = F.when(F.coalesce("primary_key", F.lit(False)) | (F.col("nullable") == F.lit(False)), F.lit(True))
    return found.withColumn("type", field_type(F.col("ctor"))).withColumn("not_null", not_null)


def cardinality(uselist: Column, backref: Column) -> Column:
    """BelongsTo or HasMany: what the declaration says, else what the name of the other side suggests."""
    return (
        F.when(uselist == F.lit(False), "BelongsTo").when(uselist, "HasMany")
        .when(backref.isNotNull() & is_plural(backref), "BelongsTo").when(backref.isNotNull(), "HasMany").otherwise("BelongsTo")
    )


def associations(relationships: DataFrame, cols: DataFrame) -> DataFrame:
    """Relationships (model, name, uselist, backref) with the column ``<name>_id`` that holds their foreign key, if there is one."""
    keys = cols.filter("foreign_key is not null").select("model", F.col("name").alias("key"), "foreign_key")
    named = relationships.withColumn("key", F.concat("name", F.lit("_id"))).withColumn("kind", cardinality(F.col("uselist"), F.col("backref")))
    return named.join(keys, ["model", "key"], "left").select("model", "name", "kind", F.when(F.col("foreign_key").isNotNull(), F.col("key")).alias("key"), "foreign_key")


def action(methods: Column) -> Column:
    """What a route does by its methods: none given means GET."""
    known = F.coalesce(methods, F.array(F.lit("GET")))
    has = lambda m: F.array_contains(known, m)
    return F.when(has("POST") & has("GET"), "form").when(F.arrays_overlap(known, F.array(*map(F.lit, WRITES))), "mutation").otherwise("read")


def routes(functions: DataFrame) -> DataFrame:
    """Functions (path, name, decorators as array of struct<name, methods>) whose first route decorator counts."""
    first = F.get(F.filter("decorators", lambda d: d["name"].endswith(".route")), F.lit(0))
    found = functions.withColumn("route", first).filter("route is not null")
    return found.select("path", "name", F.coalesce(F.col("route.methods"), F.array(F.lit("GET"))).alias("methods"), action(F.col("route.methods")).alias("action"))


def matched(definitions: DataFrame, rules: DataFrame) -> DataFrame:
    """Definitions with the rules (rule, selector, kind, least_args) that one of their decorators meets.

    A rule for any decorator has the selector ``*``.
    """
    each = definitions.withColumn("d", F.explode("decorators"))
    wanted = rules.withColumnRenamed("kind", "rule_kind")
    meets = (F.col("kind") == F.col("rule_kind")) & (F.col("selector").isin("*") | (F.col("d.name") == F.col("selector")))
    both = each.join(F.broadcast(wanted), meets)  # a configured list of rules
    return both.filter("coalesce(d.n_args, 0) >= least_args").select("path", "name", "rule").distinct()


def family(path: Column, pattern: str | None = None) -> Column:
    """The named part of a path, else the file's stem."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.coalesce(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), stem) if pattern else stem

"""The event table as a stream of changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.operators import rel
from quarry.plans.base import query, table
from quarry.streaming import changes, refine

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def shared_folder(spark) -> str:
    """A folder of its own for a stream, in the one that driver and executors share."""
    return f"{rel.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def change_stream(spark, sf):
    """The last change of each user, kept by a stream that takes what has arrived and stops."""
    folder = shared_folder(spark)
    last = changes.latest(changes.stream(spark, f"{sf}/events.parquet*", EVENTS), "user_id", "ts", ["event_id", "event_type"])
    changes.run_once(last, f"{folder}/state", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/state").select("user_id", "ts", "event_type", "event_id")


#: Events of users as changes of a path, forgotten after two days without one.
TTL = 172_800
REFINED_SQL = f"""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'created_file' WHEN event_type = 'signup' THEN 'created_folder' WHEN event_type = 'error' THEN 'deleted'
WHEN event_id % 23 = 0 THEN 'rescan' ELSE 'changed' END AS kind FROM events),
g AS (SELECT *, coalesce(ts - lag(ts) OVER l > INTERVAL {TTL} SECOND, false)::INT AS gap FROM e WINDOW l AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g),
k AS (SELECT *, last_value(CASE WHEN kind <> 'changed' THEN kind END IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM r)
SELECT user_id::VARCHAR AS key, event_id AS seq, CASE WHEN kind <> 'deleted' THEN kind WHEN known = 'created_file' THEN 'deleted_file' WHEN known = 'created_folder' THEN 'deleted_folder' ELSE 'deleted_unknown' END AS kind FROM k"""


def _changes(events):
    kind = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), "created_file").when(F.col("event_type") == "signup", "created_folder")
    kind = kind.when(F.col("event_type") == "error", "deleted").when(F.col("event_id") % 23 == 0, "rescan").otherwise("changed")
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind.alias("kind"))


@query(REFINED_SQL)
def refined_stream(spark, sf):
    """Deletions told apart by a stream that keeps state by path."""
    folder = shared_folder(spark)
    refine.run_once(_changes(changes.stream(spark, f"{sf}/events.parquet*", EVENTS)), TTL, f"{folder}/refined", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/refined").select("key", "seq", "kind")


@query(REFINED_SQL)
def refined_batch(spark, sf):
    """The same by windows over all events."""
    return refine.batch(_changes(table(spark, sf, "events")), TTL)

"""Relational helpers that Spark has no single operator for."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; on one machine (tests) a temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = getattr(shared_folder, "own", None)
        if not folder:
            folder = shared_folder.own = f"file://{tempfile.mkdtemp(prefix='quarry-tables-')}"
            atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration: a reliable checkpoint in spark.checkpoint.dir.

    Where the setting is absent (tests), the session's checkpoint folder is a temporary one.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder, of which later plans read only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows dealt out over all cores, evenly or ``by`` columns, for work that is heavy beside the bytes it reads: a small file is one task, whatever is done with its rows."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4, *by)


def with_earlier_blocks(rows: DataFrame, by: list[str], per_block: Column, fold, name: str) -> DataFrame:
    """``rows`` (with ``_block``) with ``name``: ``fold`` of the aggregate ``per_block`` over the earlier blocks of the same ``by``, null in the first."""
    blocks = rows.groupBy(*by, "_block").agg(per_block.alias(name))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn(name, fold(name).over(earlier)).alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_block"]]
    return rows.alias("a").join(carried, reduce(and_, same)).select("a.*", f"b.{name}")


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their number from 1 within ``by``, in ``order``.

    Rows are dealt in ranges of both and numbered within a range; the counts of the earlier ranges are added, so that no group has to be sorted by one task.
    """
    ranged = cut(rows.repartitionByRange(*by, *order).withColumn("_block", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(*order)) + F.coalesce("_carried", F.lit(0))
    return with_earlier_blocks(ranged, by, F.count(F.lit(1)), F.sum, "_carried").withColumn(name, place.cast("long")).drop("_block", "_carried")


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], strict: bool = False) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or (``strict``) before each ``at``, within ``by``.

    One union and one window, so that no pair of rows is formed; of equal places in ``right`` the greatest values win.
    """
    rank = 1 if strict else -1
    first = left.select("*", *[F.lit(None).alias(f"_{v}") for v in values], F.lit(0).alias("_side"))
    filled = right.select(*by, at, *[F.col(v).alias(f"_{v}") for v in values], F.lit(rank).alias("_side"))
    both = first.unionByName(filled, allowMissingColumns=True)
    order = [F.col(at), F.col("_side"), *[F.col(f"_{v}").asc_nulls_first() for v in values]]
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    packed = F.when(F.col("_side") != 0, F.struct(*[F.col(f"_{v}").alias(v) for v in values]))
    last = F.last(packed, ignorenulls=True).over(window)
    found = both.withColumn("_last", last).filter("_side = 0")
    return found.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, end: str, width: int, closed: bool = False) -> DataFrame:
    """Points with the ranges [start, end) (``closed``: [start, end]) that hold them, within ``by``.

    Ranges are dealt out over buckets of ``width``, which makes an equi-join of it; choose the width near the usual range.
    """
    last = F.col(end) if closed else F.col(end) - 1
    spread = ranges.filter(F.col(start) <= last).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))
    placed = points.withColumn("_bucket", F.floor(F.col(at) / width))
    joined = placed.join(spread, [*by, "_bucket"])
    upper = F.col(at) <= F.col(end) if closed else F.col(at) < F.col(end)
    return joined.filter((F.col(at) >= F.col(start)) & upper).drop("_bucket")


def smallest_cover(held: DataFrame, point: list[str], start: str, end: str, ties: list[str]) -> DataFrame:
    """Of the ranges that hold a point the shortest one; ``ties`` make the order total."""
    window = Window.partitionBy(*point).orderBy(F.col(end) - F.col(start), *ties)
    return held.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def widest_cover(held: DataFrame, point: list[str], start: str, end: str, ties: list[str]) -> DataFrame:
    """Of the ranges that hold a point the longest one, the outermost of nested ranges; ``ties`` make the order total."""
    key = F.struct((F.col(start) - F.col(end)).alias("length"), *[F.col(t).alias(f"tie_{i}") for i, t in enumerate(ties)])
    rest = F.struct(*[c for c in held.columns if c not in point])
    return held.groupBy(*point).agg(F.min_by(rest, key).alias("r")).select(*point, "r.*")


def with_points(ranges: DataFrame, points: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """Ranges [start, end) in which some point lies: each range asks for the nearest point below its end, so that no pair of rows is formed."""
    below = points.select(*by, F.col(at).cast("double").alias("_at"), F.col(at).cast("double").alias("_found"))
    asked = ranges.withColumn("_at", F.col(end).cast("double"))
    return asof_backward(asked, below, by, "_at", ["_found"], strict=True).filter(F.col("_found") >= F.col(start)).select(ranges.columns)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """Rows reachable from ``seed``: ``step`` maps the rows found last to new ones, until none is new."""
    known = cut(seed.dropDuplicates(key))
    fresh = known
    while True:
        fresh = cut(step(fresh).dropDuplicates(key).join(known.select(*key), key, "left_anti"))
        if fresh.isEmpty():
            return known
        known = cut(known.unionByName(fresh))


def islands(df: DataFrame, by: list[str], order: str, breaks: Column) -> DataFrame:
    """``df`` with ``island``: runs of rows in which ``breaks`` does not hold, numbered within ``by``."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("island", F.sum(breaks.cast("int")).over(window))


def set_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of only one side, with the side they are on; equal bags give no row."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def balance(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Conservation: counts of both sides by family, and whether they agree; a family may miss on a side."""
    one = left.groupBy(*by).agg(F.count(F.lit(1)).alias("n_left"))
    two = right.groupBy(*by).agg(F.count(F.lit(1)).alias("n_right"))
    both = one.join(two, by, "full_outer").select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_left", "n_right")])
    return both.withColumn("conserved", F.col("n_left") == F.col("n_right"))


def assert_balanced(balanced: DataFrame, by: list[str]) -> DataFrame:
    """The balance again; reading it fails on the first family that is not conserved."""
    says = F.concat_ws(" ", F.lit("not conserved:"), *by, F.lit("has"), "n_left", F.lit("and"), "n_right")
    return balanced.withColumn("conserved", F.when(F.col("conserved"), F.lit(True)).otherwise(F.raise_error(says).cast("boolean")))

"""Edits: ordering, choosing compatible ones and applying them to texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.rel import cut, with_earlier_blocks
from quarry.shipping import ship

#: How safe a fix is, from shown only to safe. Fixed values.
APPLICABILITY = {"display_only": 0, "unsafe": 1, "safe": 2}


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits island by island, in order; one that starts before the last taken one's end is left. Only that end is kept between batches."""
    last = None
    for batch in batches:
        taken = []
        for start, end, fresh in zip(batch["start"], batch["end"], batch["_fresh"], strict=True):
            last = None if fresh else last
            # Insertions may touch the edit before them but not stand inside it.
            taken.append(last is None or start >= last)
            last = max(end, last or 0) if taken[-1] else last
        yield batch[taken].drop(columns="_fresh")


def non_overlapping(edits: DataFrame, key: str) -> DataFrame:
    """The edits of each text that can be applied together, chosen greedily from the front.

    Edits are dealt in ranges of (key, start), so that a text with very many is spread as well, and cut into islands: one begins where no earlier
    edit of the text reaches. The choice is sequential within an island only, and reads it as a sorted stream.
    """
    ship(edits.sparkSession)
    order = ["start", "end", "content"]
    ranged = cut(edits.repartitionByRange(key, *order).withColumn("_block", F.spark_partition_id()))
    reach = F.max(F.struct(F.col("end").isNull().alias("open"), F.col("end").alias("end")))
    earlier = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(reach.over(earlier), F.col("_carried"))
    fresh = before.isNull() | F.coalesce(~before["open"] & (F.col("start") >= before["end"]), F.lit(False))
    marked = cut(with_earlier_blocks(ranged, [key], reach, F.max, "_carried").withColumn("_fresh", fresh).drop("_carried"))
    begun = F.sum(F.col("_fresh").cast("long"))
    # Of equal edits the one that begins the island comes first.
    so_far = Window.partitionBy(key, "_block").orderBy(*order, F.desc("_fresh")).rowsBetween(Window.unboundedPreceding, 0)
    island = begun.over(so_far) + F.coalesce("_carried", F.lit(0))
    islands = with_earlier_blocks(marked, [key], begun, F.sum, "_carried").withColumn("_island", island)
    lanes = islands.repartition(key, "_island").sortWithinPartitions(key, "_island", *order, F.desc("_fresh"))
    return lanes.select(*edits.columns, "_fresh").mapInPandas(_choose, edits.schema)


def apply_edits(files: DataFrame, edits: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Texts with non-overlapping edits (start, end in characters, content) applied from the back."""
    listed = edits.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct("start", "end", F.coalesce("content", F.lit("")).alias("content"))))).alias("edits"))
    done = F.aggregate(
        "edits", F.col(text), lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"].cast("int")), e["content"], F.substring(t, (e["end"] + 1).cast("int"), F.length(t)))
    )
    return files.join(listed, key, "left").withColumn(text, F.when(F.col("edits").isNull(), F.col(text)).otherwise(done)).drop("edits")

"""Bundles of models by family with their indices, and what members of a family have together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered(found: DataFrame, family: str, line: str) -> DataFrame:
    """Members with their ``place`` in the bundle of their family: by line, of equal lines by ``seq``, the order they came in."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(family).orderBy(line, "seq")))


def index(members: DataFrame, key: str, member: str) -> DataFrame:
    """(key, n, first, last) of an inverted index; its lists are (key, member) rows, never one row of all members."""
    return members.groupBy(F.col(key).cast("string").alias("key")).agg(F.countDistinct(member).alias("n"), F.min(member).alias("first"), F.max(member).alias("last"))


def indices(members: DataFrame, keys: list[str], member: str) -> DataFrame:
    """The indices of several keys, with the name of the key."""
    found = [index(members, k, member).select(F.lit(k).alias("index"), "key", "n", "first", "last") for k in keys]
    whole = found[0]
    for one in found[1:]:
        whole = whole.unionByName(one)
    return whole


def manifest(members: DataFrame, family: str, member: str) -> DataFrame:
    """(family, n): how many members the bundle of each family has; the sum is that of the input."""
    return members.groupBy(family).agg(F.count(member).alias("n"))


def write(members: DataFrame, family: str, path: str) -> None:
    """JSON lines in a folder per family."""
    members.write.partitionBy(family).json(path)


def together(members: DataFrame, member: str, part: str) -> DataFrame:
    """(a, b, n): parts that n members have both of, a before b. A member's distinct parts are few: its marks, not its rows."""
    held = members.groupBy(member).agg(F.array_sort(F.collect_set(part)).alias("parts"))
    firsts = held.select(F.posexplode("parts").alias("i", "a"), "parts")
    pairs = firsts.select("a", F.explode(F.expr("slice(parts, i + 2, size(parts))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def first_seen(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """One row per name: the first in ``order``."""
    return rows.groupBy(name).agg(F.min_by(F.struct(*[c for c in rows.columns if c != name]), F.struct(*order)).alias("r")).select(name, "r.*")


def preservation(rows: DataFrame, kept: str, by: str) -> DataFrame:
    """(by, n, n_kept, ratio): the share of each family's rows that a projection keeps."""
    counted = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(kept)).alias("n_kept"))
    return counted.withColumn("ratio", F.round(F.col("n_kept") / F.col("n"), 4))


def ratified(proposed: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Proposals with the state ``ratified`` where the known table has them and ``proposed`` where it has not."""
    told = known.select(*key, F.lit(True).alias("_known")).distinct()
    return proposed.join(told, key, "left").withColumn("state", F.when(F.col("_known"), "ratified").otherwise("proposed")).drop("_known")


#: Digits that hold any rank of 64 bits in base 255.
PLACES = 8


def digits(rank, base: int = 255):
    """A rank from 1 as digits from 1 to ``base``, the highest first, joined by dots; as many as it needs."""

    def place(a, _):
        low = F.pmod(a["rest"] - 1, F.lit(base))
        text = F.concat((low + 1).cast("string"), F.when(a["text"] == "", F.lit("")).otherwise(F.concat(F.lit("."), a["text"])))
        return F.when(a["rest"] > 0, F.struct(((a["rest"] - 1 - low) / base).cast("long").alias("rest"), text.alias("text"))).otherwise(a)

    start = F.struct(rank.cast("long").alias("rest"), F.lit("").alias("text"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PLACES)), start, place, lambda a: F.when(rank.isNotNull(), a["text"]))

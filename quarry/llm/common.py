"""Shared helpers of the training-data operators.

Words come in two kinds, as the queries ask for them:

* space words, ``[^\\x20\\x09-\\x0D]+``: on UTF-8 bytes exactly ``bytes.split()``;
* plain words, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: on UTF-8
  bytes the runs of ``0-9 a-z`` and bytes above 127.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.shipping import ship

SPACE_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table that lower-cases A-Z and turns all but plain word bytes into spaces.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space."""
    return text.lower().split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset on one machine (tests) a temporary folder of this process is used and removed at exit; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(shared_dir, "own", None)
        if not found:
            path = tempfile.mkdtemp(prefix="quarry-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            found = shared_dir.own = f"file://{path}"
    return found.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again.

    A written table outlives lost executors, and its size is known to the planner, so that small
    sides are broadcast and large ones are not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with this package present on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_mod(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)

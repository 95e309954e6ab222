"""A filter of identifiers per file, kept beside its digest, by which files are skipped before they are parsed.

``filters`` stores for each file a Bloom filter of its identifiers, sized by their number: a file without a name is told with certainty, one with it is never missed, and a file is kept
in vain about once in a hundred times per name. ``candidates`` asks the filters on the JVM, so neither texts nor Python are read for the files that are skipped.
A null text has no identifiers. Names are compared as they stand, without normalisation.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.shipping import ship

IDENTIFIER = re.compile(r"[^\W\d]\w*")
#: Bits set per identifier, and bits kept per identifier.
HASHES, BITS = 7, 10
FILTER = "path string, digest string, n_names int, bits int, words array<long>"


def _hashes(name: bytes) -> tuple[int, int]:
    """Two hashes of a name; the second is odd."""
    return zlib.crc32(name), zlib.crc32(name, 0x9E3779B9) | 1


def _filter(text: str) -> tuple[int, int, list[int]]:
    names = {x.encode() for x in IDENTIFIER.findall(text)}
    bits = 64 * (1 + len(names) * BITS // 64)
    hashes = np.array([_hashes(x) for x in names], np.int64).reshape(-1, 2)
    places = (hashes[:, :1] + np.arange(HASHES) * hashes[:, 1:]) % bits
    flags = np.zeros(bits, np.uint8)
    flags[places.ravel()] = 1
    return len(names), bits, np.packbits(flags, bitorder="little").view("<i8").tolist()


def filters(files: DataFrame) -> DataFrame:
    """(path, digest, n_names, bits, words) of files (path, text); the digest is of the text, null counting as empty."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_filter(t or "") for t in batch.column("text").to_pylist()]
            n, bits, words = zip(*made, strict=True) if made else ((), (), ())
            arrays = [batch.column("path"), batch.column("digest"), pa.array(n, pa.int32()), pa.array(bits, pa.int32()), pa.array(words, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["path", "digest", "n_names", "bits", "words"])

    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return files.select("path", digest.alias("digest"), "text").mapInArrow(run, FILTER)


def might_hold(name: str) -> Column:
    """Whether a file's filter allows for a name."""
    first, step = _hashes(name.encode())
    held = F.lit(True)
    for i in range(HASHES):
        place = (F.lit(first + i * step).cast("long") % F.col("bits")).cast("int")
        held = held & (F.getbit(F.get("words", F.floor(place / 64).cast("int")), place % 64) == 1)
    return held


def candidates(stored: DataFrame, names: list[str]) -> DataFrame:
    """(path, digest, names): files that may hold some of the names, with those."""
    asked = [F.when(might_hold(n), F.lit(n)) for n in dict.fromkeys(names)]
    found = F.array_compact(F.array(*asked)) if asked else F.array().cast("array<string>")
    return stored.select("path", "digest", found.alias("names")).where(F.size("names") > 0)


def files_to_parse(files: DataFrame, stored: DataFrame, names: list[str]) -> DataFrame:
    """``files`` (path, text) that have to be parsed for the names: those whose filter allows for one, and those whose text has changed since it was made."""
    now = files.withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    known = stored.select("path", "digest", F.lit(True).alias("_known")).distinct()
    kept = candidates(stored, names).select("path", "digest", F.lit(True).alias("_kept")).distinct()
    joined = now.join(known, ["path", "digest"], "left").join(kept, ["path", "digest"], "left")
    return joined.where("_known is null or _kept").select(files.columns)

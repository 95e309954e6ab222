"""Source trees: texts with digests, notebooks, inline metadata, include and exclude patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.names import FNV_BASIS, FNV_PRIME, fnv_hex
from quarry.shipping import ship

#: Folders of a tree that hold no sources of their own. Fixed values.
SKIPPED = [".archive", "__pycache__", "tests", "venv", ".venv", "node_modules", ".git"]


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ** over folders, * and ? within a name."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^(?:{out})$"


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a path is in: some include pattern holds and no exclude pattern does."""
    any_of = lambda globs: path.rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)
    return any_of(include) & ~any_of(exclude)


def read_tree(spark: SparkSession, root: str, suffix: str = "py", skip: list[str] | None = None) -> DataFrame:
    """(path, text, error) of a tree's files: path relative to the root; text null and error set where it is not UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    relative = F.regexp_replace("path", "^.*?" + re.escape(root.split("://")[-1].rstrip("/")) + "/", "")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    named = files.select(relative.alias("path"), text.alias("text"))
    hidden = "(^|/)(" + "|".join(map(re.escape, SKIPPED if skip is None else skip)) + ")/" if skip != [] else "^$"
    return named.filter(~F.col("path").rlike(hidden)).withColumn("error", F.when(F.col("text").isNull(), "not UTF-8"))


def digests(files: DataFrame) -> DataFrame:
    return files.select("path", fnv_hex(F.col("text")).alias("fnv64"))


def _lanes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What each line does to a running FNV-1a state: state -> factor * state + added[lowest byte of the state], modulo 2**64.

    Exclusive or with a byte changes the lowest byte alone, by an amount that depends on it alone; so 256 lanes, one per lowest byte, tell all.
    """
    sizes = np.array([len(x) for x in lines])
    order = np.argsort(-sizes, kind="stable")
    data = np.zeros((len(lines), int(sizes.max(initial=0))), np.uint64)
    for i, k in enumerate(order.tolist()):
        data[i, : sizes[k]] = np.frombuffer(lines[k], np.uint8)
    alive = np.searchsorted(-sizes[order], -np.arange(1, data.shape[1] + 1), side="right")
    state = np.tile(np.arange(256, dtype=np.uint64), (len(lines), 1))
    for at, n in enumerate(alive.tolist()):
        state[:n] = (state[:n] ^ data[:n, at : at + 1]) * np.uint64(FNV_PRIME)
    factor = np.array([pow(FNV_PRIME, int(s), 2**64) for s in sizes[order]], np.uint64)
    added = state - factor[:, None] * np.arange(256, dtype=np.uint64)
    back = np.argsort(order, kind="stable")
    return factor[back], added[back]


def _after(factor: int, added: np.ndarray, then: int, more: np.ndarray) -> tuple[int, np.ndarray]:
    """One block's effect on the state, followed by another's."""
    lowest = (np.uint64(factor) * np.arange(256, dtype=np.uint64) + added) & np.uint64(255)
    return factor * then % 2**64, added * np.uint64(then) + more[lowest.astype(np.int64)]


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    factor, added, seen = 1, np.zeros(256, np.uint64), False
    with np.errstate(over="ignore"):
        for batch in batches:
            lines = batch.column("line").cast(pa.binary()).to_pylist()
            for at in range(0, len(lines), 500):
                seen = True
                for f, a in zip(*_lanes(lines[at : at + 500]), strict=True):
                    factor, added = _after(factor, added, int(f), a)
    if seen:
        block = [TaskContext.get().partitionId()]
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([factor.to_bytes(8, "little")]), pa.array([added.astype("<u8").tobytes()])], ["block", "factor", "added"])


def snapshot(files: DataFrame) -> DataFrame:
    """One digest over all files: FNV-1a of the sorted lines path, tab, digest, as if read one after the other.

    Lines are dealt in ranges of their order; a task gives what its range does to any running state (2 kB), and these are laid end to end. No row or task holds all lines; the
    driver holds one such row per task. Null paths and texts have no line; no lines give the digest of the empty text.
    """
    spark = files.sparkSession
    ship(spark)
    lines = digests(files).select(F.concat("path", F.lit("\t"), "fnv64", F.lit("\n")).alias("line")).where("line is not null")
    ranged = lines.repartitionByRange("line").sortWithinPartitions("line")
    blocks = ranged.mapInArrow(_block, "block int, factor binary, added binary").collect()
    state = FNV_BASIS
    for row in sorted(blocks, key=lambda r: r.block):
        state = (state * int.from_bytes(row.factor, "little") + int(np.frombuffer(row.added, "<u8")[state & 255])) % 2**64
    return spark.createDataFrame([(f"{state:016x}",)], "digest string")


def notebook_cells(files: DataFrame) -> DataFrame:
    """(path, cell, kind, text, start_row): cells of notebooks with the row each starts at when code cells are laid end to end."""
    shape = "cells array<struct<cell_type:string,source:array<string>>>"
    cells = files.select("path", F.posexplode(F.from_json("text", shape)["cells"]).alias("cell", "c"))
    named = cells.select("path", "cell", F.col("c.cell_type").alias("kind"), F.array_join("c.source", "").alias("text"))
    from pyspark.sql import Window

    code = named.filter("kind = 'code'").withColumn("rows", F.size(F.split("text", "\n", -1)))
    window = Window.partitionBy("path").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return code.withColumn("start_row", F.coalesce(F.sum("rows").over(window), F.lit(0)) + 1).drop("rows")


def script_metadata(text: Column) -> Column:
    """The TOML text of an inline script block, without its comment signs; null if a file has none."""
    block = F.regexp_extract(text, r"(?m)^# /// script\n((?:#(?: .*)?\n)+?)# ///$", 1)
    return F.when(block != "", F.regexp_replace(block, "(?m)^# ?", ""))


def source_type(path: Column) -> Column:
    return (
        F.when(path.endswith(".py") | path.endswith(".pyi") | path.endswith(".pyw"), F.when(path.endswith(".pyi"), "stub").otherwise("python"))
        .when(path.endswith(".ipynb"), "notebook").when(path.endswith(".toml"), "toml").when(path.endswith(".md"), "markdown").otherwise("other")
    )

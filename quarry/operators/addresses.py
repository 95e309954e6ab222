"""Addresses of memory operations in a block of three-address code, by the nearest write before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.rel import asof_backward


def base(a_space: Column, a: Column, b_space: Column, b: Column, bits: int = 32) -> Column:
    """The constant part of a sum: of two constants the sum modulo the word, of one that one, else none."""
    both = (a_space == "Const") & (b_space == "Const")
    return F.when(both, (a + b) % (1 << bits)).when(a_space == "Const", a).when(b_space == "Const", b)


def resolved(ops: DataFrame) -> DataFrame:
    """(block, idx, op, address) of loads and stores with a known address.

    ``ops`` has block, idx, op, dst_space, dst_offset, a_space, a_offset, b_space, b_offset, addr_space, addr_offset. A constant address is
    itself; a temporary's is the constant operand of the addition that wrote it last, and unknown after any other write.
    """
    memory = ops.filter("op in ('Load', 'Store') and addr_space is not null")
    fixed = memory.filter("addr_space = 'Const'").select("block", "idx", "op", F.col("addr_offset").alias("address"))
    asked = memory.filter("addr_space = 'Unique'").select("block", F.col("addr_offset").alias("temp"), "idx", F.col("op").alias("asked"))
    found = F.when(F.col("op") == "IntAdd", base(F.col("a_space"), F.col("a_offset"), F.col("b_space"), F.col("b_offset")))
    writes = ops.filter("dst_space = 'Unique'").select("block", F.col("dst_offset").alias("temp"), "idx", found.alias("address"))
    last = asof_backward(asked, writes, ["block", "temp"], "idx", ["address"], strict=True)
    return fixed.unionByName(last.filter("address is not null").select("block", "idx", F.col("asked").alias("op"), "address"))

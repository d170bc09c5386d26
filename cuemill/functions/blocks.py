"""Many small rows from one large one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are made of one copy of what they are made from.
BLOCK = 1024


def exploded(rows: DataFrame, n: Column, make: Callable[[Column, Column], Column], keep: list[str], of: list[str], name: str = "_x", block: int = BLOCK) -> DataFrame:
    """``keep`` and ``make(i, v)`` (as ``name``) for every i below ``n``; ``v`` has the columns ``of``.

    Spark copies what a row carries along for each row that is exploded from it: with a
    file's bytes and packets of a few bytes, that is the square of the file. Here the bytes
    are carried once a block, and held by a variable within it, since every read of a
    binary column copies it.
    """
    n, zero = n.cast("bigint"), F.lit(0).cast("bigint")
    blocks = rows.withColumn("_n", n).where("_n > 0").withColumn("_b", F.explode(F.sequence(zero, F.floor((F.col("_n") - 1) / block))))
    at = F.col("_b") * block
    numbers = F.sequence(at, F.least(at + block, F.col("_n")) - 1)
    made = F.transform(F.array(F.struct(*of, numbers.alias("_i"))), lambda v: F.transform(v["_i"], lambda i: make(i, v)))
    return blocks.select(*keep, F.explode_outer(F.get(made, F.lit(0))).alias(name))

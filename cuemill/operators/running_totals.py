"""Running totals over groups of any length, spread over tasks.

A window over a stream puts the stream into one task. Here a group is cut into blocks by
its order: each block's total is known from one aggregation (combined before the shuffle),
a block begins with the totals of those before it, and the window runs within a block. One
shuffle of the rows, as with a plain window, but keyed by group and block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a block in the units of the order column.
BLOCK = 1 << 16


def running(rows: DataFrame, keys: list[str], order: str, totals: dict[str, Column], block: int = BLOCK, reverse: bool = False, combine: Callable[[Column], Column] = F.sum, inclusive: bool = False, ties: list[Column] | None = None) -> DataFrame:
    """Adds running ``totals`` (name -> what is added up) per ``keys`` in the order of a whole-number column.

    Totals are of the rows before (behind, if ``reverse``) each one, or with it if
    ``inclusive``; the first has null for none. ``combine`` may be any aggregate that
    combines its own results (sum, max, min). Rows of equal order are ranked by ``ties``.
    Null keys are groups of their own; a null order comes first, in a block of its own.
    """
    at = F.floor(F.col(order) / block)
    rows = rows.withColumn("_block", at)
    each = rows.withColumns({f"_of_{n}": c for n, c in totals.items()})
    sums = each.groupBy(*keys, "_block").agg(*[combine(F.col(f"_of_{n}")).alias(f"_sum_{n}") for n in totals])
    by_block = F.desc_nulls_last("_block") if reverse else F.asc_nulls_first("_block")
    before = Window.partitionBy(*keys).orderBy(by_block).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_k_block"), *[combine(F.col(f"_sum_{n}")).over(before).alias(f"_base_{n}") for n in totals])
    same = F.col("_block").eqNullSafe(F.col("_k_block"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = each.join(bases, same)
    by_order = F.desc_nulls_last(order) if reverse else F.asc_nulls_first(order)
    within = Window.partitionBy(*keys, "_block").orderBy(by_order, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    both = {n: _both(combine, F.col(f"_base_{n}"), combine(F.col(f"_of_{n}")).over(within)) for n in totals}
    return joined.select(*[c for c in rows.columns if c != "_block" and c not in totals], *[c.alias(n) for n, c in both.items()])


def _both(combine: Callable[[Column], Column], a: Column, b: Column) -> Column:
    """Two partial results as one."""
    if combine is F.sum:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return F.greatest(a, b) if combine is F.max else F.least(a, b)

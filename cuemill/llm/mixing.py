"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words: its weight's part of the whole, never more than a
set multiple of what it has, the excess going to the other sources by weight. A document's
expected copies are target over source size; the whole part is taken for certain, the rest
is the inclusion probability p of one more copy. Those copies are drawn by order sampling:
every document has the ranking value [u / (1 - u)] / [p / (1 - p)] with its own lasting
random u, and of each source those with the smallest values are taken until the words
reach what the whole copies leave open.

The cut in each source's ranking is found by counting words in ranges of the ranking
value, twice, so that no source is ever sorted or collected as a whole: only the last
range, about one part in 16 million of a source, is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Ranges on each of the two levels.
RANGES = 4096
WORDS = r"[^ \t-\r]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source.

    Resharing the excess until no source is above its limit ends where every source gets
    the smaller of its limit and one common level times its weight; the level is found by
    going through the sources in the order in which they reach their limits.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(kinds, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    rows = rows.select(
        "*",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full_size"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("full_weight"),
        F.sum("source_size").over(everyone).alias("all_size"),
        F.sum("weight").over(everyone).alias("all_weight"),
    )
    level = (F.lit(share) * F.col("all_size") - F.lit(most) * F.col("full_size")) / (F.col("all_weight") - F.col("full_weight"))
    rows = rows.withColumn("level", level)
    open_ = F.min(F.when(F.col("level") * F.col("weight") <= F.lit(most) * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")).alias("s"))).over(everyone)
    return rows.select("source", "source_size", F.least(F.lit(most) * F.col("source_size"), F.coalesce(open_["level"], F.lit(float("inf"))) * F.col("weight")).alias("target"))


def lasting_random(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends only on the key and the seed: 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def place(u: Column, p: Column) -> Column:
    """Pareto ranking value z = odds(u) / odds(p), folded into (0, 1) as z / (1 + z)."""
    z = (u * (F.lit(1.0) - p)) / ((F.lit(1.0) - u) * p)
    return z / (F.lit(1.0) + z)


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for every row, and the columns to ``carry``.

    A row's size is its number of words (null text: 0); a null source is a source of its
    own, last in order. ``taken`` is ``copies`` times the size. Wordless documents get only
    the certain copies. A source without words, or a table without rows, has the target 0.
    Rows that repeat an id share its random number and are ranked by size, then text hash;
    so do rows with a null id, all of which are ranked in one window where they cross a
    source's line: meant for tables in which ids are mostly distinct. Other columns are not
    looked at but for those to carry, whose names must not be among the result's.
    """
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"), *carry), "mixing")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialise(targets(sizes, share, most, weights), "mixing-targets")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sure = F.floor(expected)
    plan = plan.select(F.struct("source").alias("s"), "source_size", "target", sure.cast("long").alias("sure"), (expected - sure).alias("p"), (F.col("target") - sure * F.col("source_size")).alias("open"))

    ranked = rows.withColumn("s", F.struct("source")).join(plan, "s")
    ranked = ranked.withColumn("place", F.when((F.col("p") > 0) & (F.col("size") > 0), place(lasting_random(F.col("doc_id"), seed), F.col("p"))))
    ranked = ranked.withColumn("range", F.floor(F.col("place") * RANGES)).withColumn("part", F.floor(F.col("place") * (RANGES * RANGES)))

    outer = _cut(ranked.where("place is not null"), ["s"], "range", "open")
    first = ranked.join(outer, "s", "left")
    inner = _cut(first.where("range = cut"), ["s"], "part", "left_open")
    second = first.join(inner.withColumnRenamed("cut", "part_cut").withColumnRenamed("left_open", "last_open"), "s", "left")
    last = second.where("part = part_cut").withColumn("sum", F.sum("size").over(Window.partitionBy("s").orderBy("place", F.col("doc_id").asc_nulls_last(), "size", "tie").rowsBetween(Window.unboundedPreceding, 0)))
    # the document that crosses the line is taken if that comes nearer to it
    drawn_last = last.withColumn("drawn", F.col("sum") - F.col("size") / 2 <= F.col("last_open"))
    drawn = (F.col("part") < F.col("part_cut")) | (F.col("range") < F.col("cut")) | F.col("cut").isNull()
    others = second.where("part is null or part_cut is null or part != part_cut").withColumn("drawn", F.when(F.col("place").isNull(), False).otherwise(drawn))
    both = others.unionByName(drawn_last.select(*others.columns))
    copies = F.col("sure") + F.col("drawn").cast("long")
    return both.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *carry)


def _cut(rows: DataFrame, keys: list[str], ranges: str, open_: str) -> DataFrame:
    """For each key the range in which its open words run out, and what is open at its start; no row if all fits."""
    sums = rows.groupBy(*keys, ranges).agg(F.sum("size").alias("words"), F.max(open_).alias("most"))
    run = F.sum("words").over(Window.partitionBy(*keys).orderBy(ranges).rowsBetween(Window.unboundedPreceding, 0))
    over = sums.withColumn("run", run).where(F.col("run") > F.col("most"))
    first = over.groupBy(*keys).agg(F.min(F.struct(F.col(ranges).alias("cut"), (F.col("most") - (F.col("run") - F.col("words"))).alias("left_open"))).alias("x"))
    return first.select(*keys, "x.cut", "x.left_open")

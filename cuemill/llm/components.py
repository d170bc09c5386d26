"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def _star(links: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours: ``u, m``."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_star(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    """Links already point from the larger to the smaller node."""
    star = _star(links)
    onto = links.join(star, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onto.unionByName(star.select("u", F.col("m").alias("v")))


def _clean(links: DataFrame) -> DataFrame:
    return links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(links: DataFrame):
    """Row count and an order-free checksum, to see whether a round changed anything."""
    return links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links(u, v)``; root is its component's smallest node.

    Rounds work on tables only (minimum per node, joins on the node), so a node with very
    many links is aggregated map-side and split by the adaptive join. Every round is
    written to the shared folder. Empty input gives an empty result; self-links vanish,
    and a node with nothing else is not listed.
    """
    now = materialise(_clean(links), "components")
    mark = _mark(now)
    for _ in range(most_rounds):
        now = materialise(_clean(_small(_clean(_large(now)))), "components")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

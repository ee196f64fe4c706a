"""Connected components of a table of links, by alternating large and small stars.

Each round reads a written table of links and writes the next, so nothing is gathered on the driver
and a lost executor costs one round at most. A node with very many links is pre-aggregated before the
shuffle, and its join can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.storage import written


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links with the larger node first, stored."""
    ends = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return written(ends.where("u <> v").distinct(), "links")


def _open(links: DataFrame) -> bool:
    """Whether a node has two links to smaller ones, or has one and is itself the smaller of another."""
    up = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up > 0 and up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of the links (u, v); the label is the smallest node reachable."""
    return _labels(_ordered(links))


def _labels(links: DataFrame) -> DataFrame:
    while _open(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("c"), F.least("m", "u").alias("m")
        )
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(least, F.col("u") == F.col("c")).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        links = written(small, "links")
    ends = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(ends)


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) of ``components`` after more links (u, v), which join whole components."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    met = links.join(side("u"), "u", "left").join(side("v"), "v", "left")
    met = _ordered(met.select(F.coalesce("label_u", "u").alias("u"), F.coalesce("label_v", "v").alias("v")))
    if met.isEmpty():
        return labels
    joined = _labels(met)
    smaller = joined.select(F.col("node").alias("label"), F.col("label").alias("smaller"))
    moved = labels.join(smaller, "label", "left").select("node", F.coalesce("smaller", "label").alias("label"))
    return written(moved.unionByName(joined.join(labels, "node", "leftanti")), "labels")

"""Connected components of a table of links, by alternating large and small stars.

Each round is a few joins and partial aggregations over the remaining links
and ends in a written table; no link, node or component reaches the driver.
A node with very many links makes a skewed partition of a plain join: least
neighbours are written before they are joined, so that Spark can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

# Links go from the greater node (src) to the smaller one (dst).


def _least(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, least): the smallest neighbour below each node that has one."""
    return scratch.stage(links.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")))


def _large_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node's greater neighbours go to the smallest of its neighbours and itself."""
    out = links.join(_least(links, scratch), links["dst"] == F.col("node"), "left")
    return out.select("src", F.coalesce("least", "dst").alias("dst")).distinct()


def _small_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these."""
    out = links.join(_least(links, scratch), links["src"] == F.col("node"))
    return out.select(F.explode(F.array("src", "dst")).alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for nodes of ``links`` (src, dst) other than roots; the root is the smallest node.

    Repeated links, links of a node to itself and links in both directions are
    allowed, links with a null end are left out; no links give no rows.
    """
    down = links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    now = scratch.stage(down.distinct())
    size = (-1, 0)
    while True:
        large = scratch.stage(_large_star(now, scratch))
        then = scratch.stage(_small_star(large, scratch))
        found = then.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        scratch.drop(large)
        now = then
        if tuple(found) == size or not found[0]:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        size = tuple(found)

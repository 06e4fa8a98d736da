"""Connected components of links by large-star and small-star rounds.

Each round points every node at the smallest node around it; the links become
stars around the smallest node of each component after a few rounds (about
the logarithm of the longest chain). Links are written to the shared folder
after each round, so lineage stays short and nothing is collected: the driver
only learns whether the links are stars by now.

Cases: no links give no rows; repeated links and links of a node to itself
change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import staged

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round over undirected links (a > b): large stars move the bigger neighbours of every
    node, small stars the smaller ones, to the smallest node around it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else links
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    moved = near.join(least, "a")
    if large:
        moved = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars: every node that points at another points at one only, and
    nothing points at it."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    n = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return n.filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component) for every node that has a link to another one; the
    component is its smallest node."""
    links = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a > b").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if _settled(links):
            break
        links = staged(_star(_star(links, True), False), "links")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

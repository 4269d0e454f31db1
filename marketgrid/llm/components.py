"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.llm.common import stage


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, larger end first, no loops."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the least node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b")))


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node that has a link; links are (a, b) longs.

    The rounds are logarithmic in the longest chain; each one is a stored table, and a one-row digest tells when
    nothing moved. No node's neighbours are gathered into a row, so a hub costs a join that Spark can split.
    """
    links = stage(_tidy(links), "links")
    before = _digest(links)
    while before[0]:
        links = stage(_tidy(_small_star(_tidy(_large_star(links)))), "links")
        now = _digest(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))

"""Areal apportionment and connected components of the overlap graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.session import materialise

WHOLE_PARENT = 0.95      # weight from which a parent counts as whole
ESTIMATED_TOLERANCE = 0.01
MATERIAL_LINK = 0.01
GROWTH_YEARS = 5


def land_weights(overlaps: DataFrame) -> DataFrame:
    """(child, parent, land_part, w): share of the parent's land in the child.

    Water-only overlaps are dropped.  The parent total is an aggregate joined
    back, not a window, so a parent with many parts is not one task.
    """
    land = overlaps.withColumn("land_part", F.coalesce(C.number("land_part"), F.lit(0.0))).filter(F.col("land_part") > 0)
    total = land.groupBy("parent").agg(F.sum("land_part").alias("_total"))
    return land.join(total, "parent").withColumn("w", F.col("land_part") / F.col("_total")).drop("_total")


def apportion(
    weights: DataFrame, old_counts: DataFrame, whole: float = WHOLE_PARENT, tolerance: float = ESTIMATED_TOLERANCE
) -> DataFrame:
    """Old households carried to child tracts, with the basis they rest on.

    old_counts: (parent, households_old); negative or missing is suppressed.
    """
    known = old_counts.select("parent", C.not_negative("households_old").alias("h"))
    parts = weights.join(known, "parent", "left").withColumn("part", F.col("h") * F.col("w"))
    sums = parts.groupBy("child").agg(
        F.coalesce(F.sum("part"), F.lit(0.0)).alias("hh"),
        F.coalesce(C.sum_where(F.col("w") < whole, "part"), F.lit(0.0)).alias("est"),
        F.count_distinct("parent").alias("parents"),
        C.count_where(F.col("h").isNull()).alias("parents_missing"),
        F.max("w").alias("max_w"),
    ).withColumn("estimated_share", C.ratio("est", "hh"))
    basis = (
        F.when(F.col("parents_missing") > 0, "parent_suppressed")
        .when(F.col("max_w") < whole, "fragmentary")
        .when(F.col("estimated_share") > tolerance, "apportioned")
        .otherwise("direct")
    )
    return sums.select(
        F.col("child").alias("tract_geoid"),
        F.when(F.col("parents_missing") == 0, F.col("hh")).alias("households_2019"),
        basis.alias("growth_basis"), "parents", "parents_missing", "max_w", "estimated_share",
    )


def material_links(weights: DataFrame, least: float = MATERIAL_LINK) -> DataFrame:
    """Graph edges between child and parent nodes; slivers do not connect areas."""
    return weights.filter(F.col("w") >= least).select(
        F.concat(F.lit("c"), "child").alias("a"), F.concat(F.lit("p"), "parent").alias("b")
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node id of the connected component.

    Alternating large-star and small-star rounds (Kiveris et al., *Connected
    Components in MapReduce and Beyond*, 2014): the number of rounds grows
    with the logarithm of the longest chain.  Every round is two combining
    aggregates and two joins whose right side is unique; each result is stored
    so that lineage does not grow.  The rounds end when no edge changes.
    """
    start = edges.select(F.col("a").cast("string").alias("u"), F.col("b").cast("string").alias("v"))
    nodes = start.select(F.col("u").alias("node")).unionByName(start.select(F.col("v").alias("node"))).distinct()
    # stars: v is the greater end, u the smaller
    current = materialise(_oriented(start))
    for _ in range(max_rounds):
        large = _large_star(current)
        after = materialise(_small_star(large))
        changed = after.join(current, ["u", "v"], "left_anti").limit(1).count() + (
            current.join(after, ["u", "v"], "left_anti").limit(1).count()
        )
        current = after
        if changed == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = current.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _oriented(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("u") != F.col("v")).select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    ).distinct()


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the node's least neighbour."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return _oriented(
        both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v")
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = pairs.groupBy("v").agg(F.min("u").alias("m"))
    joined = pairs.join(least, "v")
    return _oriented(
        joined.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(least.select(F.col("m").alias("u"), "v"))
    )


def cluster_totals(components: DataFrame, old_counts: DataFrame) -> DataFrame:
    """Per child tract: its cluster, the cluster's old households and child count."""
    kind, key = F.substring("node", 1, 1), F.expr("substring(node, 2)")
    member = components.select(kind.alias("kind"), key.alias("key"), F.col("component").alias("growth_cluster"))
    parents = member.filter(F.col("kind") == "p").select(F.col("key").alias("parent"), "growth_cluster")
    old = parents.join(
        old_counts.select("parent", C.not_negative("households_old").alias("h")), "parent"
    ).groupBy("growth_cluster").agg(F.sum("h").alias("cluster_households_2019"))
    child = member.filter(F.col("kind") == "c").select(F.col("key").alias("tract_geoid"), "growth_cluster")
    size = child.groupBy("growth_cluster").agg(F.count(F.lit(1)).alias("cluster_tracts"))
    return child.join(size, "growth_cluster").join(old, "growth_cluster", "left").select(
        "tract_geoid", "growth_cluster", "cluster_households_2019", "cluster_tracts"
    )


def household_growth(tracts: DataFrame, base: DataFrame, clusters: DataFrame, years: int = GROWTH_YEARS) -> DataFrame:
    """Annual household growth per tract with the basis ladder applied in order.

    tracts: (tract_geoid, households, tract_status).  A fragmentary tract takes
    the growth of its cluster; what cannot be measured stays NULL and says why.
    """
    rows = tracts.select("tract_geoid", "households", "tract_status").join(
        base.select("tract_geoid", "households_2019", F.col("growth_basis").alias("b0")), "tract_geoid", "left"
    ).join(clusters, "tract_geoid", "left")
    now = rows.filter(F.col("growth_cluster").isNotNull()).groupBy("growth_cluster").agg(
        F.coalesce(F.sum("households"), F.lit(0.0)).alias("cluster_now")
    )
    rows = rows.join(now, "growth_cluster", "left")
    structural = F.col("tract_status").isin("water_or_special", "unpopulated")
    basis = F.when(structural, "not_applicable").otherwise(F.coalesce("b0", F.lit("no_2010_counterpart")))
    own = F.when(~structural, C.rnd(C.cagr_pct("households", "households_2019", F.lit(years)), 4))
    usable = basis.isin("direct", "apportioned", "fragmentary")
    rows = rows.withColumn("own", own).withColumn(
        "b1", F.when(F.col("own").isNull() & usable, "no_2019_base").otherwise(basis)
    )
    frag = F.col("b1") == "fragmentary"
    by_cluster = F.when(
        (F.col("cluster_households_2019") > 0) & (F.col("cluster_now") > 0),
        C.rnd(C.cagr_pct("cluster_now", "cluster_households_2019", F.lit(years)), 4),
    )
    return rows.select(
        "tract_geoid", "households", "households_2019",
        F.when(frag, by_cluster).otherwise(F.col("own")).alias("household_growth_pct"),
        F.col("own").alias("household_growth_pct_tract"),
        F.when(frag & by_cluster.isNotNull(), "cluster").when(frag, "fragmentary_no_cluster")
        .otherwise(F.col("b1")).alias("growth_basis"),
        "growth_cluster", "cluster_tracts",
    )


def tract_growth(tracts: DataFrame, overlaps: DataFrame, old_counts: DataFrame) -> DataFrame:
    """The whole ladder: weights, apportionment, clusters, growth."""
    weights = materialise(land_weights(overlaps))
    clusters = cluster_totals(connected_components(material_links(weights)), old_counts)
    return household_growth(tracts, apportion(weights, old_counts), clusters)

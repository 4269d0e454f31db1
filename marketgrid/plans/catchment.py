"""Tier radii, the branch-tract bridge, competition and what is left uncovered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.functions.geo import with_xy
from marketgrid.operators import ranking, relational, spatial
from marketgrid.operators.quality import require_rows
from marketgrid.session import materialise

RADIUS_BOUNDS = (1.0, 30.0)


def subject_sites(wh) -> DataFrame:
    """Current, located branches of the subject with their tier and map position."""
    branch = wh.dim_branch
    newest = branch.agg(F.max("last_year")).scalar()
    current = branch.filter(
        F.col("is_subject_bank") & (F.col("last_year") == newest) & F.col("tract_geoid").isNotNull()
    ).select("uninumbr", "tract_geoid", "latitude", "longitude")
    tier = wh.dim_tract.select("tract_geoid", "tier")
    return with_xy(
        current.join(tier, "tract_geoid", "left").withColumn("tier", F.coalesce("tier", F.lit("rural"))),
        "longitude", "latitude", "px", "py",
    ).select("uninumbr", "tier", "px", "py")


def tract_points(wh) -> DataFrame:
    """Tracts with a centroid at their map position."""
    return with_xy(
        wh.dim_tract.filter(F.col("centroid_lat").isNotNull()), "centroid_lon", "centroid_lat", "px", "py"
    ).select("tract_geoid", "tier", "households", "lmi_flag", "px", "py")


def site_spacing(sites: DataFrame) -> DataFrame:
    """Distance from each site to the nearest other site."""
    return spatial.nearest_distance(sites, sites, ["uninumbr", "tier"], exclude_self=True)


def tier_radii(sites: DataFrame) -> DataFrame:
    """Radius per tier: the median spacing of its own sites (three rows)."""
    return ranking.quantiles(site_spacing(sites), ["tier"], "nearest_miles", {"radius_miles": 0.5}, count="sites")


def radius_violations(radii: DataFrame, bounds: tuple[float, float] = RADIUS_BOUNDS) -> DataFrame:
    """Tiers whose radius may not be used: too few sites or outside the bounds."""
    every = radii.sparkSession.createDataFrame([(t,) for t in C.TIERS], "tier string")
    found = every.join(radii, "tier", "left").withColumn("sites", F.coalesce("sites", F.lit(0)))
    reason = F.when(F.col("sites") < 2, "too few sites").when(
        ~F.coalesce(F.col("radius_miles").between(*bounds), F.lit(False)), "outside the bounds"
    )
    return found.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def membership(wh) -> DataFrame:
    """Every (tract, subject branch) pair within the branch's tier radius."""
    circles = wh.subject_sites.select(F.col("px").alias("cx0"), F.col("py").alias("cy0"), "tier", "uninumbr")
    points = wh.tract_points.select("tract_geoid", "px", "py")
    return spatial.radius_join(circles, points, wh.tier_radii).select(
        "tract_geoid", "uninumbr", F.col("tier").alias("branch_tier"), C.rnd("miles", 3).alias("distance_miles")
    )


def bridge(wh) -> DataFrame:
    """Membership with the nearest branch marked primary, ties to the least id."""
    pairs = materialise(membership(wh))
    nearest = primary_by_distance(pairs).withColumnRenamed("uninumbr", "_nearest")
    return pairs.join(nearest, "tract_geoid").select(
        "tract_geoid", "uninumbr", "branch_tier", "distance_miles",
        (F.col("uninumbr") == F.col("_nearest")).alias("is_primary"), F.lit(True).alias("is_subject_bank"),
    )


def primary_by_distance(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("tract_geoid").agg(
        F.min_by("uninumbr", F.struct("distance_miles", "uninumbr")).alias("uninumbr")
    )


def primary_by_deposits(pairs: DataFrame, deposits: DataFrame) -> DataFrame:
    """The other tie-break: the branch with the greatest deposits, then least id."""
    known = pairs.join(deposits, "uninumbr", "left")
    order = F.struct(F.coalesce(-F.col("deposits"), F.lit(2**62)), F.col("uninumbr"))
    return known.groupBy("tract_geoid").agg(F.min_by("uninumbr", order).alias("uninumbr"))


def latest_deposits(wh) -> DataFrame:
    return relational.only_latest(wh.fact_branch_deposits, wh.vintages).select("uninumbr", "deposits")


def reach_sizes(bridge_rows: DataFrame) -> DataFrame:
    """Tracts per branch, all and as the nearest branch."""
    return bridge_rows.groupBy("uninumbr", "branch_tier").agg(
        F.count(F.lit(1)).alias("tracts"), C.count_where(F.col("is_primary")).alias("primary_tracts"))


def overlap_sizes(bridge_rows: DataFrame) -> DataFrame:
    """How many tracts lie in the catchments of 1, 2, 3 .. branches."""
    per_tract = bridge_rows.groupBy("tract_geoid").agg(F.count(F.lit(1)).alias("branches"))
    return per_tract.groupBy("branches").agg(F.count(F.lit(1)).alias("tracts"))


def tie_break_sensitivity(wh) -> DataFrame:
    """How much ownership moves between the two tie-breaks: one row."""
    pairs = wh.bridge_branch_catchment.select("tract_geoid", "uninumbr", "distance_miles")
    near = primary_by_distance(pairs).withColumnRenamed("uninumbr", "near")
    deposits = require_rows(latest_deposits(wh), "no deposits in the newest vintage: the second tie-break has no input")
    big = primary_by_deposits(pairs, deposits).withColumnRenamed("uninumbr", "big")
    members = pairs.groupBy("tract_geoid").agg(F.count(F.lit(1)).alias("n"))
    both = near.join(big, "tract_geoid").join(members, "tract_geoid")
    moved = F.col("near") != F.col("big")
    tracts = both.agg(
        F.count(F.lit(1)).alias("covered_tracts"),
        C.count_where(F.col("n") > 1).alias("contested_tracts"),
        C.count_where(moved).alias("switched"),
        C.count_where(moved & (F.col("n") > 1)).alias("contested_switched"),
    )
    hh = wh.dim_tract.select("tract_geoid", F.coalesce("households", F.lit(0.0)).alias("h"))
    owned = both.join(hh, "tract_geoid", "left")
    change = (
        owned.select(F.col("near").alias("u"), F.col("h").alias("hn"), F.lit(0.0).alias("hb"))
        .unionByName(owned.select(F.col("big").alias("u"), F.lit(0.0).alias("hn"), F.col("h").alias("hb")))
        .groupBy("u").agg(F.sum("hn").alias("hn"), F.sum("hb").alias("hb"))
        .withColumn("moved_pct", F.when(F.col("hn") > 0, F.abs(F.col("hb") - F.col("hn")) / F.col("hn") * 100))
    )
    branches = change.agg(
        F.count(F.lit(1)).alias("branches"),
        C.count_where(F.col("moved_pct") > 25).alias("over_25"),
        C.count_where(F.col("moved_pct") > 100).alias("over_100"),
    )
    mid = ranking.quantiles(change, [], "moved_pct", {"median_pct_change": 0.5})
    # three one-row frames
    one = F.lit(1).alias("_one")
    return (
        tracts.select("*", one).join(branches.select("*", one), "_one").join(mid.select("*", one), "_one", "left")
        .select(
            "covered_tracts", "contested_tracts", "switched",
            C.rnd(C.ratio("switched", "covered_tracts"), 6).alias("switched_share"),
            "contested_switched",
            C.rnd(C.ratio("contested_switched", "contested_tracts"), 6).alias("contested_share"),
            C.rnd("median_pct_change", 4).alias("median_pct_change"), "over_25", "over_100", "branches",
        )
    )


def nearest_branch(wh) -> DataFrame:
    """Miles from every tract to the nearest subject branch."""
    return spatial.nearest_distance(
        wh.tract_points.select("tract_geoid", "px", "py"), wh.subject_sites, ["tract_geoid"]
    )


def uncovered_tracts(wh) -> DataFrame:
    """Tracts outside every catchment, with the distance to the nearest branch."""
    covered = wh.bridge_branch_catchment.select("tract_geoid").distinct()
    return (
        wh.dim_tract.join(covered, "tract_geoid", "left_anti")
        .join(nearest_branch(wh), "tract_geoid", "left")
        .withColumn("miles_to_nearest_branch", C.rnd("nearest_miles", 2)).drop("nearest_miles")
    )


def coverage_summary(wh) -> DataFrame:
    """Covered against uncovered tracts with a known income class."""
    flagged = relational.flag_exists(
        wh.dim_tract, wh.bridge_branch_catchment, ["tract_geoid"], "covered"
    ).filter(F.col("lmi_flag").isNotNull())
    return flagged.groupBy("covered").agg(
        F.count(F.lit(1)).alias("tracts"),
        C.count_where(F.col("lmi_flag")).alias("lmi_tracts"),
        F.sum("households").alias("households"),
        C.sum_where(F.col("lmi_flag"), "households").alias("lmi_households"),
    ).withColumn("lmi_household_pct", C.rnd(C.pct("lmi_households", "households"), 4))


def competition(wh) -> DataFrame:
    """Branches and households inside the tract's own tier radius.

    Branches and tract households are summed by one radius join: both are
    weighted points, so the grid is built and shuffled once. Positions are
    projected once, in as many tasks as the shuffle has, however few parts the
    branch file is read in, and stored: every level of the sums reads them.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    subject = F.col("is_subject_bank")
    sites = materialise(with_xy(
        wh.dim_branch.filter(
            F.col("service_type").isin(*C.FULL_SERVICE_TYPES) & (F.col("validity") == "ok")
            & F.col("latitude").isNotNull()
        ).select("longitude", "latitude", "is_subject_bank").repartition("longitude", "latitude"),
        "longitude", "latitude", "px", "py",
    ).select("px", "py", "is_subject_bank")).select(
        "px", "py", F.when(subject, none).otherwise(one).alias("competitor_branches"),
        F.when(subject, one).otherwise(none).alias("subject_branches"),
        none.alias("catchment_tracts"), F.lit(0.0).alias("catchment_households"),
    )
    tracts = wh.tract_points.select("tract_geoid", "tier", "households", "px", "py")
    homes = tracts.select(
        "px", "py", none.alias("competitor_branches"), none.alias("subject_branches"), one.alias("catchment_tracts"),
        F.coalesce("households", F.lit(0.0)).alias("catchment_households"),
    )
    sums = ["competitor_branches", "subject_branches", "catchment_tracts", "catchment_households"]
    circles = tracts.select("tract_geoid", "tier", F.col("px").alias("cx0"), F.col("py").alias("cy0"))
    inside = spatial.radius_sums(circles, sites.unionByName(homes), wh.tier_radii, ["tract_geoid"], sums)
    radii = wh.tier_radii.select("tier", C.rnd("radius_miles", 2).alias("radius_miles"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in sums}
    return (
        tracts.select("tract_geoid", "tier", F.col("households").alias("tract_households"))
        .join(F.broadcast(radii), "tier", "left")
        .join(inside, "tract_geoid", "left").withColumns(zero)
        .select(
            "tract_geoid", "tier", "radius_miles", "competitor_branches", "subject_branches", "catchment_tracts",
            C.rnd("catchment_households", 0).alias("catchment_households"), "tract_households",
            C.rnd(C.ratio("competitor_branches", "catchment_households", 10000.0), 4)
            .alias("competitor_per_10k_catchment_hh"),
            C.rnd(C.ratio("competitor_branches", "tract_households", 10000.0), 4)
            .alias("competitor_per_10k_tract_hh_unadjusted"),
        )
    )


def competition_shape(competition_rows: DataFrame, n: int = 10) -> DataFrame:
    """Medians by household band: shows whether a density measure tracks tract size."""
    sized = competition_rows.withColumn(
        "sized_households", F.when(F.col("tract_households") != 0, F.col("tract_households"))
    )
    banded = materialise(ranking.bands(sized, "sized_households", n, "hh_band").filter(F.col("hh_band").isNotNull()))
    measures = [
        "tract_households", "catchment_households", "competitor_branches",
        "competitor_per_10k_tract_hh_unadjusted", "competitor_per_10k_catchment_hh",
    ]
    out = ranking.medians(banded, ["hh_band"], measures)
    return out.select("hh_band", *[C.rnd(m, 2).alias(m) for m in measures])

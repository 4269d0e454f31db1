"""Catchment demographics and the branch performance index: queries 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.operators import ranking, relational
from marketgrid.plans.deposits import three_rows_back
from marketgrid.session import materialise

BOOKING_MULTIPLE = 20


def primary_tracts(wh) -> DataFrame:
    """Tract attributes of every primary (branch, tract) pair."""
    return wh.bridge_branch_catchment.filter(F.col("is_primary")).select(
        "uninumbr", "tract_geoid", "distance_miles"
    ).join(
        wh.dim_tract.select(
            "tract_geoid", "households", "median_family_income", "owner_occupied_units", "lmi_flag", "tract_status"
        ),
        "tract_geoid",
    )


def catchments(wh) -> DataFrame:
    """Household, income and coverage sums per branch over its primary tracts."""
    ok = F.col("tract_status") == "ok"
    value = F.col("households") * F.col("median_family_income")
    return primary_tracts(wh).groupBy("uninumbr").agg(
        F.count(F.lit(1)).alias("tracts"),
        C.count_where(ok).alias("tracts_measured"),
        C.count_where(F.col("tract_status") == "suppressed").alias("tracts_suppressed"),
        C.sum_where(ok, "households").alias("households"),
        C.sum_where(ok, "owner_occupied_units").alias("owner_occupied"),
        C.sum_where(ok, value).alias("catchment_potential"),
        C.count_where(F.col("lmi_flag")).alias("lmi_tracts"),
        C.sum_where(ok & F.col("lmi_flag"), "households").alias("lmi_households"),
        # distances have three decimals: whole thousandths give the same mean in any order
        C.rnd(F.sum(C.rnd(F.col("distance_miles") * 1000).cast("long")) / F.count("distance_miles") / 1000, 2)
        .alias("mean_distance_miles"),
        C.rnd(F.max("distance_miles"), 2).alias("max_distance_miles"),
    )


def q07_catchment_demographics(wh) -> DataFrame:
    branch = wh.dim_branch.select("uninumbr", "city", "state", "is_main_office", "drift_kind")
    return catchments(wh).join(branch, "uninumbr").select(
        "uninumbr", "city", "state", "is_main_office", "drift_kind", "tracts", "tracts_measured",
        "tracts_suppressed", "households", "owner_occupied", "catchment_potential",
        C.rnd(C.ratio("catchment_potential", "households"), 0).alias("weighted_family_income"),
        "lmi_tracts", "lmi_households",
        C.rnd(C.pct("lmi_households", "households"), 2).alias("lmi_household_share_pct"),
        "mean_distance_miles", "max_distance_miles",
        C.rnd(C.pct("tracts_suppressed", "tracts"), 1).alias("pct_tracts_suppressed"),
    ).orderBy(F.desc_nulls_last("catchment_potential"))


def eligible_branches(wh) -> DataFrame:
    """Full-service, current, located subject branches that are not head offices."""
    newest = relational.latest_year(wh.vintages)
    branch = wh.dim_branch.filter(
        F.col("is_subject_bank") & (F.col("last_year") == newest) & F.col("tract_geoid").isNotNull()
        & (F.coalesce("is_main_office", F.lit("0")) != "1") & F.col("service_type").isin(*C.FULL_SERVICE_TYPES)
    ).select("uninumbr", "city", "state", "tract_geoid", "position_drift_miles", "drift_kind", "county_agrees")
    tract = wh.dim_tract.select("tract_geoid", "cbsa", "tier")
    return branch.join(tract, "tract_geoid", "left").withColumn("market", C.market_key("cbsa", "state")).drop(
        "tract_geoid", "cbsa"
    )


def scored_branches(wh) -> DataFrame:
    """Eligible branches with actual and predicted deposits and their trend."""
    newest = relational.latest_year(wh.vintages)
    history = three_rows_back(wh.fact_branch_deposits.select("uninumbr", "year", "deposits")).filter(
        F.col("year") == newest
    ).select(
        "uninumbr", F.col("deposits").alias("actual_deposits"),
        C.cagr_pct("deposits", "deposits_3y_ago", F.col("year") - F.col("prior_year")).alias("trend"),
    )
    base = materialise(eligible_branches(wh).join(catchments(wh), "uninumbr").join(history, "uninumbr"))
    totals = [
        F.sum("catchment_potential").alias("p"), F.sum("actual_deposits").alias("d"), F.count(F.lit(1)).alias("n")
    ]
    market = base.groupBy("market").agg(*totals).select(
        "market", F.col("p").alias("market_potential"), F.col("d").alias("market_deposits"),
        F.col("n").alias("market_branch_count"),
    )
    network = base.agg(F.struct(*totals).alias("t")).scalar()
    middle = ranking.quantiles(base, [], "actual_deposits", {"m": 0.5}).select("m").scalar()
    share = C.ratio("catchment_potential", "market_potential")
    return base.join(market, "market").withColumns({
        "predicted": F.col("market_deposits") * share,
        "predicted_network": network.getField("d") * C.ratio("catchment_potential", network.getField("p")),
        "network_median": middle,
    }).withColumn("level", C.ratio("actual_deposits", "predicted"))


def size_bands(scored: DataFrame, tiles: int = 4) -> DataFrame:
    """Quartile of catchment households within the tier; equal sizes split by id digest."""
    sized = scored.filter((F.col("households") > 0) & F.col("tier").isNotNull()).select(
        "uninumbr", "tier", "households", "level"
    )
    placed = ranking.ordinal(sized, ["tier"], "households", "uninumbr", "_pos")
    return placed.withColumn("size_quartile", ranking.ntile("_pos", "n_group", tiles)).select(
        "uninumbr", "tier", "size_quartile", "level"
    )


def q08_performance_index(wh) -> DataFrame:
    """Deposits over what the catchment predicts, raw and against same-size peers."""
    scored = materialise(scored_branches(wh))
    bands = size_bands(scored)
    peers = ranking.quantiles(bands, ["tier", "size_quartile"], "level", {"band_level": 0.5})
    sized = bands.select("uninumbr", "tier", "size_quartile").join(peers, ["tier", "size_quartile"], "left").select(
        "uninumbr", "size_quartile", "band_level"
    )
    return scored.join(sized, "uninumbr", "left").select(
        "uninumbr", "city", "state", "tracts", "tracts_suppressed", "households", "actual_deposits",
        C.rnd("predicted", 0).alias("predicted_deposits"), C.rnd("level", 4).alias("performance_index"),
        C.rnd(C.ratio("level", "band_level"), 4).alias("index_size_adjusted"), "size_quartile",
        C.rnd("trend", 2).alias("cagr_3y_pct"), C.diagnosis("level", "trend").alias("diagnosis"), "market",
        "market_branch_count",
        C.rnd(C.ratio("actual_deposits", "predicted_network"), 4).alias("index_vs_network"),
        (F.col("tracts_suppressed") > 0).alias("catchment_partly_unmeasured"),
        ((F.col("drift_kind") == "relocation") & (F.col("position_drift_miles") > 1)).alias("branch_relocated"),
        (~F.col("county_agrees")).alias("county_disputed"),
        (F.col("actual_deposits") > BOOKING_MULTIPLE * F.col("network_median")).alias("booking_concentration"),
    ).orderBy(F.asc_nulls_last("index_size_adjusted"))

"""The tables handed to a reporting tool."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.operators import relational
from marketgrid.plans import deposits, lending, performance, siting
from marketgrid.plans.opportunity import recovered_z
from marketgrid.plans.warehouse import COMPONENTS

Z_NAMES = {
    "household_growth": "household_growth_z", "median_income": "median_income_z",
    "deposit_market_growth": "deposit_growth_z", "competitor_saturation": "competitor_saturation_z",
    "unmet_mortgage_demand": "unmet_demand_z",
}


def branch_model(wh, index: DataFrame | None = None) -> DataFrame:
    """Every branch with the performance columns of those that have one."""
    index = performance.q08_performance_index(wh) if index is None else index
    perf = index.select(
        "uninumbr", "index_size_adjusted", F.col("performance_index").alias("index_raw"), "diagnosis", "market",
        "cagr_3y_pct", "actual_deposits", "predicted_deposits", F.col("households").alias("catchment_households"),
        "booking_concentration", "catchment_partly_unmeasured",
    )
    return wh.dim_branch.join(perf, "uninumbr", "left")


def tract_model(wh) -> DataFrame:
    """Tracts with a state-qualified county name and the footprint flag."""
    rows = relational.flag_exists(wh.dim_tract, wh.bridge_branch_catchment, ["tract_geoid"], "in_catchment")
    name = C.state_name(C.state_of("county_fips"))
    return rows.withColumns({
        "state_name": name, "county_full": F.concat("county_name", F.lit(", "), name),
    }).drop("households_2019", "household_growth_pct_tract", "growth_cluster", "cluster_tracts", "owner_occupied_units")


def year_model(wh) -> DataFrame:
    return wh.dim_year.select("year", "sod_as_of_date", C.as_of_date("year").alias("date")).orderBy("year")


def component_scores(wh) -> DataFrame:
    """Wide z-scores recovered from the published contributions, with centroids."""
    place = wh.dim_tract.select("tract_geoid", "centroid_lat", "centroid_lon")
    return recovered_z(wh.opportunity_index, wh.ref_index_weights).select(
        "tract_geoid", *[C.rnd(f"z_{c}", 6).alias(Z_NAMES[c]) for c in COMPONENTS], "opportunity_score", "county_name",
        "lmi_flag", "growth_is_estimated",
    ).join(place, "tract_geoid", "left")


def site_model(wh, sites: DataFrame) -> DataFrame:
    place = wh.dim_tract.select("tract_geoid", "centroid_lat", "centroid_lon", "county_fips")
    return sites.join(place, "tract_geoid", "left")


def tables(wh) -> dict[str, Callable[[], DataFrame]]:
    """Name -> builder of the seventeen exported tables."""
    picked: list[siting.Selection] = []

    def selection() -> siting.Selection:
        if not picked:
            picked.append(siting.Selection(wh))
        return picked[0]

    return {
        "dim_branch": lambda: branch_model(wh),
        "dim_tract": lambda: tract_model(wh),
        "dim_year": lambda: year_model(wh),
        "dim_institution": lambda: wh.dim_institution.select(
            "cert", "institution_name", "lei", "match_quality", "is_subject_bank"),
        "fact_branch_deposits": lambda: wh.fact_branch_deposits.select("uninumbr", "cert", "year", "deposits"),
        "bridge_branch_catchment": lambda: wh.bridge_branch_catchment,
        "fact_tract_competition": lambda: wh.fact_tract_competition.select(
            "tract_geoid", "tier", "radius_miles", "competitor_branches", "subject_branches", "catchment_households",
            "competitor_per_10k_catchment_hh"),
        "fact_county_deposit_growth": lambda: wh.fact_county_deposit_growth.select(
            "county_fips", "cagr_pct_total", "cagr_pct_retail", "cagr_shift_pp", "excluded_branches",
            "excluded_deposit_share", "retail_basis_status"),
        "market_share": lambda: deposits.q02_market_share(wh),
        "tract_capture_rate": lambda: lending.q10_capture_rate(wh),
        "unmet_demand": lambda: lending.q11_unmet_demand(wh),
        "lmi_coverage": lambda: siting.q13_lmi_coverage(wh, selection().coverage()),
        "opportunity_index": lambda: wh.opportunity_index,
        "ref_index_weights": lambda: wh.ref_index_weights,
        "index_components": lambda: component_scores(wh),
        "recommendation_sets": lambda: site_model(wh, selection().sites()),
        "recommended_coverage": lambda: selection().coverage(),
    }

"""Declared column types per table; identifiers are always text."""

from __future__ import annotations



def struct(ddl: str) -> str:
    """DDL text on one line, as readers and writers take it."""
    return " ".join(ddl.split())


def columns(table: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a declared table."""
    return [tuple(part.split()) for part in SCHEMAS[table].split(", ")]


SCHEMAS: dict[str, str] = {
    "dim_year": struct("year int, sod_as_of_date date"),
    "dim_institution": struct(
        """cert string, institution_name string, fed_rssd string, lei string, match_quality string,
        match_method string, is_subject_bank boolean, attribute_as_of_date date"""
    ),
    "dim_branch": struct(
        """uninumbr string, cert string, institution_name string, address string, city string, state string,
        county_fips string, latitude double, longitude double, tract_geoid string, service_type string,
        is_main_office string, first_year int, last_year int, position_drift_miles double, drift_kind string,
        county_agrees boolean, validity string, is_subject_bank boolean"""
    ),
    "dim_tract": struct(
        """tract_geoid string, county_fips string, county_name string, cbsa string, cbsa_title string, tier string,
        population double, households double, households_2019 double, household_growth_pct double,
        household_growth_pct_tract double, growth_basis string, growth_cluster string, cluster_tracts long,
        median_hh_income double, median_family_income double, median_home_value double,
        owner_occupied_units double, tract_to_area_income_pct double, lmi_flag boolean, lmi_basis string,
        tract_status string, centroid_lat double, centroid_lon double"""
    ),
    "fact_branch_deposits": struct(
        "uninumbr string, cert string, year int, deposits long, institution_total_deposits long"
    ),
    "fact_tract_lending": struct(
        """tract_geoid string, lei string, loan_purpose string, action_taken string, record_count long,
        total_amount double, action_class string"""
    ),
    "bridge_branch_catchment": struct(
        """tract_geoid string, uninumbr string, branch_tier string, distance_miles double, is_primary boolean,
        is_subject_bank boolean"""
    ),
    "fact_tract_competition": struct(
        """tract_geoid string, tier string, radius_miles double, competitor_branches long, subject_branches long,
        catchment_tracts long, catchment_households double, tract_households double,
        competitor_per_10k_catchment_hh double, competitor_per_10k_tract_hh_unadjusted double"""
    ),
    "fact_county_deposit_growth": struct(
        """county_fips string, deposits_from_total double, deposits_to_total double, branches_from_total long,
        branches_to_total long, cagr_pct_total double, deposits_from_retail double, deposits_to_retail double,
        branches_from_retail long, branches_to_retail long, cagr_pct_retail double, deposits_from_excl_hq double,
        deposits_to_excl_hq double, branches_from_excl_hq long, branches_to_excl_hq long, cagr_pct_excl_hq double,
        excluded_branches_from long, excluded_deposits_from double, excluded_branch_share_from double,
        excluded_deposit_share_from double, excluded_branches_to long, excluded_deposits_to double,
        excluded_branch_share_to double, excluded_deposit_share_to double, excluded_branches long,
        excluded_deposit_share double, excluded_branch_share double, cagr_shift_pp double,
        retail_basis_status string"""
    ),
    "ref_index_weights": struct(
        "scenario string, component string, weight double, inverted boolean, normalization string"
    ),
    "ref_sod_state_totals": struct("year int, state string, branches long, deposits_thousands double"),
    # inputs of the staging jobs
    "sod": struct(
        """CERT string, UNINUMBR string, YEAR int, STALPBR string, STNUMBR int, CNTYNUMB int, STCNTYBR string,
        NAMEFULL string, ADDRESBR string, CITYBR string, BRSERTYP string, BKMO string, DEPSUMBR long, DEPSUM long,
        SIMS_LATITUDE double, SIMS_LONGITUDE double, SIMS_ESTABLISHED_DATE string"""
    ),
    "institutions": struct(
        """CERT string, NAME string, STALP string, CITY string, ASSET string, FED_RSSD string, ACTIVE string,
        CLASS string"""
    ),
    "tract_rel": struct("GEOID_TRACT_20 string, GEOID_TRACT_10 string, AREALAND_PART string"),
    "coverage": struct("rule string, tract_geoid string, newly_covered boolean"),
    "sites": struct(
        """rule string, tract_geoid string, county_name string, cbsa_title string, tier string, households double,
        lmi_flag boolean, opportunity_score double, unmet_mortgage_demand double, growth_is_estimated boolean"""
    ),
}

# Identifier columns and the length each must have
ID_LENGTHS = {
    ("dim_tract", "tract_geoid"): 11,
    ("dim_tract", "county_fips"): 5,
    ("dim_branch", "tract_geoid"): 11,
    ("dim_branch", "county_fips"): 5,
    ("fact_tract_lending", "tract_geoid"): 11,
    ("bridge_branch_catchment", "tract_geoid"): 11,
}
# columns that must be true booleans, three-valued
BOOLEAN_COLUMNS = {
    "dim_tract": ("lmi_flag", "in_catchment"),
    "opportunity_index": ("lmi_flag", "growth_is_estimated"),
    "index_components": ("lmi_flag", "growth_is_estimated"),
    "recommendation_sets": ("lmi_flag", "growth_is_estimated"),
    "dim_branch": ("is_subject_bank",),
    "dim_institution": ("is_subject_bank",),
    "unmet_demand": ("lmi_flag",),
    "tract_capture_rate": ("lmi_flag",),
}

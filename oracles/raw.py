"""Oracle texts of the warehouse that is built from raw files: the raw inputs, the tables, and queries over them."""

from __future__ import annotations

from oracles.base import CTES, LAT, LON, PARTS, compose, cte, over
from oracles.business import ORACLES
from oracles.operators import CLASS, O, validity


def cell(axis: str, key: str) -> str:
    at = f"({LON.format(k=key)} + 93)" if axis == "x" else f"({LAT.format(k=key)} - 36)"
    return f"CAST(floor({at} * 4) AS INTEGER)"


def pad(number: str, width: int) -> str:
    return f"lpad(CAST({number} AS VARCHAR), {width}, '0')"


AREA = f"{pad('n', 5)} || {pad('i', 3)} || {pad('j', 3)}"
cte("rarea", f"""
SELECT *, {AREA} AS area, {pad('n', 5)} AS county, (i + j) % 2 = 0 AS holed FROM (
  SELECT *, i // 4 * 20 + j // 4 + 1 AS n FROM (
    SELECT {cell('x', 'k')} AS i, {cell('y', 'k')} AS j, CAST(sum(cents) AS BIGINT) // count(*) AS level FROM (
      SELECT p_partkey AS k, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part
      UNION ALL SELECT c_custkey, 100000 + c_custkey % 50000 FROM customer) GROUP BY 1, 2)) """)
cte("rtileid", "SELECT i, j, area AS poly_id, holed FROM rarea", "rarea")
cte("sod0", CTES["sod"][1], *CTES["sod"][0])
cte("rsod", f"""
SELECT * EXCLUDE (STCNTYBR, n), {pad('CASE WHEN c % 29 <> 0 THEN n WHEN n % 20 < 11 THEN n + 1 ELSE n - 1 END', 5)} AS STCNTYBR,
  CASE WHEN BKMO = '1' THEN 10 * DEPSUMBR ELSE 0 END AS DEPSUM
FROM (SELECT *, {cell('x', 'c')} // 4 * 20 + {cell('y', 'c')} // 4 + 1 AS n FROM sod0) """, "sod0")
cte("rloans", f"""
SELECT CASE WHEN o_custkey % 97 <> 0 THEN {AREA} END AS census_tract, lpad(CAST(l_suppkey AS VARCHAR), 20, '0') AS lei,
  l_returnflag AS loan_purpose, CAST(l_linenumber AS VARCHAR) AS action_taken,
  CASE WHEN l_suppkey % 19 = 0 THEN 'Exempt' ELSE CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) END AS loan_amount,
  CASE WHEN l_orderkey % 3 <> 0 THEN CAST(40 + (l_suppkey * 7 + l_linenumber) % 90 AS VARCHAR) ELSE 'NA' END AS tract_to_msa_income_percentage
FROM (SELECT *, i // 4 * 20 + j // 4 + 1 AS n FROM (
  SELECT *, {cell('x', 'o_custkey')} AS i, {cell('y', 'o_custkey')} AS j FROM lineitem JOIN orders ON o_orderkey = l_orderkey)) """)
cte("rbr", f"""
SELECT l.UNINUMBR AS uninumbr, l.CERT AS cert, NAMEFULL AS institution_name, ADDRESBR AS address, CITYBR AS city, STALPBR AS state,
  STCNTYBR AS county_fips, SIMS_LATITUDE AS latitude, SIMS_LONGITUDE AS longitude, CASE WHEN vv = 'ok' THEN p.poly_id END AS tract_geoid,
  BRSERTYP AS service_type, BKMO AS is_main_office, first_year, last_year, position_drift_miles, drift_kind,
  CASE WHEN vv = 'ok' THEN STCNTYBR = substr(p.poly_id, 1, 5) END AS county_agrees, vv AS validity, l.CERT = '00000' AS is_subject_bank
FROM (SELECT s.*, {validity('SIMS_LATITUDE', 'SIMS_LONGITUDE')} AS vv FROM rsod s WHERE s.YEAR = (SELECT max(YEAR) FROM rsod t WHERE t.UNINUMBR = s.UNINUMBR)) l
JOIN ({O['d19_branch_drift']}) d ON d.UNINUMBR = l.UNINUMBR
LEFT JOIN rtileid p ON floor((SIMS_LONGITUDE + 93) * 4) = p.i AND floor((SIMS_LATITUDE - 36) * 4) = p.j
  AND NOT (holed AND (SIMS_LONGITUDE + 93) * 4 - p.i >= 0.25 AND (SIMS_LONGITUDE + 93) * 4 - p.i < 0.75 AND (SIMS_LATITUDE - 36) * 4 - p.j >= 0.25 AND (SIMS_LATITUDE - 36) * 4 - p.j < 0.75)""",
    "rsod", "rtileid")
cte("rdep", """
SELECT UNINUMBR AS uninumbr, CERT AS cert, YEAR AS year, CAST(DEPSUMBR * 1000 AS BIGINT) AS deposits,
  CAST(DEPSUM * 1000 AS BIGINT) AS institution_total_deposits FROM rsod """, "rsod")
cte("rlend", f"""
SELECT census_tract AS tract_geoid, lei, loan_purpose, action_taken, count(*) AS record_count,
  CAST(coalesce(sum(TRY_CAST(loan_amount AS BIGINT)), 0) AS DOUBLE) AS total_amount, {CLASS} AS action_class
FROM rloans WHERE census_tract IS NOT NULL GROUP BY 1, 2, 3, 4 """, "rloans")
centroid, needs = PARTS[O["f18_polygon_centroids"]]
for rounded, plain in (("round(-96 +", "(-96 +"), (", 6) AS centroid_lon", ") AS centroid_lon"),
                       ("round(degrees(beta +", "(degrees(beta +"), (", 6) AS centroid_lat", ") AS centroid_lat")):
    centroid = centroid.replace(rounded, plain)
cte("rcen", centroid, *needs)
cte("rtr", """
SELECT tract_geoid, county_fips, county_name, cbsa, cbsa_title, tier, population, households, h19 AS households_2019,
  own AS household_growth_pct, own AS household_growth_pct_tract,
  CASE WHEN own IS NULL AND b0 = 'direct' THEN 'no_2019_base' ELSE b0 END AS growth_basis, growth_cluster, cluster_tracts, median_hh_income,
  median_family_income, median_home_value, owner_occupied_units, coalesce(r, alone) AS tract_to_area_income_pct, coalesce(r, alone) < 80 AS lmi_flag,
  CASE WHEN r IS NOT NULL THEN 'ffiec_ratio' WHEN alone IS NOT NULL THEN 'acs_fallback' ELSE '' END AS lmi_basis, tract_status, centroid_lat, centroid_lon
FROM (SELECT *, CASE WHEN tract_status = 'unpopulated' THEN 'not_applicable' WHEN new_land THEN 'no_2010_counterpart'
      WHEN gone THEN 'parent_suppressed' ELSE 'direct' END AS b0,
    CASE WHEN tract_status <> 'unpopulated' AND h19 > 0 THEN round((pow(households / h19, 0.2::DOUBLE) - 1) * 100, 4) END AS own,
    100.0::DOUBLE * median_family_income / CASE WHEN cbsa IS NOT NULL AND n % 11 <> 0 THEN 90000 + (n * 137) % 60000 END AS alone
  FROM (SELECT a.*, area AS tract_geoid, county AS county_fips, 'County ' || county AS county_name,
      CASE WHEN n % 4 <> 0 AND n % 7 <> 3 THEN county END AS cbsa, CASE WHEN n % 4 <> 0 AND n % 7 <> 3 THEN 'Area ' || county END AS cbsa_title,
      CASE WHEN n % 7 = 3 THEN 'rural' WHEN n % 3 = 0 THEN 'metro' WHEN n % 3 = 1 THEN 'micro' ELSE 'rural' END AS tier,
      (1000 + (i * 91 + j * 17) % 5000)::DOUBLE AS population, households, CASE WHEN (i * 5 + j) % 13 <> 0 THEN level::DOUBLE END AS median_family_income,
      (level - 1000 * (i % 5))::DOUBLE AS median_hh_income, (level * 4)::DOUBLE AS median_home_value, ((i * 37 + j * 211) % 2600)::DOUBLE AS owner_occupied_units,
      (i + j) % 9 = 0 AS new_land, (i + 2 * j) % 11 = 0 AS gone,
      CASE WHEN (i + j) % 9 <> 0 AND (i + 2 * j) % 11 <> 0 THEN (300 + (i * 31 + j * 173) % 2000)::DOUBLE END AS h19,
      CASE WHEN (i + j) % 9 <> 0 THEN 'c' || area END AS growth_cluster, CASE WHEN (i + j) % 9 <> 0 THEN 1::BIGINT END AS cluster_tracts,
      CASE WHEN households = 0 THEN 'unpopulated' WHEN households IS NULL OR (i * 5 + j) % 13 = 0 THEN 'suppressed' ELSE 'ok' END AS tract_status
    FROM (SELECT *, (CASE WHEN (i * 3 + j) % 23 = 0 THEN NULL WHEN (i + j) % 19 = 0 THEN 0 ELSE 400 + (i * 37 + j * 211) % 2600 END)::DOUBLE AS households
      FROM rarea) a))
LEFT JOIN (SELECT census_tract AS area, median(TRY_CAST(tract_to_msa_income_percentage AS DOUBLE)) AS r FROM rloans GROUP BY 1) USING (area)
LEFT JOIN (SELECT poly_id AS area, centroid_lat, centroid_lon FROM rcen) USING (area) """, "rarea", "rloans", "rcen")
cte("rxw", *CTES["xw"][1:], *CTES["xw"][0])
cte("rinst", """
SELECT cert, name AS institution_name, fed_rssd, nullif(lei, '') AS lei, match_quality, match_method, is_subject_bank, DATE '2002-01-01' AS attribute_as_of_date
FROM rxw """, "rxw")

#: Base tables of the published queries -> the same tables out of raw files.
SWAPPED = {"sod": "rsod", "loans": "rloans", "br": "rbr", "tr": "rtr", "fbd": "rdep", "lend": "rlend", "inst": "rinst", "tileid": "rtileid"}


def _raw(body: str, *needs: str) -> str:
    return over(compose(body, *needs), SWAPPED)


def _rounded(table: str, *columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 4) AS {c}' for c in columns)}) FROM {table}"


TABLES = {
    "dim_year": ("SELECT DISTINCT year FROM rdep", "rdep"), "dim_institution": ("SELECT * FROM rinst", "rinst"),
    "dim_branch": ("SELECT * FROM rbr", "rbr"), "dim_tract": ("SELECT * FROM rtr", "rtr"),
    "fact_branch_deposits": ("SELECT * FROM rdep", "rdep"), "fact_tract_lending": ("SELECT * FROM rlend", "rlend"),
    "bridge_branch_catchment": ("SELECT * FROM bridge", "bridge"), "fact_tract_competition": ("SELECT * FROM comp", "comp"),
    "fact_county_deposit_growth": ("SELECT * FROM cg", "cg"), "ref_index_weights": ("SELECT * FROM wt", "wt"),
    "ref_sod_state_totals": ("SELECT * FROM totals_pub", "totals_pub"),
}
R: dict[str, str] = {
    "p01_dim_institution": _raw("SELECT * FROM rinst", "rinst"),
    "p01_dim_branch": _raw(_rounded("rbr", "latitude", "longitude", "position_drift_miles"), "rbr"),
    "p01_dim_tract": _raw(_rounded("rtr", "tract_to_area_income_pct", "centroid_lat", "centroid_lon"), "rtr"),
    "p01_fact_branch_deposits": _raw("SELECT * FROM rdep", "rdep"),
    "p01_fact_tract_lending": _raw("SELECT * FROM rlend", "rlend"),
    "p01_release_counts": _raw(" UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS rows FROM ({body})" for t, (body, _) in TABLES.items()), *(n for _, n in TABLES.values())),
    "p01_release_market_share": over(ORACLES["q02_market_share_by_county_year"], SWAPPED),
    "p01_release_opportunity": over(ORACLES["q12_market_opportunity_index"], SWAPPED),
    "p03_records_without_area": compose(
        "SELECT count(*) AS records, count(*) FILTER (WHERE census_tract IS NULL) AS without_tract FROM rloans", "rloans"),
}

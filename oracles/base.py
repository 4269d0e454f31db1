"""DuckDB common table expressions that repeat the star-schema mapping.

Written independently of the DataFrame jobs: plain SQL with window functions,
cross joins and recursive queries where the jobs use distributed forms.
"""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}
#: Composed text -> what it was composed of, so that it can be put over other base tables.
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, text: str, *needs: str) -> None:
    CTES[name] = (needs, text)


def compose(body: str, *needs: str) -> str:
    """A query text with every CTE it needs, dependencies first."""
    text = _compose(body, needs, CTES)
    PARTS[text] = body, needs
    return text


def over(text: str, swapped: dict[str, str]) -> str:
    """A composed text again, with some of its tables standing for other CTEs."""
    body, needs = PARTS[text]
    return _compose(body, needs, {**CTES, **{n: ((o,), f"SELECT * FROM {o}") for n, o in swapped.items()}})


def _compose(body: str, needs: tuple[str, ...], ctes: dict[str, tuple[tuple[str, ...], str]]) -> str:
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for d in ctes[n][0]:
            visit(d)
        done.append(n)

    for n in needs:
        visit(n)
    recursive = any("--recursive" in ctes[n][1] for n in done)
    heads = [f"{n} AS (\n{ctes[n][1]}\n)" for n in done]
    return ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(heads) + "\n" if heads else "") + body


LON = "-93 + (({k} * 3700711) % 7000003) / 1000000.0::DOUBLE"
LAT = "36 + (({k} * 9100717) % 11000009) / 1000000.0::DOUBLE"

# Albers constants of EPSG:5070, computed in SQL from the ellipsoid
cte("cone", """
SELECT a, e2, e, n, c, a * sqrt(c - n * q0) / n AS rho0 FROM (
  SELECT *, (m1*m1 - m2*m2) / (q2 - q1) AS n, m1*m1 + (m1*m1 - m2*m2) / (q2 - q1) * q1 AS c FROM (
    SELECT a, e2, e,
      cos(radians(29.5)) / sqrt(1 - e2 * sin(radians(29.5))**2) AS m1,
      cos(radians(45.5)) / sqrt(1 - e2 * sin(radians(45.5))**2) AS m2,
      (1-e2) * (sin(radians(29.5)) / (1 - e2 * sin(radians(29.5))**2) - ln((1 - e*sin(radians(29.5))) / (1 + e*sin(radians(29.5)))) / (2*e)) AS q1,
      (1-e2) * (sin(radians(45.5)) / (1 - e2 * sin(radians(45.5))**2) - ln((1 - e*sin(radians(45.5))) / (1 + e*sin(radians(45.5)))) / (2*e)) AS q2,
      (1-e2) * (sin(radians(23.0)) / (1 - e2 * sin(radians(23.0))**2) - ln((1 - e*sin(radians(23.0))) / (1 + e*sin(radians(23.0)))) / (2*e)) AS q0
    FROM (SELECT 6378137.0::DOUBLE AS a, e2, sqrt(e2) AS e FROM (
      SELECT (1/298.257222101::DOUBLE) * (2 - 1/298.257222101::DOUBLE) AS e2)))) """)


def projected(source: str, lon: str, lat: str, keep: str) -> str:
    """SELECT keep, x, y of projected points; `source` may be a CTE or a subquery."""
    return f"""
SELECT {keep}, rho * sin(th) AS x, rho0 - rho * cos(th) AS y FROM (
  SELECT s.*, k.rho0, k.n * radians({lon} + 96.0) AS th,
    k.a * sqrt(k.c - k.n * (1 - k.e2) * (sin(radians({lat})) / (1 - k.e2 * sin(radians({lat}))**2)
      - ln((1 - k.e * sin(radians({lat}))) / (1 + k.e * sin(radians({lat})))) / (2 * k.e))) / k.n AS rho
  FROM {source} s CROSS JOIN cone k)"""


cte("bk", """
SELECT c, q, k, p, bal, state, county_no,
  CASE WHEN c % 97 <> 0 THEN county_no || lpad(CAST(CASE WHEN (q + 2*k) % 31 = 0 THEN 980000 + k ELSE k END AS VARCHAR), 6, '0') END AS tract_geoid
FROM (
  SELECT c_custkey AS c, c_nationkey + 25 * (c_custkey // 15000) AS q,
    (c_custkey % 7) + 7 * ((c_custkey % 15000) // 1500) AS k,
    ((c_custkey % 7) // 2) + 4 * ((c_custkey % 15000) // 1500) + CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS p,
    c_acctbal AS bal, lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS state,
    lpad(CAST(c_nationkey + 25 * (c_custkey // 15000) AS VARCHAR), CAST(greatest(5, length(CAST(c_nationkey + 25 * (c_custkey // 15000) AS VARCHAR))) AS INTEGER), '0') AS county_no
  FROM customer JOIN nation ON n_nationkey = c_nationkey) """)

cte("by_", """
SELECT o_custkey AS c, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders GROUP BY 1, 2 """)

CERT = "CASE WHEN {s} < 6 THEN '00000' ELSE lpad(CAST({s} AS VARCHAR), 5, '0') END"
YEAR_CERT = CERT.format(s="(CASE WHEN c % 17 = 0 AND year >= 1998 THEN (c + 7) % 40 ELSE c % 40 END)")

cte("fbd", f"""
SELECT lpad(CAST(c AS VARCHAR), CAST(greatest(8, length(CAST(c AS VARCHAR))) AS INTEGER), '0') AS uninumbr, {YEAR_CERT} AS cert, year, (cents + 50) // 100 AS deposits,
  CASE WHEN c % 53 = 0 THEN 10 * ((cents + 50) // 100) ELSE 0 END AS institution_total_deposits
FROM by_ """, "by_")

cte("br", f"""
SELECT lpad(CAST(bk.c AS VARCHAR), CAST(greatest(8, length(CAST(bk.c AS VARCHAR))) AS INTEGER), '0') AS uninumbr, {CERT.format(s='(bk.c % 40)')} AS cert,
  'Bank ' || {CERT.format(s='(bk.c % 40)')} AS institution_name,
  CAST(bk.c % 900 + 1 AS VARCHAR) || ' West Main Street' AS address,
  'City ' || CAST(bk.c % 83 AS VARCHAR) AS city, state,
  CASE WHEN tract_geoid IS NOT NULL AND bk.c % 29 = 0 THEN lpad(CAST(q + 1 AS VARCHAR), CAST(greatest(5, length(CAST(q + 1 AS VARCHAR))) AS INTEGER), '0') ELSE county_no END AS county_fips,
  CASE WHEN tract_geoid IS NOT NULL THEN {LAT.format(k='bk.c')} END AS latitude,
  CASE WHEN tract_geoid IS NOT NULL THEN {LON.format(k='bk.c')} END AS longitude, tract_geoid,
  CASE WHEN bk.c % 10 < 6 THEN '11' WHEN bk.c % 10 < 8 THEN '12' WHEN bk.c % 10 = 8 THEN '21' ELSE '23' END AS service_type,
  CASE WHEN bk.c % 53 = 0 THEN '1' WHEN bk.c % 59 = 0 THEN NULL ELSE '0' END AS is_main_office,
  first_year, last_year,
  CAST(CASE WHEN bk.c % 33 = 0 THEN 2.5 WHEN bk.c % 11 = 0 THEN 0.7 ELSE 0.0 END AS DOUBLE) AS position_drift_miles,
  CASE WHEN bk.c % 22 = 0 THEN 'relocation' WHEN bk.c % 11 = 0 THEN 'regeocode' ELSE 'stable' END AS drift_kind,
  CASE WHEN tract_geoid IS NOT NULL THEN bk.c % 29 <> 0 END AS county_agrees,
  CASE WHEN tract_geoid IS NOT NULL THEN 'ok' ELSE 'missing_coordinates' END AS validity,
  bk.c % 40 < 6 AS is_subject_bank
FROM bk LEFT JOIN (SELECT c, min(year) AS first_year, max(year) AS last_year FROM by_ GROUP BY c) s ON s.c = bk.c
""", "bk", "by_")

cte("tr", f"""
SELECT tract_geoid, county_no AS county_fips, 'County ' || county_no AS county_name,
  CASE WHEN q % 4 <> 0 THEN county_no END AS cbsa, CASE WHEN q % 4 <> 0 THEN 'Area ' || county_no END AS cbsa_title,
  CASE q % 3 WHEN 0 THEN 'metro' WHEN 1 THEN 'micro' ELSE 'rural' END AS tier, hh * 2.5 AS population, hh AS households,
  round(hh * 9) / 10.0::DOUBLE AS households_2019, growth AS household_growth_pct, growth AS household_growth_pct_tract,
  CASE WHEN (q*2 + k) % 17 = 0 THEN 'parent_suppressed' WHEN (q + k) % 5 = 0 THEN 'cluster' ELSE 'direct' END AS growth_basis,
  CAST(NULL AS VARCHAR) AS growth_cluster, CAST(1 AS BIGINT) AS cluster_tracts,
  inc AS median_hh_income, fam AS median_family_income, inc * 4 AS median_home_value,
  round(hh * 0.6, 0) AS owner_occupied_units, CASE WHEN known THEN pct END AS tract_to_area_income_pct,
  CASE WHEN known THEN pct < 80 END AS lmi_flag,
  CASE WHEN NOT known THEN '' WHEN k % 5 = 0 THEN 'acs_fallback' ELSE 'ffiec_ratio' END AS lmi_basis,
  CASE WHEN left(right(tract_geoid, 6), 2) IN ('98', '99') THEN 'water_or_special' WHEN hh = 0 THEN 'unpopulated'
       WHEN hh IS NULL OR fam IS NULL THEN 'suppressed' ELSE 'ok' END AS tract_status,
  {LAT.format(k='(7*q + k + 3)')} AS centroid_lat, {LON.format(k='(7*q + k + 3)')} AS centroid_lon
FROM (SELECT tract_geoid, county_no, q, k,
    CAST(CASE WHEN (q*3 + k) % 23 = 0 THEN NULL WHEN (q + k) % 19 = 0 THEN 0 ELSE 400 + (q*37 + k*211) % 2600 END AS DOUBLE) AS hh,
    CASE WHEN round(arg_min(bal, c) * 10, 0) >= 0 THEN round(arg_min(bal, c) * 10, 0) END AS fam,
    CASE WHEN round(arg_max(bal, c) * 8, 0) >= 0 THEN round(arg_max(bal, c) * 8, 0) END AS inc,
    CAST(40 + (q*13 + k*17) % 90 AS DOUBLE) AS pct, (q*7 + k) % 13 <> 0 AS known,
    CASE WHEN (q*2 + k) % 17 <> 0 THEN ((q*5 + k*3) % 40 - 12) / 10.0::DOUBLE END AS growth
  FROM bk WHERE tract_geoid IS NOT NULL GROUP BY tract_geoid, county_no, q, k) """, "bk")

cte("inst", f"""
SELECT {CERT.format(s='i')} AS cert, 'Bank ' || {CERT.format(s='i')} AS institution_name,
  lpad(CAST(i + 1000 AS VARCHAR), 7, '0') AS fed_rssd,
  CASE WHEN i % 2 = 0 THEN lpad(CAST(i AS VARCHAR), 20, '0') END AS lei,
  CASE WHEN i % 2 = 0 THEN 'exact_rssd' ELSE 'no_lei_for_rssd' END AS match_quality,
  CASE WHEN i % 2 = 0 THEN 'fed_rssd == institutionId2017' ELSE '' END AS match_method, i = 0 AS is_subject_bank,
  DATE '2002-01-01' AS attribute_as_of_date
FROM (SELECT unnest(range(40)) AS i) WHERE i = 0 OR i >= 6 """)

cte("lend", """
SELECT CASE WHEN l_orderkey % 997 = 5 THEN left(tract_geoid, length(tract_geoid) - 6) || '999999' ELSE tract_geoid END AS tract_geoid, lpad(CAST(l_suppkey AS VARCHAR), 20, '0') AS lei, l_returnflag AS loan_purpose,
  CAST(l_linenumber AS VARCHAR) AS action_taken, count(*) AS record_count,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS total_amount
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN bk ON bk.c = o_custkey
WHERE bk.tract_geoid IS NOT NULL GROUP BY 1, 2, 3, 4 """, "bk")

cte("loans", """
SELECT tract_geoid AS census_tract, lpad(CAST(l_suppkey AS VARCHAR), 20, '0') AS lei, l_returnflag AS loan_purpose,
  CASE WHEN l_orderkey % 499 = 7 THEN '9' ELSE CAST(l_linenumber AS VARCHAR) END AS action_taken,
  CASE WHEN l_suppkey % 19 = 0 THEN 'Exempt' ELSE CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) END AS loan_amount,
  CASE WHEN CAST(tract_geoid AS BIGINT) % 3 <> 0 THEN CAST(40 + (l_suppkey * 7 + l_linenumber) % 90 AS VARCHAR) ELSE 'NA' END AS tract_to_msa_income_percentage
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN bk ON bk.c = o_custkey """, "bk")

cte("sod", f"""
SELECT {YEAR_CERT} AS CERT, lpad(CAST(c AS VARCHAR), CAST(greatest(8, length(CAST(c AS VARCHAR))) AS INTEGER), '0') AS UNINUMBR, year AS YEAR, state AS STALPBR,
  CASE WHEN c % 29 = 0 THEN lpad(CAST(q + 1 AS VARCHAR), CAST(greatest(5, length(CAST(q + 1 AS VARCHAR))) AS INTEGER), '0') ELSE county_no END AS STCNTYBR,
  'Bank ' || {YEAR_CERT} AS NAMEFULL,
  CASE WHEN c % 22 = 0 AND year >= 1998 THEN CAST(c % 900 + 2 AS VARCHAR) || ' East Oak Road'
       WHEN year >= 1999 THEN CAST(c % 900 + 1 AS VARCHAR) || ' W. Main St'
       ELSE CAST(c % 900 + 1 AS VARCHAR) || ' West Main Street' END AS ADDRESBR,
  'City ' || CAST(c % 83 AS VARCHAR) AS CITYBR,
  CASE WHEN c % 10 < 6 THEN '11' WHEN c % 10 < 8 THEN '12' WHEN c % 10 = 8 THEN '21' ELSE '23' END AS BRSERTYP,
  CASE WHEN c % 53 = 0 THEN '1' ELSE '0' END AS BKMO,
  CASE WHEN c % 71 = 0 AND (year < 1998 OR c % 142 = 0) THEN 40 ELSE 1 END * ((cents + 50000) // 100000) AS DEPSUMBR,
  CASE WHEN tract_geoid IS NOT NULL THEN CASE WHEN c % 101 = 0 AND year < 1997 THEN 0.0
     ELSE {LAT.format(k='c')} + 0.0 + CASE WHEN c % 11 = 0 AND year >= 1998 THEN 0.01::DOUBLE ELSE 0.0 END END END AS SIMS_LATITUDE,
  CASE WHEN tract_geoid IS NOT NULL THEN CASE WHEN c % 101 = 0 AND year < 1997 THEN 0.0 ELSE {LON.format(k='c')} END END AS SIMS_LONGITUDE,
  CASE WHEN c % 9 <> 0 THEN '06/30/' || CAST(1985 + c % 15 AS VARCHAR) END AS SIMS_ESTABLISHED_DATE, tract_geoid, c
FROM by_ JOIN bk USING (c) """, "by_", "bk")

cte("totals_pub", """
SELECT year, state, branches + CASE WHEN year = 1997 AND state = '02' THEN 1 ELSE 0 END AS branches,
  d / 1000.0::DOUBLE * CASE WHEN year = 1998 AND state = '03' THEN 1.002::DOUBLE ELSE 1.0 END AS deposits_thousands
FROM (SELECT year, state, count(*) AS branches, CAST(sum((cents + 50) // 100) AS BIGINT) AS d FROM by_ JOIN bk USING (c) GROUP BY 1, 2)
WHERE NOT (year = 1996 AND state = '01')
UNION ALL SELECT max(year) + 1, '00', 1, 1.0 FROM by_ """, "by_", "bk")

cte("wt", """
SELECT * FROM (VALUES
 ('primary','household_growth',0.20::DOUBLE,false),('primary','median_income',0.15,false),('primary','deposit_market_growth',0.25,false),('primary','competitor_saturation',0.20,true),('primary','unmet_mortgage_demand',0.20,false),
 ('equal_weight','household_growth',0.20,false),('equal_weight','median_income',0.20,false),('equal_weight','deposit_market_growth',0.20,false),('equal_weight','competitor_saturation',0.20,true),('equal_weight','unmet_mortgage_demand',0.20,false),
 ('growth_led','household_growth',0.35,false),('growth_led','median_income',0.10,false),('growth_led','deposit_market_growth',0.35,false),('growth_led','competitor_saturation',0.10,true),('growth_led','unmet_mortgage_demand',0.10,false),
 ('underserved_led','household_growth',0.15,false),('underserved_led','median_income',0.05,false),('underserved_led','deposit_market_growth',0.20,false),('underserved_led','competitor_saturation',0.20,true),('underserved_led','unmet_mortgage_demand',0.40,false)
) t(scenario, component, weight, inverted) """)

# -- catchments by brute force ---------------------------------------------
cte("newest", "SELECT max(year) AS y FROM by_", "by_")
cte("site0", """
SELECT b.uninumbr, coalesce(t.tier, 'rural') AS tier, b.latitude, b.longitude
FROM br b LEFT JOIN tr t USING (tract_geoid)
WHERE b.is_subject_bank AND b.tract_geoid IS NOT NULL AND b.last_year = (SELECT max(last_year) FROM br) """, "br", "tr")
cte("site", projected("site0", "s.longitude", "s.latitude", "uninumbr, tier"), "site0", "cone")
cte("tp", projected("tr", "s.centroid_lon", "s.centroid_lat", "tract_geoid, tier, households"), "tr", "cone")
cte("spacing", """
SELECT a.uninumbr, a.tier, min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) / 1609.344) AS nearest_miles
FROM site a LEFT JOIN site b ON a.uninumbr <> b.uninumbr GROUP BY 1, 2 """, "site")
cte("rad", "SELECT tier, median(nearest_miles) AS r, count(nearest_miles) AS sites FROM spacing GROUP BY tier HAVING count(nearest_miles) > 0", "spacing")
cte("pairs", """
SELECT t.tract_geoid, s.uninumbr, s.tier AS branch_tier,
  round(sqrt((t.x-s.x)*(t.x-s.x) + (t.y-s.y)*(t.y-s.y)) / 1609.344, 3) AS distance_miles
FROM tp t CROSS JOIN site s JOIN rad ON rad.tier = s.tier
WHERE sqrt((t.x-s.x)*(t.x-s.x) + (t.y-s.y)*(t.y-s.y)) / 1609.344 <= rad.r """, "tp", "site", "rad")
cte("bridge", """
SELECT *, row_number() OVER (PARTITION BY tract_geoid ORDER BY distance_miles, uninumbr) = 1 AS is_primary FROM pairs
""", "pairs")
cte("bp0", """
SELECT longitude, latitude, is_subject_bank AS mine FROM br
WHERE service_type IN ('11', '12') AND validity = 'ok' AND latitude IS NOT NULL """, "br")
cte("bp", projected("bp0", "s.longitude", "s.latitude", "mine"), "bp0", "cone")
cte("comp", """
SELECT t.tract_geoid, t.tier, round(rad.r, 2) AS radius_miles, coalesce(b.comp, 0) AS competitor_branches,
  coalesce(b.subj, 0) AS subject_branches, coalesce(h.n, 0) AS catchment_tracts,
  round(coalesce(h.hh, 0), 0) AS catchment_households, t.households AS tract_households,
  round(10000.0 * coalesce(b.comp, 0) / nullif(round(coalesce(h.hh, 0), 0), 0), 4) AS competitor_per_10k_catchment_hh,
  round(10000.0 * coalesce(b.comp, 0) / nullif(t.households, 0), 4) AS competitor_per_10k_tract_hh_unadjusted
FROM tp t LEFT JOIN rad ON rad.tier = t.tier
LEFT JOIN (SELECT t.tract_geoid, count(*) FILTER (WHERE NOT mine) AS comp, count(*) FILTER (WHERE mine) AS subj
  FROM tp t JOIN rad ON rad.tier = t.tier CROSS JOIN bp b
  WHERE sqrt((t.x-b.x)*(t.x-b.x) + (t.y-b.y)*(t.y-b.y)) / 1609.344 <= rad.r GROUP BY 1) b ON b.tract_geoid = t.tract_geoid
LEFT JOIN (SELECT t.tract_geoid, count(*) AS n, sum(coalesce(o.households, 0)) AS hh
  FROM tp t JOIN rad ON rad.tier = t.tier CROSS JOIN tp o
  WHERE sqrt((t.x-o.x)*(t.x-o.x) + (t.y-o.y)*(t.y-o.y)) / 1609.344 <= rad.r GROUP BY 1) h ON h.tract_geoid = t.tract_geoid
""", "tp", "rad", "bp")

# -- county growth ------------------------------------------------------------
cte("ends", "SELECT min(year) AS y0, max(year) AS y1 FROM by_", "by_")
cte("rec", """
SELECT s.*, coalesce(left(b.tract_geoid, length(b.tract_geoid) - 6), b.county_fips) AS cf, s.year = y0 AS at0,
  coalesce(DEPSUMBR > 20 * (SELECT median(DEPSUMBR) FROM sod WHERE year = (SELECT y1 FROM ends)), false) AS big, s.BKMO = '1' AS head
FROM sod s CROSS JOIN ends LEFT JOIN br b ON b.uninumbr = s.UNINUMBR WHERE s.year = y0 OR s.year = y1 """, "sod", "br", "ends")


def _growth_sums() -> str:
    parts = []
    for tag, here in (("from", "at0"), ("to", "NOT at0")):
        for base, cond in (("total", "true"), ("retail", "NOT big"), ("excl_hq", "NOT big AND NOT head")):
            w = f"FILTER (WHERE {here} AND {cond})"
            parts.append(f"CAST(sum(DEPSUMBR) {w} AS DOUBLE) AS deposits_{tag}_{base}, nullif(count(*) {w}, 0) AS branches_{tag}_{base}")
        w = f"FILTER (WHERE {here} AND big)"
        parts.append(f"count(*) {w} AS excluded_branches_{tag}, CAST(coalesce(sum(DEPSUMBR) {w}, 0) AS DOUBLE) AS excluded_deposits_{tag}")
    return ",\n  ".join(parts)


def _cagr(base: str) -> str:
    return (f"CASE WHEN deposits_from_{base} > 0 AND deposits_to_{base} IS NOT NULL THEN round((pow(deposits_to_{base} / deposits_from_{base},"
            f" 1.0::DOUBLE / (SELECT y1 - y0 FROM ends)) - 1) * 100, 4) END AS cagr_pct_{base}")


cte("cg", f"""
SELECT g.*, greatest(excluded_branches_from, excluded_branches_to) AS excluded_branches,
  greatest(excluded_deposit_share_from, excluded_deposit_share_to) AS excluded_deposit_share,
  greatest(excluded_branch_share_from, excluded_branch_share_to) AS excluded_branch_share,
  round(cagr_pct_retail - cagr_pct_total, 4) AS cagr_shift_pp,
  CASE WHEN cagr_pct_retail IS NOT NULL THEN 'measured' WHEN coalesce(branches_to_retail, 0) = 0 THEN 'no_retail_branches'
       ELSE 'no_2019_retail_base' END AS retail_basis_status
FROM (SELECT s.*, {_cagr('total')}, {_cagr('retail')}, {_cagr('excl_hq')},
    round(excluded_branches_from / nullif(branches_from_total, 0), 4) AS excluded_branch_share_from,
    round(excluded_deposits_from / nullif(deposits_from_total, 0), 4) AS excluded_deposit_share_from,
    round(excluded_branches_to / nullif(branches_to_total, 0), 4) AS excluded_branch_share_to,
    round(excluded_deposits_to / nullif(deposits_to_total, 0), 4) AS excluded_deposit_share_to
  FROM (SELECT cf AS county_fips, {_growth_sums()} FROM rec WHERE cf IS NOT NULL GROUP BY cf) s) g """, "rec", "ends")

# -- index ----------------------------------------------------------------------
cte("demand", """
SELECT l.tract_geoid, CAST(sum(record_count) FILTER (WHERE action_taken = '1') AS BIGINT) AS orig,
  sum(total_amount) FILTER (WHERE action_taken = '1') AS orig_amt,
  CAST(sum(record_count) FILTER (WHERE action_taken IN ('1','2','3','4','5')) AS BIGINT) AS apps,
  count(DISTINCT lei) FILTER (WHERE action_taken = '1') AS lenders,
  CAST(coalesce(sum(record_count) FILTER (WHERE action_taken = '1' AND own), 0) AS BIGINT) AS mine,
  coalesce(sum(total_amount) FILTER (WHERE action_taken = '1' AND own), 0) AS mine_amt
FROM (SELECT l.*, coalesce(lei IN (SELECT lei FROM inst WHERE is_subject_bank AND lei IS NOT NULL), false) AS own FROM lend l) l
GROUP BY 1 """, "lend", "inst")
cte("comp5", """
SELECT t.*, g.cagr_pct_retail, g.retail_basis_status, g.excluded_deposit_share, c.competitor_per_10k_catchment_hh AS sat,
  CASE WHEN d.orig > 0 THEN d.orig - d.mine END AS unmet
FROM tr t LEFT JOIN cg g USING (county_fips) LEFT JOIN comp c ON c.tract_geoid = t.tract_geoid
LEFT JOIN demand d ON d.tract_geoid = t.tract_geoid """, "tr", "cg", "comp", "demand")
cte("zs", """
SELECT *, (household_growth_pct - avg(household_growth_pct) OVER ()) / nullif(stddev_samp(household_growth_pct) OVER (), 0) AS z1,
  (median_hh_income - avg(median_hh_income) OVER ()) / nullif(stddev_samp(median_hh_income) OVER (), 0) AS z2,
  (cagr_pct_retail - avg(cagr_pct_retail) OVER ()) / nullif(stddev_samp(cagr_pct_retail) OVER (), 0) AS z3,
  -((sat - avg(sat) OVER ()) / nullif(stddev_samp(sat) OVER (), 0)) AS z4,
  (unmet - avg(unmet) OVER ()) / nullif(stddev_samp(unmet) OVER (), 0) AS z5
FROM comp5 """, "comp5")
cte("idx", """
SELECT tract_geoid, county_name, cbsa_title, tier, households, lmi_flag, round(household_growth_pct, 3) AS household_growth,
  median_hh_income AS median_income, round(cagr_pct_retail, 3) AS deposit_market_growth, round(sat, 3) AS competitor_saturation,
  unmet AS unmet_mortgage_demand, round(0.20 * z1, 4) AS contrib_household_growth, round(0.15 * z2, 4) AS contrib_median_income,
  round(0.25 * z3, 4) AS contrib_deposit_market_growth, round(0.20 * z4, 4) AS contrib_competitor_saturation,
  round(0.20 * z5, 4) AS contrib_unmet_mortgage_demand,
  CAST((z1 IS NOT NULL)::INT + (z2 IS NOT NULL)::INT + (z3 IS NOT NULL)::INT + (z4 IS NOT NULL)::INT + (z5 IS NOT NULL)::INT AS INTEGER) AS components_present,
  round(0.20 * z1 + 0.15 * z2 + 0.25 * z3 + 0.20 * z4 + 0.20 * z5, 4) AS opportunity_score,
  growth_basis <> 'direct' AS growth_is_estimated, tract_status <> 'ok' AS tract_partly_unmeasured, lmi_flag IS NULL AS lmi_undetermined,
  excluded_deposit_share > 0.25 AS county_growth_heavily_adjusted, retail_basis_status
FROM zs """, "zs")

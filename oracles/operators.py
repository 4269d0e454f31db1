"""Oracle texts of the operators, gates, measures and export models."""

from __future__ import annotations

from marketgrid.functions.columns import ADDRESS_TOKENS
from marketgrid.plans.profile import KEY_FIELDS
from oracles import business
from oracles.base import CERT, LAT, LON, compose, cte, projected

O: dict[str, str] = {}
BOX = "lat BETWEEN 36.0 AND 47.5 AND lon BETWEEN -93.5 AND -86.0"


def validity(lat: str, lon: str) -> str:
    return (f"CASE WHEN {lat} IS NULL OR {lon} IS NULL THEN 'missing_coordinates' WHEN {lat} = 0 AND {lon} = 0 THEN 'null_island'"
            f" WHEN {lon} > 0 OR {lat} < 0 THEN 'transposed_coordinates'"
            f" WHEN {lat} NOT BETWEEN 36.0 AND 47.5 OR {lon} NOT BETWEEN -93.5 AND -86.0 THEN 'out_of_range' ELSE 'ok' END")


CASE_TOKEN = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ADDRESS_TOKENS.items()) + " ELSE w END"
NORM = (f"array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(lower(ADDRESBR), '[^a-z0-9 ]', ' ', 'g'), ' +'),"
        f" lambda w: w <> ''), lambda w: {CASE_TOKEN}), ' ')")

O["p05_latest_vintage"] = compose("SELECT max(year) AS year, count(*) AS branches, CAST(sum(deposits) AS BIGINT) AS deposits FROM fbd WHERE year = (SELECT y FROM newest)", "fbd", "newest")
O["p08_market_keys"] = compose("""
SELECT coalesce(cbsa, 'RURAL-' || state) AS market, coalesce(cbsa_title, 'Outside any CBSA, ' || state) AS market_name, count(*) AS branches
FROM br LEFT JOIN tr USING (tract_geoid) GROUP BY 1, 2""", "br", "tr")
cte("oldc", """
SELECT county_no || lpad(CAST(p AS VARCHAR), 6, '0') AS parent,
  CAST(max(CASE WHEN (q + p) % 11 = 0 THEN -666666666 ELSE 300 + (q*31 + p*173) % 2000 END) AS DOUBLE) AS households_old
FROM bk WHERE tract_geoid IS NOT NULL GROUP BY 1 """, "bk")
O["p23_sentinel_profile"] = compose("SELECT 'households_old' AS \"column\", CAST(households_old AS BIGINT) AS code, count(*) AS rows FROM oldc WHERE households_old < 0 GROUP BY 2", "oldc")
O["p25_coordinate_validity"] = compose(f"SELECT YEAR, {validity('SIMS_LATITUDE', 'SIMS_LONGITUDE')} AS validity, count(*) AS rows FROM sod GROUP BY 1, 2", "sod")
O["p30_lmi_basis"] = compose("SELECT lmi_basis, lmi_flag, count(*) AS tracts, sum(households) AS households FROM tr GROUP BY 1, 2", "tr")
O["p36_county_check"] = compose(f"""
SELECT validity, sc = gc AS county_agrees, count(*) AS branches FROM (
  SELECT {validity('SIMS_LATITUDE', 'SIMS_LONGITUDE')} AS validity, lpad(STCNTYBR, 5, '0') AS sc, left(b.tract_geoid, greatest(5, length(b.tract_geoid) - 6)) AS gc
  FROM sod s JOIN br b ON b.uninumbr = s.UNINUMBR WHERE s.YEAR = (SELECT max(YEAR) FROM sod t WHERE t.UNINUMBR = s.UNINUMBR)) GROUP BY 1, 2""", "sod", "br")
O["f04_normalised_address"] = compose(f"SELECT {NORM} AS address, count(DISTINCT ADDRESBR) AS spellings, count(*) AS rows FROM sod GROUP BY 1", "sod")
O["f16_projected_tracts"] = compose("SELECT tract_geoid, round(x, 3) AS x, round(y, 3) AS y FROM tp", "tp")

# -- polygons ---------------------------------------------------------------------
cte("tile", f"""
SELECT DISTINCT CAST(floor(({LON.format(k='s_suppkey')} + 93) * 4) AS INTEGER) AS i, CAST(floor(({LAT.format(k='s_suppkey')} - 36) * 4) AS INTEGER) AS j FROM supplier """)
cte("tileid", "SELECT *, lpad(CAST(i AS VARCHAR), 3, '0') || lpad(CAST(j AS VARCHAR), 3, '0') AS poly_id, (i + j) % 2 = 0 AS holed FROM tile", "tile")
cte("tedge", """
SELECT poly_id, i, j, -93 + (i + a0 / 4) / 4 AS lon1, 36 + (j + a1 / 4) / 4 AS lat1, -93 + (i + b0 / 4) / 4 AS lon2, 36 + (j + b1 / 4) / 4 AS lat2
FROM tileid JOIN (VALUES (1, 0.0::DOUBLE, 0.0::DOUBLE, 4.0::DOUBLE, 0.0::DOUBLE), (1, 4, 0, 4, 4), (1, 4, 4, 0, 4), (1, 0, 4, 0, 0),
  (2, 1, 1, 1, 3), (2, 1, 3, 3, 3), (2, 3, 3, 3, 1), (2, 3, 1, 1, 1)) e(ring, a0, a1, b0, b1) ON e.ring = 1 OR holed """, "tileid")
cte("pt", f"SELECT lpad(CAST(c AS VARCHAR), 8, '0') AS uninumbr, {LON.format(k='c')} AS lon, {LAT.format(k='c')} AS lat FROM bk WHERE tract_geoid IS NOT NULL", "bk")
cte("hit", """
SELECT uninumbr, min(poly_id) AS poly_id, count(*) AS n_matches FROM pt JOIN tileid
  ON floor((lon + 93) * 4) = i AND floor((lat - 36) * 4) = j
WHERE NOT (holed AND (lon + 93) * 4 - i >= 0.25 AND (lon + 93) * 4 - i < 0.75 AND (lat - 36) * 4 - j >= 0.25 AND (lat - 36) * 4 - j < 0.75)
GROUP BY 1 """, "pt", "tileid")
O["j18_point_in_polygon"] = compose("SELECT * FROM hit", "hit")
cte("pe1", projected("tedge", "s.lon1", "s.lat1", "poly_id, lon1, lat1, lon2, lat2"), "tedge", "cone")
cte("pe2", projected("pe1", "s.lon2", "s.lat2", "poly_id, x AS ax, y AS ay, s.lon1, s.lat1, lon2, lat2").replace("SELECT poly_id, x AS ax, y AS ay, s.lon1, s.lat1, lon2, lat2, rho * sin(th) AS x", "SELECT poly_id, x AS ax, y AS ay, lon1, lat1, lon2, lat2, rho * sin(th) AS bx").replace("AS y FROM (", "AS by2 FROM ("), "pe1", "cone")
O["f18_polygon_centroids"] = compose("""
SELECT poly_id, round(-96 + degrees(atan2(cx, rho0 - cy) / n), 6) AS centroid_lon,
  round(degrees(beta + (e2/3 + 31*e2*e2/180 + 517*e2*e2*e2/5040) * sin(2*beta) + (23*e2*e2/360 + 251*e2*e2*e2/3780) * sin(4*beta) + 761*e2*e2*e2/45360 * sin(6*beta)), 6) AS centroid_lat,
  round(abs(a2) / 2 / (1609.344 * 1609.344), 3) AS square_miles
FROM (SELECT s.*, k.*, asin((k.c - pow(sqrt(cx*cx + (rho0 - cy)*(rho0 - cy)) * k.n / k.a, 2)) / k.n
    / (1 - (1 - e2) / (2*e) * ln((1 - e) / (1 + e)))) AS beta
  FROM (SELECT poly_id, sum(ax*by2 - bx*ay) AS a2, sum((ax + bx) * (ax*by2 - bx*ay)) / (3 * sum(ax*by2 - bx*ay)) AS cx,
      sum((ay + by2) * (ax*by2 - bx*ay)) / (3 * sum(ax*by2 - bx*ay)) AS cy FROM pe2 GROUP BY 1) s CROSS JOIN cone k)""", "pe2", "cone")
cte("outl", """
SELECT group_id, lon1, lat1, lon2, lat2 FROM (
  SELECT CAST(i // 4 AS VARCHAR) || '-' || CAST(j // 4 AS VARCHAR) AS group_id, least(lon1, lon2) AS lon1, least(lat1, lat2) AS lat1,
    greatest(lon1, lon2) AS lon2, greatest(lat1, lat2) AS lat2 FROM tedge)
GROUP BY ALL HAVING count(*) % 2 = 1 """, "tedge")
O["f19_dissolved_outline"] = compose("SELECT * FROM outl", "outl")
cte("corner", "SELECT group_id, lon1 AS lon, lat1 AS lat FROM outl UNION SELECT group_id, lon2, lat2 FROM outl", "outl")
O["j29_touching_groups"] = compose("SELECT DISTINCT a.group_id AS group_a, b.group_id AS group_b FROM corner a JOIN corner b ON a.lon = b.lon AND a.lat = b.lat AND a.group_id < b.group_id", "corner")
cte("oe1", projected("outl", "s.lon1", "s.lat1", "group_id, lon1, lat1, lon2, lat2"), "outl", "cone")
cte("oe2", projected("oe1", "s.lon2", "s.lat2", "@").replace("SELECT @, rho * sin(th) AS x", "SELECT group_id, lon1, lat1, lon2, lat2, x AS ax, y AS ay, rho * sin(th) AS bx").replace("AS y FROM (", "AS by2 FROM ("), "oe1", "cone")
cte("ptx", projected("pt", "s.lon", "s.lat", "uninumbr, lon, lat, CAST(CAST(floor((lon + 94) * 4) AS INTEGER) // 4 AS VARCHAR) || '-' || CAST(CAST(floor((lat - 36) * 4) AS INTEGER) // 4 AS VARCHAR) AS group_id"), "pt", "cone")
O["j28_miles_to_outline"] = compose("""
SELECT uninumbr, group_id, round(CASE WHEN cross_ % 2 = 1 THEN 0.0 ELSE gap END, 3) AS miles_off FROM (
  SELECT uninumbr, group_id, count(*) FILTER (WHERE (lat1 > lat) <> (lat2 > lat) AND lon < lon1 + (lat - lat1) * (lon2 - lon1) / nullif(lat2 - lat1, 0)) AS cross_,
    min(sqrt((x - ax - t*(bx-ax))*(x - ax - t*(bx-ax)) + (y - ay - t*(by2-ay))*(y - ay - t*(by2-ay))) / 1609.344) AS gap
  FROM (SELECT *, greatest(0.0, least(1.0, ((x-ax)*(bx-ax) + (y-ay)*(by2-ay)) / ((bx-ax)*(bx-ax) + (by2-ay)*(by2-ay)))) AS t
    FROM ptx JOIN oe2 USING (group_id)) GROUP BY 1, 2)""", "ptx", "oe2")

cte("mm", """
SELECT *, split_part(located, '-', 1)::INTEGER + 1 || '-' || split_part(located, '-', 2) AS group_id FROM (
  SELECT pt.*, substr(poly_id, 1, 3)::INTEGER // 4 || '-' || substr(poly_id, 4, 3)::INTEGER // 4 AS located
  FROM pt JOIN hit USING (uninumbr))
WHERE CAST(uninumbr AS BIGINT) % 29 = 0 """, "pt", "hit")
cte("mmx", projected("mm", "s.lon", "s.lat", "uninumbr, lon, lat, located, group_id"), "mm", "cone")
O["q16_county_mismatch"] = compose("""
SELECT m.uninumbr, m.group_id AS reported, m.located, round(CASE WHEN cross_ % 2 = 1 THEN 0.0 ELSE gap END, 3) AS miles_off,
  EXISTS (SELECT 1 FROM corner a JOIN corner b ON a.lon = b.lon AND a.lat = b.lat WHERE a.group_id = m.group_id AND b.group_id = m.located) AS adjacent
FROM mm m LEFT JOIN (
  SELECT uninumbr, count(*) FILTER (WHERE (lat1 > lat) <> (lat2 > lat) AND lon < lon1 + (lat - lat1) * (lon2 - lon1) / nullif(lat2 - lat1, 0)) AS cross_,
    min(sqrt((x - ax - t*(bx-ax))*(x - ax - t*(bx-ax)) + (y - ay - t*(by2-ay))*(y - ay - t*(by2-ay))) / 1609.344) AS gap
  FROM (SELECT *, greatest(0.0, least(1.0, ((x-ax)*(bx-ax) + (y-ay)*(by2-ay)) / ((bx-ax)*(bx-ax) + (by2-ay)*(by2-ay)))) AS t
    FROM mmx JOIN oe2 USING (group_id)) GROUP BY 1) d USING (uninumbr)""", "mm", "mmx", "oe2", "corner")

# -- catchments ---------------------------------------------------------------------
O["j20_catchment_pairs"] = compose("SELECT * FROM pairs", "pairs")
O["j23_site_spacing"] = compose("SELECT uninumbr, tier, round(nearest_miles, 4) AS nearest_miles FROM spacing", "spacing")
cte("near_b", "SELECT t.tract_geoid, min(sqrt((t.x-s.x)*(t.x-s.x) + (t.y-s.y)*(t.y-s.y)) / 1609.344) AS m FROM tp t CROSS JOIN site s GROUP BY 1", "tp", "site")
O["j24_nearest_branch"] = compose("SELECT tract_geoid, round(m, 4) AS nearest_miles FROM near_b", "near_b")
O["d01_tier_radii"] = compose("SELECT tier, round(r, 4) AS radius_miles, sites FROM rad", "rad")
O["d02_catchment_bridge"] = compose("SELECT *, true AS is_subject_bank FROM bridge", "bridge")
cte("own2", """
SELECT tract_geoid, count(*) AS n, arg_min(uninumbr, (distance_miles, uninumbr)) AS near, first(uninumbr ORDER BY deposits DESC NULLS LAST, uninumbr) AS big
FROM pairs LEFT JOIN (SELECT uninumbr, deposits FROM fbd WHERE year = (SELECT y FROM newest)) USING (uninumbr) GROUP BY 1 """, "pairs", "fbd", "newest")
O["d03_tie_break_sensitivity"] = compose("""
SELECT a.*, b.* FROM (SELECT count(*) AS covered_tracts, count(*) FILTER (WHERE n > 1) AS contested_tracts, count(*) FILTER (WHERE near <> big) AS switched,
    round(count(*) FILTER (WHERE near <> big) / count(*), 6) AS switched_share, count(*) FILTER (WHERE near <> big AND n > 1) AS contested_switched,
    round(count(*) FILTER (WHERE near <> big AND n > 1) / nullif(count(*) FILTER (WHERE n > 1), 0), 6) AS contested_share FROM own2) a
CROSS JOIN (SELECT round(median(pc), 4) AS median_pct_change, count(*) FILTER (WHERE pc > 25) AS over_25, count(*) FILTER (WHERE pc > 100) AS over_100, count(*) AS branches
  FROM (SELECT CASE WHEN hn > 0 THEN abs(hb - hn) / hn * 100 END AS pc FROM (
    SELECT u, sum(hn) AS hn, sum(hb) AS hb FROM (
      SELECT near AS u, coalesce(households, 0) AS hn, 0 AS hb FROM own2 JOIN tr USING (tract_geoid)
      UNION ALL SELECT big, 0, coalesce(households, 0) FROM own2 JOIN tr USING (tract_geoid)) GROUP BY u))) b""", "own2", "tr")
O["d04_uncovered_tracts"] = compose("""
SELECT tract_geoid, tier, households, lmi_flag, round(m, 2) AS miles_to_nearest_branch FROM tr LEFT JOIN near_b USING (tract_geoid)
WHERE tract_geoid NOT IN (SELECT tract_geoid FROM pairs)""", "tr", "near_b", "pairs")
O["a40_coverage_summary"] = compose("""
SELECT *, round(100.0 * lmi_households / households, 4) AS lmi_household_pct FROM (
  SELECT tract_geoid IN (SELECT tract_geoid FROM pairs) AS covered, count(*) AS tracts, count(*) FILTER (WHERE lmi_flag) AS lmi_tracts,
    sum(households) AS households, sum(households) FILTER (WHERE lmi_flag) AS lmi_households FROM tr WHERE lmi_flag IS NOT NULL GROUP BY 1)""", "tr", "pairs")
O["d05_tract_competition"] = compose("SELECT * FROM comp", "comp")
O["d06_county_growth"] = compose("SELECT * FROM cg", "cg")


def banding(source: str, value: str, where: str) -> str:
    edges = ", ".join(f"{i / 10}" for i in range(11))
    band = " + ".join(f"(e[{i + 1}] > e[{i}] AND e[{i + 1}] < v)::INT" for i in range(1, 11))
    return (f"SELECT *, CAST({band} AS BIGINT) AS band FROM (SELECT *, {value} AS v FROM {source} WHERE {where})"
            f" CROSS JOIN (SELECT quantile_cont({value}, [{edges}]) AS e FROM {source} WHERE {where})")


O["w09_household_bands"] = compose(f"SELECT band, count(*) AS tracts, min(households) AS low, max(households) AS high FROM ({banding('tr', 'households', 'households > 0')}) GROUP BY 1", "tr")
O["d05_competition_shape"] = compose(f"""
SELECT band AS hh_band, round(median(tract_households), 2) AS tract_households, round(median(catchment_households), 2) AS catchment_households,
  round(median(competitor_branches), 2) AS competitor_branches, round(median(competitor_per_10k_tract_hh_unadjusted), 2) AS competitor_per_10k_tract_hh_unadjusted,
  round(median(competitor_per_10k_catchment_hh), 2) AS competitor_per_10k_catchment_hh
FROM ({banding('comp', 'tract_households', 'tract_households <> 0')}) GROUP BY 1""", "comp")

# -- yearly profiles ------------------------------------------------------------------
pivot = ", ".join(f"nullif(count(DISTINCT UNINUMBR) FILTER (WHERE STALPBR = '{s}'), 0) AS \"{s}\"" for s in ("00", "01", "02", "03", "04"))
O["a13_branch_counts"] = compose(f"SELECT YEAR, {pivot}, count(DISTINCT (UNINUMBR, STALPBR)) AS total FROM sod GROUP BY 1", "sod")
O["a14_deposit_distribution"] = compose("""
SELECT YEAR, count(*) AS branches, CAST(sum(DEPSUMBR) AS BIGINT) AS total_deposits_k, round(median(DEPSUMBR), 2) AS median_k,
  round(quantile_cont(DEPSUMBR, 0.9), 2) AS p90_k, max(DEPSUMBR) AS max_k,
  round(sum(DEPSUMBR) FILTER (WHERE rn <= greatest(1, n // 100)) / sum(DEPSUMBR), 6) AS share_in_top_1pct
FROM (SELECT *, row_number() OVER (PARTITION BY YEAR ORDER BY DEPSUMBR DESC) AS rn, count(*) OVER (PARTITION BY YEAR) AS n FROM sod) GROUP BY 1""", "sod")
O["a16_population_rates"] = compose("SELECT YEAR, " + ", ".join(f"round(count({f}) / count(*), 4) AS {f}" for f in KEY_FIELDS) + " FROM sod GROUP BY 1", "sod")
cte("yr", "SELECT DISTINCT year FROM by_", "by_")
cte("step", "SELECT year AS prev, (SELECT min(year) FROM yr n WHERE n.year > yr.year) AS cur FROM yr WHERE year < (SELECT max(year) FROM yr)", "yr")
cte("pres", "SELECT DISTINCT CERT, UNINUMBR, YEAR FROM sod", "sod")
cte("moves", """
SELECT prev, cur, u, bool_or(y = prev) AS b, bool_or(y = cur) AS a FROM (SELECT prev, cur, UNINUMBR AS u, YEAR AS y FROM step JOIN pres ON YEAR IN (prev, cur)) GROUP BY 1, 2, 3 """, "step", "pres")
O["x05_transitions"] = compose("""
SELECT CAST(prev AS VARCHAR) || '->' || CAST(cur AS VARCHAR) AS transition, count(*) FILTER (WHERE a AND b) AS carried_over, count(*) FILTER (WHERE b AND NOT a) AS closed,
  count(*) FILTER (WHERE a AND NOT b) AS opened,
  (SELECT count(*) FROM pres p WHERE p.YEAR = m.cur AND NOT EXISTS (SELECT 1 FROM pres o WHERE o.YEAR = m.prev AND o.CERT = p.CERT AND o.UNINUMBR = p.UNINUMBR)) - count(*) FILTER (WHERE a AND NOT b) AS transferred,
  count(*) FILTER (WHERE a) - count(*) FILTER (WHERE b) AS net FROM moves m GROUP BY prev, cur""", "moves", "pres")
O["x06_material_movements"] = compose("""
SELECT CAST(prev AS VARCHAR) || '->' || CAST(cur AS VARCHAR) AS transition, CASE WHEN a THEN 'appeared' ELSE 'disappeared' END AS event, CERT AS cert,
  min(NAMEFULL) AS institution, count(*) AS branches
FROM moves JOIN sod ON UNINUMBR = u AND YEAR = CASE WHEN a THEN cur ELSE prev END WHERE a <> b GROUP BY 1, 2, 3 HAVING count(*) >= 5""", "moves", "sod")
O["x07_established_split"] = compose("""
SELECT YEAR, CERT, count(*) FILTER (WHERE built < YEAR - 1) AS established_before, count(*) FILTER (WHERE built >= YEAR - 1) AS recent
FROM (SELECT s.*, CAST(right(SIMS_ESTABLISHED_DATE, 4) AS INTEGER) AS built FROM sod s) JOIN moves ON UNINUMBR = u AND YEAR = cur WHERE a AND NOT b GROUP BY 1, 2""", "moves", "sod")
cte("acq", """
SELECT CERT, round(sum(r), 6) AS acq_ratio, round(max(r), 6) AS max_year_ratio FROM (
  SELECT p.CERT, cur, count(*) / (SELECT count(*) FROM sod s WHERE s.CERT = p.CERT AND s.YEAR = prev) AS r
  FROM pres p JOIN step ON p.YEAR = cur
  WHERE EXISTS (SELECT 1 FROM pres o WHERE o.UNINUMBR = p.UNINUMBR AND o.YEAR = prev) AND NOT EXISTS (SELECT 1 FROM pres o WHERE o.UNINUMBR = p.UNINUMBR AND o.YEAR = prev AND o.CERT = p.CERT)
    AND EXISTS (SELECT 1 FROM sod s WHERE s.CERT = p.CERT AND s.YEAR = prev) GROUP BY p.CERT, prev, cur) GROUP BY 1 """, "pres", "step", "sod")
O["a43_acquisition_ratio"] = compose("SELECT * FROM acq", "acq")
cte("foot", """
SELECT CERT, arg_max(NAMEFULL, YEAR) AS name, count(DISTINCT UNINUMBR) FILTER (WHERE YEAR = (SELECT y FROM newest) AND STALPBR = '00') AS state_1,
  count(DISTINCT UNINUMBR) FILTER (WHERE YEAR = (SELECT y FROM newest) AND STALPBR = '01') AS state_2,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM sod t WHERE t.CERT = s.CERT GROUP BY YEAR)) AS peak, count(DISTINCT YEAR) AS vintages FROM sod s GROUP BY CERT """, "sod", "newest")
O["d18_footprint_profile"] = compose("SELECT *, state_1 + state_2 AS current_branches FROM foot", "foot")
O["p34_selection_criteria"] = compose("""
SELECT CERT, name, state_1, state_2, r AS acq_ratio, asset_k, greatest(state_1, state_2) >= 2 AND least(state_1, state_2) >= 1 AS c1_both_states,
  state_1 + state_2 >= 3 AS c2_scale, vintages = (SELECT count(*) FROM yr) AS c3a_continuous, r <= 0.2 AS c3b_organic,
  coalesce(rn > 5, true) AS c5_not_top5, coalesce(asset_k BETWEEN 1 AND 1000000000000000, false) AS c6_asset_band
FROM (SELECT foot.*, coalesce(acq_ratio, 0) AS r FROM foot LEFT JOIN acq USING (CERT))
LEFT JOIN (SELECT cert AS CERT, CAST(sum(deposits) AS BIGINT) // 1000 AS asset_k, row_number() OVER (ORDER BY CAST(sum(deposits) AS BIGINT) // 1000 DESC, cert) AS rn FROM fbd GROUP BY 1) USING (CERT)""",
                                      "foot", "acq", "yr", "fbd")
cte("drift0", f"SELECT s.*, {validity('SIMS_LATITUDE', 'SIMS_LONGITUDE')} = 'ok' AS good, {NORM} AS addr FROM sod s", "sod")
cte("drift1", projected("(SELECT * FROM drift0 WHERE good)", "s.SIMS_LONGITUDE", "s.SIMS_LATITUDE", "UNINUMBR, YEAR, addr"), "drift0", "cone")
O["d19_branch_drift"] = compose("""
SELECT s.UNINUMBR, first_year, last_year, invalid_vintages, round(mi, 4) AS position_drift_miles, chg AS address_changed,
  CASE WHEN nv = 1 THEN 'single_vintage' WHEN mi <= 0.1 THEN 'stable' WHEN chg THEN 'relocation' WHEN nv > 1 THEN 'regeocode' END AS drift_kind
FROM (SELECT UNINUMBR, min(YEAR) AS first_year, max(YEAR) AS last_year, count(*) FILTER (WHERE NOT good AND SIMS_LATITUDE IS NOT NULL) AS invalid_vintages FROM drift0 GROUP BY 1) s
LEFT JOIN (SELECT UNINUMBR, count(*) AS nv, count(DISTINCT addr) > 1 AS chg,
    sqrt((arg_max(x, YEAR) - arg_min(x, YEAR))**2 + (arg_max(y, YEAR) - arg_min(y, YEAR))**2) / 1609.344 AS mi FROM drift1 GROUP BY 1) d ON d.UNINUMBR = s.UNINUMBR""", "drift0", "drift1")
cte("lookup", "SELECT lpad(CAST(s_suppkey + 1000 AS VARCHAR), 7, '0') AS rssd, lpad(CAST(s_suppkey AS VARCHAR), 20, '0') AS lei FROM supplier WHERE s_suppkey % 2 = 0")
cte("register", f"""
SELECT {CERT.format(s='i')} AS cert, CASE WHEN i % 11 = 7 THEN '' ELSE lpad(CAST(i + 1000 AS VARCHAR), 7, '0') END AS fed_rssd
FROM (SELECT unnest(range(40)) AS i) WHERE i = 0 OR (i >= 6 AND i % 13 <> 0) """)
cte("xw", """
SELECT c.cert, c.name, c.current_branches, r.fed_rssd, CASE WHEN r.cert IS NULL THEN 'not_in_fdic' WHEN r.fed_rssd = '' THEN 'no_fed_rssd' WHEN l.lei IS NULL THEN 'no_lei_for_rssd' ELSE 'exact_rssd' END AS match_quality,
  coalesce(l.lei, '') AS lei, CASE WHEN l.lei IS NULL THEN '' ELSE 'fed_rssd == institutionId2017' END AS match_method,
  CASE WHEN l.lei IS NULL THEN 0 ELSE (SELECT count(*) FROM loans WHERE loans.lei = l.lei) END AS applications, c.cert = '00000' AS is_subject_bank
FROM (SELECT CERT AS cert, arg_max(NAMEFULL, YEAR) AS name, count(DISTINCT UNINUMBR) FILTER (WHERE YEAR = (SELECT y FROM newest)) AS current_branches FROM sod GROUP BY 1) c
LEFT JOIN register r ON r.cert = c.cert LEFT JOIN lookup l ON l.rssd = r.fed_rssd """, "sod", "newest", "register", "lookup", "loans")
O["j17_crosswalk"] = compose("SELECT * FROM xw", "xw")

O["p31_income_basis"] = compose("""
SELECT tract_geoid, round(coalesce(r, own), 4) AS tract_to_area_income_pct, CASE WHEN r IS NOT NULL THEN 'ffiec_ratio' WHEN own IS NOT NULL THEN 'acs_fallback' ELSE '' END AS lmi_basis,
  coalesce(r, own) < 80 AS lmi_flag
FROM (SELECT tract_geoid, r, 100.0 * median_family_income / nullif(ai, 0) AS own FROM tr
  LEFT JOIN (SELECT census_tract AS tract_geoid, median(TRY_CAST(tract_to_msa_income_percentage AS DOUBLE)) AS r FROM loans GROUP BY 1) USING (tract_geoid)
  LEFT JOIN (SELECT cbsa, CASE WHEN CAST(cbsa AS INTEGER) % 7 <> 0 THEN round(avg(median_family_income)) END AS ai FROM tr WHERE cbsa IS NOT NULL GROUP BY 1) USING (cbsa))""", "tr", "loans")
O["j19_staged_branches"] = compose(f"""
SELECT l.UNINUMBR AS uninumbr, l.CERT AS cert, CASE WHEN vv = 'ok' THEN p.poly_id END AS tract_geoid, vv AS validity, CASE WHEN vv = 'ok' THEN STCNTYBR END AS sod_county,
  CASE WHEN vv = 'ok' THEN substr(p.poly_id, 1, 5) END AS geo_county, CASE WHEN vv = 'ok' THEN STCNTYBR = substr(p.poly_id, 1, 5) END AS county_agrees,
  first_year, last_year, position_drift_miles, drift_kind, address_changed, invalid_vintages
FROM (SELECT s.*, {validity('SIMS_LATITUDE', 'SIMS_LONGITUDE')} AS vv FROM sod s WHERE s.YEAR = (SELECT max(YEAR) FROM sod t WHERE t.UNINUMBR = s.UNINUMBR)) l
JOIN ({O['d19_branch_drift']}) d ON d.UNINUMBR = l.UNINUMBR
LEFT JOIN tileid p ON floor((SIMS_LONGITUDE + 93) * 4) = p.i AND floor((SIMS_LATITUDE - 36) * 4) = p.j
  AND NOT (holed AND (SIMS_LONGITUDE + 93) * 4 - p.i >= 0.25 AND (SIMS_LONGITUDE + 93) * 4 - p.i < 0.75 AND (SIMS_LATITUDE - 36) * 4 - p.j >= 0.25 AND (SIMS_LATITUDE - 36) * 4 - p.j < 0.75)""", "sod", "tileid")

# -- lending staging ---------------------------------------------------------------------
CLASS = "CASE WHEN action_taken = '1' THEN 'origination' WHEN action_taken IN ('2','3','4','5') THEN 'application' WHEN action_taken = '6' THEN 'purchased' WHEN action_taken IN ('7','8') THEN 'preapproval' ELSE 'unmapped' END"
MEANING = ("CASE action_taken WHEN '1' THEN 'Loan originated' WHEN '2' THEN 'Application approved but not accepted' WHEN '3' THEN 'Application denied' WHEN '4' THEN 'Application withdrawn by applicant'"
           " WHEN '5' THEN 'File closed for incompleteness' WHEN '6' THEN 'Purchased loan' WHEN '7' THEN 'Preapproval request denied' WHEN '8' THEN 'Preapproval request approved but not accepted' END")
cte("ln", "SELECT * FROM loans WHERE census_tract IS NOT NULL", "loans")
O["a21_staged_lending"] = compose(f"""
SELECT census_tract AS tract_geoid, lei, loan_purpose, action_taken, count(*) AS record_count, CAST(coalesce(sum(TRY_CAST(loan_amount AS BIGINT)), 0) AS BIGINT) AS total_amount, {CLASS} AS action_class
FROM ln GROUP BY 1, 2, 3, 4""", "ln")
O["a22_outcome_profile"] = compose(f"SELECT action_taken, {MEANING} AS meaning, {CLASS} AS class, count(*) AS records, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM ln), 1) AS share_pct FROM ln GROUP BY 1", "ln")
O["a23_purchased_share"] = compose("""
SELECT lei, count(*) FILTER (WHERE action_taken = '1') AS originated, count(*) FILTER (WHERE action_taken = '6') AS purchased,
  round(100.0::DOUBLE * count(*) FILTER (WHERE action_taken = '6') / count(*), 1) AS pct_purchased
FROM ln WHERE action_taken IN ('1', '6') GROUP BY 1 HAVING count(*) >= 200 ORDER BY 4 DESC, 1 LIMIT 6""", "ln")
O["a24_filter_cost"] = compose("""
SELECT *, round(100.0::DOUBLE * (with_purchased - originations) / originations, 1) AS with_purchased_extra_pct, round(100.0::DOUBLE * (applications - originations) / originations, 1) AS applications_extra_pct,
  round(100.0::DOUBLE * (all_records - originations) / originations, 1) AS all_records_extra_pct
FROM (SELECT count(*) FILTER (WHERE action_taken = '1') AS originations, count(*) FILTER (WHERE action_taken IN ('1','6')) AS with_purchased,
  count(*) FILTER (WHERE action_taken <= '5') AS applications, count(*) AS all_records FROM ln)""", "ln")
kinds = ("ok", "suppressed", "unpopulated", "water_or_special")
O["a25_tier_status_crosstab"] = compose("SELECT tier, " + ", ".join(f"count(*) FILTER (WHERE tract_status = '{k}') AS {k}, round(100.0::DOUBLE * count(*) FILTER (WHERE tract_status = '{k}') / count(*), 1) AS {k}_pct" for k in kinds) + " FROM tr GROUP BY 1", "tr")

# -- overlap graph --------------------------------------------------------------------------
cte("lw", """
SELECT *, land_part / sum(land_part) OVER (PARTITION BY parent) AS w FROM (
  SELECT tract_geoid AS child, county_no || lpad(CAST(p AS VARCHAR), 6, '0') AS parent,
    CAST(sum(CASE WHEN c % 37 = 0 THEN 0 WHEN c % 39 = 0 THEN 1 ELSE c % 900 + 100 END) AS DOUBLE) AS land_part
  FROM bk WHERE tract_geoid IS NOT NULL GROUP BY 1, 2) WHERE land_part > 0 """, "bk")
O["g01_land_weights"] = compose("SELECT child, parent, round(w, 6) AS w FROM lw", "lw")
cte("app", """
SELECT child AS tract_geoid, CASE WHEN miss = 0 THEN hh END AS h19, parents, miss AS parents_missing, mw AS max_w, est / nullif(hh, 0) AS es,
  CASE WHEN miss > 0 THEN 'parent_suppressed' WHEN mw < 0.95 THEN 'fragmentary' WHEN est / nullif(hh, 0) > 0.01 THEN 'apportioned' ELSE 'direct' END AS gb
FROM (SELECT child, coalesce(sum(h * w), 0) AS hh, coalesce(sum(h * w) FILTER (WHERE w < 0.95), 0) AS est, count(DISTINCT parent) AS parents,
    count(*) FILTER (WHERE h IS NULL) AS miss, max(w) AS mw
  FROM lw LEFT JOIN (SELECT parent, CASE WHEN households_old >= 0 THEN households_old END AS h FROM oldc) USING (parent) GROUP BY 1) """, "lw", "oldc")
O["g02_apportioned_households"] = compose("SELECT tract_geoid, round(h19, 4) AS households_2019, gb AS growth_basis, parents, parents_missing, round(max_w, 6) AS max_w, round(es, 6) AS estimated_share FROM app", "app")
cte("lk", "SELECT 'c' || child AS a, 'p' || parent AS b FROM lw WHERE w >= 0.01", "lw")
cte("lk2", "SELECT a, b FROM lk UNION SELECT b, a FROM lk", "lk")
cte("cc0", "SELECT a AS node, a AS label FROM lk2 --recursive\nUNION SELECT l.b, r.label FROM cc0 r JOIN lk2 l ON l.a = r.node", "lk2")
cte("cc", "SELECT node, min(label) AS component FROM cc0 GROUP BY 1", "cc0")
O["g04_connected_components"] = compose("SELECT * FROM cc", "cc")
cte("clu", """
SELECT substr(node, 2) AS tract_geoid, component, count(*) OVER (PARTITION BY component) AS k,
  (SELECT sum(CASE WHEN households_old >= 0 THEN households_old END) FROM cc p JOIN oldc ON parent = substr(p.node, 2) WHERE p.node LIKE 'p%' AND p.component = cc.component) AS c19
FROM cc WHERE node LIKE 'c%' """, "cc", "oldc")
O["g06_household_growth"] = compose("""
SELECT tract_geoid, households, round(h19, 4) AS households_2019, CASE WHEN b1 = 'fragmentary' THEN byc ELSE own END AS household_growth_pct, own AS household_growth_pct_tract,
  CASE WHEN b1 = 'fragmentary' THEN CASE WHEN byc IS NULL THEN 'fragmentary_no_cluster' ELSE 'cluster' END ELSE b1 END AS growth_basis, component AS growth_cluster, k AS cluster_tracts
FROM (SELECT *, CASE WHEN own IS NULL AND b0 IN ('direct', 'apportioned', 'fragmentary') THEN 'no_2019_base' ELSE b0 END AS b1,
    CASE WHEN c19 > 0 AND c24 > 0 THEN round((pow(c24 / c19, 0.2::DOUBLE) - 1) * 100, 4) END AS byc
  FROM (SELECT *, CASE WHEN st THEN 'not_applicable' ELSE coalesce(gb, 'no_2010_counterpart') END AS b0,
      CASE WHEN NOT st AND h19 > 0 AND households IS NOT NULL THEN round((pow(households / h19, 0.2::DOUBLE) - 1) * 100, 4) END AS own,
      sum(households) OVER (PARTITION BY component) AS c24
    FROM (SELECT tract_geoid, households, tract_status IN ('water_or_special', 'unpopulated') AS st FROM tr) LEFT JOIN app USING (tract_geoid) LEFT JOIN clu USING (tract_geoid)))""",
                                   "tr", "app", "clu")

# -- index statistics -----------------------------------------------------------------------
cte("sc", "SELECT * FROM idx WHERE opportunity_score IS NOT NULL", "idx")
O["w10_global_rank"] = compose("SELECT tract_geoid, opportunity_score, rank() OVER (ORDER BY opportunity_score DESC) AS score_rank FROM sc", "sc")
O["a33_spearman"] = compose("""
SELECT round(corr(a, b), 6) AS spearman, count(*) AS n FROM (
  SELECT row_number() OVER (ORDER BY households, md5(tract_geoid)) AS a, row_number() OVER (ORDER BY median_hh_income, md5(tract_geoid)) AS b
  FROM tr WHERE households IS NOT NULL AND median_hh_income IS NOT NULL)""", "tr")
O["d08_score_reproduction"] = compose("""
SELECT count(*) AS scored, max(abs(contrib_household_growth + contrib_median_income + contrib_deposit_market_growth + contrib_competitor_saturation + contrib_unmet_mortgage_demand - opportunity_score)) <= 1e-3 AS within_tolerance FROM sc""", "sc")
COMPS = ("household_growth", "median_income", "deposit_market_growth", "competitor_saturation", "unmet_mortgage_demand")
PW = dict(zip(COMPS, (0.20, 0.15, 0.25, 0.20, 0.20)))
cte("sets_alt", "SELECT scenario, " + ", ".join(f"max(weight) FILTER (WHERE component = '{c}') AS w{i}" for i, c in enumerate(COMPS)) + " FROM wt WHERE scenario <> 'primary' GROUP BY 1", "wt")
cte("sets_loo", " UNION ALL ".join(
    f"SELECT '{d}' AS scenario, " + ", ".join(f"{0.0 if c == d else PW[c]}::DOUBLE / (1 - {PW[d]}::DOUBLE) AS w{i}" for i, c in enumerate(COMPS)) for d in COMPS))
cte("sets_zero", " UNION ALL ".join(
    f"SELECT '{d}' AS scenario, " + ", ".join(f"{0.0 if c == d else PW[c]}::DOUBLE AS w{i}" for i, c in enumerate(COMPS)) for d in COMPS))


def compared(sets: str) -> str:
    alt = " + ".join(f"contrib_{c} / {PW[c]}::DOUBLE * w{i}" for i, c in enumerate(COMPS))
    cte(f"r_{sets}", f"""
SELECT *, abs(ar - br_) AS shift, row_number() OVER (PARTITION BY scenario ORDER BY br_, tract_geoid) AS bi, row_number() OVER (PARTITION BY scenario ORDER BY ar, tract_geoid) AS ai FROM (
  SELECT *, rank() OVER (PARTITION BY scenario ORDER BY base DESC) AS br_, rank() OVER (PARTITION BY scenario ORDER BY alt DESC) AS ar,
    row_number() OVER (PARTITION BY scenario ORDER BY base, md5(tract_geoid)) AS bo, row_number() OVER (PARTITION BY scenario ORDER BY alt, md5(tract_geoid)) AS ao
  FROM (SELECT scenario, tract_geoid, lmi_flag, opportunity_score AS base, round({alt}, 6) AS alt FROM sc CROSS JOIN {sets})) """, "sc", sets)
    cte(f"c_{sets}", f"""
SELECT scenario, round(corr(bo, ao), 4) AS spearman, count(*) FILTER (WHERE bi <= 50 AND ai <= 50) AS top_retained,
  CAST(floor(median(shift)) AS BIGINT) AS median_shift, CAST(floor(quantile_cont(shift, 0.95)) AS BIGINT) AS p95_shift, CAST(max(shift) AS BIGINT) AS max_shift,
  round(100.0::DOUBLE * count(*) FILTER (WHERE shift >= 500) / count(*), 2) AS pct_moving_far,
  round(avg(CASE WHEN ai <= 50 THEN lmi_flag::INT END) * 100, 1) AS top_lmi_share_pct FROM r_{sets} GROUP BY 1 """, f"r_{sets}")
    return compose(f"SELECT * FROM c_{sets}", f"c_{sets}")


O["d10_scenario_sensitivity"] = compared("sets_alt")
O["d11_leave_one_out"] = compared("sets_loo")
O["d22_zero_weight"] = compared("sets_zero")
O["d13_drivers"] = compose("SELECT first(scenario ORDER BY spearman, scenario) AS driver_full_ranking, first(scenario ORDER BY top_retained, scenario) AS driver_top FROM c_sets_loo", "c_sets_loo")
cte("t50", "SELECT * FROM sc ORDER BY opportunity_score DESC, tract_geoid LIMIT 50", "sc")
O["d12_influence"] = compose(" UNION ALL ".join(f"""
SELECT '{c}' AS component, {PW[c]}::DOUBLE AS weight, round(stddev_samp(contrib_{c}), 4) AS sd_of_contribution, round(corr(contrib_{c}, opportunity_score), 3) AS corr_with_score,
  (SELECT round(100.0::DOUBLE * sum(contrib_{c}) / sum(opportunity_score), 1) FROM t50) AS share_of_top_contrib FROM sc""" for c in COMPS), "sc", "t50")
O["d14_top_composition"] = compose(" UNION ALL ".join(f"""
SELECT '{p}' AS part, round(avg(growth_is_estimated::INT) * 100, 1) AS share_estimated_growth, round(avg(lmi_flag::INT) * 100, 1) AS share_lmi,
  round(avg(coalesce(county_growth_heavily_adjusted, false)::INT) * 100, 1) AS share_county_adjusted FROM {s}""" for p, s in (("top", "t50"), ("all", "sc"))), "t50", "sc")
O["d17_corridor_test"] = compose("""
SELECT max(cbsa) FILTER (WHERE m) AS dominant_cbsa, count(*) FILTER (WHERE m) AS in_dominant, count(*) FILTER (WHERE m AND e) AS estimated_in_dominant,
  count(*) FILTER (WHERE NOT m AND e) AS estimated_elsewhere, round(corr(m::INT, e::INT), 3) AS phi
FROM (SELECT cbsa, growth_is_estimated AS e, coalesce(cbsa = (SELECT cbsa FROM t50 JOIN tr USING (tract_geoid) WHERE cbsa IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), false) AS m
  FROM t50 JOIN (SELECT tract_geoid, cbsa FROM tr) USING (tract_geoid))""", "t50", "tr")
cte("longv", " UNION ALL ".join(f"SELECT tract_geoid, households, coalesce(cbsa, 'RURAL-' || substr(county_fips, 1, 2)) AS market, '{n}' AS component, {c}::DOUBLE AS v FROM comp5"
                                for n, c in (("median_income", "median_hh_income"), ("deposit_market_growth", "cagr_pct_retail"), ("competitor_saturation", "sat"), ("unmet_mortgage_demand", "unmet"))), "comp5")
O["d20_scale_test"] = compose("""
SELECT component, round(pooled, 3) AS pooled, round(wm, 3) AS within_market, markets FROM (
  SELECT component, corr(a, b) AS pooled FROM (SELECT component, row_number() OVER (PARTITION BY component ORDER BY households, md5(tract_geoid)) AS a,
    row_number() OVER (PARTITION BY component ORDER BY v, md5(tract_geoid)) AS b FROM longv WHERE households IS NOT NULL AND v IS NOT NULL) GROUP BY 1)
JOIN (SELECT component, sum(r * n) / sum(n) AS wm, count(*) AS markets FROM (
  SELECT component, market, corr(a, b) AS r, count(*) AS n FROM (SELECT component, market, row_number() OVER (PARTITION BY component, market ORDER BY households, md5(tract_geoid)) AS a,
    row_number() OVER (PARTITION BY component, market ORDER BY v, md5(tract_geoid)) AS b FROM longv WHERE households IS NOT NULL AND v IS NOT NULL) GROUP BY 1, 2)
  WHERE n >= 3 AND r IS NOT NULL GROUP BY 1) USING (component)""", "longv")
O["d21_over_index"] = compose("""
SELECT round(c, 4) AS catchment_lmi_pct, round(f, 4) AS footprint_lmi_pct, round(c - f, 4) AS over_index_pp FROM (
  SELECT 100.0 * sum(households) FILTER (WHERE lmi_flag AND i) / sum(households) FILTER (WHERE i) AS c, 100.0 * sum(households) FILTER (WHERE lmi_flag) / sum(households) AS f
  FROM (SELECT *, tract_geoid IN (SELECT tract_geoid FROM pairs) AS i FROM tr WHERE lmi_flag IS NOT NULL AND households IS NOT NULL))""", "tr", "pairs")

# -- siting -----------------------------------------------------------------------------------
cte("cand0", """
SELECT s.*, t.county_fips, t.cbsa, t.centroid_lat, t.centroid_lon, round(rad.r, 2) AS rr, row_number() OVER (ORDER BY opportunity_score DESC, s.tract_geoid) - 1 AS i
FROM sc s JOIN tr t USING (tract_geoid) LEFT JOIN rad ON rad.tier = s.tier """, "sc", "tr", "rad")
cte("cand", projected("cand0", "s.centroid_lon", "s.centroid_lat", "s.* EXCLUDE (rho0)").replace("SELECT s.* EXCLUDE (rho0), rho", "SELECT *, rho"), "cand0", "cone")
cte("sep", "SELECT a.i, b.i AS j FROM cand a JOIN cand b ON a.i < b.i AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2) / 1609.344 > greatest(a.rr, b.rr)", "cand")
cte("uni", "SELECT tract_geoid, households AS h, lmi_flag AS lmi, t.x, t.y FROM tr JOIN (SELECT tract_geoid, x, y FROM tp) t USING (tract_geoid) WHERE lmi_flag IS NOT NULL AND households IS NOT NULL", "tr", "tp")
cte("rch", """
SELECT c.i, u.tract_geoid, u.h, u.lmi FROM cand c JOIN uni u ON sqrt((c.x-u.x)**2 + (c.y-u.y)**2) / 1609.344 <= c.rr
WHERE u.tract_geoid NOT IN (SELECT tract_geoid FROM pairs) """, "cand", "uni", "pairs")
cte("ga", """
SELECT 0 AS i1, (SELECT min(j) FROM sep WHERE i = 0) AS i2,
  (SELECT min(a.j) FROM sep a JOIN sep b ON a.j = b.j WHERE a.i = 0 AND b.i = (SELECT min(j) FROM sep WHERE i = 0)) AS i3 """, "sep")
cte("tot", "SELECT sum(h) FILTER (WHERE lmi) AS lt, sum(h) FILTER (WHERE NOT lmi) AS nt FROM uni", "uni")
cte("lst", "SELECT c.i, c.opportunity_score AS s, coalesce(list(DISTINCT r.tract_geoid) FILTER (WHERE r.tract_geoid IS NOT NULL), []) AS l FROM cand c LEFT JOIN rch r ON r.i = c.i GROUP BY 1, 2", "cand", "rch")
cte("nz", "SELECT i, s, l, coalesce(lh, 0) AS lh, coalesce(nh, 0) AS nh FROM lst LEFT JOIN (SELECT i, sum(h) FILTER (WHERE lmi) AS lh, sum(h) FILTER (WHERE NOT lmi) AS nh FROM rch GROUP BY 1) USING (i)", "lst", "rch")
cte("tri", """
SELECT a.i, a.j, b.j AS k FROM sep a JOIN sep b ON b.i = a.j JOIN sep c ON c.i = a.i AND c.j = b.j """, "sep")
cte("trs", """
SELECT t.i, t.j, t.k, round(x.s + y.s + z.s, 4) AS s, x.lh + y.lh + z.lh AS lh0, x.nh + y.nh + z.nh AS nh0, list_distinct(list_concat(list_concat(x.l, y.l), z.l)) AS l, len(x.l) + len(y.l) + len(z.l) AS n0
FROM tri t JOIN nz x ON x.i = t.i JOIN nz y ON y.i = t.j JOIN nz z ON z.i = t.k """, "tri", "nz")
cte("ovl", """
SELECT i, j, k, coalesce(sum(h) FILTER (WHERE lmi), 0) AS lh, coalesce(sum(h) FILTER (WHERE NOT lmi), 0) AS nh
FROM (SELECT i, j, k, unnest(l) AS tract_geoid FROM trs WHERE len(l) < n0) JOIN uni USING (tract_geoid) GROUP BY 1, 2, 3 """, "trs", "uni")
cte("gb", """
SELECT t.i, t.j, t.k FROM trs t LEFT JOIN ovl o ON o.i = t.i AND o.j = t.j AND o.k = t.k CROSS JOIN tot
WHERE coalesce(o.lh, lh0) / lt >= coalesce(o.nh, nh0) / nt ORDER BY t.s DESC, t.i, t.j, t.k LIMIT 1 """, "trs", "ovl", "tot")
cte("mem", """
SELECT 'A_commercial' AS rule, unnest([i1, i2, i3]) AS i FROM ga UNION ALL SELECT 'B_constrained', unnest([i, j, k]) FROM gb """, "ga", "gb")
cte("sites", """
SELECT rule, tract_geoid, county_name, cbsa_title, tier, households, lmi_flag, opportunity_score, unmet_mortgage_demand, growth_is_estimated FROM mem JOIN cand USING (i) """, "mem", "cand")
O["d16_recommended_sites"] = compose("SELECT * FROM sites", "sites")
O["d16_constraint_cost"] = compose("""
SELECT round(a, 4) AS score_a, round(b, 4) AS score_b, round(a - b, 4) AS cost_points, round(100.0 * (a - b) / a, 2) AS cost_pct FROM (
  SELECT sum(opportunity_score) FILTER (WHERE rule = 'A_commercial') AS a, sum(opportunity_score) FILTER (WHERE rule = 'B_constrained') AS b FROM sites)""", "sites")
cte("newt", "SELECT DISTINCT rule, tract_geoid, h, lmi FROM mem JOIN rch USING (i)", "mem", "rch")
O["d15_site_evaluation"] = compose("""
SELECT s.*, round(dl, 4) AS delta_lmi_pp, round(dn, 4) AS delta_non_lmi_pp, dl >= dn AS passes, coalesce(n, 0) AS new_tracts, coalesce(hh, 0) AS new_households FROM (
  SELECT rule, round(sum(opportunity_score), 4) AS score, CAST(sum(unmet_mortgage_demand) AS BIGINT) AS unmet, count(DISTINCT cbsa) AS cbsas, count(DISTINCT county_fips) AS counties,
    count(*) FILTER (WHERE growth_is_estimated) AS estimated_growth, count(*) FILTER (WHERE lmi_flag) AS lmi_sites FROM mem JOIN cand USING (i) GROUP BY 1) s
JOIN (SELECT m.rule, count(n.tract_geoid) AS n, sum(h) AS hh, 100.0 * coalesce(sum(h) FILTER (WHERE lmi), 0) / any_value(lt) AS dl, 100.0 * coalesce(sum(h) FILTER (WHERE NOT lmi), 0) / any_value(nt) AS dn
  FROM (SELECT DISTINCT rule FROM mem) m CROSS JOIN tot LEFT JOIN newt n ON n.rule = m.rule GROUP BY 1) e USING (rule)""", "mem", "cand", "newt", "tot")
cte("cov", """
SELECT rule, tract_geoid, false AS newly_covered FROM (SELECT DISTINCT tract_geoid FROM pairs) CROSS JOIN (VALUES ('current'), ('A_commercial'), ('B_constrained')) r(rule)
UNION ALL SELECT rule, tract_geoid, true FROM newt """, "pairs", "newt")
O["k05_coverage_sets"] = compose("SELECT * FROM cov", "cov")
cte("rates", """
SELECT rule, n AS tracts_covered, round(100.0 * l / lt, 4) AS lmi_coverage_pct, round(100.0 * o / nt, 4) AS non_lmi_coverage_pct, round(100.0 * l / lt - 100.0 * o / nt, 4) AS coverage_gap_pp
FROM (SELECT rule, count(*) AS n, sum(h) FILTER (WHERE lmi) AS l, sum(h) FILTER (WHERE NOT lmi) AS o FROM cov JOIN uni USING (tract_geoid) GROUP BY 1) CROSS JOIN tot """, "cov", "uni", "tot")
cte("cvr", """
SELECT r.*, CASE WHEN lmi_coverage_pct IS NOT NULL THEN 'PASS - value present (criterion cannot fail)' END AS ac06_as_written, round(dl, 4) AS delta_lmi_pp, round(dn, 4) AS delta_non_lmi_pp,
  CASE WHEN rule = 'current' THEN NULL WHEN dl IS NULL THEN 'NOT MEASURED' WHEN dl >= dn THEN 'PASS - expansion is proportional' ELSE 'FAIL - non-LMI coverage grows faster' END AS binding_test,
  CASE WHEN rule <> 'current' AND dl > 0 THEN round(dn / dl, 2) END AS non_lmi_growth_multiple
FROM (SELECT r.*, r.lmi_coverage_pct - c.lmi_coverage_pct AS dl, r.non_lmi_coverage_pct - c.non_lmi_coverage_pct AS dn FROM rates r CROSS JOIN (SELECT * FROM rates WHERE rule = 'current') c) r """, "rates")
O["q13_lmi_coverage"] = compose("SELECT * EXCLUDE (dl, dn) FROM cvr", "cvr")

# -- gates ---------------------------------------------------------------------------------------
O["gate01_scope"] = compose("SELECT STALPBR, count(*) AS rows FROM sod WHERE STALPBR NOT IN ('00', '01', '02') GROUP BY 1", "sod")
O["gate02_footprint_change"] = compose("""
SELECT cert, branches_before, branches_now, round((branches_now - branches_before) / branches_before, 6) AS change, (SELECT y FROM newest) AS year FROM (
  SELECT CERT AS cert, count(DISTINCT UNINUMBR) FILTER (WHERE YEAR = (SELECT max(prev) FROM step)) AS branches_before, count(DISTINCT UNINUMBR) FILTER (WHERE YEAR = (SELECT y FROM newest)) AS branches_now FROM sod GROUP BY 1)
WHERE branches_before >= 3 AND abs((branches_now - branches_before) / branches_before) > 0.02 AND cert <> '00009'""", "sod", "step", "newest")
O["gate03_county_codes"] = compose("SELECT count(*) FILTER (WHERE STCNTYBR IS NULL OR length(STCNTYBR) <> 5) AS malformed FROM sod", "sod")
O["gate04_outcome_codes"] = compose("SELECT action_taken, count(*) AS rows FROM loans WHERE action_taken NOT IN ('1', '2', '3', '4', '5', '6', '7', '8') GROUP BY 1", "loans")
O["gate05_subject_resolution"] = compose("""
SELECT *, subject_rows = 1 AND same_lei = 1 AND applications > 0 AS passes FROM (SELECT count(*) FILTER (WHERE is_subject_bank) AS subject_rows,
  count(*) FILTER (WHERE lei <> '' AND lei = (SELECT max(lei) FROM xw WHERE is_subject_bank)) AS same_lei, CAST(coalesce(sum(applications) FILTER (WHERE is_subject_bank), 0) AS BIGINT) AS applications FROM xw)""", "xw")
LEN = (("dim_tract", "tr", "tract_geoid", 11), ("dim_tract", "tr", "county_fips", 5), ("dim_branch", "br", "tract_geoid", 11), ("dim_branch", "br", "county_fips", 5),
       ("fact_tract_lending", "lend", "tract_geoid", 11), ("bridge_branch_catchment", "bridge", "tract_geoid", 11))
O["gate06_identifier_lengths"] = compose(" UNION ALL ".join(f"SELECT '{t}.{c}' AS identifier, count(*) FILTER (WHERE length({c}) <> {n}) AS wrong_length FROM {s}" for t, s, c, n in LEN), "tr", "br", "lend", "bridge")
REFS = (("deposits.uninumbr -> branch", "fbd", "uninumbr", "br"), ("deposits.cert -> institution", "fbd", "cert", "inst"), ("bridge.uninumbr -> branch", "bridge", "uninumbr", "br"),
        ("bridge.tract -> tract", "bridge", "tract_geoid", "tr"), ("lending.tract -> tract", "lend", "tract_geoid", "tr"), ("branch.tract -> tract", "br", "tract_geoid", "tr"),
        ("competition.tract -> tract", "comp", "tract_geoid", "tr"), ("tract -> competition", "tr", "tract_geoid", "comp"), ("growth.county -> tract", "cg", "county_fips", "tr"))
O["gate07_references"] = compose(" UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) AS orphans FROM {a} x WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {b} y WHERE y.{k} = x.{k})" for n, a, k, b in REFS)
    + " UNION ALL SELECT 'tract.county -> growth', count(DISTINCT county_fips) FROM tr WHERE county_fips NOT IN (SELECT county_fips FROM cg)", "fbd", "br", "inst", "bridge", "lend", "comp", "cg", "tr")
O["gate07_orphan_tracts"] = compose("""
SELECT tract_geoid, count(*) AS fact_rows, CAST(sum(record_count) AS BIGINT) AS applications, count(DISTINCT lei) AS lenders, substr(tract_geoid, 1, 2) AS state_fips
FROM lend WHERE tract_geoid NOT IN (SELECT tract_geoid FROM tr) GROUP BY 1""", "lend", "tr")
TABLES = (("dim_year", "yr"), ("dim_institution", "inst"), ("dim_branch", "br"), ("dim_tract", "tr"), ("fact_branch_deposits", "fbd"), ("fact_tract_lending", "lend"),
          ("bridge_branch_catchment", "bridge"), ("fact_tract_competition", "comp"), ("fact_county_deposit_growth", "cg"))
O["gate09_row_counts"] = compose(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {s}" for n, s in TABLES), *[s for _, s in TABLES])
O["gate10_single_primary"] = compose("SELECT tract_geoid, count(*) AS n FROM bridge WHERE is_primary GROUP BY 1 HAVING count(*) > 1", "bridge")
O["gate11_radius_bounds"] = compose("""
SELECT * FROM (SELECT t.tier, coalesce(sites, 0) AS sites, CASE WHEN coalesce(sites, 0) < 2 THEN 'too few sites' WHEN r < 1 OR r > 15 THEN 'outside the bounds' END AS reason
  FROM (VALUES ('metro'), ('micro'), ('rural')) t(tier) LEFT JOIN rad ON rad.tier = t.tier) WHERE reason IS NOT NULL""", "rad")
O["gate13_boolean_values"] = compose("SELECT is_main_office AS value, count(*) AS rows, 'is_main_office' AS \"column\" FROM br WHERE is_main_office IS NOT NULL GROUP BY 1", "br")
O["gate14_unique_branch_year"] = compose("SELECT uninumbr, year, count(*) AS n FROM fbd GROUP BY 1, 2 HAVING count(*) > 1", "fbd")
O["gate17_reconciliation_failures"] = f"SELECT * FROM ({business.ORACLES['q14_reconciliation']}) WHERE ac01_result NOT LIKE 'PASS%'"

# -- measures ---------------------------------------------------------------------------------------
cte("df_", "SELECT f.uninumbr, f.cert, f.year, f.deposits, i.is_subject_bank AS own, b.state FROM fbd f LEFT JOIN inst i USING (cert) LEFT JOIN br b USING (uninumbr)", "fbd", "inst", "br")
for name, keys, keep in (("m01_deposit_measures", "state, year", "true"), ("m05_market_share_of_subject", "year", "own")):
    O[name] = compose(f"""
SELECT {keys}, total_deposits, branch_count, subject_deposits, market_deposits, round(total_deposits / 1e9, 4) AS total_deposits_bn, round(100.0::DOUBLE * subject_deposits / market_deposits, 4) AS market_share_pct
FROM (SELECT {keys}, CAST(sum(deposits) FILTER (WHERE {keep}) AS BIGINT) AS total_deposits, count(DISTINCT uninumbr) FILTER (WHERE {keep}) AS branch_count,
  CAST(sum(deposits) FILTER (WHERE own) AS BIGINT) AS subject_deposits, CAST(sum(deposits) AS BIGINT) AS market_deposits FROM df_ GROUP BY {keys})""", "df_")
cte("sy", "SELECT state, year, CAST(sum(deposits) AS BIGINT) AS d FROM df_ GROUP BY 1, 2", "df_")
O["m07_deposit_trend"] = compose("""
SELECT a.state, a.year, a.d AS total_deposits, b.d AS deposits_py, CASE WHEN c.d > 0 THEN round(pow(a.d::DOUBLE / c.d, 1.0::DOUBLE / 3) - 1, 6) END AS deposit_cagr_3yr
FROM sy a LEFT JOIN sy b ON b.state = a.state AND b.year = a.year - 1 LEFT JOIN sy c ON c.state = a.state AND c.year = a.year - 3""", "sy")
O["m09_deposit_cagr"] = compose("""
SELECT a.state, a.d AS start_deposits, b.d AS end_deposits, round((pow(b.d::DOUBLE / a.d, 1.0::DOUBLE / (b.year - a.year)) - 1) * 100, 4) AS deposit_cagr_pct
FROM sy a JOIN sy b ON a.state = b.state WHERE a.year = (SELECT min(year) FROM sy) AND b.year = (SELECT max(year) FROM sy)""", "sy")
Q8 = business.ORACLES["q08_branch_performance_index"]
O["m10_performance_measures"] = f"SELECT round(avg(index_size_adjusted), 4) AS index_size_adjusted, round(avg(performance_index), 4) AS index_raw, count(*) FILTER (WHERE index_size_adjusted < 1) AS underperforming_branches FROM ({Q8})"
O["m13_equity_measures"] = compose("""
SELECT round(c.lmi_coverage_pct, 4) AS lmi_coverage_pct, round(b.lmi_coverage_pct, 4) AS lmi_coverage_recommended_pct, round(b.dl - b.dn, 4) AS coverage_delta_gap_pp,
  CASE WHEN b.dl - b.dn IS NULL THEN 'NOT MEASURED' WHEN b.dl - b.dn >= 0 THEN 'PASS - expansion is proportional' ELSE 'FAIL - non-LMI coverage grows faster' END AS binding_test_result,
  round(sa - sb, 4) AS constraint_cost_points, round(100.0 * (sa - sb) / sa, 4) AS constraint_cost_pct, k AS lmi_sites_in_shortlist
FROM (SELECT sum(opportunity_score) FILTER (WHERE rule = 'A_commercial') AS sa, sum(opportunity_score) FILTER (WHERE rule = 'B_constrained') AS sb, count(*) FILTER (WHERE rule = 'B_constrained' AND lmi_flag) AS k FROM sites)
LEFT JOIN cvr c ON c.rule = 'current' LEFT JOIN cvr b ON b.rule = 'B_constrained'""", "sites", "cvr")
O["m20_tract_measures"] = compose("""
SELECT tier, round(lc, 4) AS subject_lmi_coverage, round(nc, 4) AS subject_non_lmi_coverage, round(ls, 4) AS lmi_share_of_selection_pct, round(cg_, 4) AS cluster_measured_growth_pct, round(tc, 4) AS subject_tract_coverage_pct,
  'LMI ' || format('{:.1f}', ls) || '% vs ' || format('{:.1f}', (SELECT 100.0::DOUBLE * sum(households) FILTER (WHERE lmi_flag) / sum(households) FROM tr WHERE lmi_flag IS NOT NULL AND households IS NOT NULL)) || '% footprint  |  growth estimated for ' || format('{:.1f}', cg_) || '% of these tracts' AS shortlist_caveat
FROM (SELECT tier, sum(households) FILTER (WHERE lmi_flag AND i) / sum(households) FILTER (WHERE lmi_flag) AS lc, sum(households) FILTER (WHERE NOT lmi_flag AND i) / sum(households) FILTER (WHERE NOT lmi_flag) AS nc,
    100.0::DOUBLE * count(*) FILTER (WHERE lmi_flag) / count(lmi_flag) AS ls, 100.0::DOUBLE * count(*) FILTER (WHERE growth_basis <> 'direct') / count(household_growth_pct) AS cg_,
    100.0::DOUBLE * count(*) FILTER (WHERE i) / (SELECT count(*) FROM tr) AS tc
  FROM (SELECT *, tract_geoid IN (SELECT tract_geoid FROM pairs) AS i FROM tr) GROUP BY 1)""", "tr", "pairs")
O["m26_capture_measures"] = compose("SELECT tier, round(100.0::DOUBLE * sum(mine) / sum(orig), 4) AS capture_rate_pct, CAST(sum(orig - mine) AS BIGINT) AS unmet_originations FROM demand JOIN tr USING (tract_geoid) WHERE orig > 0 GROUP BY 1", "demand", "tr")
O["m28_published_score"] = compose("SELECT tier, round(avg(opportunity_score), 3) AS published_opportunity_score FROM idx GROUP BY 1", "idx")
WI = {**PW, "unmet_mortgage_demand": 0.05}
cte("wif", "SELECT tract_geoid, lmi_flag, growth_is_estimated, 0.85::DOUBLE AS weight_total, round(round((" + " + ".join(f"round(contrib_{c} / {PW[c]}::DOUBLE, 6) * {WI[c]}::DOUBLE" for c in COMPS) + ") / 0.85::DOUBLE, 6), 4) AS weighted_score FROM sc", "sc")
O["m30_weighted_score"] = compose("SELECT * FROM wif", "wif")
O["m31_top_measures"] = compose("""
SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE lmi_flag) / count(lmi_flag), 4) AS top_lmi_share_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE growth_is_estimated) / count(*), 4) AS top_cluster_growth_pct
FROM (SELECT * FROM wif ORDER BY weighted_score DESC, tract_geoid LIMIT 50)""", "wif")

O["p32_staged_deposits"] = compose("SELECT UNINUMBR AS uninumbr, CERT AS cert, YEAR AS year, CAST(DEPSUMBR * 1000 AS BIGINT) AS deposits FROM sod", "sod")
O["p01_staged_institutions"] = f"""
SELECT cert, name AS institution_name, fed_rssd, nullif(lei, '') AS lei, match_quality, match_method, is_subject_bank, DATE '2002-01-01' AS attribute_as_of_date FROM ({O['j17_crosswalk']})"""
O["p34_selection_funnel"] = f"""
SELECT count(*) AS all_institutions, count(*) FILTER (WHERE c1_both_states) AS after_c1_both_states, count(*) FILTER (WHERE c1_both_states AND c2_scale) AS after_c2_scale,
  count(*) FILTER (WHERE c1_both_states AND c2_scale AND c3a_continuous) AS after_c3a_continuous,
  count(*) FILTER (WHERE c1_both_states AND c2_scale AND c3a_continuous AND c5_not_top5) AS after_c5_not_top5,
  count(*) FILTER (WHERE c1_both_states AND c2_scale AND c3a_continuous AND c5_not_top5 AND c6_asset_band) AS after_c6_asset_band FROM ({O['p34_selection_criteria']})"""
O["a30_branch_reach"] = compose("SELECT uninumbr, branch_tier, count(*) AS tracts, count(*) FILTER (WHERE is_primary) AS primary_tracts FROM bridge GROUP BY 1, 2", "bridge")
O["a30_overlap_sizes"] = compose("SELECT branches, count(*) AS tracts FROM (SELECT tract_geoid, count(*) AS branches FROM bridge GROUP BY 1) GROUP BY 1", "bridge")
GRID = " UNION ALL ".join(
    f"SELECT tract_geoid, '{c}' AS component, w, round({' + '.join('w' if d == c else f'{PW[d]}::DOUBLE' for d in COMPS)}, 2) AS weight_total, "
    + " + ".join(f"round(contrib_{d} / {PW[d]}::DOUBLE, 6) * {'w' if d == c else f'{PW[d]}::DOUBLE'}" for d in COMPS) + " AS raw FROM sc CROSS JOIN grid"
    for c in COMPS)
cte("grid", "SELECT round(i * 0.05::DOUBLE, 2) AS w FROM range(11) t(i)")
cte("gridded", GRID, "sc", "grid")
O["m33_weight_grid"] = compose("""
SELECT component, w AS weight, weight_total, round(avg(round(raw / weight_total, 6)), 4) AS mean_score, count(*) AS tracts,
  first(tract_geoid ORDER BY round(raw / weight_total, 6) DESC, tract_geoid) AS best_tract FROM gridded GROUP BY 1, 2, 3""", "gridded")

# -- export models --------------------------------------------------------------------------------
O["e01_branch_model"] = compose(f"""
SELECT b.*, p.index_size_adjusted, p.performance_index AS index_raw, p.diagnosis, p.market, p.cagr_3y_pct, p.actual_deposits, p.predicted_deposits, p.households AS catchment_households, p.booking_concentration, p.catchment_partly_unmeasured
FROM br b LEFT JOIN ({Q8}) p ON p.uninumbr = b.uninumbr""", "br")
O["e02_tract_model"] = compose("""
SELECT t.* EXCLUDE (households_2019, household_growth_pct_tract, growth_cluster, cluster_tracts, owner_occupied_units), s AS state_name, county_name || ', ' || s AS county_full, tract_geoid IN (SELECT tract_geoid FROM pairs) AS in_catchment
FROM (SELECT *, CASE substr(county_fips, 1, 2) WHEN '17' THEN 'Illinois' WHEN '55' THEN 'Wisconsin' END AS s FROM tr) x JOIN tr t USING (tract_geoid)""".replace("SELECT t.* EXCLUDE (", "SELECT x.* EXCLUDE (s, ").replace(" x JOIN tr t USING (tract_geoid)", " x"), "tr", "pairs")
O["e03_year_model"] = compose("SELECT year, make_date(year, 6, 30) AS sod_as_of_date, make_date(year, 6, 30) AS date FROM yr", "yr")
cte("zc", "SELECT tract_geoid, " + ", ".join(f"round(contrib_{c} / {PW[c]}::DOUBLE, 6) AS {z}" for c, z in zip(COMPS, ("household_growth_z", "median_income_z", "deposit_growth_z", "competitor_saturation_z", "unmet_demand_z")))
    + ", opportunity_score, county_name, lmi_flag, growth_is_estimated FROM sc", "sc")
O["e06_component_scores"] = compose("SELECT zc.*, centroid_lat, centroid_lon FROM zc JOIN (SELECT tract_geoid, centroid_lat, centroid_lon FROM tr) USING (tract_geoid)", "zc", "tr")
O["e07_site_model"] = compose("SELECT sites.*, centroid_lat, centroid_lon, county_fips FROM sites JOIN (SELECT tract_geoid, centroid_lat, centroid_lon, county_fips FROM tr) USING (tract_geoid)", "sites", "tr")

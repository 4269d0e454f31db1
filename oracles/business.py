"""Oracle texts of the fourteen business queries."""

from __future__ import annotations

from oracles.base import compose, cte

cte("geo_dep", """
SELECT f.*, b.state, substr(b.tract_geoid, 1, 5) AS cf, b.cert AS bcert, b.is_subject_bank AS own, b.is_main_office AS head,
  b.county_agrees, b.tract_geoid
FROM fbd f JOIN br b USING (uninumbr) WHERE b.tract_geoid IS NOT NULL """, "fbd", "br")
cte("lagged", """
SELECT *, lag(deposits, 3) OVER w AS d0, lag(year, 3) OVER w AS y0 FROM geo_dep
WINDOW w AS (PARTITION BY uninumbr ORDER BY year) """, "geo_dep")

ORACLES: dict[str, str] = {}

ORACLES["q01_deposits_by_county_year"] = compose("""
SELECT state, cf AS county_fips, (SELECT min(county_name) FROM tr WHERE tr.county_fips = g.cf) AS county_name, year,
  count(DISTINCT bcert) AS institutions, count(DISTINCT uninumbr) AS branches,
  count(DISTINCT uninumbr) FILTER (WHERE own) AS subject_branches,
  count(DISTINCT uninumbr) FILTER (WHERE NOT county_agrees) AS contested_branches,
  CAST(sum(deposits) AS BIGINT) AS deposits, CAST(sum(deposits) FILTER (WHERE own) AS BIGINT) AS subject_deposits,
  round(sum(deposits)::DOUBLE / count(DISTINCT uninumbr), 0) AS deposits_per_branch
FROM geo_dep g GROUP BY state, cf, year""", "geo_dep", "tr")

ORACLES["q02_market_share_by_county_year"] = compose("""
SELECT m.*, round(100.0 * subject_deposits / nullif(market_deposits, 0), 3) AS deposit_share_pct,
  round(100.0 * subject_branches / nullif(market_branches, 0), 3) AS branch_share_pct,
  round(100.0 * subject_deposits / nullif(market_deposits, 0) - 100.0 * subject_branches / nullif(market_branches, 0), 3) AS share_gap_pp
FROM (SELECT state, cf AS county_fips, year, count(DISTINCT bcert) AS institutions, count(DISTINCT uninumbr) AS market_branches,
    (SELECT count(DISTINCT uninumbr) FROM geo_dep s WHERE s.own AND s.cf = g.cf AND s.year = g.year) AS subject_branches,
    count(DISTINCT uninumbr) FILTER (WHERE head = '1') AS hq_branches, CAST(sum(deposits) AS BIGINT) AS market_deposits,
    (SELECT CAST(coalesce(sum(deposits), 0) AS BIGINT) FROM geo_dep s WHERE s.own AND s.cf = g.cf AND s.year = g.year) AS subject_deposits
  FROM geo_dep g GROUP BY state, cf, year) m""", "geo_dep")

ORACLES["q03_branch_deposit_cagr"] = compose("""
SELECT uninumbr, cert, state, cf AS county_fips, own AS is_subject_bank, head AS is_main_office, y0 AS prior_year, year,
  year - y0 AS years_elapsed, d0 AS deposits_3y_ago, deposits,
  round(100 * (pow(deposits::DOUBLE / d0, 1.0::DOUBLE / (year - y0)) - 1), 3) AS cagr_pct, year - y0 <> 3 AS irregular_interval
FROM lagged WHERE d0 > 0""", "lagged")

cte("mk", """
SELECT l.*, coalesce(t.cbsa, 'RURAL-' || l.state) AS market, coalesce(t.cbsa_title, 'Outside any CBSA, ' || l.state) AS market_name,
  100 * (pow(deposits::DOUBLE / d0, 1.0::DOUBLE / (year - y0)) - 1) AS g
FROM lagged l LEFT JOIN tr t USING (tract_geoid) WHERE d0 > 0 AND year = (SELECT y FROM newest) """, "lagged", "tr", "newest")
ORACLES["q04_rank_branches_in_market"] = compose("""
SELECT market, market_name, n AS market_branches, uninumbr, cert, own AS is_subject_bank, head AS is_main_office,
  round(g, 3) AS cagr_pct, round(med, 3) AS market_median_cagr, round(g - med, 3) AS vs_market_pp, rk AS growth_rank_in_market,
  round(pr, 4) AS growth_percentile, n < 10 AS thin_market
FROM (SELECT *, rank() OVER (PARTITION BY market ORDER BY g DESC) AS rk, percent_rank() OVER (PARTITION BY market ORDER BY g) AS pr,
    count(*) OVER (PARTITION BY market) AS n, median(g) OVER (PARTITION BY market) AS med FROM mk) WHERE own""", "mk")

ORACLES["q05_market_vs_branch_attribution"] = compose("""
SELECT state, cf AS county_fips, py AS prev_year, year, mb AS market_branches, sb AS subject_branches, round(mg, 2) AS market_growth_pct,
  round(sg, 2) AS subject_growth_pct, round(sg - mg, 2) AS excess_growth_pp,
  CASE WHEN sg IS NULL THEN 'no subject presence' WHEN sg > mg THEN 'gaining share' ELSE 'losing share' END AS attribution,
  mb - pmb AS market_branch_change, sb - psb AS subject_branch_change,
  abs(mg) > 40 AND abs(coalesce(mb - pmb, 0)) <= 2 AS market_volatile
FROM (SELECT *, 100.0 * (md - pmd) / nullif(pmd, 0) AS mg, 100.0 * (sd - psd) / nullif(psd, 0) AS sg FROM (
    SELECT *, lag(md) OVER w AS pmd, lag(sd) OVER w AS psd, lag(mb) OVER w AS pmb, lag(sb) OVER w AS psb, lag(year) OVER w AS py FROM (
      SELECT state, cf, year, CAST(sum(deposits) AS BIGINT) AS md, count(*) AS mb, CAST(sum(deposits) FILTER (WHERE own) AS BIGINT) AS sd,
        count(*) FILTER (WHERE own) AS sb FROM geo_dep GROUP BY ALL)
    WINDOW w AS (PARTITION BY state, cf ORDER BY year)) WHERE year = py + 1 AND sb > 0)""", "geo_dep")

ORACLES["q06_branch_percentile_in_county"] = compose("""
SELECT uninumbr, cert, state, cf AS county_fips, head AS is_main_office, n AS county_branches, deposits, med AS county_median_deposits,
  round(deposits / nullif(med, 0), 4) AS vs_county_median, round(pr, 4) AS deposit_percentile, n < 10 AS thin_county
FROM (SELECT *, percent_rank() OVER (PARTITION BY cf ORDER BY deposits) AS pr, median(deposits) OVER (PARTITION BY cf) AS med,
    count(*) OVER (PARTITION BY cf) AS n FROM geo_dep WHERE year = (SELECT y FROM newest)) WHERE own""", "geo_dep", "newest")

cte("catch", """
SELECT p.uninumbr, count(*) AS tracts, count(*) FILTER (WHERE tract_status = 'ok') AS tracts_measured,
  count(*) FILTER (WHERE tract_status = 'suppressed') AS tracts_suppressed,
  sum(households) FILTER (WHERE tract_status = 'ok') AS households,
  sum(owner_occupied_units) FILTER (WHERE tract_status = 'ok') AS owner_occupied,
  sum(households * median_family_income) FILTER (WHERE tract_status = 'ok') AS catchment_potential,
  count(*) FILTER (WHERE lmi_flag) AS lmi_tracts, sum(households) FILTER (WHERE tract_status = 'ok' AND lmi_flag) AS lmi_households,
  round(CAST(sum(CAST(round(distance_miles * 1000) AS BIGINT)) AS BIGINT)::DOUBLE / count(*) / 1000, 2) AS mean_distance_miles, round(max(distance_miles), 2) AS max_distance_miles
FROM bridge p JOIN tr USING (tract_geoid) WHERE is_primary GROUP BY 1 """, "bridge", "tr")
ORACLES["q07_catchment_demographics"] = compose("""
SELECT c.uninumbr, city, state, is_main_office, drift_kind, tracts, tracts_measured, tracts_suppressed, households, owner_occupied,
  catchment_potential, round(catchment_potential / nullif(households, 0), 0) AS weighted_family_income, lmi_tracts, lmi_households,
  round(100.0 * lmi_households / nullif(households, 0), 2) AS lmi_household_share_pct, mean_distance_miles, max_distance_miles,
  round(100.0 * tracts_suppressed / tracts, 1) AS pct_tracts_suppressed
FROM catch c JOIN br USING (uninumbr)""", "catch", "br")

cte("elig", """
SELECT b.uninumbr, b.city, b.state, b.position_drift_miles, b.drift_kind, b.county_agrees, t.tier,
  coalesce(t.cbsa, 'RURAL-' || b.state) AS market, c.tracts, c.tracts_suppressed, c.households, c.catchment_potential AS pot, f.deposits AS dep
FROM br b JOIN catch c USING (uninumbr) JOIN fbd f ON f.uninumbr = b.uninumbr AND f.year = (SELECT y FROM newest)
LEFT JOIN tr t ON t.tract_geoid = b.tract_geoid
WHERE b.is_subject_bank AND b.last_year = (SELECT y FROM newest) AND b.tract_geoid IS NOT NULL
  AND coalesce(b.is_main_office, '0') <> '1' AND b.service_type IN ('11', '12') """, "br", "catch", "fbd", "newest", "tr")
cte("lvl", """
SELECT *, mdep * (pot / nullif(mpot, 0)) AS pred, dep / nullif(mdep * (pot / nullif(mpot, 0)), 0) AS level,
  ndep * (pot / nullif(npot, 0)) AS pred_n FROM (
  SELECT *, sum(pot) OVER m AS mpot, CAST(sum(dep) OVER m AS DOUBLE) AS mdep, count(*) OVER m AS mn, sum(pot) OVER () AS npot,
    CAST(sum(dep) OVER () AS DOUBLE) AS ndep, median(dep) OVER () AS nmed FROM elig WINDOW m AS (PARTITION BY market)) """, "elig")
cte("quart", """
SELECT uninumbr, tier, level, ntile(4) OVER (PARTITION BY tier ORDER BY households, md5(uninumbr)) AS size_quartile
FROM lvl WHERE households > 0 AND tier IS NOT NULL """, "lvl")
cte("trend", """
SELECT uninumbr, 100 * (pow(deposits::DOUBLE / d0, 1.0::DOUBLE / (year - y0)) - 1) AS tr3 FROM (
  SELECT uninumbr, year, deposits, lag(deposits, 3) OVER w AS d0, lag(year, 3) OVER w AS y0 FROM fbd WINDOW w AS (PARTITION BY uninumbr ORDER BY year))
WHERE d0 > 0 AND year = (SELECT y FROM newest) """, "fbd", "newest")
ORACLES["q08_branch_performance_index"] = compose("""
SELECT l.uninumbr, city, state, tracts, tracts_suppressed, households, dep AS actual_deposits, round(pred, 0) AS predicted_deposits,
  round(l.level, 4) AS performance_index, round(l.level / nullif(m.bm, 0), 4) AS index_size_adjusted, q.size_quartile,
  round(tr3, 2) AS cagr_3y_pct,
  CASE WHEN tr3 IS NULL THEN CASE WHEN l.level < 1 THEN 'poor level, trajectory unknown' ELSE 'adequate level, trajectory unknown' END
       WHEN l.level < 1 THEN CASE WHEN tr3 < 0 THEN 'poor level AND poor trajectory' ELSE 'poor level, positive trajectory' END
       WHEN tr3 < 0 THEN 'adequate level, poor trajectory' ELSE 'adequate level and trajectory' END AS diagnosis,
  market, mn AS market_branch_count, round(dep / nullif(pred_n, 0), 4) AS index_vs_network, tracts_suppressed > 0 AS catchment_partly_unmeasured,
  drift_kind = 'relocation' AND position_drift_miles > 1 AS branch_relocated, NOT county_agrees AS county_disputed,
  dep > 20 * nmed AS booking_concentration
FROM lvl l LEFT JOIN trend USING (uninumbr) LEFT JOIN quart q ON q.uninumbr = l.uninumbr
LEFT JOIN (SELECT tier, size_quartile, median(level) AS bm FROM quart GROUP BY 1, 2) m ON m.tier = q.tier AND m.size_quartile = q.size_quartile
""", "lvl", "quart", "trend")

ORACLES["q09_tract_lending_outcomes"] = compose("""
SELECT *, round(100.0 * origination_count / application_count, 2) AS origination_rate_pct,
  round(100.0 * denial_count / application_count, 2) AS denial_rate_pct_biased_low
FROM (SELECT f.tract_geoid, f.lei, i.institution_name, i.cert, i.is_subject_bank, f.loan_purpose,
    CAST(sum(CASE WHEN action_taken BETWEEN '1' AND '5' THEN record_count END) AS BIGINT) AS application_count,
    CAST(sum(CASE WHEN action_taken = '1' THEN record_count END) AS BIGINT) AS origination_count,
    sum(CASE WHEN action_taken = '1' THEN total_amount END) AS origination_amount,
    CAST(sum(CASE WHEN action_taken = '3' THEN record_count END) AS BIGINT) AS denial_count,
    CAST(sum(CASE WHEN action_taken = '6' THEN record_count END) AS BIGINT) AS purchased_count,
    CAST(sum(CASE WHEN action_taken IN ('7','8') THEN record_count END) AS BIGINT) AS preapproval_count
  FROM lend f LEFT JOIN inst i ON i.lei = f.lei GROUP BY ALL)
WHERE application_count > 0""", "lend", "inst")

ORACLES["q10_capture_rate_by_tract"] = compose("""
SELECT d.tract_geoid, county_name, tier, households, lmi_flag, lmi_basis, d.tract_geoid IN (SELECT tract_geoid FROM bridge) AS is_in_catchment,
  lenders AS lenders_originating, apps AS all_applications, orig AS all_originations, orig_amt AS all_origination_amt,
  mine AS subject_originations, mine_amt AS subject_origination_amt, round(100.0 * mine / orig, 3) AS capture_rate_pct,
  orig - mine AS competitor_originations, round(orig_amt - mine_amt, 2) AS competitor_origination_amt
FROM demand d JOIN tr USING (tract_geoid) WHERE orig > 0""", "demand", "tr", "bridge")

ORACLES["q11_unmet_demand_ranking"] = compose("""
SELECT tract_geoid, county_name, CASE substr(tract_geoid, 1, 2) WHEN '55' THEN 'WI' WHEN '17' THEN 'IL' ELSE substr(tract_geoid, 1, 2) END AS state,
  tier, households, median_family_income, lmi_flag, lmi_basis, apps AS all_applications, orig AS all_originations, mine AS subject_originations,
  orig - mine AS unmet_originations, orig_amt AS all_origination_amt, cap AS capture_rate_pct, outside AS outside_footprint,
  orig - mine AS basis_absolute, round((orig - mine) / nullif(households, 0), 5) AS basis_per_household,
  round((orig - mine)::DOUBLE / nullif(apps, 0), 5) AS basis_per_application, round((1 - cap / 100.0) * apps, 2) AS basis_uncaptured_apps,
  CASE WHEN outside THEN 'siting - outside the footprint' WHEN cap = 0 THEN 'conversion - present, capturing none'
       ELSE 'conversion - present, under-capturing' END AS opportunity_type,
  lmi_flag IS NULL AS lmi_undetermined, tract_status <> 'ok' AS tract_partly_unmeasured
FROM (SELECT *, round(100.0::DOUBLE * mine / orig, 3) AS cap, tract_geoid NOT IN (SELECT tract_geoid FROM bridge) AS outside
  FROM demand JOIN tr USING (tract_geoid) WHERE orig > 0)""", "demand", "tr", "bridge")

ORACLES["q12_market_opportunity_index"] = compose("SELECT * FROM idx", "idx")

ORACLES["q14_reconciliation"] = compose("""
SELECT state, year, n AS computed_branches, branches AS published_branches, n - branches AS branch_diff, k AS computed_deposits_k,
  deposits_thousands AS published_deposits_k, k - deposits_thousands AS deposit_diff_k, round(p, 6) AS deposit_diff_pct,
  CASE WHEN n IS NULL THEN 'MISSING FROM WAREHOUSE' WHEN branches IS NULL THEN 'MISSING FROM REFERENCE'
       WHEN n <> branches THEN 'BRANCH COUNT MISMATCH' WHEN abs(p) > 0.1 THEN 'FAIL - outside 0.1%'
       WHEN k <> deposits_thousands THEN 'PASS - within tolerance' ELSE 'PASS - exact' END AS ac01_result
FROM (SELECT coalesce(a.state, b.state) AS state, coalesce(a.year, b.year) AS year, n, branches, k, deposits_thousands,
    100.0 * (k - deposits_thousands) / nullif(deposits_thousands, 0) AS p
  FROM (SELECT state, year, count(*) AS n, CAST(sum(deposits) AS BIGINT) / 1000.0::DOUBLE AS k FROM fbd JOIN br USING (uninumbr) GROUP BY 1, 2) a
  FULL JOIN totals_pub b ON a.state = b.state AND a.year = b.year)""", "fbd", "br", "totals_pub")

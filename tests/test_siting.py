import itertools
import random

import pytest
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.operators.quality import GateError
from marketgrid.plans import measures, siting
from marketgrid.plans.warehouse import Warehouse

RADII = {"metro": 3.0, "micro": 6.0, "rural": 9.0}


def world(seed, n_tracts=90, n_scored=18):
    rnd = random.Random(seed)
    tiers = list(RADII)
    tracts = []
    for i in range(n_tracts):
        tracts.append({
            "tract_geoid": f"{i:011d}", "county_name": "x", "cbsa_title": "y", "county_fips": f"{i % 7:05d}",
            "cbsa": f"{i % 3}", "tier": tiers[i % 3], "households": None if i % 23 == 5 else float(rnd.randint(50, 900)),
            "lmi_flag": None if i % 17 == 3 else rnd.random() < 0.3,
            "lon": -89 + rnd.uniform(0, 0.5), "lat": 42 + rnd.uniform(0, 0.4),
        })
    scored = sorted(rnd.sample(range(n_tracts), n_scored))
    score = {i: round(rnd.uniform(-1, 3), 1) for i in scored}      # one decimal: many equal sums
    covered = set(rnd.sample(range(n_tracts), 8))
    return tracts, score, covered


def warehouse(spark, tracts, score, covered):
    dim = spark.createDataFrame(
        [(t["tract_geoid"], t["county_name"], t["cbsa_title"], t["county_fips"], t["cbsa"], t["tier"], t["households"],
          t["lmi_flag"], t["lon"], t["lat"]) for t in tracts],
        "tract_geoid string, county_name string, cbsa_title string, county_fips string, cbsa string, tier string,"
        " households double, lmi_flag boolean, centroid_lon double, centroid_lat double")
    index = dim.join(spark.createDataFrame([(tracts[i]["tract_geoid"], s) for i, s in score.items()],
                                           "tract_geoid string, opportunity_score double"), "tract_geoid").withColumns({
        "unmet_mortgage_demand": F.lit(10), "growth_is_estimated": F.lit(False)})
    bridge = spark.createDataFrame([(tracts[i]["tract_geoid"], True) for i in covered], "tract_geoid string, is_primary boolean")
    from marketgrid.plans.catchment import tract_points

    wh = Warehouse({"dim_tract": dim, "opportunity_index": index, "bridge_branch_catchment": bridge,
                    "tier_radii": spark.createDataFrame(list(RADII.items()), "tier string, radius_miles double")})
    wh._tables["tract_points"] = lambda: tract_points(wh)
    return wh


def brute_force(spark, wh, tracts, score, covered):
    xy = {r.tract_geoid: (r.px, r.py) for r in wh.tract_points.collect()}
    far = lambda a, b: (sum((p - q) ** 2 for p, q in zip(xy[a], xy[b]))) ** 0.5 / C.METRES_PER_MILE
    by_id = {t["tract_geoid"]: t for t in tracts}
    cand = sorted(((s, tracts[i]["tract_geoid"]) for i, s in score.items()), key=lambda c: (-c[0], c[1]))
    rated = [t for t in tracts if t["lmi_flag"] is not None and t["households"] is not None]
    now = {tracts[i]["tract_geoid"] for i in covered}
    total = [sum(t["households"] for t in rated if t["lmi_flag"] is f) for f in (True, False)]
    reach = [{t["tract_geoid"] for t in rated if far(g, t["tract_geoid"]) <= RADII[by_id[g]["tier"]]} - now for _, g in cand]
    sep = lambda i, j: far(cand[i][1], cand[j][1]) > max(RADII[by_id[cand[k][1]]["tier"]] for k in (i, j))
    chosen = []
    for i in range(len(cand)):
        if len(chosen) < 3 and all(sep(i, j) for j in chosen):
            chosen.append(i)
    best = None
    for tri in itertools.combinations(range(len(cand)), 3):
        if not all(sep(a, b) for a, b in itertools.combinations(tri, 2)):
            continue
        s = round(sum(cand[i][0] for i in tri), 4)
        if best and s <= best[0]:
            continue
        new = set().union(*(reach[i] for i in tri))
        gain = [sum(by_id[g]["households"] for g in new if by_id[g]["lmi_flag"] is f) for f in (True, False)]
        if gain[0] / total[0] >= gain[1] / total[1]:
            best = (s, tri)
    return [cand[i][1] for i in chosen], best and (best[0], [cand[i][1] for i in best[1]])


@pytest.mark.parametrize("seed,first", [(1, 64), (2, 3), (3, 4)])
def test_rules_match_brute_force(spark, seed, first):
    """A short first prefix has to grow until the triple is proven best."""
    tracts, score, covered = world(seed)
    wh = warehouse(spark, tracts, score, covered)
    want_a, want_b = brute_force(spark, wh, tracts, score, covered)
    got = siting.Selection(wh, first=first)
    sites = got.sites().collect()
    assert sorted(s.tract_geoid for s in sites if s.rule == siting.RULE_A) == sorted(want_a)
    chosen = sorted(s.tract_geoid for s in sites if s.rule == siting.RULE_B)
    assert chosen == (sorted(want_b[1]) if want_b else [])
    report = {r.rule: r for r in siting.q13_lmi_coverage(wh, got.coverage()).collect()}
    for r in report.values():               # a site adds coverage and removes none
        assert r.delta_lmi_pp >= 0 and r.delta_non_lmi_pp >= 0
    if want_b:
        assert got.constraint_cost().first().score_b == pytest.approx(want_b[0])
        assert {r.rule: r.passes for r in got.evaluation().collect()}[siting.RULE_B]


def test_winner_beyond_the_first_prefix(spark):
    """The best tracts add no low-income households, so the winner lies far down the list."""
    tracts = [{
        "tract_geoid": f"{i:011d}", "county_name": "x", "cbsa_title": "y", "county_fips": "00001", "cbsa": "1",
        "tier": "metro", "households": 100.0, "lmi_flag": i >= 12, "lon": -92 + 0.3 * (i % 15), "lat": 38 + 0.3 * (i // 15),
    } for i in range(15)]
    score = {i: round(3 - 0.1 * i, 1) for i in range(15)}
    wh = warehouse(spark, tracts, score, {})
    want_a, want_b = brute_force(spark, wh, tracts, score, {})
    got = siting.Selection(wh, first=3)
    sites = got.sites().collect()
    assert sorted(s.tract_geoid for s in sites if s.rule == siting.RULE_A) == sorted(want_a)
    assert sorted(s.tract_geoid for s in sites if s.rule == siting.RULE_B) == sorted(want_b[1])
    assert max(want_b[1]) >= "00000000012"


@pytest.mark.parametrize("seed", [4, 5, 8])
def test_tied_scores(spark, seed, monkeypatch):
    """All scores equal: the first triple of the list wins, and no list of all pairs is formed to find it."""
    tracts, score, covered = world(seed, n_scored=40)
    score = dict.fromkeys(score, 1.5)
    wh = warehouse(spark, tracts, score, covered)
    _, want = brute_force(spark, wh, tracts, score, covered)
    depths, ties = [], []
    monkeypatch.setattr(siting, "passing_triple", lambda w, r, d, least, f=siting.passing_triple: (depths.append(d), f(w, r, d, least))[1])
    monkeypatch.setattr(siting, "earlier_tie", lambda *a, f=siting.earlier_tie: (ties.append(a[2].i), f(*a))[1])
    got = siting.constrained_sites(wh, siting.candidates(wh), 8)
    assert sorted(got) == (sorted(want[1]) if want else [])
    assert ties == [0] * len(ties) and (len(depths) == 1 or not ties or depths[-2] < 40)


def test_many_tied_scores_form_few_pairs(spark, monkeypatch):
    tracts = [{
        "tract_geoid": f"{i:011d}", "county_name": "x", "cbsa_title": "y", "county_fips": "00001", "cbsa": "1",
        "tier": "metro", "households": 100.0, "lmi_flag": i % 2 == 1, "lon": -92 + 0.1 * (i % 40), "lat": 38 + 0.1 * (i // 40),
    } for i in range(1_600)]
    wh = warehouse(spark, tracts, dict.fromkeys(range(1_600), 2.0), {})
    sizes = []
    monkeypatch.setattr(siting, "separated_pairs", lambda *a, f=siting.separated_pairs: (sizes.append(f(*a).count()), f(*a))[1])
    got = siting.constrained_sites(wh, siting.candidates(wh), 16)
    assert sorted(got) == ["00000000000", "00000000001", "00000000003"] and sum(sizes) <= 16 * 15 / 2


def test_short_selection_is_refused(spark):
    tracts, score, covered = world(1, n_scored=2)
    with pytest.raises(GateError, match="separated sites"):
        siting.Selection(warehouse(spark, tracts, score, covered))
    assert siting.Selection(warehouse(spark, tracts, score, covered), complete=False).sites().count() <= 2


RATES = [("current", 1839, 42.4944, 38.7077, 3.7868), ("B_constrained", 1850, 42.8686, 39.055, 3.8136),
         ("A_commercial", 1858, 42.5708, 39.3495, 3.2213)]
RATE_DDL = ("rule string, tracts_covered long, lmi_coverage_pct double, non_lmi_coverage_pct double,"
            " coverage_gap_pp double")


def test_published_coverage_table(spark):
    got = siting.coverage_report(spark.createDataFrame(RATES, RATE_DDL)).collect()
    assert [r.rule for r in got] == ["current", "B_constrained", "A_commercial"]
    now, b, a = got
    assert (now.delta_lmi_pp, now.binding_test, now.non_lmi_growth_multiple) == (0.0, None, None)
    assert (b.delta_lmi_pp, b.delta_non_lmi_pp, b.non_lmi_growth_multiple) == (0.3742, 0.3473, 0.93)
    assert b.binding_test == "PASS - expansion is proportional"
    assert (a.delta_lmi_pp, a.delta_non_lmi_pp, a.non_lmi_growth_multiple) == (0.0764, 0.6418, 8.4)
    assert a.binding_test == "FAIL - non-LMI coverage grows faster"


def test_published_constraint_cost(spark):
    sites = spark.createDataFrame(
        [("A_commercial", s, None) for s in (2.6999, 2.3654, 2.095)] + [("B_constrained", s, False) for s in (2.6999, 2.0334, 1.7558)],
        "rule string, opportunity_score double, lmi_flag boolean")
    r = measures.equity_measures(siting.coverage_report(spark.createDataFrame(RATES, RATE_DDL)), sites).first()
    assert round(r.constraint_cost_points, 4) == 0.6712
    assert round(r.constraint_cost_pct, 1) == 9.4
    assert r.lmi_sites_in_shortlist == 0
    assert r.binding_test_result.startswith("PASS")
    missing = measures.equity_measures(
        siting.coverage_report(spark.createDataFrame(RATES[:1], RATE_DDL)), sites).first()
    assert missing.binding_test_result == "NOT MEASURED"

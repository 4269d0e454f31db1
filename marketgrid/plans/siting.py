"""Site selection under a proportional-coverage rule, and its coverage test (query 13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.functions.geo import miles, with_xy
from marketgrid.operators import ranking, relational, spatial
from marketgrid.operators.quality import GateError
from marketgrid.session import materialise

FIRST_PREFIX = 64
N_SITES = 3
RULE_A, RULE_B, CURRENT = "A_commercial", "B_constrained", "current"


def universe(wh) -> DataFrame:
    """Tracts with a known income class and known households."""
    return wh.dim_tract.filter(F.col("lmi_flag").isNotNull() & F.col("households").isNotNull())


def current_tracts(wh) -> DataFrame:
    return wh.bridge_branch_catchment.select("tract_geoid").distinct()


def published_radii(wh) -> DataFrame:
    return wh.tier_radii.select("tier", C.rnd("radius_miles", 2).alias("radius_miles"))


def candidates(wh) -> DataFrame:
    """All scored tracts with their attributes, map position and radius."""
    index = wh.opportunity_index.filter(F.col("opportunity_score").isNotNull()).select(
        "tract_geoid", "county_name", "cbsa_title", "tier", "households", "lmi_flag", "opportunity_score",
        "unmet_mortgage_demand", "growth_is_estimated",
    )
    place = wh.dim_tract.select("tract_geoid", "county_fips", "cbsa", "centroid_lat", "centroid_lon")
    return with_xy(
        index.join(place, "tract_geoid", "left").join(published_radii(wh), "tier", "left"),
        "centroid_lon", "centroid_lat",
    )


def best_of(cand: DataFrame, k: int) -> DataFrame:
    """The k best tracts: highest score, then least id."""
    return relational.top_k(cand, k, F.desc("opportunity_score"), F.asc("tract_geoid"))


def listed(cand: DataFrame) -> DataFrame:
    """All candidates with their place `i` in the order of the list, from 0."""
    return materialise(ranking.numbered(cand, [F.desc("opportunity_score"), F.asc("tract_geoid")], "i"))


def separated_pairs(ranked: DataFrame, last: int) -> DataFrame:
    """(i, j) with i < j <= last whose distance exceeds the greater of the two radii.

    The pairs of a short list are enumerated by place, so the comparison is an
    equi-join.
    """
    a = ranked.select("i", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("radius_miles").alias("ar"))
    b = ranked.select(F.col("i").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"),
                      F.col("radius_miles").alias("br"))
    later = a.filter(F.col("i") < last).withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.lit(last).cast("long"))))
    return later.join(b, "j").filter(miles("ax", "ay", "bx", "by") > F.greatest("ar", "br")).select("i", "j")


def candidate_reach(wh, cand: DataFrame) -> DataFrame:
    """New tracts each candidate would cover, at the candidate's own tier radius."""
    rated = wh.tract_points.filter(F.col("lmi_flag").isNotNull() & F.col("households").isNotNull())
    points = rated.join(current_tracts(wh), "tract_geoid", "left_anti").drop("tier")
    circles = cand.select(F.col("tract_geoid").alias("site"), "tier", F.col("x").alias("cx0"), F.col("y").alias("cy0"))
    return spatial.radius_join(circles, points, published_radii(wh)).select(
        "site", "tract_geoid", "households", "lmi_flag"
    )


def greedy_sites(cand: DataFrame, n: int = N_SITES) -> list[str]:
    """Rule A: the best tract, then each time the best one separated from all chosen; at most n ids.

    One pass over the scored tracts per site: nothing but the chosen rows reaches the driver, and no list is cut.
    """
    chosen, open_tracts = [], cand
    for _ in range(n):
        row = best_of(open_tracts, 1).select("tract_geoid", "x", "y", "radius_miles").first()
        if row is None:
            break
        chosen.append(row.tract_geoid)
        apart = miles(F.lit(row.x), F.lit(row.y), "x", "y") > F.greatest(F.lit(row.radius_miles), F.col("radius_miles"))
        open_tracts = open_tracts.filter(apart)
    return chosen


def _weighted(reach: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    lmi = F.when(F.col("lmi_flag"), F.col("households")).otherwise(0.0)
    return reach.groupBy(*keys).agg(
        F.sum(lmi).alias(f"{prefix}_lmi"), F.sum(F.col("households") - lmi).alias(f"{prefix}_non")
    )


def lmi_totals(wh) -> DataFrame:
    lmi = F.when(F.col("lmi_flag"), F.col("households")).otherwise(0.0)
    return universe(wh).agg(F.sum(lmi).alias("lmi"), F.sum(F.col("households") - lmi).alias("non"))


def passing_triple(wh, ranked: DataFrame, depth: int, at_least: float | None) -> Row | None:
    """The best-scored separated triple of `ranked` whose coverage grows proportionally; (i, j, k, score) or None.

    Only triples that score `at_least` so much are looked at, and pairs that
    reach it with the best score as the third. Coverage of a triple comes by
    inclusion and exclusion from sums per candidate, per pair and per triple
    of overlapping reaches; overlaps are only formed for separated members, so
    few candidates share a tract.
    """
    score = ranked.select("i", "opportunity_score")
    best, last = ranked.agg(F.max("opportunity_score"), F.max("i")).first()
    if best is None:
        return None
    if at_least is not None:
        # a member of a pair has two others beside it that score at most the best score each
        able = F.round(F.lit(2 * best) + F.col("opportunity_score"), 4) >= at_least
        last = ranked.filter(able).agg(F.max("i")).first()[0] or 0

    def member(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("i").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c != "i"])

    pairs = separated_pairs(ranked, last)
    if at_least is not None:
        pairs = pairs.join(member(score, "i"), "i").join(member(score, "j"), "j").filter(
            F.round(F.col("opportunity_score_i") + F.col("opportunity_score_j") + F.lit(best), 4) >= at_least
        ).select("i", "j")
    pairs = materialise(pairs)
    reach = materialise(candidate_reach(wh, ranked).join(
        ranked.select(F.col("tract_geoid").alias("site"), "i"), "site").drop("site"))
    one = _weighted(reach, ["i"], "s")
    shared = (
        reach.join(reach.select(F.col("i").alias("j"), "tract_geoid"), "tract_geoid")
        .join(pairs, ["i", "j"])
        .select("tract_geoid", "i", "j", "households", "lmi_flag")
    )
    two = _weighted(shared, ["i", "j"], "p")
    three = _weighted(
        shared.join(shared.select("tract_geoid", F.col("i").alias("j"), F.col("j").alias("k")), ["tract_geoid", "j"])
        .join(pairs.select("i", F.col("j").alias("k")), ["i", "k"]),
        ["i", "j", "k"], "t",
    )
    single = score.join(one, "i", "left")
    # attach the candidate sums to the short pair list, so the triple join carries them along
    pair_two = pairs.join(two, ["i", "j"], "left")
    triples = (
        pair_two.join(pair_two.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("p_lmi").alias("q_lmi"),
                                      F.col("p_non").alias("q_non")), "j")
        .join(pair_two.select("i", F.col("j").alias("k"), F.col("p_lmi").alias("r_lmi"),
                              F.col("p_non").alias("r_non")), ["i", "k"])
        .join(member(single, "i"), "i").join(member(single, "j"), "j").join(member(single, "k"), "k")
        .withColumn("score", C.rnd(sum((F.col(f"opportunity_score_{m}") for m in "ijk"), F.lit(0.0)), 4))
    )
    if at_least is not None:
        triples = triples.filter(F.col("score") >= at_least)
    triples = triples.join(three, ["i", "j", "k"], "left")

    def total(kind: str):
        z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        return (z(f"s_{kind}_i") + z(f"s_{kind}_j") + z(f"s_{kind}_k") - z(f"p_{kind}") - z(f"q_{kind}")
                - z(f"r_{kind}") + z(f"t_{kind}"))

    t = lmi_totals(wh).agg(F.struct(F.max("lmi").alias("lmi"), F.max("non").alias("non")).alias("t")).scalar()
    passing = triples.filter(
        C.ratio(total("lmi"), t.getField("lmi")) >= C.ratio(total("non"), t.getField("non")))
    return relational.top_k(passing, 1, F.desc("score"), F.asc("i"), F.asc("j"), F.asc("k")).select(
        "i", "j", "k", "score").first()


def earlier_tie(wh, every: DataFrame, found: Row, depth: int) -> Row:
    """The first among equals: `found`, or a triple of the same score with a member beyond `depth` that comes before it.

    Taken where `found` starts with the best tract and no triple beats its
    score. One that comes before it then starts with the best tract too, has
    its second member before the second of `found` - fewer than `depth` - and
    its third beyond; so at most `depth` rows are formed for a tract.
    """
    place = F.struct("i", "opportunity_score", "x", "y", "radius_miles")
    lead = every.filter("i = 0").agg(F.first(place)).scalar()
    apart = lambda a, b: miles(a.getField("x"), a.getField("y"), b.getField("x"), b.getField("y")) > F.greatest(
        a.getField("radius_miles"), b.getField("radius_miles"))
    seconds = every.filter((F.col("i") > 0) & (F.col("i") < found.j)).select(place.alias("b")).filter(apart(lead, F.col("b")))
    several = seconds.agg(F.collect_list("b")).scalar()        # fewer than depth rows
    thirds = every.filter(F.col("i") >= depth).select(place.alias("c"), F.explode(several).alias("b"))
    score = F.round(lead.getField("opportunity_score") + F.col("b.opportunity_score") + F.col("c.opportunity_score"), 4)
    triples = thirds.filter((score == found.score) & apart(lead, F.col("c")) & apart(F.col("b"), F.col("c"))).select(
        F.col("b.i").alias("j"), F.col("c.i").alias("k"))
    triples = materialise(triples)
    taking = triples.select(F.col("j").alias("i")).unionByName(triples.select(F.col("k").alias("i"))).distinct()
    members = every.filter("i = 0").unionByName(every.join(taking, "i").select(every.columns))
    reach = materialise(candidate_reach(wh, members).join(
        members.select(F.col("tract_geoid").alias("site"), "i"), "site").drop("site"))
    second = triples.select("j").distinct()
    # the reach of the best tract, once per second member
    every_second = second.agg(F.collect_list("j")).scalar()
    both = second.join(reach.withColumnRenamed("i", "j"), "j").unionByName(
        reach.filter("i = 0").withColumn("j", F.explode(every_second)).select("j", "tract_geoid", "households", "lmi_flag")
    ).distinct()
    one = _weighted(reach.withColumnRenamed("i", "k"), ["k"], "s")
    pair = _weighted(both, ["j"], "p")
    shared = _weighted(both.join(reach.select(F.col("i").alias("k"), "tract_geoid"), "tract_geoid").join(
        triples, ["j", "k"]), ["j", "k"], "t")
    rows = triples.join(one, "k", "left").join(pair, "j", "left").join(shared, ["j", "k"], "left")
    t = lmi_totals(wh).agg(F.struct(F.max("lmi").alias("lmi"), F.max("non").alias("non")).alias("t")).scalar()

    def total(kind: str):
        z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        return z(f"s_{kind}") + z(f"p_{kind}") - z(f"t_{kind}")

    passing = rows.filter(C.ratio(total("lmi"), t.getField("lmi")) >= C.ratio(total("non"), t.getField("non")))
    first = relational.top_k(passing, 1, F.asc("j"), F.asc("k")).select(
        F.lit(0).cast("long").alias("i"), "j", "k", F.lit(found.score).alias("score")).first()
    return first or found


def constrained_sites(wh, cand: DataFrame, first: int = FIRST_PREFIX) -> list[str]:
    """Rule B: the ids of the best-scored separated triple whose coverage grows proportionally; empty if none passes.

    A threshold search down the list. The best triple of a prefix is the
    incumbent; a tract that beats or meets its score only with the two best
    scores beside it is looked at no further down than that. If all such
    tracts lie in the prefix, the incumbent is the answer; if only equal
    scores lie beyond, the first among equals is looked for; otherwise the
    prefix doubles, with pairs below the incumbent left out. All tracts take
    part in the end, whatever their number; only the triple and three scores
    reach the driver.
    """
    every = listed(cand)
    n = every.count()
    depth, found = first, None
    while True:
        found = passing_triple(wh, every.filter(F.col("i") < depth), depth, found.score if found else None) or found
        if depth >= n:
            break
        if found:
            two = every.filter("i < 2").agg(F.sum("opportunity_score")).scalar()
            reach = F.round(two + F.col("opportunity_score"), 4)
            beating, meeting = every.agg(
                C.count_where(reach > found.score), C.count_where(reach >= found.score)).first()
            if meeting <= depth:
                break
            if beating <= depth and found.i == 0:
                found = earlier_tie(wh, every, found, depth)
                break
        depth *= 2
    if not found:
        return []
    rows = every.filter(F.col("i").isin(found.i, found.j, found.k)).select("tract_geoid").collect()
    return [r.tract_geoid for r in rows]


class Selection:
    """Both rules worked out once; every report reads from the stored stages.

    A short list is refused: fewer than n separated tracts under Rule A raise
    an error, unless `complete` is off. Rule B is a triple by its definition.
    """

    def __init__(self, wh, n: int = N_SITES, complete: bool = True, first: int = FIRST_PREFIX):
        self.wh = wh
        self.cand = materialise(candidates(wh))
        a = greedy_sites(self.cand, n)
        if complete and len(a) < n:
            raise GateError(f"only {len(a)} of {n} separated sites exist")
        rows = [(RULE_A, g) for g in a] + [(RULE_B, g) for g in constrained_sites(wh, self.cand, first)]
        picks = wh.dim_tract.sparkSession.createDataFrame(rows, "rule string, tract_geoid string")
        self.members = materialise(picks.join(self.cand, "tract_geoid"))
        self.reach = materialise(candidate_reach(wh, self.members.dropDuplicates(["tract_geoid"])))

    def sites(self) -> DataFrame:
        """Chosen tracts of both rules with their attributes."""
        return self.members.select(
            "rule", "tract_geoid", "county_name", "cbsa_title", "tier", "households", "lmi_flag",
            "opportunity_score", "unmet_mortgage_demand", "growth_is_estimated",
        )

    def coverage(self) -> DataFrame:
        """Covered tracts per rule: the current footprint plus what the sites add.

        Newly covered tracts are those of the rated universe, as reach is.
        """
        now = current_tracts(self.wh)
        # three labels: each covered tract is repeated per rule
        base = now.withColumn("rule", F.explode(F.array(F.lit(CURRENT), F.lit(RULE_A), F.lit(RULE_B)))).withColumn(
            "newly_covered", F.lit(False))
        new = self._new().select("rule", "tract_geoid").withColumn("newly_covered", F.lit(True))
        return base.select("rule", "tract_geoid", "newly_covered").unionByName(
            new.select("rule", "tract_geoid", "newly_covered"))

    def _new(self) -> DataFrame:
        """Tracts that the sites of a rule add, once per rule."""
        sites = self.members.select("rule", F.col("tract_geoid").alias("site"))
        return sites.join(self.reach, "site").select("rule", "tract_geoid", "households", "lmi_flag").distinct()

    def evaluation(self) -> DataFrame:
        """Score, coverage change, verdict and composition per rule."""
        per_site = self.members.groupBy("rule").agg(
            C.rnd(F.sum("opportunity_score"), 4).alias("score"),
            F.sum("unmet_mortgage_demand").cast("long").alias("unmet"),
            F.count_distinct("cbsa").alias("cbsas"),
            F.count_distinct("county_fips").alias("counties"),
            C.count_where(F.col("growth_is_estimated")).alias("estimated_growth"),
            C.count_where(F.col("lmi_flag")).alias("lmi_sites"),
        )
        new = self._new()
        added = _weighted(new, ["rule"], "new").join(
            new.groupBy("rule").agg(F.count(F.lit(1)).alias("new_tracts")), "rule")
        t = lmi_totals(self.wh).agg(F.struct(F.max("lmi").alias("lmi"), F.max("non").alias("non")).alias("t")).scalar()
        dl = C.pct(F.coalesce("new_lmi", F.lit(0.0)), t.getField("lmi"))
        dn = C.pct(F.coalesce("new_non", F.lit(0.0)), t.getField("non"))
        return per_site.join(added, "rule", "left").select(
            "rule", "score", C.rnd(dl, 4).alias("delta_lmi_pp"), C.rnd(dn, 4).alias("delta_non_lmi_pp"),
            (dl >= dn).alias("passes"), F.coalesce("new_tracts", F.lit(0)).alias("new_tracts"),
            (F.coalesce("new_lmi", F.lit(0.0)) + F.coalesce("new_non", F.lit(0.0))).alias("new_households"),
            "unmet", "cbsas", "counties", "estimated_growth", "lmi_sites",
        )

    def constraint_cost(self) -> DataFrame:
        """What the coverage rule costs in index points: one row."""
        score = self.members.agg(
            C.sum_where(F.col("rule") == RULE_A, "opportunity_score").alias("a"),
            C.sum_where(F.col("rule") == RULE_B, "opportunity_score").alias("b"),
        )
        return score.select(
            C.rnd("a", 4).alias("score_a"), C.rnd("b", 4).alias("score_b"),
            C.rnd(F.col("a") - F.col("b"), 4).alias("cost_points"),
            C.rnd(C.pct(F.col("a") - F.col("b"), "a"), 2).alias("cost_pct"),
        )


def corridor_test(wh, k: int = 50) -> DataFrame:
    """Does estimated growth concentrate in the dominant area of the top k?  One row."""
    best = relational.top_k(
        wh.opportunity_index.filter(F.col("opportunity_score").isNotNull()).select(
            "tract_geoid", "opportunity_score", "growth_is_estimated"),
        k, F.desc("opportunity_score"), F.asc("tract_geoid"),
    )
    top = materialise(best.join(wh.dim_tract.select("tract_geoid", "cbsa"), "tract_geoid"))
    main = relational.top_k(
        top.filter(F.col("cbsa").isNotNull()).groupBy("cbsa").agg(F.count(F.lit(1)).alias("n")),
        1, F.desc("n"), F.asc("cbsa"),
    ).select("cbsa").scalar()
    inside = F.coalesce(F.col("cbsa") == main, F.lit(False))
    est = F.col("growth_is_estimated")
    return top.agg(
        F.max(F.when(inside, F.col("cbsa"))).alias("dominant_cbsa"),
        C.count_where(inside).alias("in_dominant"),
        C.count_where(inside & est).alias("estimated_in_dominant"),
        C.count_where(~inside & est).alias("estimated_elsewhere"),
        C.rnd(F.corr(inside.cast("double"), est.cast("double")), 3).alias("phi"),
    )


def coverage_rates(wh, covered: DataFrame) -> DataFrame:
    """Household coverage of LMI and other tracts per rule."""
    rated = universe(wh).select("tract_geoid", "households", "lmi_flag")
    t = lmi_totals(wh).agg(F.struct(F.max("lmi").alias("lmi"), F.max("non").alias("non")).alias("t")).scalar()
    by_rule = covered.select("rule", "tract_geoid").join(rated, "tract_geoid").groupBy("rule").agg(
        F.count(F.lit(1)).alias("tracts_covered"),
        C.sum_where(F.col("lmi_flag"), "households").alias("l"),
        C.sum_where(~F.col("lmi_flag"), "households").alias("n"),
    )
    lmi, non = C.pct("l", t.getField("lmi")), C.pct("n", t.getField("non"))
    return by_rule.select(
        "rule", "tracts_covered", C.rnd(lmi, 4).alias("lmi_coverage_pct"), C.rnd(non, 4).alias("non_lmi_coverage_pct"),
        C.rnd(lmi - non, 4).alias("coverage_gap_pp"),
    )


def q13_lmi_coverage(wh, covered: DataFrame) -> DataFrame:
    """Coverage per rule, its change against today and the binding test."""
    rates = coverage_rates(wh, covered)
    return coverage_report(rates)


def coverage_report(rates: DataFrame) -> DataFrame:
    """The delta and binding-test columns over rounded coverage rates."""
    now = rates.filter(F.col("rule") == CURRENT).agg(
        F.struct(F.max("lmi_coverage_pct").alias("l"), F.max("non_lmi_coverage_pct").alias("n")).alias("r")
    ).scalar()
    dl = F.col("lmi_coverage_pct") - now.getField("l")
    dn = F.col("non_lmi_coverage_pct") - now.getField("n")
    order = F.when(F.col("rule") == CURRENT, 0).when(F.col("rule") == RULE_B, 1).otherwise(2)
    return rates.withColumns({"_dl": dl, "_dn": dn, "_now": now.getField("l")}).select(
        "rule", "tracts_covered", "lmi_coverage_pct", "non_lmi_coverage_pct", "coverage_gap_pp",
        F.when(F.col("lmi_coverage_pct").isNotNull(), "PASS - value present (criterion cannot fail)")
        .alias("ac06_as_written"),
        C.rnd("_dl", 4).alias("delta_lmi_pp"), C.rnd("_dn", 4).alias("delta_non_lmi_pp"),
        C.binding_test("rule", "lmi_coverage_pct", "_now", "_dl", "_dn").alias("binding_test"),
        F.when((F.col("rule") != CURRENT) & (F.col("_dl") > 0), C.rnd(F.col("_dn") / F.col("_dl"), 2))
        .alias("non_lmi_growth_multiple"),
    ).orderBy(order)


def over_index(wh) -> DataFrame:
    """LMI share of catchment households minus that of all households: one row."""
    rows = relational.flag_exists(universe(wh), wh.bridge_branch_catchment, ["tract_geoid"], "inside")
    lmi, inside = F.col("lmi_flag"), F.col("inside")
    return rows.agg(
        C.pct(C.sum_where(lmi & inside, "households"), C.sum_where(inside, "households")).alias("c"),
        C.pct(C.sum_where(lmi, "households"), F.sum("households")).alias("f"),
    ).select(
        C.rnd("c", 4).alias("catchment_lmi_pct"), C.rnd("f", 4).alias("footprint_lmi_pct"),
        C.rnd(F.col("c") - F.col("f"), 4).alias("over_index_pp"),
    )

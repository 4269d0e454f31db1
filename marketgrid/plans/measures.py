"""Report measures as aggregate expressions over explicit groups and filters.

A measure takes the frame it is evaluated on (filters already applied) and the
group columns.  Where a published measure removes a filter for its
denominator, the unfiltered frame is a second argument.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.operators import relational
from marketgrid.plans.opportunity import recovered_z
from marketgrid.plans.siting import CURRENT, RULE_A, RULE_B
from marketgrid.plans.warehouse import COMPONENTS

# Defaults of the five what-if weights
DEFAULT_WEIGHTS = {
    "household_growth": 0.20, "median_income": 0.15, "deposit_market_growth": 0.25, "competitor_saturation": 0.20,
    "unmet_mortgage_demand": 0.20,
}


def deposit_facts(wh) -> DataFrame:
    """Deposits with the branch and institution attributes the measures filter on."""
    inst = wh.dim_institution.select("cert", "is_subject_bank")
    branch = wh.dim_branch.select("uninumbr", "state")
    return wh.fact_branch_deposits.select("uninumbr", "cert", "year", "deposits").join(inst, "cert", "left").join(
        branch, "uninumbr", "left")


# -- deposits and share -------------------------------------------------------
def deposit_measures(facts: DataFrame, groups: Sequence[str], institution: Column | None = None) -> DataFrame:
    """Totals, branches, subject and market deposits and share in one aggregate.

    `institution` is the filter on the lender side: it applies to the totals
    and is removed for the market denominator.
    """
    keep = F.lit(True) if institution is None else institution
    own = F.col("is_subject_bank")
    out = facts.groupBy(*groups).agg(
        C.sum_where(keep, "deposits").alias("total_deposits"),
        F.count_distinct(F.when(keep, F.col("uninumbr"))).alias("branch_count"),
        C.sum_where(keep & own, "deposits").alias("subject_deposits"),
        F.sum("deposits").alias("market_deposits"),
    )
    return out.withColumns({
        "total_deposits_bn": C.ratio("total_deposits", F.lit(1_000_000_000)),
        "market_share_pct": C.pct("subject_deposits", "market_deposits"),
    })


def _shifted(facts: DataFrame, groups: Sequence[str], years: int, name: str) -> DataFrame:
    return facts.groupBy(*groups, (F.col("year") + years).alias("year")).agg(F.sum("deposits").alias(name))


def deposit_trend(facts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Total, prior-year deposits and three-year growth per group and year."""
    keys = [*groups, "year"]
    now = facts.groupBy(*keys).agg(F.sum("deposits").alias("total_deposits"))
    rows = now.join(_shifted(facts, groups, 1, "deposits_py"), keys, "left").join(
        _shifted(facts, groups, 3, "base"), keys, "left")
    return rows.select(
        *keys, "total_deposits", "deposits_py",
        (C.cagr_pct("total_deposits", "base", F.lit(3)) / 100).alias("deposit_cagr_3yr"),
    )


def deposit_cagr(facts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Growth between the first and last year of the selection."""
    ends = facts.agg(F.struct(F.min("year").alias("a"), F.max("year").alias("b")).alias("y")).scalar()
    a, b = ends.getField("a"), ends.getField("b")
    return facts.groupBy(*groups).agg(
        C.sum_where(F.col("year") == a, "deposits").alias("start_deposits"),
        C.sum_where(F.col("year") == b, "deposits").alias("end_deposits"),
    ).withColumn("deposit_cagr_pct", C.cagr_pct("end_deposits", "start_deposits", b - a))


# -- branch performance ---------------------------------------------------------
def performance_measures(performance: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return performance.groupBy(*groups).agg(
        F.avg("index_size_adjusted").alias("index_size_adjusted"),
        F.avg("performance_index").alias("index_raw"),
        C.count_where(F.col("index_size_adjusted") < 1).alias("underperforming_branches"),
    )


# -- equity -----------------------------------------------------------------------
def equity_measures(coverage: DataFrame, sites: DataFrame, selected: str = RULE_B) -> DataFrame:
    """Coverage, delta gap, verdict and constraint cost: one row."""
    def at(rule: str, column: str) -> Column:
        return F.max(F.when(F.col("rule") == rule, F.col(column)))

    cov = coverage.agg(
        at(CURRENT, "lmi_coverage_pct").alias("lmi_coverage_pct"),
        at(RULE_B, "lmi_coverage_pct").alias("lmi_coverage_recommended_pct"),
        ((at(selected, "lmi_coverage_pct") - at(CURRENT, "lmi_coverage_pct"))
         - (at(selected, "non_lmi_coverage_pct") - at(CURRENT, "non_lmi_coverage_pct"))).alias("gap"),
    )
    cost = sites.agg(
        C.sum_where(F.col("rule") == RULE_A, "opportunity_score").alias("a"),
        C.sum_where(F.col("rule") == RULE_B, "opportunity_score").alias("b"),
        C.count_where((F.col("rule") == RULE_B) & F.col("lmi_flag")).alias("lmi_sites_in_shortlist"),
    )
    one = F.lit(1).alias("_one")
    return cov.select("*", one).join(cost.select("*", one), "_one").select(
        "lmi_coverage_pct", "lmi_coverage_recommended_pct", F.col("gap").alias("coverage_delta_gap_pp"),
        F.when(F.col("gap").isNull(), "NOT MEASURED").when(F.col("gap") >= 0, "PASS - expansion is proportional")
        .otherwise("FAIL - non-LMI coverage grows faster").alias("binding_test_result"),
        (F.col("a") - F.col("b")).alias("constraint_cost_points"),
        C.pct(F.col("a") - F.col("b"), "a").alias("constraint_cost_pct"), "lmi_sites_in_shortlist",
    )


# -- tracts -----------------------------------------------------------------------
def tracts_in_context(wh) -> DataFrame:
    return relational.flag_exists(wh.dim_tract, wh.bridge_branch_catchment, ["tract_geoid"], "in_catchment")


def tract_measures(selection: DataFrame, every: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Coverage and composition of a tract selection.

    The tract coverage denominator ignores the selection: it counts `every`.
    """
    lmi, inside, hh = F.col("lmi_flag"), F.col("in_catchment"), "households"
    all_tracts = every.agg(F.count(F.lit(1))).scalar()
    rated = every.filter(lmi.isNotNull() & F.col(hh).isNotNull())
    footprint = rated.agg(C.pct(C.sum_where(lmi, hh), F.sum(hh))).scalar()
    out = selection.groupBy(*groups).agg(
        C.ratio(C.sum_where(lmi & inside, hh), C.sum_where(lmi, hh)).alias("subject_lmi_coverage"),
        C.ratio(C.sum_where(~lmi & inside, hh), C.sum_where(~lmi, hh)).alias("subject_non_lmi_coverage"),
        C.count_where(inside).alias("_inside"),
        C.pct(C.count_where(lmi), C.count_where(lmi.isNotNull())).alias("lmi_share_of_selection_pct"),
        C.pct(C.count_where(F.col("growth_basis") != "direct"),
              C.count_where(F.col("household_growth_pct").isNotNull())).alias("cluster_measured_growth_pct"),
    )
    return out.withColumn("subject_tract_coverage_pct", C.pct("_inside", all_tracts)).drop("_inside").withColumn(
        "shortlist_caveat", C.caption("lmi_share_of_selection_pct", "cluster_measured_growth_pct", footprint))


# -- lending and index ---------------------------------------------------------------
def capture_measures(capture: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return capture.groupBy(*groups).agg(
        C.pct(F.sum("subject_originations"), F.sum("all_originations")).alias("capture_rate_pct"),
        F.sum("competitor_originations").alias("unmet_originations"),
    )


def published_score(index: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return index.groupBy(*groups).agg(F.avg("opportunity_score").alias("published_opportunity_score"))


def weight_parameters() -> Column:
    """Array of (component, weight): the grid that each what-if weight can take, 0 to 0.5."""
    def grid(component: str) -> Column:
        return F.transform(C.weight_grid(), lambda w: F.struct(F.lit(component).alias("component"), w.alias("weight")))

    return F.flatten(F.array(*[grid(c) for c in COMPONENTS]))


def weight_grid_scores(index: DataFrame, weights: DataFrame) -> DataFrame:
    """Per component and grid weight, the other weights at their defaults: mean score, tracts, best tract.

    The scores of a tract under all grid weights are one array, so the index is read once.
    """
    z = recovered_z(index, weights)
    part = {c: C.rnd(f"z_{c}", 6) for c in COMPONENTS}
    rows = z.select("tract_geoid", *[part[c].alias(f"_{c}") for c in COMPONENTS]).withColumn(
        "g", F.explode(weight_parameters())).select("*", "g.component", "g.weight")

    def weight(c: str) -> Column:
        return F.when(F.col("component") == c, F.col("weight")).otherwise(F.lit(DEFAULT_WEIGHTS[c]))

    total = C.rnd(sum((weight(c) for c in COMPONENTS), F.lit(0.0)), 2)
    score = sum((F.col(f"_{c}") * weight(c) for c in COMPONENTS), F.lit(0.0)) / F.when(total != 0, total)
    return rows.withColumns({"weight_total": total, "score": C.rnd(score, 6)}).groupBy(
        "component", "weight", "weight_total"
    ).agg(
        C.rnd(F.avg("score"), 4).alias("mean_score"), F.count("score").alias("tracts"),
        F.min_by("tract_geoid", F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), F.col("tract_geoid"))))
        .alias("best_tract"),
    )


def weighted_scores(index: DataFrame, weights: DataFrame, chosen: Mapping[str, float] | None = None) -> DataFrame:
    """Score per tract under chosen weights, normalised by their sum; NULL at sum 0."""
    w = {**DEFAULT_WEIGHTS, **(chosen or {})}
    total = sum(w[c] for c in COMPONENTS)
    z = recovered_z(index, weights)
    raw = sum((C.rnd(f"z_{c}", 6) * F.lit(w[c]) for c in COMPONENTS), F.lit(0.0))
    score = raw / F.lit(total) if total else F.lit(None).cast("double")
    return z.select(
        "tract_geoid", "lmi_flag", "growth_is_estimated", F.lit(float(total)).alias("weight_total"),
        C.rnd(score, 6).alias("weighted_score"),
    )


def top_measures(scores: DataFrame, k: int = 50) -> DataFrame:
    """Composition of the k best tracts under the chosen weights: one row."""
    top = relational.top_k(scores, k, F.desc_nulls_last("weighted_score"), F.asc("tract_geoid"))
    return top.agg(
        C.pct(C.count_where(F.col("lmi_flag")), C.count_where(F.col("lmi_flag").isNotNull()))
        .alias("top_lmi_share_pct"),
        C.pct(C.count_where(F.col("growth_is_estimated")), F.count(F.lit(1))).alias("top_cluster_growth_pct"),
    )

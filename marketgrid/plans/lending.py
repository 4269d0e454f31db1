"""Loan applications: staging, outcomes, capture rate and unmet demand (queries 9-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.operators import ranking, relational

#: Fact rows that one task groups by tract, lender and purpose: there are nearly as many groups as rows.
TASK_FACTS = 1_000_000


# -- staging ------------------------------------------------------------------
def placed(records: DataFrame) -> DataFrame:
    return records.filter(F.col("census_tract").isNotNull())


def unplaced_count(records: DataFrame) -> DataFrame:
    """Records without a tract: counted before they are dropped."""
    return records.agg(
        F.count(F.lit(1)).alias("records"), C.count_where(F.col("census_tract").isNull()).alias("without_tract")
    )


def stage_lending(records: DataFrame, dropped: Observation | None = None) -> DataFrame:
    """Records to tract x lender x purpose x outcome; NULL keys are kept as groups.

    `dropped` is filled by the pass that reads the records: how many there were
    and how many had no tract.
    """
    if dropped is not None:
        records = records.observe(dropped, F.count(F.lit(1)).alias("records"), C.count_where(
            F.col("census_tract").isNull()).alias("without_tract"))
    amount = C.number("loan_amount", "bigint")
    return (
        placed(records).groupBy(F.col("census_tract").alias("tract_geoid"), "lei", "loan_purpose", "action_taken")
        .agg(F.count(F.lit(1)).alias("record_count"), F.coalesce(F.sum(amount), F.lit(0)).alias("total_amount"))
        .withColumn("action_class", C.action_class("action_taken"))
    )


def outcome_profile(records: DataFrame) -> DataFrame:
    """Records and share per outcome code, with its meaning."""
    rows = placed(records)
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.filter(F.col("action_taken").isNotNull()).groupBy("action_taken").agg(
        F.count(F.lit(1)).alias("records")
    ).select(
        "action_taken", C.action_meaning("action_taken").alias("meaning"), C.action_class("action_taken").alias("class"),
        "records", C.rnd(C.pct("records", total), 1).alias("share_pct"),
    ).orderBy("action_taken")


def filter_cost(records: DataFrame) -> DataFrame:
    """What each looser outcome filter would add to the originations: one row."""
    a = F.col("action_taken")
    row = placed(records).agg(
        C.count_where(C.is_origination(a)).alias("originations"),
        C.count_where(a.isin(C.ORIGINATION_CODE, C.PURCHASED_CODE)).alias("with_purchased"),
        C.count_where(C.is_application(a)).alias("applications"),
        F.count(F.lit(1)).alias("all_records"),
    )
    extra = {f"{c}_extra_pct": C.rnd(C.growth_pct(c, "originations"), 1)
             for c in ("with_purchased", "applications", "all_records")}
    return row.withColumns(extra)


def purchased_share(records: DataFrame, least: int = 200, k: int = 6) -> DataFrame:
    """Lenders with the greatest purchased share among those with enough records."""
    a = F.col("action_taken")
    by = placed(records).filter(F.col("lei").isNotNull() & a.isin(C.ORIGINATION_CODE, C.PURCHASED_CODE)).groupBy("lei").agg(
        C.count_where(C.is_origination(a)).alias("originated"),
        C.count_where(a == C.PURCHASED_CODE).alias("purchased"),
    ).filter(F.col("originated") + F.col("purchased") >= least)
    return relational.top_k(
        by.withColumn("pct_purchased", C.rnd(C.pct("purchased", F.col("originated") + F.col("purchased")), 1)),
        k, F.desc("pct_purchased"), F.asc("lei"),
    )


def income_ratio(ratios: DataFrame) -> DataFrame:
    """Median reported tract-to-area income ratio per tract."""
    rows = ratios.filter(F.col("census_tract").isNotNull()).select(
        F.col("census_tract").alias("tract_geoid"), C.number("tract_to_msa_income_percentage").alias("r")
    )
    return ranking.quantiles(rows, ["tract_geoid"], "r", {"tract_to_area_income_pct": 0.5})


# -- queries --------------------------------------------------------------------
def q09_lending_outcomes(wh) -> DataFrame:
    """Applications by outcome per tract, lender and purpose.

    The fact is summed to its group first; the lender attributes join the
    much smaller result. The rows of the fact are counted and dealt to as many
    tasks as their number asks for, so a task's table of groups is bounded.
    """
    a, n = F.col("action_taken"), F.col("record_count")
    group = ["tract_geoid", "lei", "loan_purpose"]
    fact = wh.fact_tract_lending
    parts = max(fact.sparkSession.sparkContext.defaultParallelism, -(-fact.count() // TASK_FACTS))
    sums = (
        fact.repartition(parts, *group).groupBy(*group)
        .agg(
            C.sum_where(C.is_application(a), n).alias("application_count"),
            C.sum_where(C.is_origination(a), n).alias("origination_count"),
            C.sum_where(C.is_origination(a), "total_amount").alias("origination_amount"),
            C.sum_where(a == C.DENIAL_CODE, n).alias("denial_count"),
            C.sum_where(a == C.PURCHASED_CODE, n).alias("purchased_count"),
            C.sum_where(a.isin(*C.PREAPPROVAL_CODES), n).alias("preapproval_count"),
        )
        .filter(F.col("application_count") > 0)
    )
    lender = wh.dim_institution.filter(F.col("lei").isNotNull()).select(
        "lei", "institution_name", "cert", "is_subject_bank"
    )
    return sums.join(lender, "lei", "left").select(
        "tract_geoid", "lei", "institution_name", "cert", "is_subject_bank", "loan_purpose", "application_count",
        "origination_count", "origination_amount", "denial_count", "purchased_count", "preapproval_count",
        C.rnd(C.pct("origination_count", "application_count"), 2).alias("origination_rate_pct"),
        C.rnd(C.pct("denial_count", "application_count"), 2).alias("denial_rate_pct_biased_low"),
    )


def tract_lending(wh) -> DataFrame:
    """Applications and originations per tract, all lenders and the subject.

    One pass over the fact feeds capture rate, unmet demand and the index.
    The subject's lender codes are few and join by broadcast of a dimension
    whose rows are institutions.
    """
    subject = wh.dim_institution.filter(F.col("is_subject_bank") & F.col("lei").isNotNull()).select(
        "lei", F.lit(True).alias("mine")
    ).distinct()
    a, n = F.col("action_taken"), F.col("record_count")
    orig, mine = C.is_origination(a), F.col("mine")
    return (
        wh.fact_tract_lending.join(subject, "lei", "left").groupBy("tract_geoid").agg(
            C.sum_where(orig, n).alias("all_originations"),
            C.sum_where(orig, "total_amount").alias("all_origination_amt"),
            C.sum_where(C.is_application(a), n).alias("all_applications"),
            F.count_distinct(F.when(orig, F.col("lei"))).alias("lenders_originating"),
            C.sum_where(orig & mine, n).alias("subject_originations"),
            C.sum_where(orig & mine, "total_amount").alias("subject_origination_amt"),
            C.sum_where(C.is_application(a) & mine, n).alias("subject_applications"),
        )
    )


def _capture(wh) -> DataFrame:
    return tract_lending(wh).filter(F.col("all_originations") > 0).withColumns({
        "subject_originations": F.coalesce("subject_originations", F.lit(0)),
        "subject_origination_amt": F.coalesce("subject_origination_amt", F.lit(0.0)),
    }).withColumns({
        "capture_rate_pct": C.rnd(C.pct("subject_originations", "all_originations"), 3),
        "competitor_originations": F.col("all_originations") - F.col("subject_originations"),
        "competitor_origination_amt": F.col("all_origination_amt") - F.col("subject_origination_amt"),
    })


def q10_capture_rate(wh) -> DataFrame:
    tract = wh.dim_tract.select("tract_geoid", "county_name", "tier", "households", "lmi_flag", "lmi_basis")
    rows = relational.flag_exists(
        _capture(wh).join(tract, "tract_geoid"), wh.bridge_branch_catchment, ["tract_geoid"], "is_in_catchment"
    )
    return rows.select(
        "tract_geoid", "county_name", "tier", "households", "lmi_flag", "lmi_basis", "is_in_catchment",
        "lenders_originating", "all_applications", "all_originations", "all_origination_amt", "subject_originations",
        "subject_origination_amt", "capture_rate_pct", "competitor_originations",
        C.rnd("competitor_origination_amt", 2).alias("competitor_origination_amt"),
    )


def q11_unmet_demand(wh) -> DataFrame:
    """Unmet originations per tract on four ranking bases side by side."""
    tract = wh.dim_tract.select(
        "tract_geoid", "county_name", "tier", "households", "median_family_income", "lmi_flag", "lmi_basis",
        "tract_status",
    )
    rows = relational.flag_exists(
        _capture(wh).join(tract, "tract_geoid"), wh.bridge_branch_catchment, ["tract_geoid"], "inside"
    ).withColumn("outside_footprint", ~F.col("inside"))
    unmet = F.col("competitor_originations")
    return rows.select(
        "tract_geoid", "county_name", C.state_code(C.state_of("tract_geoid")).alias("state"), "tier", "households",
        "median_family_income", "lmi_flag", "lmi_basis", "all_applications", "all_originations",
        "subject_originations", unmet.alias("unmet_originations"), "all_origination_amt", "capture_rate_pct",
        "outside_footprint", unmet.alias("basis_absolute"),
        C.rnd(C.ratio(unmet, "households"), 5).alias("basis_per_household"),
        C.rnd(C.ratio(unmet, "all_applications"), 5).alias("basis_per_application"),
        C.rnd((1 - F.col("capture_rate_pct") / 100.0) * F.col("all_applications"), 2)
        .alias("basis_uncaptured_apps"),
        C.opportunity_type("outside_footprint", "capture_rate_pct").alias("opportunity_type"),
        F.col("lmi_flag").isNull().alias("lmi_undetermined"),
        (F.col("tract_status") != "ok").alias("tract_partly_unmeasured"),
    )

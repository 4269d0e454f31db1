"""Deposits, shares, growth and ranks by market: business queries 1-6 and 14."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.operators import ranking, relational
from marketgrid.session import materialise


def located_branches(wh, *extra: str) -> DataFrame:
    """Branches with a resolved tract; the county is the tract's, not the reported one."""
    return wh.dim_branch.filter(F.col("tract_geoid").isNotNull()).select(
        "uninumbr", "state", C.county_of("tract_geoid").alias("county_fips"), *extra
    )


def county_market(wh) -> DataFrame:
    """State x county x year totals, all institutions and the subject side by side.

    The deposit table holds one row per branch and year, so branches are row
    counts; only the certificates need a distinct count, which Spark resolves
    on (county, certificate) before the final merge.
    """
    branch = located_branches(wh, F.col("cert").alias("bc"), "is_subject_bank", "is_main_office", "county_agrees")
    own = F.col("is_subject_bank")
    return (
        wh.fact_branch_deposits.select("uninumbr", "year", "deposits")
        .join(branch, "uninumbr")
        .groupBy("state", "county_fips", "year")
        .agg(
            F.count_distinct("bc").alias("institutions"),
            F.count(F.lit(1)).alias("branches"),
            C.count_where(own).alias("subject_branches"),
            C.count_where(~F.col("county_agrees")).alias("contested_branches"),
            C.count_where(F.col("is_main_office") == "1").alias("hq_branches"),
            F.sum("deposits").alias("deposits"),
            C.sum_where(own, "deposits").alias("subject_deposits"),
        )
    )


def county_names(wh) -> DataFrame:
    """One name per county."""
    return wh.dim_tract.filter(F.col("county_name").isNotNull()).groupBy("county_fips").agg(
        F.min("county_name").alias("county_name")
    )


def q01_deposits_by_county_year(wh) -> DataFrame:
    return (
        county_market(wh).join(county_names(wh), "county_fips", "left")
        .select(
            "state", "county_fips", "county_name", "year", "institutions", "branches", "subject_branches",
            "contested_branches", "deposits", "subject_deposits",
            C.rnd(C.ratio("deposits", "branches"), 0).alias("deposits_per_branch"),
        )
    )


def q02_market_share(wh) -> DataFrame:
    """Subject share per county and year; a county without the subject is 0 %.

    The subject is matched by county and year as in the published query, so a
    county split over two states shows the same subject in both.
    """
    market = county_market(wh)
    subject = market.groupBy("county_fips", "year").agg(
        F.sum("subject_deposits").alias("sd"), F.sum("subject_branches").alias("sb")
    )
    joined = market.drop("subject_deposits", "subject_branches").join(subject, ["county_fips", "year"], "left")
    mine, sites = F.coalesce("sd", F.lit(0)), F.coalesce("sb", F.lit(0))
    share, site_share = C.pct(mine, "deposits"), C.pct(sites, "branches")
    return joined.select(
        "state", "county_fips", "year", "institutions", F.col("branches").alias("market_branches"),
        sites.alias("subject_branches"), "hq_branches", F.col("deposits").alias("market_deposits"),
        mine.alias("subject_deposits"), C.rnd(share, 3).alias("deposit_share_pct"),
        C.rnd(site_share, 3).alias("branch_share_pct"), C.rnd(share - site_share, 3).alias("share_gap_pp"),
    )


def three_rows_back(deposits: DataFrame) -> DataFrame:
    """Deposits and year three records earlier; a branch has one record a year."""
    w = W.partitionBy("uninumbr").orderBy("year")
    return deposits.withColumns({
        "deposits_3y_ago": F.lag("deposits", 3).over(w), "prior_year": F.lag("year", 3).over(w)
    })


def q03_branch_cagr(wh) -> DataFrame:
    branch = located_branches(wh, "is_subject_bank", "is_main_office")
    dep = wh.fact_branch_deposits.select("uninumbr", "cert", "year", "deposits").join(branch, "uninumbr")
    gap = F.col("year") - F.col("prior_year")
    return (
        three_rows_back(dep).filter(F.col("deposits_3y_ago") > 0)
        .withColumn("years_elapsed", gap)
        .select(
            "uninumbr", "cert", "state", "county_fips", "is_subject_bank", "is_main_office", "prior_year", "year",
            "years_elapsed", "deposits_3y_ago", "deposits",
            C.rnd(C.cagr_pct("deposits", "deposits_3y_ago", "years_elapsed"), 3).alias("cagr_pct"),
            (F.col("years_elapsed") != 3).alias("irregular_interval"),
        )
    )


def latest_growth(wh) -> DataFrame:
    """Three-record growth of every located branch in the newest vintage, by market."""
    tract = wh.dim_tract.select("tract_geoid", "cbsa", "cbsa_title")
    branch = located_branches(wh, "tract_geoid", "is_subject_bank", "is_main_office").join(
        tract, "tract_geoid", "left"
    ).withColumns({
        "market": C.market_key("cbsa", "state"), "market_name": C.market_label("cbsa_title", "state")
    }).select("uninumbr", "is_subject_bank", "is_main_office", "market", "market_name")
    dep = wh.fact_branch_deposits.select("uninumbr", "cert", "year", "deposits")
    newest = relational.latest_year(wh.vintages)
    return (
        three_rows_back(dep).filter((F.col("year") == newest) & (F.col("deposits_3y_ago") > 0))
        .join(branch, "uninumbr")
        .withColumn("growth", C.cagr_pct("deposits", "deposits_3y_ago", F.col("year") - F.col("prior_year")))
    )


def q04_rank_in_market(wh) -> DataFrame:
    """Subject branches against the growth of all branches of their market."""
    rows = materialise(latest_growth(wh))
    pos = ranking.positions(rows, ["market"], "growth")
    mid = ranking.quantiles_of(pos, ["market"], "growth", {"mid": 0.5})
    own = ranking.attach(rows.filter(F.col("is_subject_bank")), pos, ["market", "growth"]).join(mid, "market")
    return own.select(
        "market", "market_name", F.col("n_group").alias("market_branches"), "uninumbr", "cert", "is_subject_bank",
        "is_main_office", C.rnd("growth", 3).alias("cagr_pct"), C.rnd("mid", 3).alias("market_median_cagr"),
        C.rnd(F.col("growth") - F.col("mid"), 3).alias("vs_market_pp"),
        ranking.rank_desc().alias("growth_rank_in_market"),
        C.rnd(ranking.percent_rank(), 4).alias("growth_percentile"),
        (F.col("n_group") < 10).alias("thin_market"),
    )


def q05_attribution(wh) -> DataFrame:
    """County growth split into the market's and the subject's own."""
    years = county_market(wh).select(
        "state", "county_fips", "year", F.col("branches").alias("mb"), F.col("subject_branches").alias("sb"),
        F.col("deposits").alias("md"), F.col("subject_deposits").alias("sd"),
    )
    w = W.partitionBy("state", "county_fips").orderBy("year")   # one row a year
    before = {f"{c}0": F.lag(c).over(w) for c in ("year", "mb", "sb", "md", "sd")}
    rows = years.withColumns(before).filter((F.col("year") == F.col("year0") + 1) & (F.col("sb") > 0)).withColumns({
        "mg": C.growth_pct("md", "md0"), "sg": C.growth_pct("sd", "sd0"), "change": F.col("mb") - F.col("mb0"),
    })
    return rows.select(
        "state", "county_fips", F.col("year0").alias("prev_year"), "year", F.col("mb").alias("market_branches"),
        F.col("sb").alias("subject_branches"), C.rnd("mg", 2).alias("market_growth_pct"),
        C.rnd("sg", 2).alias("subject_growth_pct"), C.rnd(F.col("sg") - F.col("mg"), 2).alias("excess_growth_pp"),
        C.attribution("sg", "mg").alias("attribution"), F.col("change").alias("market_branch_change"),
        (F.col("sb") - F.col("sb0")).alias("subject_branch_change"),
        C.market_volatile("mg", "change").alias("market_volatile"),
    )


def q06_percentile_in_county(wh) -> DataFrame:
    branch = located_branches(wh, "is_subject_bank", "is_main_office")
    rows = materialise(
        relational.only_latest(wh.fact_branch_deposits, wh.vintages).select("uninumbr", "cert", "deposits")
        .join(branch, "uninumbr")
    )
    pos = ranking.positions(rows, ["county_fips"], "deposits")
    mid = ranking.quantiles_of(pos, ["county_fips"], "deposits", {"county_median_deposits": 0.5})
    own = ranking.attach(
        rows.filter(F.col("is_subject_bank")), pos, ["county_fips", "deposits"]
    ).join(mid, "county_fips")
    return own.select(
        "uninumbr", "cert", "state", "county_fips", "is_main_office", F.col("n_group").alias("county_branches"),
        "deposits", "county_median_deposits",
        C.rnd(C.ratio("deposits", "county_median_deposits"), 4).alias("vs_county_median"),
        C.rnd(ranking.percent_rank(), 4).alias("deposit_percentile"),
        (F.col("n_group") < 10).alias("thin_county"),
    )


def q14_reconciliation(wh) -> DataFrame:
    """Warehouse totals against published totals, with a verdict per state and year."""
    have = (
        wh.fact_branch_deposits.select("uninumbr", "year", "deposits")
        .join(wh.dim_branch.select("uninumbr", "state"), "uninumbr")
        .groupBy("state", "year")
        .agg(F.count(F.lit(1)).alias("computed_branches"), (F.sum("deposits") / 1000.0).alias("computed_deposits_k"))
    )
    want = wh.ref_sod_state_totals.select(
        "state", "year", F.col("branches").alias("published_branches"),
        F.col("deposits_thousands").alias("published_deposits_k"),
    )
    both = have.join(want, ["state", "year"], "full").withColumns({
        "branch_diff": F.col("computed_branches") - F.col("published_branches"),
        "deposit_diff_k": F.col("computed_deposits_k") - F.col("published_deposits_k"),
    }).withColumn("pct", C.pct("deposit_diff_k", "published_deposits_k"))
    return both.select(
        "state", "year", "computed_branches", "published_branches", "branch_diff", "computed_deposits_k",
        "published_deposits_k", "deposit_diff_k", C.rnd("pct", 6).alias("deposit_diff_pct"),
        C.reconciliation_verdict("computed_branches", "published_branches", "branch_diff", "deposit_diff_k", "pct")
        .alias("ac01_result"),
    ).orderBy("state", "year")

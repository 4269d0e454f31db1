"""The composite opportunity index (query 12) and its weight sensitivity."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.operators import ranking, relational
from marketgrid.plans.lending import tract_lending
from marketgrid.plans.warehouse import COMPONENTS
from marketgrid.session import materialise

TOP_N = 50
# component column -> column of the index table that carries its raw value


def raw_components(wh) -> DataFrame:
    """The five inputs per tract; absence of evidence stays NULL."""
    county = wh.fact_county_deposit_growth.select(
        "county_fips", F.col("cagr_pct_retail").alias("deposit_market_growth"), "retail_basis_status",
        "excluded_deposit_share",
    )
    near = wh.fact_tract_competition.select(
        "tract_geoid", F.col("competitor_per_10k_catchment_hh").alias("competitor_saturation")
    )
    demand = tract_lending(wh).select(
        "tract_geoid",
        F.when(
            F.col("all_originations") > 0,
            F.col("all_originations") - F.coalesce("subject_originations", F.lit(0)),
        ).alias("unmet_mortgage_demand"),
    )
    tract = wh.dim_tract.select(
        "tract_geoid", "county_fips", "county_name", "cbsa_title", "tier", "households", "lmi_flag", "tract_status",
        "growth_basis", F.col("household_growth_pct").alias("household_growth"),
        F.col("median_hh_income").alias("median_income"),
    )
    return tract.join(county, "county_fips", "left").join(near, "tract_geoid", "left").join(
        demand, "tract_geoid", "left"
    ).drop("county_fips")


def with_z(df: DataFrame, columns, invert=()) -> DataFrame:
    """z-scores over the rows that have a value, from one-row statistics.

    The statistics come from one aggregate (a scalar subquery), so no row
    moves; `invert` negates the score, not the input.
    """
    stats = df.agg(F.struct(*[
        s for c in columns for s in (F.avg(c).alias(f"{c}_m"), F.stddev_samp(c).alias(f"{c}_s"))
    ]).alias("s")).scalar()
    out = {}
    for c in columns:
        z = C.ratio(F.col(c) - stats.getField(f"{c}_m"), stats.getField(f"{c}_s"))
        out[f"z_{c}"] = -z if c in invert else z
    return df.withColumns(out)


def weight_row(weights: DataFrame, scenario: str) -> F.Column:
    """All weights of a scenario as one struct; a negative sign carries the inversion."""
    one = weights.filter(F.col("scenario") == scenario).agg(F.struct(*[
        F.struct(
            F.max(F.when(F.col("component") == c, F.col("weight"))).alias("w"),
            F.max(F.when(F.col("component") == c, F.when(F.col("inverted"), -1.0).otherwise(1.0))).alias("sign"),
        ).alias(c)
        for c in COMPONENTS
    ]).alias("w"))
    return one.scalar()


def q12_opportunity_index(wh, scenario: str = "primary") -> DataFrame:
    return index_rows(wh, scenario)


def index_rows(wh, scenario: str = "primary") -> DataFrame:
    """Weighted z-score per tract; no score unless all five components are known."""
    scored = with_z(materialise(raw_components(wh)), COMPONENTS)
    w = weight_row(wh.ref_index_weights, scenario)
    parts = {c: w.getField(c).getField("w") * w.getField(c).getField("sign") * F.col(f"z_{c}") for c in COMPONENTS}
    z = [f"z_{c}" for c in COMPONENTS]
    complete = C.present_count(*z) == len(COMPONENTS)
    return scored.select(
        "tract_geoid", "county_name", "cbsa_title", "tier", "households", "lmi_flag",
        C.rnd("household_growth", 3).alias("household_growth"), "median_income",
        C.rnd("deposit_market_growth", 3).alias("deposit_market_growth"),
        C.rnd("competitor_saturation", 3).alias("competitor_saturation"), "unmet_mortgage_demand",
        *[C.rnd(parts[c], 4).alias(f"contrib_{c}") for c in COMPONENTS],
        C.present_count(*z).alias("components_present"),
        F.when(complete, C.rnd(reduce(add, parts.values()), 4)).alias("opportunity_score"),
        (F.col("growth_basis") != "direct").alias("growth_is_estimated"),
        (F.col("tract_status") != "ok").alias("tract_partly_unmeasured"),
        F.col("lmi_flag").isNull().alias("lmi_undetermined"),
        (F.col("excluded_deposit_share") > 0.25).alias("county_growth_heavily_adjusted"),
        "retail_basis_status",
    )


# -- sensitivity --------------------------------------------------------------
def scored_tracts(index: DataFrame) -> DataFrame:
    return index.filter(F.col("opportunity_score").isNotNull())


def recovered_z(index: DataFrame, weights: DataFrame, scenario: str = "primary") -> DataFrame:
    """Scored rows with z-scores divided back out of the published contributions.

    A component with weight 0 has no recoverable score and stays NULL.
    """
    w = weight_row(weights, scenario)
    return scored_tracts(index).withColumns({
        f"z_{c}": C.ratio(f"contrib_{c}", w.getField(c).getField("w")) for c in COMPONENTS
    })


def reproduction_error(index: DataFrame, weights: DataFrame, scenario: str = "primary") -> DataFrame:
    """Greatest gap between the recomputed and the published score: one row."""
    w = weight_row(weights, scenario)
    again = reduce(add, [F.col(f"z_{c}") * w.getField(c).getField("w") for c in COMPONENTS])
    return recovered_z(index, weights, scenario).agg(
        F.count(F.lit(1)).alias("scored"), F.max(F.abs(again - F.col("opportunity_score"))).alias("max_error")
    )


def weight_sets(weights: DataFrame) -> DataFrame:
    """Alternative weight sets as (name, weights struct): the non-primary scenarios."""
    return weights.filter(F.col("scenario") != "primary").groupBy("scenario").agg(*[
        F.max(F.when(F.col("component") == c, F.col("weight"))).alias(f"w_{c}") for c in COMPONENTS
    ])


def leave_one_out_sets(weights: DataFrame) -> DataFrame:
    """Five sets, each without one component and renormalised to 1."""
    primary = weights.filter(F.col("scenario") == "primary").select("component", "weight")
    total = primary.agg(F.sum("weight")).scalar()
    row = primary.agg(*[F.max(F.when(F.col("component") == c, F.col("weight"))).alias(f"w_{c}") for c in COMPONENTS])
    dropped = row.withColumn("removed", F.explode(F.array(*[F.lit(c) for c in COMPONENTS])))
    own = F.coalesce(*[F.when(F.col("removed") == c, F.col(f"w_{c}")) for c in COMPONENTS])
    kept = {
        f"w_{c}": F.when(F.col("removed") == c, 0.0).otherwise(F.col(f"w_{c}") / (total - F.col("own_weight")))
        for c in COMPONENTS
    }
    return dropped.withColumn("own_weight", own).withColumns(kept).select(
        F.col("removed").alias("scenario"), "own_weight", *[f"w_{c}" for c in COMPONENTS]
    )


def zero_weight_sets(weights: DataFrame) -> DataFrame:
    """Five sets, each with one weight set to 0 and nothing renormalised."""
    row = weights.filter(F.col("scenario") == "primary").agg(
        *[F.max(F.when(F.col("component") == c, F.col("weight"))).alias(f"w_{c}") for c in COMPONENTS]
    )
    return row.withColumn("scenario", F.explode(F.array(*[F.lit(c) for c in COMPONENTS]))).withColumns({
        f"w_{c}": F.when(F.col("scenario") == c, 0.0).otherwise(F.col(f"w_{c}")) for c in COMPONENTS
    })


def rescored(z: DataFrame, sets: DataFrame) -> DataFrame:
    """Every scored tract under every weight set (a handful of sets, broadcast)."""
    alt = reduce(add, [F.coalesce(F.col(f"z_{c}"), F.lit(0.0)) * F.col(f"w_{c}") for c in COMPONENTS])
    # the sets are at most a few rows: one literal array per tract, no join
    names = ["scenario", *[f"w_{c}" for c in COMPONENTS]]
    listed = sets.agg(F.collect_list(F.struct(*names)).alias("s")).scalar()
    return z.select(
        "tract_geoid", F.col("opportunity_score").alias("base_score"), "lmi_flag",
        *[f"z_{c}" for c in COMPONENTS], F.explode(listed).alias("_s"),
    ).select("tract_geoid", "base_score", "lmi_flag", *[f"z_{c}" for c in COMPONENTS], "_s.*").withColumn(
        "alt_score", C.rnd(alt, 6)
    ).select("scenario", "tract_geoid", "lmi_flag", "base_score", "alt_score")


def rank_compare(rows: DataFrame, key: str = "scenario", k: int = TOP_N, far: int = 500) -> DataFrame:
    """How far a second score moves a first one, per key.

    Competition ranks, rank shift quantiles, rank correlation on ordinal
    positions, members kept in the top k and their LMI share.  The top k is by
    (rank, tract id) so that ties at the edge are settled the same way each run.
    The ranks are read by several steps and stored once.
    """
    a = ranking.with_positions(rows, [key], "base_score").withColumn("base_rank", ranking.rank_desc()).drop(
        "n_equal", "n_below", "n_group")
    b = ranking.with_positions(a, [key], "alt_score").withColumn("alt_rank", ranking.rank_desc()).drop(
        "n_equal", "n_below", "n_group")
    both = materialise(b.withColumn("shift", F.abs(F.col("alt_rank") - F.col("base_rank"))))
    shape = ranking.quantiles(both, [key], "shift", {"median_shift": 0.5, "p95_shift": 0.95, "max_shift": 1.0})
    overall = both.groupBy(key).agg(
        C.rnd(F.avg(F.when(F.col("shift") >= far, 1.0).otherwise(0.0)) * 100, 2).alias("pct_moving_far")
    )
    top_a = _top(both, key, "base_rank", k).withColumn("in_base", F.lit(True))
    top_b = _top(both, key, "alt_rank", k)
    kept = top_b.join(top_a.select(key, "tract_geoid", "in_base"), [key, "tract_geoid"], "left").groupBy(key).agg(
        F.count("in_base").alias("top_retained"),
        C.rnd(F.avg(F.col("lmi_flag").cast("double")) * 100, 1).alias("top_lmi_share_pct"),
    )
    rho = spearman(rows, "base_score", "alt_score", "tract_geoid", [key])
    return (
        shape.join(overall, key).join(kept, key).join(rho, key)
        .select(
            key, C.rnd("spearman", 4).alias("spearman"), "top_retained",
            F.floor("median_shift").alias("median_shift"), F.floor("p95_shift").alias("p95_shift"),
            F.floor("max_shift").alias("max_shift"), "pct_moving_far", "top_lmi_share_pct",
        )
    )


def _top(rows: DataFrame, key: str, rank: str, k: int) -> DataFrame:
    """At most k rows per key by (rank, tract id).

    A row_number filter of this size is planned with a group limit before the
    exchange, so each task sends k rows per key, however many share a rank.
    """
    w = W.partitionBy(key).orderBy(rank, "tract_geoid")
    return rows.filter(F.col(rank) <= k).withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= k).drop("_i")


def spearman(df: DataFrame, a: str, b: str, unique_id: str, keys=()) -> DataFrame:
    """Correlation of ordinal ranks; rows with an unknown side are left out.

    The second ranking reads its rows more than once, so the first one is stored.
    """
    keys = list(keys)
    known = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, unique_id, a, b)
    ranked = materialise(ranking.ordinal(known, keys, a, unique_id, "_ra").drop("n_group"))
    ranked = ranking.ordinal(ranked, keys, b, unique_id, "_rb")
    return ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def influence(index: DataFrame, weights: DataFrame, k: int = TOP_N) -> DataFrame:
    """Spread, correlation with the score and share of the top k, per component."""
    rows = scored_tracts(index)
    top = relational.top_k(rows, k, F.desc("opportunity_score"), F.asc("tract_geoid"))
    spread = rows.agg(*[
        x for c in COMPONENTS for x in (
            F.stddev_samp(f"contrib_{c}").alias(f"sd_{c}"),
            F.corr(f"contrib_{c}", "opportunity_score").alias(f"corr_{c}"),
        )
    ])
    shares = top.agg(*[
        C.pct(F.sum(f"contrib_{c}"), F.sum("opportunity_score")).alias(f"share_{c}") for c in COMPONENTS
    ])

    def long(df: DataFrame, prefix: str, name: str) -> DataFrame:
        return df.select(*[F.col(f"{prefix}_{c}").alias(c) for c in COMPONENTS]).unpivot(
            [], list(COMPONENTS), "component", name)

    primary = weights.filter(F.col("scenario") == "primary").select("component", "weight")
    return (
        primary.join(long(spread, "sd", "sd"), "component").join(long(spread, "corr", "cor"), "component")
        .join(long(shares, "share", "share"), "component")
        .select(
            "component", "weight", C.rnd("sd", 4).alias("sd_of_contribution"),
            C.rnd("cor", 3).alias("corr_with_score"), C.rnd("share", 1).alias("share_of_top_contrib"),
        )
    )


def drivers(compared: DataFrame) -> DataFrame:
    """The component whose removal moves the whole ranking, and the shortlist, most."""
    return compared.agg(
        F.min_by("scenario", F.struct("spearman", "scenario")).alias("driver_full_ranking"),
        F.min_by("scenario", F.struct("top_retained", "scenario")).alias("driver_top"),
    )


def top_composition(index: DataFrame, k: int = TOP_N) -> DataFrame:
    """Share of estimated growth, LMI and adjusted counties: top k against all."""
    rows = scored_tracts(index)
    top = relational.top_k(rows, k, F.desc("opportunity_score"), F.asc("tract_geoid"))

    def shares(df: DataFrame, label: str) -> DataFrame:
        mean = lambda c: C.rnd(F.avg(c.cast("double")) * 100, 1)
        return df.agg(
            mean(F.col("growth_is_estimated")).alias("share_estimated_growth"),
            mean(F.col("lmi_flag")).alias("share_lmi"),
            mean(F.coalesce("county_growth_heavily_adjusted", F.lit(False))).alias("share_county_adjusted"),
        ).withColumn("part", F.lit(label))

    return shares(top, "top").unionByName(shares(rows, "all"))


def scale_test(wh) -> DataFrame:
    """Rank correlation of each component with tract size, pooled and within markets.

    The pooled and the within-market figure come from the same long table, so
    every component is ranked in one pass per scope.
    """
    tract = wh.dim_tract.select(
        "tract_geoid", C.market_key("cbsa", C.state_of("county_fips")).alias("market")
    )
    values = [c for c in COMPONENTS if c != "household_growth"]
    wide = materialise(raw_components(wh)).select("tract_geoid", "households", *[F.col(c).cast("double").alias(c) for c in values])
    long = materialise(wide.join(tract, "tract_geoid").unpivot(
        ["tract_geoid", "market", "households"], values, "component", "value"))
    pooled = spearman(long, "households", "value", "tract_geoid", ["component"]).select(
        "component", F.col("spearman").alias("pooled"))
    within = spearman(long, "households", "value", "tract_geoid", ["component", "market"]).filter(
        (F.col("n") >= 3) & F.col("spearman").isNotNull())
    inside = within.groupBy("component").agg(
        (F.sum(F.col("spearman") * F.col("n")) / F.sum("n")).alias("within_market"),
        F.count(F.lit(1)).alias("markets"))
    return pooled.join(inside, "component", "left").select(
        "component", C.rnd("pooled", 3).alias("pooled"), C.rnd("within_market", 3).alias("within_market"), "markets")

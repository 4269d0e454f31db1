"""Profiles of the yearly site file: counts, transitions, selection funnel, drift, crosswalk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.functions.geo import miles, with_xy
from marketgrid.operators import ranking, relational

KEY_FIELDS = (
    "UNINUMBR", "CERT", "DEPSUMBR", "SIMS_LATITUDE", "SIMS_LONGITUDE", "BRSERTYP", "BKMO", "ADDRESBR", "CITYBR",
    "NAMEFULL", "SIMS_ESTABLISHED_DATE",
)
# Selection criteria
MIN_PRIMARY_STATE, MIN_SECONDARY_STATE, MIN_BRANCHES = 25, 10, 50
ACQUISITION_LIMIT = 0.20
ASSET_MIN_K, ASSET_MAX_K = 10_000_000, 100_000_000
MATERIAL_MOVE = 25
FOOTPRINT_LIMIT, FOOTPRINT_MIN = 0.20, 10


def branch_counts(sod: DataFrame) -> DataFrame:
    """Distinct branches per year and state, with the row total; one column per state that occurs.

    The total has a count of its own, rows without a state included.
    """
    wide = sod.groupBy("YEAR").pivot("STALPBR").agg(F.count_distinct("UNINUMBR"))
    total = sod.filter(F.col("UNINUMBR").isNotNull()).groupBy("YEAR").agg(
        F.count_distinct(F.struct("UNINUMBR", "STALPBR")).alias("total"))
    return wide.join(total, "YEAR", "left")


def deposit_distribution(sod: DataFrame) -> DataFrame:
    """Count, sum, median, p90, maximum and top-percent share per year."""
    base = sod.groupBy("YEAR").agg(
        F.count(F.lit(1)).alias("branches"), F.sum("DEPSUMBR").alias("total_deposits_k"), F.max("DEPSUMBR").alias("max_k")
    )
    shape = ranking.quantiles(sod, ["YEAR"], "DEPSUMBR", {"median_k": 0.5, "p90_k": 0.9})
    top = ranking.top_share(sod, ["YEAR"], "DEPSUMBR")
    return base.join(shape, "YEAR").join(top, "YEAR").select(
        "YEAR", "branches", "total_deposits_k", C.rnd("median_k", 2).alias("median_k"), C.rnd("p90_k", 2).alias("p90_k"),
        "max_k", C.rnd("top_share", 6).alias("share_in_top_1pct"),
    )


def population_rates(sod: DataFrame, fields=KEY_FIELDS) -> DataFrame:
    return sod.groupBy("YEAR").agg(*[
        C.rnd(F.avg(F.col(f).isNotNull().cast("double")), 4).alias(f) for f in fields if f in sod.columns
    ])


def presence(sod: DataFrame) -> DataFrame:
    """One row per (branch, year) with the certificates it was filed under."""
    return sod.filter(F.col("UNINUMBR").isNotNull()).select("CERT", "UNINUMBR", "YEAR").distinct()


def _next_vintage(years: DataFrame) -> DataFrame:
    """(prev, cur) for consecutive vintages; a handful of distinct years."""
    w = W.partitionBy(F.lit(0)).orderBy("year")
    return years.select(F.col("year").alias("prev"), F.lead("year").over(w).alias("cur")).filter(
        F.col("cur").isNotNull())


def vintage_changes(sod: DataFrame, vintages: DataFrame) -> DataFrame:
    """Per branch and transition: was it there before, is it there after?

    Presence is shifted to the next vintage and met with presence by an
    aggregate on (branch, transition), so no self join is needed.
    """
    steps = F.broadcast(_next_vintage(vintages))          # one row per vintage
    seen = sod.filter(F.col("UNINUMBR").isNotNull()).select("UNINUMBR", "YEAR")
    before = seen.join(steps, F.col("YEAR") == F.col("prev")).select(
        "UNINUMBR", "prev", "cur", F.lit(1).alias("b"), F.lit(0).alias("a"))
    after = seen.join(steps, F.col("YEAR") == F.col("cur")).select(
        "UNINUMBR", "prev", "cur", F.lit(0).alias("b"), F.lit(1).alias("a"))
    return before.unionByName(after).groupBy("UNINUMBR", "prev", "cur").agg(
        (F.max("b") == 1).alias("before"), (F.max("a") == 1).alias("after"))


def transitions(sod: DataFrame, vintages: DataFrame) -> DataFrame:
    """Carried over, closed, opened, transferred and net branches per transition.

    Transferred: pairs (certificate, branch) that are new minus branches that are new.
    """
    steps = F.broadcast(_next_vintage(vintages))
    b, a = F.col("before"), F.col("after")
    moves = vintage_changes(sod, vintages).groupBy("prev", "cur").agg(
        C.count_where(b & a).alias("carried_over"), C.count_where(b & ~a).alias("closed"),
        C.count_where(~b & a).alias("opened"),
        (C.count_where(a) - C.count_where(b)).alias("net"),
    )
    pairs = sod.select("CERT", "UNINUMBR", "YEAR").distinct()
    cur = pairs.join(steps, F.col("YEAR") == F.col("cur")).select("CERT", "UNINUMBR", "prev", "cur")
    old = pairs.select("CERT", "UNINUMBR", F.col("YEAR").alias("prev"))
    new_pairs = cur.join(old, ["CERT", "UNINUMBR", "prev"], "left_anti").groupBy("prev", "cur").agg(
        F.count(F.lit(1)).alias("new_pairs"))
    return moves.join(new_pairs, ["prev", "cur"], "left").select(
        F.concat_ws("->", "prev", "cur").alias("transition"), "carried_over", "closed", "opened",
        (F.coalesce("new_pairs", F.lit(0)) - F.col("opened")).alias("transferred"), "net",
    )


def material_movements(sod: DataFrame, vintages: DataFrame, n: int = MATERIAL_MOVE) -> DataFrame:
    """Certificates with at least n branches appearing or disappearing in a transition."""
    changes = vintage_changes(sod, vintages).filter(F.col("before") != F.col("after")).select(
        "UNINUMBR", F.concat_ws("->", "prev", "cur").alias("transition"),
        F.when(F.col("after"), "appeared").otherwise("disappeared").alias("event"),
        F.when(F.col("after"), F.col("cur")).otherwise(F.col("prev")).alias("YEAR"),
    )
    return sod.select("CERT", "UNINUMBR", "YEAR", "NAMEFULL").join(changes, ["UNINUMBR", "YEAR"]).groupBy(
        "transition", "event", F.col("CERT").alias("cert")
    ).agg(F.min("NAMEFULL").alias("institution"), F.count(F.lit(1)).alias("branches")).filter(F.col("branches") >= n)


def established_split(sod: DataFrame, vintages: DataFrame) -> DataFrame:
    """New branches per transition and certificate: built before, or in, the last year."""
    fresh = vintage_changes(sod, vintages).filter(F.col("after") & ~F.col("before")).select(
        "UNINUMBR", F.col("cur").alias("YEAR"))
    rows = sod.select("CERT", "UNINUMBR", "YEAR", C.year_of("SIMS_ESTABLISHED_DATE").alias("built")).join(
        fresh, ["UNINUMBR", "YEAR"])
    return rows.groupBy("YEAR", "CERT").agg(
        C.count_where(F.col("built") < F.col("YEAR") - 1).alias("established_before"),
        C.count_where(F.col("built") >= F.col("YEAR") - 1).alias("recent"),
    )


def acquisition_intensity(sod: DataFrame, vintages: DataFrame) -> DataFrame:
    """Branches gained from another certificate over last year's base, per cert and year."""
    steps = F.broadcast(_next_vintage(vintages))
    pairs = presence(sod)
    cur = pairs.join(steps, F.col("YEAR") == F.col("cur")).select("CERT", "UNINUMBR", "prev", "cur")
    old = pairs.withColumnRenamed("YEAR", "prev")
    gained = cur.join(old, ["CERT", "UNINUMBR", "prev"], "left_anti").join(
        old.select("UNINUMBR", "prev").distinct(), ["UNINUMBR", "prev"], "left_semi")
    base = sod.groupBy("CERT", F.col("YEAR").alias("prev")).agg(F.count(F.lit(1)).alias("base"))
    return gained.groupBy("CERT", "prev", "cur").agg(F.count(F.lit(1)).alias("gained")).join(
        base, ["CERT", "prev"]
    ).select("CERT", F.col("cur").alias("YEAR"), "gained", "base", C.ratio("gained", "base").alias("year_ratio"))


def acquisition_ratio(sod: DataFrame, vintages: DataFrame) -> DataFrame:
    return acquisition_intensity(sod, vintages).groupBy("CERT").agg(
        C.rnd(F.sum("year_ratio"), 6).alias("acq_ratio"), C.rnd(F.max("year_ratio"), 6).alias("max_year_ratio"))


def footprint_profile(sod: DataFrame, vintages: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """Per certificate: name, current branches by state, peak size and years present."""
    newest = relational.latest_year(vintages)
    yearly = sod.groupBy("CERT", "YEAR").agg(
        F.count(F.lit(1)).alias("n"), F.max("NAMEFULL").alias("name"),
        *[F.count_distinct(F.when(F.col("STALPBR") == s, F.col("UNINUMBR"))).alias(f"s{i}")
          for i, s in enumerate(states)],
    )
    now = F.col("YEAR") == newest
    return yearly.groupBy("CERT").agg(
        F.max_by("name", "YEAR").alias("name"),
        *[F.coalesce(F.max(F.when(now, F.col(f"s{i}"))), F.lit(0)).alias(f"state_{i + 1}")
          for i in range(len(states))],
        F.max("n").alias("peak"), F.count(F.lit(1)).alias("vintages"),
    ).withColumn("current_branches", F.expr(" + ".join(f"state_{i + 1}" for i in range(len(states)))))


def selection_funnel(profile: DataFrame, ratios: DataFrame, assets: DataFrame, vintages: DataFrame, limits=None) -> DataFrame:
    """Selection criteria as boolean columns, one row per certificate."""
    lim = {
        "primary": MIN_PRIMARY_STATE, "secondary": MIN_SECONDARY_STATE, "total": MIN_BRANCHES,
        "low_k": ASSET_MIN_K, "high_k": ASSET_MAX_K, **(limits or {}),
    }
    n_years = vintages.agg(F.count_distinct("year")).scalar()
    top5 = relational.top_k(assets.filter(F.col("asset_k").isNotNull()), 5, F.desc("asset_k"), F.asc("CERT"))
    rows = profile.join(ratios.select("CERT", "acq_ratio"), "CERT", "left").join(
        assets.select("CERT", "asset_k"), "CERT", "left").withColumn("acq_ratio", F.coalesce("acq_ratio", F.lit(0.0)))
    rows = relational.flag_exists(rows, top5, ["CERT"], "is_top5")
    high, low = F.greatest("state_1", "state_2"), F.least("state_1", "state_2")
    return rows.select(
        "CERT", "name", "state_1", "state_2", "acq_ratio", "asset_k",
        ((high >= lim["primary"]) & (low >= lim["secondary"])).alias("c1_both_states"),
        (F.col("state_1") + F.col("state_2") >= lim["total"]).alias("c2_scale"),
        (F.col("vintages") == n_years).alias("c3a_continuous"),
        (F.col("acq_ratio") <= ACQUISITION_LIMIT).alias("c3b_organic"),
        (~F.col("is_top5")).alias("c5_not_top5"),
        F.coalesce(F.col("asset_k").between(lim["low_k"], lim["high_k"]), F.lit(False)).alias("c6_asset_band"),
    )


def funnel_counts(criteria: DataFrame) -> DataFrame:
    """How many certificates are left after each criterion, in order: one row."""
    steps = ["c1_both_states", "c2_scale", "c3a_continuous", "c5_not_top5", "c6_asset_band"]
    conds, so_far = [], F.lit(True)
    for s in steps:
        so_far = so_far & F.col(s)
        conds.append(C.count_where(so_far).alias(f"after_{s}"))
    return criteria.agg(F.count(F.lit(1)).alias("all_institutions"), *conds)


def crosswalk(sod: DataFrame, vintages: DataFrame, institutions: DataFrame, lei_index: DataFrame, volume: DataFrame,
              subject_cert: str) -> DataFrame:
    """Certificate -> register number -> lender code, never on the certificate itself.

    institutions: (CERT, fed_rssd); lei_index: (rssd, lei); volume: (lei, applications).
    """
    newest = relational.latest_year(vintages)
    certs = sod.groupBy(F.col("CERT").alias("cert")).agg(
        F.max_by("NAMEFULL", F.struct("YEAR", "NAMEFULL")).alias("name"),
        F.count_distinct(F.when(F.col("YEAR") == newest, F.col("UNINUMBR"))).alias("current_branches"),
    )
    register = institutions.groupBy(F.col("CERT").alias("cert")).agg(
        F.min(F.struct("fed_rssd")).alias("r")).select("cert", F.col("r.fed_rssd").alias("fed_rssd"), F.lit(True).alias("listed"))
    codes = lei_index.select(F.col("rssd").alias("fed_rssd"), "lei")
    rows = relational.join_one(relational.join_one(
        certs.join(register, "cert", "left"), codes, ["fed_rssd"], "lender codes"), volume, ["lei"], "volumes")
    quality = C.match_quality(F.coalesce("listed", F.lit(False)), "fed_rssd", "lei")
    return rows.withColumn("match_quality", quality).select(
        "cert", "name", "current_branches", "fed_rssd",
        F.when(F.col("match_quality") == "exact_rssd", F.col("lei")).otherwise("").alias("lei"), "match_quality",
        F.when(F.col("match_quality") == "exact_rssd", "fed_rssd == institutionId2017").otherwise("").alias("match_method"),
        F.when(F.col("match_quality") == "exact_rssd", F.coalesce("applications", F.lit(0))).otherwise(F.lit(0))
        .alias("applications"),
        (F.col("cert") == subject_cert).alias("is_subject_bank"),
    )


def applications_per_bn(rows: DataFrame, applications: str = "applications", asset_k: str = "asset_k") -> DataFrame:
    """Volume sanity ratio: applications per billion of assets."""
    return rows.withColumn("apps_per_bn", C.rnd(C.ratio(applications, F.col(asset_k) / 1e6), 0))


def branch_drift(sod: DataFrame, box=C.DEFAULT_BOX) -> DataFrame:
    """One row per branch: span, invalid vintages, net displacement and its kind.

    Validity is judged per vintage; only valid vintages enter the displacement.
    """
    ok = C.coord_ok("SIMS_LATITUDE", "SIMS_LONGITUDE", box)
    rows = with_xy(
        sod.withColumns({"ok": ok, "addr": C.norm_address("ADDRESBR")}), "SIMS_LONGITUDE", "SIMS_LATITUDE", "px", "py"
    )
    spot = F.struct("px", "py")
    seen = F.when(F.col("ok"), F.col("YEAR"))
    per = rows.groupBy("UNINUMBR").agg(
        F.min("YEAR").alias("first_year"), F.max("YEAR").alias("last_year"),
        C.count_where(~F.col("ok") & F.col("SIMS_LATITUDE").isNotNull()).alias("invalid_vintages"),
        C.count_where(F.col("ok")).alias("valid_vintages"),
        F.min_by(spot, seen).alias("a"), F.max_by(spot, seen).alias("b"),
        F.min(F.when(F.col("ok"), F.col("addr"))).alias("a1"), F.max(F.when(F.col("ok"), F.col("addr"))).alias("a2"),
    )
    moved = miles("a.px", "a.py", "b.px", "b.py")
    return per.withColumns({
        "position_drift_miles": F.when(F.col("valid_vintages") < 2, F.when(F.col("valid_vintages") == 1, 0.0))
        .otherwise(moved),
        "address_changed": F.when(F.col("valid_vintages") == 1, False).when(
            F.col("valid_vintages") > 1, F.col("a1") != F.col("a2")),
    }).select(
        "UNINUMBR", "first_year", "last_year", "invalid_vintages",
        C.rnd("position_drift_miles", 4).alias("position_drift_miles"), "address_changed",
        F.when(F.col("valid_vintages") > 0, C.drift_kind("valid_vintages", "position_drift_miles", "address_changed"))
        .alias("drift_kind"),
    )


def latest_validity(sod: DataFrame, box=C.DEFAULT_BOX) -> DataFrame:
    """Coordinate validity of the newest record of each branch."""
    last = sod.groupBy("UNINUMBR").agg(
        F.max_by(F.struct("SIMS_LATITUDE", "SIMS_LONGITUDE", "STCNTYBR", "CERT"), "YEAR").alias("r"))
    return last.select("UNINUMBR", "r.*").withColumn("validity", C.coord_validity("SIMS_LATITUDE", "SIMS_LONGITUDE", box))


def county_check(located: DataFrame) -> DataFrame:
    """Reported county against the county of the matched tract; NULL when either is unknown."""
    return located.withColumns({
        "sod_county": C.pad_code("STCNTYBR", 5), "geo_county": C.county_of("tract_geoid"),
    }).withColumn("county_agrees", F.col("sod_county") == F.col("geo_county"))

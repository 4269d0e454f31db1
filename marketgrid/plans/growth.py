"""County deposit growth with and without booking centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.operators import ranking, relational
from marketgrid.session import materialise

BOOKING_MULTIPLE = 20
BASES = ("total", "retail", "excl_hq")


def endpoints(wh) -> tuple[Column, Column]:
    """First and last vintage as scalar subqueries."""
    years = wh.dim_year.agg(F.min("year").alias("a"), F.max("year").alias("b"))
    return years.select("a").scalar(), years.select("b").scalar()


def with_county(sod: DataFrame, branches: DataFrame) -> DataFrame:
    """Yearly records with the county of the coordinates, else the reported one; a branch described twice is an error."""
    county = branches.select(
        F.col("uninumbr").alias("UNINUMBR"),
        F.coalesce(C.county_of("tract_geoid"), F.col("county_fips")).alias("county_fips"),
    )
    return relational.join_one(sod, county, ["UNINUMBR"], "branches").filter(F.col("county_fips").isNotNull())


def flag_booking(records: DataFrame, year_to: Column, multiple: float = BOOKING_MULTIPLE) -> DataFrame:
    """Mark records above `multiple` times the all-branch median of the end year."""
    end = records.filter(F.col("YEAR") == year_to)
    mid = ranking.quantiles(end, [], "DEPSUMBR", {"m": 0.5}).select("m").scalar()
    return records.withColumn("is_booking_centre", F.coalesce(F.col("DEPSUMBR") > multiple * mid, F.lit(False)))


def county_growth(
    records: DataFrame, year_from: Column, year_to: Column, multiple: float = BOOKING_MULTIPLE,
    tags: tuple[str, str] = ("from", "to"),
) -> DataFrame:
    """Deposits, branches and CAGR per county at two endpoints on three bases.

    All three bases and the exclusion diagnostics are conditional sums of one
    grouped aggregate, so the records are shuffled once.
    """
    both = records.filter((F.col("YEAR") == year_from) | (F.col("YEAR") == year_to))
    flagged = flag_booking(
        materialise(both.select("county_fips", "YEAR", "DEPSUMBR", "BKMO")), year_to, multiple
    )
    booking = F.col("is_booking_centre")
    head = F.coalesce(C.number("BKMO") == 1, F.lit(False))
    keep = {"total": F.lit(True), "retail": ~booking, "excl_hq": ~booking & ~head}
    aggs = []
    for tag, year in zip(tags, (year_from, year_to)):
        here = F.col("YEAR") == year
        for base, cond in keep.items():
            # NULL when the county has no record of the base in that year, 0 when all are unknown
            n = C.count_where(here & cond)
            aggs += [
                F.when(n > 0, F.coalesce(C.sum_where(here & cond, "DEPSUMBR"), F.lit(0))).cast("double")
                .alias(f"deposits_{tag}_{base}"),
                F.when(n > 0, n).alias(f"branches_{tag}_{base}"),
            ]
        aggs += [
            C.count_where(here & booking).alias(f"excluded_branches_{tag}"),
            F.coalesce(C.sum_where(here & booking, "DEPSUMBR"), F.lit(0)).cast("double")
            .alias(f"excluded_deposits_{tag}"),
        ]
    span = (year_to - year_from).cast("double")
    out = flagged.groupBy("county_fips").agg(*aggs)
    a, b = tags
    for base in BASES:
        rate = C.cagr_pct(f"deposits_{b}_{base}", f"deposits_{a}_{base}", span)
        out = out.withColumn(f"cagr_pct_{base}", C.rnd(rate, 4))
    for tag in tags:
        out = out.withColumns({
            f"excluded_branch_share_{tag}": C.rnd(
                C.ratio(f"excluded_branches_{tag}", f"branches_{tag}_total"), 4),
            f"excluded_deposit_share_{tag}": C.rnd(
                C.ratio(f"excluded_deposits_{tag}", f"deposits_{tag}_total"), 4),
        })
    worst = {
        name: F.greatest(f"{name}_{a}", f"{name}_{b}")
        for name in ("excluded_branches", "excluded_deposit_share", "excluded_branch_share")
    }
    out = out.withColumns(worst).withColumn(
        "cagr_shift_pp", C.rnd(F.col("cagr_pct_retail") - F.col("cagr_pct_total"), 4)
    )
    return out.withColumn(
        "retail_basis_status",
        F.when(F.col("cagr_pct_retail").isNotNull(), "measured")
        .when(F.coalesce(f"branches_{b}_retail", F.lit(0)) == 0, "no_retail_branches")
        .otherwise("no_2019_retail_base"),
    )

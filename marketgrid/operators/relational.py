"""Small reusable DataFrame steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_year(vintages: DataFrame, year: str = "year") -> Column:
    """The newest vintage as a scalar subquery."""
    return vintages.agg(F.max(year)).scalar()


def only_latest(df: DataFrame, vintages: DataFrame, year: str = "year") -> DataFrame:
    return df.filter(F.col(year) == latest_year(vintages, year))


def flag_exists(df: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Boolean column: does the key occur in the other table?  Never NULL."""
    seen = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(seen, list(on), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of an order that ends in a unique column."""
    return df.orderBy(*order).limit(k)


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def in_report_order(df: DataFrame, query: str) -> DataFrame:
    """The rows of a business query in their published order.

    The queries themselves return unsorted frames: a global sort of a large
    result is paid for only where a report asks for it.
    """
    last = F.asc_nulls_last
    order = {
        "q01": ("state", "county_fips", "year"), "q02": ("state", "county_fips", "year"),
        "q03": (F.desc("is_subject_bank"), last("cagr_pct")), "q04": (last("vs_market_pp"),),
        "q05": (last("excess_growth_pp"),), "q06": ("deposit_percentile",),
        "q09": ("tract_geoid", F.desc_nulls_last("origination_count")), "q10": (F.desc("competitor_originations"),),
        "q11": (F.desc("unmet_originations"),), "q12": (F.desc_nulls_last("opportunity_score"),),
    }
    return df.orderBy(*order[query[:3]])


def at_most_once(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The frame with a check inside its plan: a key that occurs twice stops the query that reads it.

    One aggregate on the keys counts and hands the row on, so a join on the
    same keys needs no further exchange and no second job looks for copies.
    Rows with a NULL key match nothing in a join and may repeat.
    """
    kinds = dict(df.dtypes)
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *([F.first(F.struct(*rest)).alias("_row")] if rest else []))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    shown = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    stop = F.raise_error(F.concat(F.lit(f"{what}: more than one row for "), shown)).cast(kinds[keys[0]])
    first = F.when((F.col("_n") > 1) & known, stop).otherwise(F.col(keys[0])).alias(keys[0])
    out = grouped.select(first, *keys[1:], *(["_row.*"] if rest else []))
    return out.select(*df.columns)


def join_one(left: DataFrame, right: DataFrame, on: Sequence[str], what: str, how: str = "left") -> DataFrame:
    """Many-to-one join: the query stops where the right side has a key twice, instead of multiplying rows."""
    return left.join(at_most_once(right, on, what), list(on), how)

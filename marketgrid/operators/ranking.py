"""Exact ranks, percentiles and bands without one task per group.

A window partitioned by market or tier puts the whole group into one task, and
a global window puts the whole table there.  Here a group is cut into value
buckets first:

1. rows collapse to one row per (group, value) - map-side combined, so a hot
   group or a hot value shrinks before it is shuffled;
2. (group, bucket) counts are prefix-summed - a group has a bounded number of
   buckets, whatever its number of rows;
3. the running count inside one bucket gives the exact position.

The bucket is a monotone function of the value's magnitude, about 0.1 % wide,
and a crowded one is cut evenly between its own least and greatest value: no
sampling is involved, and a re-run task computes the same buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketgrid.session import materialise

_SLICES_PER_E = 1024          # buckets per factor e
_FILL = 4096                  # distinct values of a bucket, about
_SHIFT = 1_000_000            # larger than |ln(smallest double)| * slices


def value_bucket(value: Column) -> Column:
    """Order-preserving bucket number of a numeric value (sign and magnitude)."""
    v = value.cast("double")
    size = F.floor(F.ln(F.abs(v)) * _SLICES_PER_E).cast("long") + F.lit(_SHIFT)
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def with_buckets(counts: DataFrame, group: Sequence[str], value: str, fill: int = _FILL) -> DataFrame:
    """Add ``_bucket`` and ``_part``: together monotone in the value, about `fill` distinct values each.

    A magnitude bucket that holds many values is cut into equal ranges between its own least and greatest value.
    """
    marked = counts.withColumn("_bucket", value_bucket(F.col(value)))
    v = F.col(value).cast("double")
    span = marked.groupBy(*group, "_bucket").agg(
        F.min(v).alias("_least"), (F.max(v) - F.min(v)).alias("_span"), F.count(F.lit(1)).alias("_values"))
    at = F.floor((v - F.col("_least")) / F.col("_span") * F.ceil(F.col("_values") / fill)).cast("long")
    part = F.when((F.col("_values") > fill) & (F.col("_span") > 0), at).otherwise(F.lit(0).cast("long"))
    return attach(marked, span, [*group, "_bucket"], "inner").withColumn("_part", part).drop("_least", "_span", "_values")


def positions(df: DataFrame, keys: Sequence[str], value: str, fill: int = _FILL) -> DataFrame:
    """One row per distinct (keys, value) with exact counts around it.

    Columns: keys, value, ``n_equal`` rows with this value, ``n_below`` rows
    of the group with a smaller one, ``n_group`` rows of the group.  NULL
    values are left out.
    """
    keys = list(keys)
    named = df if keys else df.withColumn("_all", F.lit(0))
    group = keys or ["_all"]
    counts = named.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n_equal"))
    counts = with_buckets(counts, group, value, fill)
    by_bucket = W.partitionBy(*group).orderBy("_bucket", "_part")
    buckets = counts.groupBy(*group, "_bucket", "_part").agg(F.sum("n_equal").alias("_n")).select(
        *group, "_bucket", "_part",
        (F.sum("_n").over(by_bucket) - F.col("_n")).alias("_before"),
        F.sum("_n").over(W.partitionBy(*group)).alias("n_group"),
    )
    inside = W.partitionBy(*group, "_bucket", "_part").orderBy(value)
    return (
        attach(counts, buckets, [*group, "_bucket", "_part"], "inner")
        .withColumn("n_below", F.col("_before") + F.sum("n_equal").over(inside) - F.col("n_equal"))
        .select(*keys, value, "n_equal", "n_below", "n_group")
    )


def rank_desc() -> Column:
    """Competition rank, greatest first, from the columns of `positions`."""
    return F.col("n_group") - F.col("n_below") - F.col("n_equal") + 1


def rank_asc() -> Column:
    return F.col("n_below") + 1


def percent_rank() -> Column:
    return F.when(F.col("n_group") > 1, F.col("n_below") / (F.col("n_group") - 1)).otherwise(F.lit(0.0))


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, at: Mapping[str, float], count: str | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one row per group."""
    return quantiles_of(positions(df, keys, value), keys, value, at, count)


def quantiles_of(
    pos: DataFrame, keys: Sequence[str], value: str, at: Mapping[str, float], count: str | None = None
) -> DataFrame:
    """Quantiles from the output of `positions`, when that is needed anyway."""
    v = F.col(value).cast("double")
    aggs = []
    for name, p in at.items():
        spot = F.lit(float(p)) * (F.col("n_group") - 1)
        for side, edge in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (F.col("n_below") <= edge) & (edge < F.col("n_below") + F.col("n_equal"))
            aggs.append(F.max(F.when(hit, v)).alias(f"_{name}_{side}"))
    aggs.append(F.max("n_group").alias("_n"))
    out = pos.groupBy(*keys).agg(*aggs)
    cols: list[Column] = [F.col(k) for k in keys]
    for name, p in at.items():
        spot = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (spot - F.floor(spot))).alias(name))
    if count:
        cols.append(F.coalesce(F.col("_n"), F.lit(0)).alias(count))
    return out.select(*cols)


def medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Medians of several columns per group, ranked together in one long table."""
    keys = list(keys)
    wide = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values])
    long = wide.unpivot(keys, list(values), "_measure", "_value")
    mid = quantiles(long, [*keys, "_measure"], "_value", {"_mid": 0.5})
    return mid.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_measure") == v, F.col("_mid"))).alias(v) for v in values
    ])


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys of the same name, NULL keys matching NULL keys."""
    renamed = other.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in other.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return df.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def with_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of df plus ``n_equal``, ``n_below`` and ``n_group``."""
    return attach(df, positions(df, keys, value), [*keys, value])


def ordinal(df: DataFrame, keys: Sequence[str], value: str, unique_id: str, name: str) -> DataFrame:
    """0-based position of each row in its group, ordered by (value, digest of id).

    Among equal values the order is arbitrary but must be stable; the digest
    of the id is used because its leading characters also spread one hot value
    evenly over tasks.  Rows with a NULL value get a NULL position.
    """
    keys = list(keys)
    marked = df.withColumn("_digest", F.md5(F.col(unique_id).cast("string"))).withColumn(
        "_slot", F.substring("_digest", 1, 4)
    )
    slots = marked.filter(F.col(value).isNotNull()).groupBy(*keys, value, "_slot").agg(
        F.count(F.lit(1)).alias("_slot_n")
    )
    by_slot = W.partitionBy(*keys, value).orderBy("_slot")
    slots = slots.withColumn("_slot_before", F.sum("_slot_n").over(by_slot) - F.col("_slot_n"))
    placed = attach(slots, positions(df, keys, value), [*keys, value], "inner").withColumn(
        "_slot_start", F.col("n_below") + F.col("_slot_before")
    ).select(*keys, value, "_slot", "_slot_start", "n_group")
    rows = attach(marked, placed, [*keys, value, "_slot"])
    inside = W.partitionBy(*keys, value, "_slot").orderBy("_digest")
    return rows.withColumn(name, F.col("_slot_start") + F.row_number().over(inside) - 1).drop(
        "_digest", "_slot", "_slot_start"
    )


def ntile(position: str, n_group: str, tiles: int) -> Column:
    """Tile number 1..tiles from a 0-based position; the first tiles take the rest."""
    p, n = F.col(position), F.col(n_group)
    base = F.floor(n / F.lit(tiles))
    extra = n - base * tiles
    edge = extra * (base + 1)
    in_large = F.floor(p / F.when(base + 1 > 0, base + 1)) + 1
    in_small = extra + F.floor((p - edge) / F.when(base > 0, base)) + 1
    return F.when(p < edge, in_large).otherwise(in_small).cast("long")


def bands(df: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """Quantile bands over the whole table, right-closed, duplicate edges merged.

    Band numbers start at 0; the lowest edge belongs to the first band.
    """
    names = [f"q{i}" for i in range(n + 1)]
    edges = quantiles(df, [], value, {q: i / n for i, q in enumerate(names)})
    cut = edges.select(F.struct(*names).alias("e")).scalar()
    v = F.col(value).cast("double")
    edge = [cut.getField(q) for q in names]
    # distinct edges strictly below v, the lowest one not counted
    below = sum(
        (F.when((hi > lo) & (hi < v), 1).otherwise(0) for lo, hi in zip(edge, edge[1:])), F.lit(0)
    )
    return df.withColumn(name, F.when(v.isNotNull(), below.cast("long")))


def top_share(df: DataFrame, keys: Sequence[str], value: str, part: int = 100) -> DataFrame:
    """Share of the total held by the largest 1/part of the rows (one row at least)."""
    pos = positions(df, keys, value)
    take = F.greatest(F.lit(1), F.floor(F.col("n_group") / part))
    above = F.col("n_group") - F.col("n_below") - F.col("n_equal")
    used = F.greatest(F.lit(0), F.least(F.col("n_equal"), take - above))
    return pos.groupBy(*keys).agg(
        (F.sum(used * F.col(value)).cast("double") / F.sum(F.col("n_equal") * F.col(value))).alias("top_share")
    )


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """The rows with their place in a total order, from 0, without one task for the whole list.

    Rows are dealt by ranges of the order and stored, so the ranges stay what
    they were if an executor is lost; places are counted inside a range, and
    only one row per range meets in a window of its own.
    """
    dealt = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_range", (F.sum("_size").over(W.orderBy("_range")) - F.col("_size")).alias("_start"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(starts, "_range").withColumn(
        name, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")

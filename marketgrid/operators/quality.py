"""Quality gates: each returns the violations as rows; `require_empty` stops a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.operators import relational


class GateError(ValueError):
    """A gate found violations."""


def require_empty(violations: DataFrame, message: str, show: int = 20) -> None:
    """Raise with the first few violations; only `show` rows reach the driver."""
    bad = violations.limit(show).collect()
    if bad:
        raise GateError(f"{message}: " + "; ".join(str(r.asDict()) for r in bad))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Stop when a needed input is empty, else hand it on."""
    if df.limit(1).count() == 0:
        raise GateError(message)
    return df


def outside_scope(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values of a column that are not allowed, with their row counts."""
    out = df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
    return out.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def footprint_breaches(
    sod: DataFrame, vintages: DataFrame, acknowledged: DataFrame, limit: float = 0.20, least: int = 10
) -> DataFrame:
    """Institutions whose branch count moved too far in the newest transition.

    acknowledged: (cert, year) pairs that were reviewed and accepted.
    """
    newest = vintages.agg(F.max("year")).scalar()
    before = vintages.filter(F.col("year") < newest).agg(F.max("year")).scalar()
    counts = sod.filter((F.col("YEAR") == newest) | (F.col("YEAR") == before)).groupBy(F.col("CERT").alias("cert")).agg(
        F.count_distinct(F.when(F.col("YEAR") == before, F.col("UNINUMBR"))).alias("branches_before"),
        F.count_distinct(F.when(F.col("YEAR") == newest, F.col("UNINUMBR"))).alias("branches_now"),
    ).filter(F.col("branches_before") >= least)
    moved = counts.withColumn(
        "change", C.ratio(F.col("branches_now") - F.col("branches_before"), "branches_before")
    ).filter(F.abs("change") > limit).withColumn("year", newest)
    return moved.join(acknowledged.select("cert", "year"), ["cert", "year"], "left_anti")


def malformed_fips(df: DataFrame, column: str) -> DataFrame:
    """Rows whose county code is missing or not five digits: one row."""
    return df.agg(C.count_where(F.col(column).isNull() | (F.length(column) != 5)).alias("malformed"))


def id_lengths(wh, lengths: Mapping[tuple[str, str], int]) -> DataFrame:
    """Wrong-length counts per identifier column, one row each; one aggregate per table."""
    tables: dict[str, dict[str, int]] = {}
    for (table, column), n in lengths.items():
        tables.setdefault(table, {})[column] = n
    out = []
    for table, columns in tables.items():
        df = getattr(wh, table)
        kinds = dict(df.dtypes)
        counts = df.agg(*[C.count_where(F.col(c).isNotNull() & (F.length(c) != n)).alias(c) for c, n in columns.items()])
        out.append(counts.select(F.explode(F.array(*[
            F.struct(F.lit(f"{table}.{c}").alias("identifier"), F.col(c).alias("wrong_length"), F.lit(kinds[c]).alias("type"))
            for c in columns
        ])).alias("r")).select("r.*"))
    return relational.union_all(out)


def unmapped_codes(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*known)).groupBy(column).agg(
        F.count(F.lit(1)).alias("rows"))


def subject_resolution(crosswalk: DataFrame) -> DataFrame:
    """The subject must resolve to exactly one lender code that has volume: one row."""
    own = F.col("is_subject_bank")
    code = crosswalk.filter(own).agg(F.max("lei")).scalar()
    return crosswalk.agg(
        C.count_where(own).alias("subject_rows"),
        C.count_where((F.col("lei") == code) & (F.col("lei") != "")).alias("same_lei"),
        F.coalesce(C.sum_where(own, "applications"), F.lit(0)).alias("applications"),
    ).withColumn(
        "passes", (F.col("subject_rows") == 1) & (F.col("same_lei") == 1) & (F.col("applications") > 0))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows without a parent; NULL keys are not references."""
    right = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(right, key, "left_anti")


def referential_checks(wh) -> DataFrame:
    """Ten checks in both directions, orphan rows per check."""
    def county_of(df: DataFrame) -> DataFrame:
        return df.select("county_fips").distinct()

    checks = {
        "deposits.uninumbr -> branch": orphans(wh.fact_branch_deposits, wh.dim_branch, "uninumbr"),
        "deposits.cert -> institution": orphans(wh.fact_branch_deposits, wh.dim_institution, "cert"),
        "bridge.uninumbr -> branch": orphans(wh.bridge_branch_catchment, wh.dim_branch, "uninumbr"),
        "bridge.tract -> tract": orphans(wh.bridge_branch_catchment, wh.dim_tract, "tract_geoid"),
        "lending.tract -> tract": orphans(wh.fact_tract_lending, wh.dim_tract, "tract_geoid"),
        "branch.tract -> tract": orphans(wh.dim_branch, wh.dim_tract, "tract_geoid"),
        "competition.tract -> tract": orphans(wh.fact_tract_competition, wh.dim_tract, "tract_geoid"),
        "tract -> competition": orphans(wh.dim_tract, wh.fact_tract_competition, "tract_geoid"),
        "growth.county -> tract": orphans(wh.fact_county_deposit_growth, wh.dim_tract, "county_fips"),
        "tract.county -> growth": orphans(county_of(wh.dim_tract), wh.fact_county_deposit_growth, "county_fips"),
    }
    return relational.union_all([
        df.agg(F.lit(label).alias("check"), F.count(F.lit(1)).alias("orphans")) for label, df in checks.items()
    ])


def orphan_tracts(lending: DataFrame, tracts: DataFrame) -> DataFrame:
    """Lending tracts that no tract row describes, with their weight."""
    return orphans(lending, tracts, "tract_geoid").groupBy("tract_geoid").agg(
        F.count(F.lit(1)).alias("fact_rows"), F.sum("record_count").alias("applications"),
        F.count_distinct("lei").alias("lenders"),
    ).withColumn("state_fips", C.state_of("tract_geoid"))


def weight_sums(weights: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Scenarios whose weights do not sum to 1."""
    return weights.groupBy("scenario").agg(F.sum("weight").alias("total")).filter(F.abs(F.col("total") - 1) > tolerance)


def row_counts(wh, names: Sequence[str]) -> DataFrame:
    """Rows per table, one DataFrame."""
    return relational.union_all([
        getattr(wh, n).agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows")) for n in names
    ])


def empty_tables(wh, names: Sequence[str]) -> DataFrame:
    return row_counts(wh, names).filter(F.col("rows") == 0)


def more_than_one_primary(bridge: DataFrame) -> DataFrame:
    return relational.duplicate_keys(bridge.filter(F.col("is_primary")), ["tract_geoid"])


def not_boolean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values outside true, false and missing, per declared boolean column, in one pass."""
    flags = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                 (F.col(c).isNotNull() & C.as_flag(c).isNull()).alias("bad")) for c in columns
    ])).alias("r")).select("r.*")
    return flags.filter("bad").groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows")).select(
        "value", "rows", "column")


def out_of_tolerance(errors: DataFrame, limit: float = 1e-3, column: str = "max_error") -> DataFrame:
    return errors.filter(F.coalesce(F.col(column) > limit, F.lit(True)))


def reconciliation_failures(report: DataFrame) -> DataFrame:
    return report.filter(~F.col("ac01_result").startswith("PASS"))

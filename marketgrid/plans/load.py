"""Load of the warehouse with gates on the way: a violation stops it before anything is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.operators import quality, relational
from marketgrid.plans import catchment, opportunity
from marketgrid.plans.warehouse import STORED
from marketgrid.schemas import ID_LENGTHS
from marketgrid.sources import sinks

#: Lending records may name tracts of another vintage; the published load reports them and goes on.
REPORTED_ONLY = ("lending.tract -> tract",)


def _orphans(wh, reported_only: tuple[str, ...]) -> DataFrame:
    found = quality.referential_checks(wh)
    return found.filter((F.col("orphans") > 0) & ~F.col("check").isin(*reported_only))


def gates(
    wh, bounds: tuple[float, float] = catchment.RADIUS_BOUNDS, reported_only: tuple[str, ...] = REPORTED_ONLY,
) -> dict[str, Callable[[], DataFrame]]:
    """Gate name -> violations, in the order of a load: inputs first, then what is derived from them.

    A gate is worked out only when it is asked for, so a radius that may not
    be used stops the load before a catchment is built on it.
    """
    return {
        "weights sum to 1": lambda: quality.weight_sums(wh.ref_index_weights),
        "identifier lengths": lambda: quality.id_lengths(
            wh, {k: n for k, n in ID_LENGTHS.items() if not k[0].startswith("bridge")}).filter("wrong_length > 0"),
        "one row per branch and year": lambda: relational.duplicate_keys(wh.fact_branch_deposits, ["uninumbr", "year"]),
        "one row per branch": lambda: relational.duplicate_keys(wh.dim_branch, ["uninumbr"]),
        "one row per tract": lambda: relational.duplicate_keys(wh.dim_tract, ["tract_geoid"]),
        "one row per institution": lambda: relational.duplicate_keys(wh.dim_institution, ["cert"]),
        "flags are boolean": lambda: quality.not_boolean(
            wh.dim_branch, ["county_agrees", "is_subject_bank"]),
        "radii": lambda: catchment.radius_violations(wh.tier_radii, bounds),
        "one primary branch per tract": lambda: quality.more_than_one_primary(wh.bridge_branch_catchment),
        "references": lambda: _orphans(wh, reported_only),
        "tables with rows": lambda: quality.empty_tables(wh, STORED),
        "scores follow from their parts": lambda: quality.out_of_tolerance(
            opportunity.reproduction_error(wh.opportunity_index, wh.ref_index_weights)),
    }


def check(wh, **options) -> None:
    """Raise `GateError` at the first gate with a violation."""
    for name, violations in gates(wh, **options).items():
        quality.require_empty(violations(), name)


def load(wh, folder: str, database: str | None = None, buckets: int = 64, **options) -> DataFrame:
    """Check, write every table, and return the row counts read back.

    With a database, the dimensions and facts are also rebuilt as managed
    tables, the deposit fact and the branch dimension bucketed on the branch.
    """
    check(wh, **options)
    sinks.build_warehouse(wh, folder)
    if database:
        sinks.save_bucketed(wh, database, buckets)
        for name in STORED:
            if name not in sinks.BUCKETED:
                sinks.create_table(getattr(wh, name), f"{database}.{name}", name)
    return sinks.stored_counts(wh.dim_tract.sparkSession, folder)

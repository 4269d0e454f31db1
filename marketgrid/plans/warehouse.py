"""The star schema a set of jobs works on."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from marketgrid.schemas import SCHEMAS
from marketgrid.session import materialise

COMPONENTS = (
    "household_growth", "median_income", "deposit_market_growth", "competitor_saturation", "unmet_mortgage_demand",
)
WEIGHT_SCHEMA = "scenario string, component string, weight double, inverted boolean, normalization string"
# The four published weight sets, in the order of COMPONENTS
SCENARIO_WEIGHTS = {
    "primary": (0.20, 0.15, 0.25, 0.20, 0.20),
    "equal_weight": (0.20, 0.20, 0.20, 0.20, 0.20),
    "growth_led": (0.35, 0.10, 0.35, 0.10, 0.10),
    "underserved_led": (0.15, 0.05, 0.20, 0.20, 0.40),
}
# tables a stored warehouse consists of
STORED = (
    "dim_year", "dim_institution", "dim_branch", "dim_tract", "fact_branch_deposits", "fact_tract_lending",
    "bridge_branch_catchment", "fact_tract_competition", "fact_county_deposit_growth", "ref_index_weights",
    "ref_sod_state_totals",
)
INVERTED = frozenset({"competitor_saturation"})
INDEX_WEIGHTS = [
    (scenario, component, weight, component in INVERTED, "z_score")
    for scenario, weights in SCENARIO_WEIGHTS.items()
    for component, weight in zip(COMPONENTS, weights)
]


class Warehouse:
    """Named frames, built on first use and then reused by every job."""

    def __init__(
        self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]],
        derived: Mapping[str, Callable[[Warehouse], DataFrame]] | None = None,
    ):
        self._tables = dict(tables)
        self._derived = dict(derived or {})
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in self._tables:
            found = self._tables[name]
            if callable(found) and not isinstance(found, DataFrame):
                found = self._tables[name] = found()
            return found
        if name not in self._derived:
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._derived[name](self)
        return self._built[name]

    def names(self) -> list[str]:
        return [*self._tables, *(n for n in self._derived if n not in self._tables)]

    def with_tables(self, **tables: DataFrame | Callable[[], DataFrame]) -> Warehouse:
        """The same warehouse with some tables replaced; what is derived is worked out anew from them."""
        return Warehouse({**self._tables, **tables}, {k: v for k, v in self._derived.items() if k not in tables})

    def register_views(self) -> None:
        """Expose every table to ``spark.sql`` under its own name."""
        for name in self.names():
            getattr(self, name).createOrReplaceTempView(name)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> Warehouse:
        """Open a stored warehouse (one Parquet folder per table)."""
        wh = cls({
            name: (lambda n=name: spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}")) for name in STORED
        })
        wh._derived = {"vintages": lambda w: w.dim_year.select("year"), **_derived_tables(stored=True)}
        return wh

    @classmethod
    def from_database(cls, spark: SparkSession, database: str) -> Warehouse:
        """Open a warehouse of managed tables; those bucketed on the branch id join on it without an exchange."""
        wh = cls({name: (lambda n=name: spark.table(f"{database}.{n}")) for name in STORED})
        wh._derived = {"vintages": lambda w: w.dim_year.select("year"), **_derived_tables(stored=True)}
        return wh

    @classmethod
    def from_tables(cls, source) -> Warehouse:
        """A warehouse over a source of dimensions and facts; the rest is derived.

        The base tables that many steps read are stored once.
        """
        return cls({
            "dim_year": source.dim_year,
            "vintages": source.vintages,
            "dim_institution": source.dim_institution,
            "dim_branch": source.dim_branch,
            "dim_tract": lambda: materialise(source.dim_tract()),
            "fact_branch_deposits": source.fact_branch_deposits,
            "fact_tract_lending": source.fact_tract_lending,
            "ref_index_weights": source.index_weights,
            "ref_sod_state_totals": source.state_totals,
            "sod": source.sod,
        }, _derived_tables(stored=False))


def _derived_tables(stored: bool) -> dict[str, Callable[[Warehouse], DataFrame]]:
    """What is computed from the tables, each stage stored once on first use."""
    from marketgrid.plans import catchment, growth, opportunity

    out: dict[str, Callable[[Warehouse], DataFrame]] = {
        "subject_sites": lambda w: materialise(catchment.subject_sites(w)),
        "tract_points": lambda w: materialise(catchment.tract_points(w)),
        "tier_radii": lambda w: materialise(catchment.tier_radii(w.subject_sites)),
        "opportunity_index": lambda w: materialise(opportunity.index_rows(w)),
    }
    if not stored:
        out["bridge_branch_catchment"] = lambda w: materialise(catchment.bridge(w))
        out["fact_tract_competition"] = lambda w: materialise(catchment.competition(w))
        out["fact_county_deposit_growth"] = lambda w: materialise(growth.county_growth(
            growth.with_county(w.sod, w.dim_branch), *growth.endpoints(w)))
    return out

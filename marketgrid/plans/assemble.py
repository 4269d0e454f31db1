"""The star schema out of raw files: every dimension and fact a warehouse is built from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.operators import graph, relational, spatial
from marketgrid.plans import lending, profile, staging
from marketgrid.plans.warehouse import INDEX_WEIGHTS, WEIGHT_SCHEMA, Warehouse


def branch_dimension(sod: DataFrame, polygons: DataFrame, subject_cert: str, box=C.DEFAULT_BOX) -> DataFrame:
    """One row per branch: its newest record, span, drift, the area of its coordinates and the county check.

    Branches with unusable coordinates stay, without an area; a county that
    can't be checked is unknown, not wrong.
    """
    taken = ("CERT", "NAMEFULL", "ADDRESBR", "CITYBR", "STALPBR", "STCNTYBR", "SIMS_LATITUDE", "SIMS_LONGITUDE",
             "BRSERTYP", "BKMO")
    last = sod.filter(F.col("UNINUMBR").isNotNull()).groupBy("UNINUMBR").agg(
        F.max_by(F.struct(*taken), "YEAR").alias("r")).select("UNINUMBR", "r.*").withColumn(
        "validity", C.coord_validity("SIMS_LATITUDE", "SIMS_LONGITUDE", box))
    usable = last.filter(F.col("validity") == "ok").select(
        "UNINUMBR", F.col("SIMS_LONGITUDE").alias("lon"), F.col("SIMS_LATITUDE").alias("lat"))
    hit = spatial.one_polygon(spatial.point_in_polygon(usable, polygons, "UNINUMBR"), "UNINUMBR").select(
        "UNINUMBR", F.col("poly_id").alias("tract_geoid"))
    rows = profile.county_check(last.join(hit, "UNINUMBR", "left")).join(profile.branch_drift(sod, box), "UNINUMBR")
    return rows.select(
        F.col("UNINUMBR").alias("uninumbr"), F.col("CERT").alias("cert"), F.col("NAMEFULL").alias("institution_name"),
        F.col("ADDRESBR").alias("address"), F.col("CITYBR").alias("city"), F.col("STALPBR").alias("state"),
        F.col("sod_county").alias("county_fips"), F.col("SIMS_LATITUDE").alias("latitude"),
        F.col("SIMS_LONGITUDE").alias("longitude"), "tract_geoid", F.col("BRSERTYP").alias("service_type"),
        F.col("BKMO").alias("is_main_office"), "first_year", "last_year", "position_drift_miles", "drift_kind",
        "county_agrees", "validity", (F.col("CERT") == subject_cert).alias("is_subject_bank"),
    )


def deposit_fact(sod: DataFrame) -> DataFrame:
    """Deposits per branch and year in dollars, with the total that main offices report."""
    return sod.filter(F.col("UNINUMBR").isNotNull()).select(
        F.col("UNINUMBR").alias("uninumbr"), F.col("CERT").alias("cert"), F.col("YEAR").alias("year"),
        C.to_dollars("DEPSUMBR").alias("deposits"), C.to_dollars("DEPSUM").alias("institution_total_deposits"))


class RawStar:
    """Source of a warehouse over raw frames (see `sources.raw_files.RawFiles` for the frames it takes).

    `observed` holds what the drop of records without an area counted, once
    the lending fact has been written; the count costs no pass of its own.
    """

    def __init__(self, raw, subject_cert: str, as_of: str):
        self.raw, self.subject_cert, self.as_of = raw, subject_cert, as_of
        self.observed: dict[str, Observation] = {}

    def sod(self) -> DataFrame:
        return self.raw.sites()

    def vintages(self) -> DataFrame:
        return self.sod().select(F.col("YEAR").alias("year")).distinct()

    def dim_year(self) -> DataFrame:
        return self.vintages().withColumn("sod_as_of_date", C.as_of_date("year"))

    def dim_institution(self) -> DataFrame:
        volume = self.raw.loans().groupBy("lei").agg(F.count(F.lit(1)).alias("applications"))
        return staging.stage_institutions(profile.crosswalk(
            self.sod(), self.vintages(), self.raw.register(), self.raw.lei_lookup(), volume, self.subject_cert), self.as_of)

    def dim_branch(self) -> DataFrame:
        return branch_dimension(self.sod(), self.raw.polygons(), self.subject_cert)

    def dim_tract(self) -> DataFrame:
        census = self.raw.census().withColumn("tract_geoid", F.concat("state", "county", "tract"))
        status = C.tract_status("tract_geoid", "households", "median_family_income")
        growth = graph.tract_growth(
            census.withColumn("tract_status", status), self.raw.overlaps(), self.raw.old_counts())
        return staging.stage_tracts(
            census.drop("tract_geoid"), self.raw.area_kinds(), self.raw.loans(), self.raw.area_income(),
            spatial.centroids(self.raw.polygons()), growth)

    def fact_branch_deposits(self) -> DataFrame:
        return deposit_fact(self.sod())

    def fact_tract_lending(self) -> DataFrame:
        seen = self.observed["lending"] = Observation("lending")
        return lending.stage_lending(self.raw.loans(), seen)

    def index_weights(self) -> DataFrame:
        return self.raw.spark.createDataFrame(INDEX_WEIGHTS, WEIGHT_SCHEMA)

    def state_totals(self) -> DataFrame:
        return self.raw.state_totals()

    def warehouse(self) -> Warehouse:
        return Warehouse.from_tables(self)

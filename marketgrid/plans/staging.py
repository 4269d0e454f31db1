"""Assembly of the tract and branch dimensions from their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.operators import relational, spatial
from marketgrid.plans import lending, profile


def income_basis(tracts: DataFrame, records: DataFrame, area_income: DataFrame) -> DataFrame:
    """Income ratio, its basis and the LMI flag per tract.

    The reported ratio (median over the tract's records) comes first; without
    it the tract's family income over that of its area, labelled as such.
    tracts: (tract_geoid, cbsa, median_family_income); area_income:
    (cbsa, area_family_income), negative meaning suppressed.
    """
    reported = lending.income_ratio(records).withColumnRenamed("tract_to_area_income_pct", "_reported")
    area = area_income.select("cbsa", C.not_negative("area_family_income").alias("_area"))
    own = C.pct("median_family_income", "_area")
    return (
        tracts.select("tract_geoid", "cbsa", "median_family_income")
        .join(reported, "tract_geoid", "left").transform(relational.join_one, area, ["cbsa"], "area incomes")
        .withColumn("tract_to_area_income_pct", F.coalesce("_reported", own))
        .select(
            "tract_geoid", "tract_to_area_income_pct",
            F.when(F.col("_reported").isNotNull(), "ffiec_ratio").when(own.isNotNull(), "acs_fallback").otherwise("")
            .alias("lmi_basis"),
            C.lmi_flag("tract_to_area_income_pct").alias("lmi_flag"),
        )
    )


def stage_tracts(
    acs: DataFrame, areas: DataFrame, records: DataFrame, area_income: DataFrame, centers: DataFrame, growth: DataFrame
) -> DataFrame:
    """The tract dimension.

    acs: cleaned census rows (state, county, tract, NAME and the six measures);
    areas: (county_fips, cbsa, cbsa_title, tier); centers: `centroids` output
    per tract id; growth: `graph.tract_growth` output without its counts.
    """
    base = acs.withColumns({
        "tract_geoid": F.concat("state", "county", "tract"), "county_fips": F.concat("state", "county"),
        "county_name": C.county_from_label("NAME"),
    }).transform(relational.join_one, areas, ["county_fips"], "kinds of counties").withColumn("tier", F.coalesce("tier", F.lit("rural")))
    base = base.withColumn("tract_status", C.tract_status("tract_geoid", "households", "median_family_income"))
    place = centers.select(F.col("poly_id").alias("tract_geoid"), "centroid_lat", "centroid_lon")
    return (
        base.join(income_basis(base, records, area_income), "tract_geoid", "left")
        .transform(relational.join_one, place, ["tract_geoid"], "centroids")
        .transform(relational.join_one, growth.drop("households"), ["tract_geoid"], "growth rows")
        .withColumn("growth_basis", F.coalesce("growth_basis", F.lit("no_2010_counterpart")))
        .drop("state", "county", "tract", "NAME")
    )


def stage_branches(sod: DataFrame, polygons: DataFrame, box=C.DEFAULT_BOX) -> DataFrame:
    """The branch dimension: newest record, drift, tract by coordinates, county check.

    Branches with unusable coordinates stay in the result, without a tract.
    """
    drift = profile.branch_drift(sod, box)
    last = profile.latest_validity(sod, box)
    usable = last.filter(F.col("validity") == "ok").select(
        "UNINUMBR", F.col("SIMS_LONGITUDE").alias("lon"), F.col("SIMS_LATITUDE").alias("lat")
    )
    hit = spatial.one_polygon(spatial.point_in_polygon(usable, polygons, "UNINUMBR"), "UNINUMBR").select(
        "UNINUMBR", F.col("poly_id").alias("tract_geoid")
    )
    rows = profile.county_check(last.join(hit, "UNINUMBR", "left")).join(drift, "UNINUMBR")
    located = F.col("validity") == "ok"
    return rows.select(
        F.col("UNINUMBR").alias("uninumbr"), F.col("CERT").alias("cert"), "tract_geoid", "validity",
        F.when(located, F.col("sod_county")).alias("sod_county"), F.when(located, F.col("geo_county")).alias("geo_county"),
        F.when(located, F.col("county_agrees")).alias("county_agrees"),
        "first_year", "last_year", "position_drift_miles", "drift_kind", "address_changed", "invalid_vintages",
    )


def area_mismatch(points: DataFrame, outline: DataFrame, point_id: str) -> DataFrame:
    """Points located in another area than reported: miles to the reported area and whether the two touch.

    points: the id, lon, lat, reported, located; outline: edges with group_id. Unknown areas are no mismatch.
    """
    wrong = points.filter(F.col("reported") != F.col("located"))
    off = spatial.miles_to_outline(wrong.select(point_id, "lon", "lat", "reported"), outline, point_id, "reported")
    touching = spatial.touching_groups(outline).withColumn("adjacent", F.lit(True))
    pair = [F.least("reported", "located") == F.col("group_a"), F.greatest("reported", "located") == F.col("group_b")]
    return wrong.select(point_id, "reported", "located").join(off, [point_id, "reported"], "left").join(
        touching, pair, "left").select(
        point_id, "reported", "located", "miles_off", F.coalesce("adjacent", F.lit(False)).alias("adjacent"))


def stage_deposits(sod: DataFrame) -> DataFrame:
    """Deposit fact from the yearly file, which counts in thousands; rows without a branch id are left out."""
    return sod.filter(F.col("UNINUMBR").isNotNull()).select(
        F.col("UNINUMBR").alias("uninumbr"), F.col("CERT").alias("cert"), F.col("YEAR").alias("year"),
        C.to_dollars("DEPSUMBR").alias("deposits"))


def stage_institutions(crosswalk: DataFrame, as_of) -> DataFrame:
    """Institution dimension from the crosswalk; one row per certificate."""
    return crosswalk.select(
        "cert", F.col("name").alias("institution_name"), "fed_rssd", F.nullif(F.col("lei"), F.lit("")).alias("lei"),
        "match_quality", "match_method", "is_subject_bank", F.lit(as_of).cast("date").alias("attribute_as_of_date"))

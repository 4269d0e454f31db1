from pyspark.sql import functions as F

from marketgrid.operators import quality
from marketgrid.plans import lending, profile, staging


def test_tract_dimension(spark):
    acs = spark.createDataFrame(
        [("01", "125", "010405", "Tract; Adams County; Wisconsin", 900.0, 70000.0),
         ("01", "125", "010406", "Tract; Adams County; Wisconsin", 0.0, None),
         ("01", "127", "010407", "Tract; Dane County; Wisconsin", 500.0, 30000.0)],
        "state string, county string, tract string, NAME string, households double, median_family_income double")
    areas = spark.createDataFrame([("01125", "16980", "Chicago", "metro")],
                                  "county_fips string, cbsa string, cbsa_title string, tier string")
    records = spark.createDataFrame([("01125010405", "60"), ("01125010405", "NA"), ("01125010405", "90"), (None, "10")],
                                    "census_tract string, tract_to_msa_income_percentage string")
    income = spark.createDataFrame([("16980", -666666666.0)], "cbsa string, area_family_income double")
    centers = spark.createDataFrame([("01125010405", -89.0, 43.0)], "poly_id string, centroid_lon double, centroid_lat double")
    growth = spark.createDataFrame([("01125010405", 900.0, 1.5, "direct")],
                                   "tract_geoid string, households double, household_growth_pct double, growth_basis string")
    got = {r.tract_geoid: r for r in staging.stage_tracts(acs, areas, records, income, centers, growth).collect()}
    a, b, c = got["01125010405"], got["01125010406"], got["01127010407"]
    assert (a.tract_to_area_income_pct, a.lmi_basis, a.lmi_flag, a.tier, a.county_name) == (75.0, "ffiec_ratio", True, "metro", "Adams County")
    assert (a.growth_basis, a.tract_status, a.centroid_lat) == ("direct", "ok", 43.0)
    assert (b.lmi_flag, b.lmi_basis, b.tract_status, b.growth_basis) == (None, "", "unpopulated", "no_2010_counterpart")
    assert (c.tier, c.lmi_flag, c.cbsa) == ("rural", None, None)


def sod(spark):
    rows = [  # cert, branch, year, lat, lon, address, reported county
        ("A", "1", 2019, 0.0, 0.0, "1 West Main Street", "01125"), ("A", "1", 2020, 43.0, -89.0, "1 West Main Street", "01125"),
        ("B", "1", 2021, 43.02, -89.0, "1 W Main St", "01125"),
        ("A", "2", 2019, 43.0, -89.0, "2 Oak Road", "01127"), ("A", "2", 2021, 43.1, -89.0, "9 Elm Lane", "01127"),
        ("A", "3", 2019, None, None, "3 X", "01125"), ("C", "4", 2021, 43.0, -89.5, "4 Y", None),
    ]
    return spark.createDataFrame(
        rows, "CERT string, UNINUMBR string, YEAR int, SIMS_LATITUDE double, SIMS_LONGITUDE double, ADDRESBR string,"
        " STCNTYBR string").withColumns({"NAMEFULL": F.concat(F.lit("Bank "), "CERT"), "STALPBR": F.lit("WI")})


def test_branch_dimension(spark):
    ring = [(-89.2, 42.9), (-88.8, 42.9), (-88.8, 43.2), (-89.2, 43.2)]
    poly = spark.createDataFrame([("01125010405", 1, i, x, y) for i, (x, y) in enumerate(ring)],
                                 "poly_id string, ring_id int, seq int, lon double, lat double")
    got = {r.uninumbr: r for r in staging.stage_branches(sod(spark), poly).collect()}
    assert got["1"].drift_kind == "regeocode" and got["1"].invalid_vintages == 1 and got["1"].cert == "B"
    assert (got["1"].tract_geoid, got["1"].county_agrees) == ("01125010405", True)
    assert got["2"].drift_kind == "relocation" and got["2"].county_agrees is False
    assert got["3"].validity == "missing_coordinates" and got["3"].drift_kind is None and got["3"].county_agrees is None
    assert got["4"].drift_kind == "single_vintage" and got["4"].tract_geoid is None and got["4"].position_drift_miles == 0


def test_transitions_tell_transfers_from_openings(spark):
    rows = sod(spark)
    years = rows.select(F.col("YEAR").alias("year")).distinct()
    got = {r.transition: r for r in profile.transitions(rows, years).collect()}
    first, second = got["2019->2020"], got["2020->2021"]
    assert (first.carried_over, first.closed, first.opened, first.transferred, first.net) == (1, 2, 0, 0, -2)
    assert (second.carried_over, second.closed, second.opened, second.transferred, second.net) == (1, 0, 2, 1, 2)
    ratio = {r.CERT: r.acq_ratio for r in profile.acquisition_ratio(rows, years).collect()}
    assert ratio == {}           # the receiving certificate had no base in the year before
    moved = spark.createDataFrame([("A", "5", 2020), ("A", "6", 2020)], "CERT string, UNINUMBR string, YEAR int")
    rows = rows.unionByName(moved, allowMissingColumns=True)         # three branches become one
    ack = spark.createDataFrame([("A", 2021)], "cert string, year int")
    none = ack.filter("cert = 'none'")
    assert [r.cert for r in quality.footprint_breaches(rows, years, none, 0.2, 1).collect()] == ["A"]
    assert quality.footprint_breaches(rows, years, ack, 0.2, 1).count() == 0


def test_lending_staging_keeps_null_keys_and_bad_amounts(spark):
    rows = spark.createDataFrame(
        [("T", None, "1", "1", "5"), ("T", None, "1", "1", "Exempt"), ("T", "L", "1", "6", "Exempt"), (None, "L", "1", "1", "7")],
        "census_tract string, lei string, loan_purpose string, action_taken string, loan_amount string")
    got = {(r.lei, r.action_taken): (r.record_count, r.total_amount, r.action_class) for r in lending.stage_lending(rows).collect()}
    assert got == {(None, "1"): (2, 5, "origination"), ("L", "6"): (1, 0, "purchased")}
    assert tuple(lending.unplaced_count(rows).first()) == (4, 1)
    assert profile.applications_per_bn(
        spark.createDataFrame([(10, 2_000_000.0), (1, 0.0)], "applications int, asset_k double")
    ).select("apps_per_bn").collect()[0][0] == 5.0

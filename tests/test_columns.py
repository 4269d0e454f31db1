import pytest
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.functions.geo import Albers, CONUS


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_snyder_albers_example(spark):
    # Snyder 1987, numerical example for the ellipsoid: 75 W 35 N on Clarke 1866
    x, y = Albers(a=6378206.4, e2=0.00676866).forward("-75.0D", "35.0D")
    row = one(spark, x.alias("x"), y.alias("y"))
    assert row.x == pytest.approx(1885472.7, abs=0.1)
    assert row.y == pytest.approx(1535925.0, abs=0.1)


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-93.5, 36.0), (-86.0, 47.5), (-88.0, 43.0)], "lon double, lat double")
    x, y = CONUS.forward("lon", "lat")
    lon, lat = CONUS.inverse("x", "y")
    for r in df.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect():
        assert r.lon2 == pytest.approx(r.lon, abs=1e-7)
        assert r.lat2 == pytest.approx(r.lat, abs=1e-7)


def test_address_reformatting_is_not_a_move(spark):
    df = spark.createDataFrame(
        [("105 West Main Street",), ("105 W. Main St",), ("105  W  MAIN ST.",)], "a string")
    assert {r[0] for r in df.select(C.norm_address("a")).collect()} == {"105 w main st"}


@pytest.mark.parametrize("lat,lon,want", [
    (None, -88.0, "missing_coordinates"), (0.0, 0.0, "null_island"), (-88.0, 43.0, "transposed_coordinates"),
    (30.0, -88.0, "out_of_range"), (43.0, -88.0, "ok"),
])
def test_coordinate_validity(spark, lat, lon, want):
    df = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    assert df.select(C.coord_validity("lat", "lon")).first()[0] == want


@pytest.mark.parametrize("geoid,hh,income,want", [
    ("01125990000", 5.0, 1.0, "water_or_special"), ("01125010405", 0.0, None, "unpopulated"),
    ("01125010405", None, 1.0, "suppressed"), ("01125010405", 9.0, None, "suppressed"), ("01125010405", 9.0, 1.0, "ok"),
])
def test_tract_status(spark, geoid, hh, income, want):
    df = spark.createDataFrame([(geoid, hh, income)], "g string, h double, i double")
    assert df.select(C.tract_status("g", "h", "i")).first()[0] == want


def test_unknown_is_not_a_value(spark):
    df = spark.createDataFrame([(79.0,), (80.0,), (None,)], "p double")
    assert [r[0] for r in df.select(C.lmi_flag("p")).collect()] == [True, False, None]
    rows = spark.createDataFrame(
        [(0.5, None), (1.5, None), (0.5, -1.0), (0.5, 1.0), (1.5, -1.0), (1.5, 0.0)], "l double, t double")
    assert [r[0] for r in rows.select(C.diagnosis("l", "t")).collect()] == [
        "poor level, trajectory unknown", "adequate level, trajectory unknown", "poor level AND poor trajectory",
        "poor level, positive trajectory", "adequate level, poor trajectory", "adequate level and trajectory",
    ]


def test_refused_ratios(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(C.ratio("a", "b")).collect()] == [None, None, None]
    base = spark.createDataFrame([(8.0, 0.0, 3), (8.0, 1.0, 3), (8.0, 1.0, 0), (8.0, None, 3)], "n double, b double, y int")
    assert [r[0] for r in base.select(C.rnd(C.cagr_pct("n", "b", "y"), 6)).collect()] == [None, 100.0, None, None]


def test_rounding_follows_the_scaled_double(spark):
    df = spark.createDataFrame([(9.665,), (0.125,), (-2.5,), (None,)], "v double")
    assert [r[0] for r in df.select(C.rnd("v", 2)).collect()] == [9.66, 0.13, -2.5, None]


def test_labels_padding_and_dates(spark):
    df = spark.createDataFrame([("55", 7, "06/30/1990"), ("99", 12345, "bad"), (None, None, None)],
                               "f string, n int, d string")
    got = df.select(C.state_code("f"), C.pad_code("n", 3), C.year_of("d"), C.state_name("f")).collect()
    assert [tuple(r) for r in got] == [("WI", "007", 1990, "Wisconsin"), ("99", "12345", None, None),
                                       (None, None, None, None)]
    names = spark.createDataFrame([("Census Tract 1; Adams County; Wisconsin",), ("x",)], "n string")
    assert [r[0] for r in names.select(C.county_from_label("n")).collect()] == ["Adams County", None]


def test_match_quality(spark):
    df = spark.createDataFrame([(False, "1", "L"), (True, " ", None), (True, None, None), (True, "1", "L"), (True, "1", None)],
                               "i boolean, r string, l string")
    assert [r[0] for r in df.select(C.match_quality("i", "r", "l")).collect()] == [
        "not_in_fdic", "no_fed_rssd", "no_fed_rssd", "exact_rssd", "no_lei_for_rssd"]


def test_weight_grid_and_flags(spark):
    assert one(spark, C.weight_grid())[0] == [round(i * 0.05, 2) for i in range(11)]
    df = spark.createDataFrame([("True",), ("false",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(C.as_flag("t")).collect()] == [True, False, None, None]


def test_verdicts_in_priority_order(spark):
    rows = [(None, 1, None, None, None), (1, None, None, None, None), (1, 2, -1, 0.0, 0.0), (1, 1, 0, 5.0, 0.2),
            (1, 1, 0, 1.0, 0.05), (1, 1, 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "h int, w int, b int, k double, p double")
    assert [r[0] for r in df.select(C.reconciliation_verdict("h", "w", "b", "k", "p")).collect()] == [
        "MISSING FROM WAREHOUSE", "MISSING FROM REFERENCE", "BRANCH COUNT MISMATCH", "FAIL - outside 0.1%",
        "PASS - within tolerance", "PASS - exact"]
    assert df.select(F.lit(1)).count() == 6

"""The physical plans: what is pushed down, and what must not appear."""

import pytest

from marketgrid import catalogue
from marketgrid.operators import ranking, spatial
from marketgrid.plans import lending, opportunity
from marketgrid.sources import driver_tables
from marketgrid.sources.driver_tables import DriverTables
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "q01_deposits_by_county_year", "q04_rank_branches_in_market", "q10_capture_rate_by_tract",
    "q12_market_opportunity_index", "j18_point_in_polygon", "j24_nearest_branch", "d05_tract_competition",
    "x05_transitions", "g02_apportioned_households",
])
def test_no_nested_loops(spark, name):
    text = plan(catalogue.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Python" not in text         # no Python workers


def test_scans_read_what_they_need(spark):
    text = plan(catalogue.queries()["q14_reconciliation"](spark, SF))
    scans = [line for line in text.splitlines() if "FileScan parquet" in line]
    assert scans and not any("o_orderstatus" in s or "c_mktsegment" in s for s in scans)
    lending = plan(catalogue.queries()["q09_tract_lending_outcomes"](spark, SF))
    line = next(s for s in lending.splitlines() if "FileScan parquet" in s and "l_suppkey" in s)
    assert "l_discount" not in line and "l_comment" not in line


def test_branch_span_is_pruned_when_unused(spark):
    # first and last year need the orders; a query that reads neither must not scan them twice
    text = plan(catalogue.queries()["p08_market_keys"](spark, SF))
    assert "o_totalprice" not in text and "o_orderdate" not in text


def test_ranks_do_not_gather_a_group(spark):
    df = spark.range(1000).select(F.lit("one").alias("g"), F.rand(3).alias("v"))
    text = plan(ranking.positions(df, ["g"], "v"))
    for line in text.splitlines():
        # every window runs over (group, bucket) or over bucket counts, never over the rows of a group
        if "Window [" in line and "n_equal" in line:
            assert "_bucket" in line


def test_top_rows_are_limited_before_the_exchange(spark):
    from marketgrid.plans.opportunity import _top

    df = spark.range(1000).select((F.col("id") % 2).alias("scenario"), F.col("id").alias("r"), F.col("id").alias("tract_geoid"))
    assert "WindowGroupLimit" in plan(_top(df, "scenario", "r", 50))


def test_radius_join_is_an_equi_join(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, "metro")], "cid int, cx0 double, cy0 double, tier string")
    p = spark.createDataFrame([(1, 5.0, 5.0)], "pid int, px double, py double")
    r = spark.createDataFrame([("metro", 1.0)], "tier string, radius_miles double")
    text = plan(spatial.radius_join(c, p, r))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_lending_groups_are_dealt_by_their_number(spark, monkeypatch):
    """The rows a task groups stay bounded: more facts make more tasks, and the result is the same."""
    source = DriverTables(spark, "/root/testdata/sf0.001")
    want = {tuple(r) for r in lending.q09_lending_outcomes(source.warehouse()).collect()}
    monkeypatch.setattr(lending, "TASK_FACTS", 100)
    monkeypatch.setattr(driver_tables, "TASK_LINES", 300)
    rows = source.warehouse().fact_tract_lending
    assert rows.select(F.spark_partition_id()).distinct().count() > 12
    found = lending.q09_lending_outcomes(source.warehouse())
    assert found.select(F.spark_partition_id()).distinct().count() > 12
    assert {tuple(r) for r in found.collect()} == want


def test_a_second_ranking_does_not_repeat_the_first(spark):
    """The ranks that several steps read are stored: each step's plan holds its own windows only."""
    def windows(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Window [")

    rows = spark.createDataFrame([("s", f"t{i:02d}", i % 3 == 0, float(i), float(i * 7 % 20)) for i in range(20)],
                                 "scenario string, tract_geoid string, lmi_flag boolean, base_score double, alt_score double")
    once = windows(ranking.ordinal(rows, ["scenario"], "base_score", "tract_geoid", "r"))
    rho = opportunity.spearman(rows, "base_score", "alt_score", "tract_geoid", ["scenario"])
    assert 0 < windows(rho) <= once
    shape = windows(ranking.quantiles(rows, ["scenario"], "alt_score", {"m": 0.5}))
    compared = opportunity.rank_compare(rows, k=5, far=10)
    assert windows(compared) <= once + shape + 2  # and one window for either list of the first
    assert compared.first().top_retained == len({19, 18, 17, 16, 15} & set(sorted(range(20), key=lambda i: -(i * 7 % 20))[:5]))

"""A warehouse from raw files: written, audited, published; one vintage brought later; joins that refuse copies."""

import pytest
from pyspark.sql import functions as F

from marketgrid.operators import quality, relational
from marketgrid.plans import deposits, growth
from marketgrid.plans.assemble import RawStar
from marketgrid.sources import release, sinks
from marketgrid.sources.raw_files import RawFiles

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def star(spark):
    return RawStar(RawFiles(spark, SF), "00000", "2002-01-01")


@pytest.fixture(scope="module")
def published(spark, star, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("warehouse"))
    wh = star.warehouse()
    return root, wh, release.publish(wh, root, observed=star.observed)


def test_release_holds_what_was_counted(spark, published):
    root, _, made = published
    assert release.current(spark, root) == made
    wh = release.open_release(spark, root)
    for table in ("dim_branch", "fact_branch_deposits", "fact_tract_competition"):
        assert getattr(wh, table).count() == made.rows[table] > 0
    loans = RawFiles(spark, SF).loans()
    assert made.dropped == {"lending.records": loans.count(), "lending.without_tract": loans.filter("census_tract is null").count()}
    assert not any(made.wrong.values()) and wh.dim_branch.filter("not county_agrees").count() > 0


def test_one_vintage_rewrites_one_folder(spark, published):
    root, wh, first = published
    more = wh.with_tables(fact_branch_deposits=wh.fact_branch_deposits.withColumn("deposits", F.col("deposits") + 1))
    second = release.publish(more, root, vintage=1998)
    assert {y for y in second.years if second.years[y] != first.years[y]} == {"1998"} and set(second.years) == set(first.years)
    assert second.rows["fact_branch_deposits"] < first.rows["fact_branch_deposits"]
    old, new = (release.open_release(spark, root, r).fact_branch_deposits for r in (first, second))
    assert old.columns == new.columns and old.count() == new.count()
    assert new.exceptAll(old).select("year").distinct().collect() == [(1998,)]
    assert "PartitionFilters: [isnotnull(year" in new.filter("year = 1998")._jdf.queryExecution().toString()
    assert deposits.q02_market_share(release.open_release(spark, root)).count() > 0

    bad = more.with_tables(ref_index_weights=wh.ref_index_weights.withColumn("weight", F.lit(0.3)))
    with pytest.raises(quality.GateError, match="weights"):
        release.publish(bad, root, vintage=1999)
    assert release.current(spark, root) == second


def test_wrong_identifiers_stop_before_anything_is_derived(spark, published, monkeypatch):
    root, wh, _ = published
    before = release.current(spark, root)
    bad = wh.with_tables(dim_tract=wh.dim_tract.withColumn("county_fips", F.substring("county_fips", 2, 4)))
    monkeypatch.setattr(release, "DERIVED_GATES", ())
    written = []
    monkeypatch.setattr(release, "_write", lambda df, table, folder, made, put=release._write: (written.append(table), put(df, table, folder, made)))
    with pytest.raises(quality.GateError, match="identifier lengths"):
        release.publish(bad, root)
    assert release.current(spark, root) == before and not set(written) & set(release.DERIVED)


def test_a_vintage_needs_a_release(star, tmp_path):
    with pytest.raises(ValueError, match="needs a release"):
        release.publish(star.warehouse(), str(tmp_path), vintage=1998)
    with pytest.raises(FileNotFoundError):
        release.open_release(star.raw.spark, str(tmp_path))


def test_repeated_keys_stop_the_query_itself(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("d", 4)], "k string, x int")
    right = spark.createDataFrame([("a", 10), ("b", 20), (None, 30), (None, 31)], "k string, y int")
    got = relational.join_one(left, right, ["k"], "right side").select("k", "x", "y").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", 1, 10), ("b", 2, 20), (None, 3, None), ("d", 4, None)], key=repr)
    twice = right.unionByName(right.filter("k = 'b'"))
    with pytest.raises(Exception, match="right side: more than one row for b"):
        relational.join_one(left, twice, ["k"], "right side").collect()
    two = relational.at_most_once(spark.createDataFrame([(1, "x"), (1, "y")], "a int, b string"), ["a", "b"], "pairs")
    assert two.columns == ["a", "b"] and two.count() == 2
    sod = spark.createDataFrame([("1", 2000)], "UNINUMBR string, YEAR int")
    branches = spark.createDataFrame([("1", None, "00001")] * 2, "uninumbr string, tract_geoid string, county_fips string")
    with pytest.raises(Exception, match="branches: more than one row for 1"):
        growth.with_county(sod, branches).collect()


def test_the_check_costs_no_exchange_of_its_own(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = spark.range(100).selectExpr("id % 10 as k"), spark.range(10).selectExpr("id as k", "id as y")
        plan = relational.join_one(left, right, ["k"], "r")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= left.join(right, "k", "left")._jdf.queryExecution(
        ).executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_tables_join_without_an_exchange(spark, published):
    """Catalog tables bucketed on the branch id: what is written is read back, and the join needs no exchange."""
    _, wh, made = published
    spark.sql("create database if not exists grid_test")
    try:
        stored = release.open_release(spark, published[0], made)
        sinks.save_bucketed(stored, "grid_test", 4)
        sinks.create_table(stored.dim_tract, "grid_test.dim_tract", "dim_tract")
        from marketgrid.plans.warehouse import Warehouse

        catalog = Warehouse.from_database(spark, "grid_test")
        assert catalog.dim_branch.count() == made.rows["dim_branch"] and catalog.dim_tract.columns == stored.dim_tract.columns
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = catalog.fact_branch_deposits.join(catalog.dim_branch.select("uninumbr", "state"), "uninumbr")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == made.rows["fact_branch_deposits"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop database grid_test cascade")


def test_sites_closer_than_any_centroid_are_published_where_stated(spark, star, tmp_path):
    """As on larger copies of the driver tables: median spacing below a mile, no centroid within it, an empty bridge."""
    from marketgrid import catalogue

    wh = star.warehouse()
    # the subject's sites crowd together off the map, the others stand in the middle of their tiles
    near = wh.dim_branch.withColumns({
        c: F.when(F.col("is_subject_bank"), off + (F.col(c) - low) / 40).otherwise(low + (F.floor((F.col(c) - low) * 4) + 0.5) / 4)
        for c, low, off in (("longitude", -93, -92.99), ("latitude", 36, 47.5))})
    close = wh.with_tables(dim_branch=near)
    with pytest.raises(quality.GateError, match="radii"):
        release.publish(close, str(tmp_path / "strict"))
    with pytest.raises(quality.GateError, match="tables with rows"):
        release.publish(close, str(tmp_path / "bounds"), bounds=catalogue.MAP_OPTIONS["bounds"])
    made = release.publish(close, str(tmp_path / "stated"), **catalogue.MAP_OPTIONS)
    assert made.rows["bridge_branch_catchment"] == 0 < made.rows["fact_tract_competition"] == made.rows["dim_tract"]
    assert release.open_release(spark, str(tmp_path / "stated")).bridge_branch_catchment.count() == 0

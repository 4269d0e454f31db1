import pytest
from pyspark.sql import functions as F

from marketgrid.operators import quality, ranking
from marketgrid.plans import load
from marketgrid.plans.warehouse import Warehouse
from marketgrid.sources.driver_tables import DriverTables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def wh(spark):
    return DriverTables(spark, SF).warehouse()


def test_clean_tables_load(spark, wh, tmp_path):
    counts = {r.table: r.rows for r in load.load(wh, str(tmp_path)).collect()}
    assert counts["dim_branch"] == 1500 and all(counts.values())
    back = Warehouse.from_folder(spark, str(tmp_path))
    assert back.vintages.count() == 7
    newest = back.fact_branch_deposits.filter("year = 1998")
    assert "PartitionFilters: [isnotnull(year" in newest._jdf.queryExecution().toString()
    assert newest.count() == wh.fact_branch_deposits.filter("year = 1998").count()


def one(df, **changes):
    """The first row of a frame with some columns changed."""
    return df.limit(1).withColumns({c: F.lit(v).cast(dict(df.dtypes)[c]) for c, v in changes.items()})


@pytest.mark.parametrize("gate,table,change", [
    ("weights sum to 1", "ref_index_weights", lambda d: d.withColumn("weight", F.col("weight") * 1.1)),
    ("identifier lengths", "dim_tract", lambda d: d.unionByName(one(d, county_fips="123"))),
    ("one row per branch and year", "fact_branch_deposits", lambda d: d.unionByName(one(d))),
    ("one row per branch", "dim_branch", lambda d: d.unionByName(one(d))),
    ("one row per tract", "dim_tract", lambda d: d.unionByName(one(d))),
    ("one row per institution", "dim_institution", lambda d: d.unionByName(one(d))),
    ("flags are boolean", "dim_branch", lambda d: d.withColumn("county_agrees", F.lit("maybe"))),
    ("radii", "tier_radii", lambda d: d.withColumn("radius_miles", F.lit(31.0))),
    ("radii", "tier_radii", lambda d: d.withColumn("sites", F.lit(1))),
    ("one primary branch per tract", "bridge_branch_catchment", lambda d: d.unionByName(one(d.filter("is_primary")))),
    ("references", "fact_branch_deposits", lambda d: d.unionByName(one(d, uninumbr="99999999"))),
    ("tables with rows", "fact_tract_lending", lambda d: d.filter("false")),
])
def test_a_planted_violation_stops_the_load(wh, gate, table, change):
    bad = wh.with_tables(**{table: change(getattr(wh, table))})
    with pytest.raises(quality.GateError, match=gate):
        quality.require_empty(load.gates(bad)[gate](), gate)


def test_load_stops_before_writing(wh, tmp_path):
    bad = wh.with_tables(ref_index_weights=wh.ref_index_weights.withColumn("weight", F.lit(0.3)))
    with pytest.raises(quality.GateError, match="weights"):
        load.load(bad, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_replaced_tables_reach_what_is_derived(wh):
    assert wh.tract_points.count() > 0
    other = wh.with_tables(dim_tract=wh.dim_tract.filter("false"))
    assert other.tract_points.count() == 0 and wh.tract_points.count() > 0


@pytest.mark.parametrize("values", [
    "cast(1000000 + (id % 100000) / 1000 as double)", "cast(7 as double)", "cast(id * id as double)", "cast(-id as double)",
])
def test_rank_buckets_stay_small(spark, values):
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.expr(values).alias("v"))
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n_equal"))
    largest = ranking.with_buckets(counts, ["g"], "v", 1000).groupBy("g", "_bucket", "_part").count().agg(F.max("count")).first()[0]
    assert largest <= 2_000
    got = ranking.positions(df, ["g"], "v", 1000).orderBy("v").collect()
    seen = 0
    for r in got:
        assert r.n_below == seen and r.n_group == 200_000
        seen += r.n_equal


def test_empty_deposits_are_refused(wh):
    from marketgrid.plans import catchment

    with pytest.raises(quality.GateError, match="no deposits"):
        catchment.tie_break_sensitivity(wh.with_tables(fact_branch_deposits=wh.fact_branch_deposits.filter("false")))


def test_overlaps_add_up(wh):
    from marketgrid.plans import catchment

    bridge = wh.bridge_branch_catchment
    sizes = catchment.overlap_sizes(bridge).collect()
    assert sum(r.branches * r.tracts for r in sizes) == bridge.count()
    assert sum(r.primary_tracts for r in catchment.reach_sizes(bridge).collect()) == sum(r.tracts for r in sizes)

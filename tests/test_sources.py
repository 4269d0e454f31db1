import gzip
import json

import pytest
from pyspark.sql import functions as F

from marketgrid.operators import quality
from marketgrid.plans import exports
from marketgrid.plans.warehouse import INDEX_WEIGHTS, WEIGHT_SCHEMA, Warehouse
from marketgrid.sources import readers, sinks
from marketgrid.sources.driver_tables import DriverTables

SF = "/root/testdata/sf0.001"


def test_vintages_take_year_and_state_from_the_name(spark, tmp_path):
    (tmp_path / "sod_2019_wi.csv").write_text("CERT,N\n00012,3\n")
    (tmp_path / "sod_2020_il.csv").write_text("CERT,N\n00012,4\n")
    got = readers.load_vintages(spark, str(tmp_path), "CERT string, N long").orderBy("_year").collect()
    assert [tuple(r) for r in got] == [("00012", 3, 2019, "WI"), ("00012", 4, 2020, "IL")]


def test_pruned_gzip_text_read(spark, tmp_path):
    with gzip.open(tmp_path / "l.csv.gz", "wt") as fh:
        fh.write("extra,census_tract,lei\nx,01125010405,A\n")
    path = str(tmp_path / "l.csv.gz")
    assert tuple(readers.text_columns(spark, path, ["lei", "census_tract"]).first()) == ("A", "01125010405")
    with pytest.raises(ValueError, match="gone"):
        readers.text_columns(spark, path, ["gone"])


def test_matrix_json_follows_each_header(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([["NAME", "state", "B1"], ["x", "55", "-666666666"]]))
    (tmp_path / "b.json").write_text(json.dumps([["B1", "NAME"], ["7", "y"]]))
    df = readers.read_matrix_json(spark, str(tmp_path), ["NAME", "state", "B1"])
    assert sorted(tuple(str(v) for v in r) for r in df.collect()) == [("x", "55", "-666666666"), ("y", "None", "7")]
    clean = readers.clean_negatives(df, {"B1": "households"})
    assert sorted(str(r.households) for r in clean.collect()) == ["7.0", "None"]
    seen = readers.sentinel_profile(df, ["B1"]).collect()
    assert [tuple(r) for r in seen] == [("B1", -666666666, 1)]


def test_lookup_files(spark, tmp_path):
    (tmp_path / "rel.txt").write_text("﻿GEOID_TRACT_20|GEOID_TRACT_10|AREALAND_PART\n01|02|5\n", encoding="utf-8")
    rel = readers.relationship_file(spark, str(tmp_path / "rel.txt"), ["GEOID_TRACT_20", "AREALAND_PART"])
    assert tuple(rel.first()) == ("01", "5")
    (tmp_path / "f.json").write_text(json.dumps({"institutions": [{"lei": "A", "name": "n"}, {"lei": "B", "name": "m"}]}, indent=1))
    assert readers.filers(spark, str(tmp_path / "f.json")).count() == 2
    (tmp_path / "i.json").write_text(json.dumps({"leis": ["A"], "index": {"0012": "A"}, "missing": 1}, indent=1))
    assert tuple(readers.lei_index(spark, str(tmp_path / "i.json")).first()) == ("0012", "A")
    (tmp_path / "k.json").write_text(json.dumps({"accepted": [{"cert": "24998", "year": 2025, "note": "n"}]}, indent=1))
    assert tuple(readers.acknowledged(spark, str(tmp_path / "k.json")).first()) == ("24998", 2025)
    (tmp_path / "d.csv").write_text(
        "List 1,,,,\n,,,,\nCBSA Code,CBSA Title,Metropolitan/Micropolitan Statistical Area,FIPS State Code,FIPS County Code\n"
        "16980,Chicago,Metropolitan Statistical Area,17,31\n16980,Chicago,Metropolitan Statistical Area,17,31\n"
        "11111,Town,Micropolitan Statistical Area,55,1\nNote: text,,,,\n")
    got = {r.county_fips: (r.cbsa, r.tier) for r in readers.delineation(spark, str(tmp_path / "d.csv")).collect()}
    assert got == {"17031": ("16980", "metro"), "55001": ("11111", "micro")}
    (tmp_path / "c.csv").write_text("rule,tract_geoid,newly_covered\ncurrent,01125010405,false\n")
    readers.coverage_sets(spark, str(tmp_path / "c.csv"), view="covered")
    assert tuple(spark.sql("select * from covered").first()) == ("current", "01125010405", False)


def test_weights_and_page_union(spark):
    config = {"normalization": "z_score", "weights": {"a": 0.6, "b": 0.4}, "inverted": ["b"], "scenarios": {"s": {"a": 0.5, "b": 0.6}}}
    rows = readers.index_weights(spark, config)
    assert rows.count() == 4
    assert [r.scenario for r in quality.weight_sums(rows).collect()] == ["s"]
    published = spark.createDataFrame(INDEX_WEIGHTS, WEIGHT_SCHEMA)
    assert published.count() == 20 and quality.weight_sums(published).count() == 0
    pages = [spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([(2, True)], "x int, z boolean")]
    assert sorted(readers.union_pages(pages).columns) == ["x", "y", "z"]


def test_manifest_keeps_unchanged_entries(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    first = readers.file_manifest(spark, str(tmp_path))
    prior = spark.createDataFrame(
        [(r.file, r.bytes, r.sha256, "2020-01-01") for r in first.collect()], "file string, bytes long, sha256 string, t string"
    ).select("file", "bytes", "sha256", F.col("t").cast("timestamp").alias("retrieved_utc"))
    (tmp_path / "b.txt").write_text("changed")
    got = {r.file: r for r in readers.file_manifest(spark, str(tmp_path), prior).collect()}
    assert got["a.txt"].retrieved_utc.year == 2020
    assert got["b.txt"].retrieved_utc.year > 2020 and got["b.txt"].bytes == 7


def test_warehouse_round_trip_and_export(spark, tmp_path):
    wh = DriverTables(spark, SF).warehouse()
    tables = ("dim_year", "dim_institution", "dim_branch", "dim_tract", "fact_branch_deposits", "ref_index_weights")
    sinks.build_warehouse(wh, str(tmp_path / "wh"), tables)
    back = Warehouse.from_folder(spark, str(tmp_path / "wh"))
    counts = {r.table: r.rows for r in sinks.stored_counts(spark, str(tmp_path / "wh"), tables).collect()}
    assert counts["dim_branch"] == back.dim_branch.count() == 150
    assert back.vintages.count() == 7
    assert quality.require_rows(back.dim_tract, "tracts") is back.dim_tract
    models = exports.tables(wh)
    assert len(models) == 17
    small = {n: models[n] for n in ("dim_year", "dim_institution", "fact_branch_deposits")}
    manifest = sinks.export(small, str(tmp_path / "out")).collect()
    assert [r.table for r in manifest] == sorted(small)
    assert {r.table: r.rows for r in manifest}["dim_institution"] == 35
    assert all(r.kb > 0 for r in manifest)


def test_gates_stop_a_run(spark):
    df = spark.createDataFrame([("WI",), ("MN",), (None,)], "s string")
    bad = quality.outside_scope(df, "s", ["WI", "IL"])
    assert bad.count() == 2
    with pytest.raises(quality.GateError, match="scope"):
        quality.require_empty(bad, "scope")
    quality.require_empty(quality.unmapped_codes(df, "s", ["WI", "MN"]), "codes")
    with pytest.raises(ValueError, match="lmi_flag"):
        sinks.report_schema(df.withColumn("lmi_flag", F.lit("true")), "dim_tract")
    flags = spark.createDataFrame([("true",), ("maybe",), (None,)], "f string")
    assert [tuple(r) for r in quality.not_boolean(flags, ["f"]).select("column", "value", "rows").collect()] == [("f", "maybe", 1)]

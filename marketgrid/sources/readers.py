"""File readers: yearly CSVs, text matrices, relationship files, lookups, manifests."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.plans.warehouse import WEIGHT_SCHEMA
from marketgrid.schemas import SCHEMAS


def csv(spark: SparkSession, path, schema: str, sep: str = ",") -> DataFrame:
    """CSV with a header under a declared schema; header and schema must agree."""
    return spark.read.csv(path, header=True, sep=sep, schema=schema, enforceSchema=True, encoding="UTF-8")


def load_vintages(spark: SparkSession, path, schema: str, pattern: str = r"_(\d{4})_([a-z]{2})\.csv") -> DataFrame:
    """Many state-year files as one frame, year and state taken from the file name."""
    rows = csv(spark, path, schema)
    name = F.col("_metadata.file_name")
    return rows.select(
        "*", F.regexp_extract(name, pattern, 1).cast("int").alias("_year"),
        F.upper(F.regexp_extract(name, pattern, 2)).alias("_state"),
    )


def institutions(spark: SparkSession, path) -> DataFrame:
    """Register rows, all text, with assets as a number where readable."""
    return csv(spark, path, SCHEMAS["institutions"]).withColumn("ASSET_K", C.number("ASSET", "bigint"))


def text_columns(spark: SparkSession, path, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Named columns of a headed CSV as text.

    The header is read from the file, so columns are found by name and the
    rest is pruned.  A gzip file is one task; store it as Parquet first.
    """
    rows = spark.read.csv(path, header=True, sep=sep)
    return keep_columns(rows, columns)


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Project to the columns, all rows; fail when one is absent."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns absent from the source: {missing}")
    return df.select(*columns)


def read_matrix_json(spark: SparkSession, path, columns: Sequence[str]) -> DataFrame:
    """JSON array of arrays whose first row is the header.

    `columns` names the wanted columns; their positions come from the header
    of each file, so files may order columns differently.
    """
    rows = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "array<array<string>>").alias("m")
    ).select(F.element_at("m", 1).alias("h"), F.posexplode("m").alias("pos", "r")).filter(F.col("pos") > 0)
    return rows.select(*[
        F.try_element_at("r", F.nullif(F.array_position("h", F.lit(c)), F.lit(0)).cast("int")).alias(c)
        for c in columns
    ])


def relationship_file(spark: SparkSession, path, columns: Sequence[str]) -> DataFrame:
    """Pipe-separated file; a byte-order mark before the first name is ignored."""
    rows = spark.read.csv(path, header=True, sep="|")
    clean = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return keep_columns(clean, columns)


def delineation(spark: SparkSession, path) -> DataFrame:
    """County to metropolitan area, one row per county (CSV export of the sheet).

    The header row is found by content: rows above it are skipped.
    """
    names = [
        "CBSA Code", "CBSA Title", "Metropolitan/Micropolitan Statistical Area", "FIPS State Code", "FIPS County Code",
    ]
    raw = spark.read.csv(path, header=False)
    cells = F.array(*[F.trim(F.col(c)) for c in raw.columns])
    rows = raw.select(cells.alias("r"))
    # one header row: its cells give the position of every name
    header = rows.filter(F.array_contains("r", "CBSA Code")).limit(1).select("r").scalar()
    picked = rows.select(*[
        F.try_element_at("r", F.nullif(F.array_position(header, F.lit(n)), F.lit(0)).cast("int")).alias(n) for n in names
    ])
    state, county = C.number(F.col("FIPS State Code"), "int"), C.number(F.col("FIPS County Code"), "int")
    return picked.filter(state.isNotNull() & county.isNotNull()).select(
        C.county_fips(state, county).alias("county_fips"), F.col("CBSA Code").alias("cbsa"),
        F.col("CBSA Title").alias("cbsa_title"),
        C.tier_from_area_type("`Metropolitan/Micropolitan Statistical Area`").alias("tier"),
    ).groupBy("county_fips").agg(F.min(F.struct("cbsa", "cbsa_title", "tier")).alias("r")).select("county_fips", "r.*")


def polygons(spark: SparkSession, path) -> DataFrame:
    """Vertex table of polygon rings."""
    return spark.read.schema("poly_id string, ring_id int, seq int, lon double, lat double").parquet(path)


def filers(spark: SparkSession, path) -> DataFrame:
    """Lender list out of a JSON object with an array of objects."""
    schema = "institutions array<struct<lei:string,name:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("institutions").alias("i")).select("i.*")


def lei_index(spark: SparkSession, path) -> DataFrame:
    """(rssd, lei) pairs of a cached lookup."""
    schema = "leis array<string>, index map<string,string>, missing int"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("index").alias("rssd", "lei"))


def acknowledged(spark: SparkSession, path) -> DataFrame:
    """(cert, year) pairs of reviewed footprint movements."""
    schema = "accepted array<struct<cert:string,year:int>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("accepted").alias("a")).select("a.*")


def index_weights(spark: SparkSession, config: Mapping) -> DataFrame:
    """A parsed weight configuration as rows (scenario x component)."""
    inverted = set(config.get("inverted", ()))
    sets = {"primary": config["weights"], **(config.get("scenarios") or {})}
    rows = [
        (name, component, float(weight), component in inverted, config["normalization"])
        for name, weights in sets.items() for component, weight in weights.items()
    ]
    return spark.createDataFrame(rows, WEIGHT_SCHEMA)


def state_totals(spark: SparkSession, path) -> DataFrame:
    return csv(spark, path, "year int, state string, branches long, deposits_thousands double")


def coverage_sets(spark: SparkSession, path, view: str | None = None) -> DataFrame:
    """Coverage file under declared columns, optionally as a view for SQL."""
    rows = csv(spark, path, SCHEMAS["coverage"])
    if view:
        rows.createOrReplaceTempView(view)
    return rows


def union_pages(pages: Iterable[DataFrame]) -> DataFrame:
    """Pages whose columns differ; absent columns become NULL."""
    from marketgrid.operators.relational import union_all

    return union_all(list(pages), allow_missing=True)


def sentinel_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negative codes seen per numeric column, with their counts."""
    numeric = df.select(*[C.number(c).alias(c) for c in columns])
    return numeric.unpivot([], list(columns), "column", "code").filter(F.col("code") < 0).groupBy(
        "column", F.col("code").cast("long").alias("code")
    ).agg(F.count(F.lit(1)).alias("rows"))


def clean_negatives(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Text columns to numbers under new names; negative or unreadable is NULL."""
    return df.withColumns({new: C.not_negative(C.number(old)) for old, new in mapping.items()})


def file_manifest(spark: SparkSession, path: str, prior: DataFrame | None = None, glob: str = "*") -> DataFrame:
    """One row per file: name, bytes, SHA-256 and when it was first seen.

    An unchanged hash keeps the prior entry.  Files are read by executors;
    each must fit in one task's memory.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(
        path
    ).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("retrieved_utc"),
    )
    if prior is None:
        return found
    old = prior.select("file", F.col("sha256").alias("_sha"), F.col("retrieved_utc").alias("_seen"))
    kept = found.join(old, "file", "full")
    same = F.col("sha256").isNull() | (F.col("sha256") == F.col("_sha"))
    return kept.join(prior.select("file", F.col("bytes").alias("_bytes")), "file", "left").select(
        "file", F.coalesce("bytes", "_bytes").alias("bytes"), F.coalesce("sha256", "_sha").alias("sha256"),
        F.when(same, F.coalesce("_seen", "retrieved_utc")).otherwise(F.col("retrieved_utc")).alias("retrieved_utc"),
    )

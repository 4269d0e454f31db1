"""Writers: staging folders, the stored warehouse, report exports."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrid.plans.warehouse import STORED
from marketgrid.schemas import SCHEMAS, columns

# join keys of the large tables: clustered files let readers skip row groups
CLUSTER_BY = {
    "fact_branch_deposits": ["year", "uninumbr"],
    "dim_branch": ["uninumbr"],
    "fact_tract_lending": ["tract_geoid"],
}


def stage(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write a staging table and go on from the stored copy."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
        return df.sparkSession.read.csv(path, header=True, schema=df.schema)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project and cast to exactly the declared columns of a table."""
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns(table)])


# tables cut into one folder per value: a reader of the newest vintage opens that folder alone
PARTITION_BY = {"fact_branch_deposits": ["year"]}
BUCKETED = ("fact_branch_deposits", "dim_branch")


def build_warehouse(wh, folder: str, tables=STORED) -> None:
    """Rewrite every warehouse table under its declared schema.

    Large tables are range-partitioned and sorted by their join key, so each
    file covers a short span of keys and readers skip most of them; the
    deposit fact also has a folder per year.
    """
    for name in tables:
        out = conform(getattr(wh, name), name)
        if name in CLUSTER_BY:
            out = out.repartitionByRange(*CLUSTER_BY[name]).sortWithinPartitions(*CLUSTER_BY[name])
        out.write.mode("overwrite").partitionBy(*PARTITION_BY.get(name, ())).parquet(f"{folder}/{name}")


def save_bucketed(wh, database: str, buckets: int) -> None:
    """Deposit fact and branch dimension as tables bucketed on the branch id.

    Joins and per-branch windows on the id then need no exchange of either.
    """
    for name in BUCKETED:
        conform(getattr(wh, name), name).write.mode("overwrite").bucketBy(buckets, "uninumbr").sortBy(
            "uninumbr").saveAsTable(f"{database}.{name}")


def create_table(df: DataFrame, name: str, table: str) -> None:
    """Drop and rebuild one managed table from its declared schema."""
    conform(df, table).write.mode("overwrite").saveAsTable(name)


def stored_counts(spark: SparkSession, folder: str, tables=STORED) -> DataFrame:
    """Row counts read back from the stored tables."""
    from marketgrid.operators.relational import union_all

    return union_all([
        spark.read.schema(SCHEMAS[t]).parquet(f"{folder}/{t}").agg(
            F.lit(t).alias("table"), F.count(F.lit(1)).alias("rows")) for t in tables
    ])


def export(tables: Mapping[str, Callable[[], DataFrame]], folder: str, fmt: str = "csv") -> DataFrame:
    """Write every table below `folder` and return the manifest, sorted by name.

    Row counts come from an accumulator-free observation of the write itself,
    sizes from the files, so no table is computed twice.
    """
    from pyspark.sql import Observation

    rows = []
    spark = None
    for name in sorted(tables):
        df = tables[name]()
        spark = df.sparkSession
        seen = Observation(f"export_{name}")
        observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        target = f"{folder}/{name}"
        writer = observed.write.mode("overwrite")
        writer.option("header", True).csv(target) if fmt == "csv" else writer.format(fmt).save(target)
        rows.append((name, int(seen.get["rows"]), len(df.columns), target))
    manifest = spark.createDataFrame(rows, "table string, rows long, columns int, path string")
    sizes = None
    for name, _, _, target in rows:
        one = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{fmt}*").load(target).agg(
            F.lit(name).alias("table"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1024, 1).alias("kb"))
        sizes = one if sizes is None else sizes.unionByName(one)
    return manifest.join(sizes, "table").select("table", "rows", "columns", "kb").orderBy("table")


def report_schema(df: DataFrame, table: str) -> list[tuple[str, str]]:
    """(column, report type); declared booleans must really be booleans."""
    from marketgrid.schemas import BOOLEAN_COLUMNS

    kinds = dict(df.dtypes)
    wrong = [c for c in BOOLEAN_COLUMNS.get(table, ()) if c in kinds and kinds[c] != "boolean"]
    if wrong:
        raise ValueError(f"{table}: {wrong} must be boolean")
    names = {"string": "text", "boolean": "logical", "double": "number", "date": "date"}
    return [(c, names.get(k, "whole number")) for c, k in kinds.items()]

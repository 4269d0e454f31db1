"""Session settings shared by the jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marketgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC pinned."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for stored stages that driver and executors share.

    It is the one in ``spark.checkpoint.dir``. In local mode, where that may be unset, it lies below the warehouse
    folder; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


def new_folder(spark: SparkSession, name: str | None = None) -> str:
    """A path for one stored stage (or for something named), in the folder of this application, which may be removed when the run is over."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name or uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared folder and go on from the stored copy.

    For tables that many later steps read: the lineage is cut by files all executors can reach, so a lost executor
    costs a re-read, not a re-run, and each reader takes only the columns it needs. All stages of a run lie in one
    folder, named after the application, which may be removed when the run is over.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

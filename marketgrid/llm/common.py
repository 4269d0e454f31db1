"""Shared steps: stored stages, Arrow maps, folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrid.session import new_folder

BATCH_BYTES = 8 << 20


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, schema: str, fn: Callable[[list[list]], list[list]]) -> DataFrame:
    """mapInArrow with columns as Python lists; `fn` gets at most BATCH_BYTES of them (or one row) at a time."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = fn([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about BATCH_BYTES."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * BATCH_BYTES / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where a column of `df` is called so already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of parts; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def arrow_filter(df: DataFrame, column: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """Rows of `df` for whose value of `column` `keep` says true; all columns as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    at = df.columns.index(column)
    return df.mapInArrow(run, df.schema)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, per_class: int, content: str = "text",
) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, `content`) of training rows, and the number of training labels of either class.

    Training rows are those outside fold 0 of 5. Of each class the `per_class` ids with the least hash are taken, so
    the sample, and with it the broadcast side of the join, has at most 2 * per_class rows. Null labels or ids are
    left out; an id with several labels takes their rounded mean.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(target).cast("double").alias("y")).dropna().groupBy(
        "doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("label")).filter(fold(F.col("doc_id"), 5) != 0)
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = known.filter("label = 1").orderBy(*order).limit(per_class).unionByName(
        known.filter("label = 0").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content)
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "label", content), sizes


def fit_in_one_task(sample: DataFrame, fit: Callable[[list[int], list[bytes]], bytes]) -> bytes:
    """Train on a bounded sample (doc_id, label, features as bytes) in one task; returns the packed model.

    An id that stands on several rows counts once, and rows come in id order, so the model doesn't depend on the
    partitioning.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, features = [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            features += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([fit(labels, features)], pa.binary())], ["model"])

    rows = sample.groupBy("doc_id").agg(F.min(F.struct("label", "features")).alias("r")).repartition(1)
    rows = rows.sortWithinPartitions("doc_id").select("r.label", "r.features")
    model = rows.mapInArrow(run, "model binary").first()
    return bytes(model["model"]) if model else fit([], [])

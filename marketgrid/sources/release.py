"""Write, audit, publish: a warehouse whose readers never see a run that failed its gates.

A run writes every table into a folder of its own. The gates read those files.
If they hold, a list of folders is stored and one small file that names the
list is replaced by a rename; readers open what that file names. A later run
may bring one vintage: it writes that year's folder of the deposit fact and
the small tables, and its list keeps the other years' folders where they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.operators import quality
from marketgrid.plans import load
from marketgrid.plans.warehouse import STORED, Warehouse, _derived_tables
from marketgrid.schemas import ID_LENGTHS, SCHEMAS
from marketgrid.sources import sinks

POINTER = "current"
#: Tables that are worked out from the others of the same run.
DERIVED = ("bridge_branch_catchment", "fact_tract_competition", "fact_county_deposit_growth")
DERIVED_GATES = ("one primary branch per tract", "references", "scores follow from their parts")
BY_YEAR = "fact_branch_deposits"


@dataclass
class Release:
    """Folders of a published warehouse and what was counted while they were written.

    years: folder of the run that wrote each year of the deposit fact; rows and
    wrong (identifiers of a wrong length) hold what this run wrote.
    """

    run: str
    folders: dict[str, str] = field(default_factory=dict)
    years: dict[str, str] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    wrong: dict[str, int] = field(default_factory=dict)
    dropped: dict[str, int] = field(default_factory=dict)


# -- small files in the store the tables lie in ---------------------------------
def _fs(spark: SparkSession, path: str):
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    return fs, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    _, at, store = _fs(spark, path)
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file, then rename over it: readers see the old text or the new one."""
    fs, at, store = _fs(spark, path)
    beside = fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = store.create(beside)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, at, options)


def _years(spark: SparkSession, folder: str) -> list[str]:
    """Year folders below a table's folder."""
    _, at, store = _fs(spark, folder)
    names = [s.getPath().getName() for s in store.listStatus(at)]
    return sorted(n.removeprefix("year=") for n in names if n.startswith("year="))


# -- reading ---------------------------------------------------------------------
def current(spark: SparkSession, root: str) -> Release | None:
    """The release that readers see."""
    run = read_text(spark, f"{root}/{POINTER}")
    return Release(**json.loads(read_text(spark, f"{root}/releases/{run}.json"))) if run else None


def _deposits(spark: SparkSession, years: dict[str, str]) -> DataFrame:
    """The deposit fact over the folders of several runs, one scan per run; years still prune."""
    by_run: dict[str, list[str]] = {}
    for year, folder in sorted(years.items()):
        by_run.setdefault(folder, []).append(f"{folder}/year={year}")
    out = None
    for folder, paths in by_run.items():
        part = spark.read.schema(SCHEMAS[BY_YEAR]).option("basePath", folder).parquet(*paths)
        out = part if out is None else out.unionByName(part)
    return out


def tables_of(spark: SparkSession, release: Release) -> dict[str, Callable[[], DataFrame]]:
    found: dict[str, Callable[[], DataFrame]] = {
        n: (lambda n=n, p=p: spark.read.schema(SCHEMAS[n]).parquet(p)) for n, p in release.folders.items()}
    if release.years:
        found[BY_YEAR] = lambda: _deposits(spark, release.years)
    return found


def open_release(spark: SparkSession, root: str, release: Release | None = None) -> Warehouse:
    """The published warehouse."""
    release = release or current(spark, root)
    if release is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return Warehouse(tables_of(spark, release), {
        "vintages": lambda w: w.dim_year.select("year"), **_derived_tables(stored=True)})


# -- writing ----------------------------------------------------------------------
def _write(df: DataFrame, table: str, folder: str, release: Release) -> None:
    """Store one table in its declared form; rows and identifiers of a wrong length are counted by the write itself."""
    out = sinks.conform(df, table)
    if table in sinks.CLUSTER_BY:
        out = out.repartitionByRange(*sinks.CLUSTER_BY[table]).sortWithinPartitions(*sinks.CLUSTER_BY[table])
    lengths = {c: n for (t, c), n in ID_LENGTHS.items() if t == table}
    seen = Observation(f"{table}-{release.run}")
    out = out.observe(seen, F.count(F.lit(1)).alias("rows"), *[
        C.count_where(F.col(c).isNotNull() & (F.length(c) != n)).alias(c) for c, n in lengths.items()])
    out.write.partitionBy(*sinks.PARTITION_BY.get(table, ())).parquet(folder)
    release.rows[table] = int(seen.get["rows"])
    release.wrong.update({f"{table}.{c}": int(seen.get[c]) for c in lengths})


def _audit(
    wh: Warehouse, release: Release, options: dict, derived: bool, may_be_empty: tuple[str, ...] = (),
) -> None:
    """Gates over the run's files, those of the derived tables or those before; what the writes counted stays counted."""
    bad = {k: v for k, v in release.wrong.items() if v and not k.startswith("bridge")}
    if bad:
        raise quality.GateError(f"identifier lengths: {bad}")
    empty = [t for t, n in release.rows.items() if not n and t not in may_be_empty]
    if empty:
        raise quality.GateError(f"tables with rows: {empty} have none")
    for name, violations in load.gates(wh, **options).items():
        if name not in ("identifier lengths", "tables with rows") and (name in DERIVED_GATES) == derived:
            quality.require_empty(violations(), name)


def publish(
    wh: Warehouse, root: str, vintage: int | None = None, observed: dict | None = None,
    may_be_empty: tuple[str, ...] = (), **options,
) -> Release:
    """Write a run, audit its files, and make it the current release; returns it.

    wh: a warehouse over inputs (`Warehouse.from_tables`); with a `vintage`,
    only that year of the deposit fact is written, the other years stay those
    of the current release. observed: observations that were filled while the
    inputs were read (dropped records). may_be_empty: tables that are
    published without rows too. Options go to the gates. A violation raises `GateError` and
    leaves the current release as it is; the folder of the run stays for a look.
    """
    spark = wh.dim_year.sparkSession
    before = current(spark, root)
    if vintage is not None and before is None:
        raise ValueError("a single vintage needs a release to add it to")
    release = Release(uuid.uuid4().hex)
    home = f"{root}/runs/{release.run}"
    for name in (n for n in STORED if n not in DERIVED):
        rows, folder = getattr(wh, name), f"{home}/{name}"
        if name != BY_YEAR:
            release.folders[name] = folder
        elif vintage is not None:
            rows = rows.filter(F.col("year") == vintage)
        _write(rows, name, folder, release)
    kept = before.years if vintage is not None else {}
    release.years = {**kept, **{y: f"{home}/{BY_YEAR}" for y in _years(spark, f"{home}/{BY_YEAR}")}}
    # the derived tables are worked out from the files just written, not from the inputs again
    base = Warehouse({**tables_of(spark, release), "sod": lambda: wh.sod, "vintages": lambda: wh.vintages},
                     _derived_tables(stored=False))
    _audit(base, release, options, derived=False, may_be_empty=may_be_empty)
    for name in DERIVED:
        release.folders[name] = f"{home}/{name}"
        _write(getattr(base, name), name, release.folders[name], release)
    for name, seen in (observed or {}).items():
        release.dropped.update({f"{name}.{k}": int(v) for k, v in seen.get.items()})
    _audit(open_release(spark, root, release), release, options, derived=True, may_be_empty=may_be_empty)
    replace_text(spark, f"{root}/releases/{release.run}.json", json.dumps(asdict(release), sort_keys=True))
    replace_text(spark, f"{root}/{POINTER}", release.run)
    return release


def dropped(spark: SparkSession, release: Release, name: str) -> DataFrame:
    """What one observation of the inputs counted, one row."""
    found = {k.removeprefix(f"{name}."): v for k, v in release.dropped.items() if k.startswith(f"{name}.")}
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


def counts(spark: SparkSession, release: Release) -> DataFrame:
    """(table, rows) of a release, as counted by its writes."""
    return spark.createDataFrame(sorted(release.rows.items()), "table string, rows long")

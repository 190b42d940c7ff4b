"""Folders and tables that every executor can reach."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, or that the session set as its checkpoint directory.

    Where neither is set, a local session (single machine, tests) gets one temporary folder for each application. On a cluster that is
    an error: executors would write to their own disks and read back less than was written.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="depframe-")
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, used by nothing else."""
    return f"{shared_folder(spark)}/depframe/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back.

    This cuts lineage: a lost executor costs only the tasks that were running, never the plan behind the table. Spark deletes the
    shuffle files of the write when it ends. ``discard`` deletes the table once nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffle_files_cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = [path]
    return out


@contextmanager
def shuffle_files_cleaned(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` wrote; nothing may read them afterwards. Other DataFrames are left alone."""
    for t in tables:
        for path in getattr(t, "_scratch", ()):
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How much larger rows of program tables are in memory than in Parquet files: numbers in order and a few texts over and over. Measured: 50 to 70.
PACKED = 50


def prepare(spark: SparkSession, packed: float = PACKED) -> None:
    """Settings that the library's plans need, for this session, and the package on its workers. Every registered query calls it; so should users of the operators.

    A union whose inputs are dealt alike is not taken to be dealt so itself: with Spark 4.1.2 a window after such a union lost rows. Tables count as ``packed`` times
    their files where Spark chooses joins: by its files alone a table of 10 MB is broadcast, and the driver holds half a GB of rows. Adaptive execution still broadcasts what turns out to be small.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(float(packed)))
    ship_package(spark)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to Python workers that would not find it by their path: once for each application."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    reachable = {Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)} | {Path.cwd()}
    if app in _shipped or root in reachable:
        return
    target = Path(tempfile.mkdtemp(prefix="depframe-package-")) / "depframe_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (root / "depframe").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)

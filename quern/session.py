"""Session helpers: a local session for tests, and durable hand-over tables.

Some results feed two or more later steps (a selection and its report, row numbers and the
rows themselves).  They are written once as parquet under the shared folder named by
``spark.checkpoint.dir`` and read back.  That cuts lineage, survives the loss of executors and
lets the readers prune columns.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, app: str = "quern", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.minPartitionNum", str(cores))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


SPREAD = "quern.spread"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over as many partitions as the session's setting ``quern.spread`` says, if it is set.

    For tables in a few files or row groups that CPU-heavy stages read: a scan has at most one task
    per row group.  It costs a shuffle of the columns in use.  Nothing derives the number from the
    data; tables in many files don't need it.
    """
    partitions = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(partitions)) if partitions else df


def shared_folder(spark: SparkSession) -> str:
    """Folder for hand-over tables: the cluster's own setting, or a fresh one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fresh = tempfile.mkdtemp(prefix="quern-")
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh


_OPEN: ContextVar[list[str] | None] = ContextVar("_OPEN", default=None)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def delete_table(spark: SparkSession, path: str) -> None:
    system, folder = _folder(spark, path)
    system.delete(folder, True)


def make_folder(spark: SparkSession, path: str) -> None:
    system, folder = _folder(spark, path)
    system.mkdirs(folder)


@contextmanager
def handovers(spark: SparkSession) -> Iterator[None]:
    """Hand-over tables made inside are deleted at the end.  For code that has read them by then."""
    made: list[str] = []
    token = _OPEN.set(made)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in made:
            delete_table(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries inside go when the query ends, not when the driver next collects its
    garbage.  For long series of queries that each leave a table."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def job(run: Callable) -> Callable:
    """A job from paths to paths, without leftovers in the shared folder."""
    @wraps(run)
    def inside(spark: SparkSession, *args, **kwargs):
        with handovers(spark):
            return run(spark, *args, **kwargs)
    return inside


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/quern/{label}-{uuid4().hex}"
    if (made := _OPEN.get()) is not None:
        made.append(path)
    return path


def spool(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the written table."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


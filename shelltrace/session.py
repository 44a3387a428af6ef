"""Session settings the operators rely on, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    # HH:MM:SS labels and duration caps are defined in UTC.
    "spark.sql.session.timeZone": "UTC",
    # A repeated key in a JSON log line is legal; the last value wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Rows of a task whose work on each of them is long.
ROWS_PER_TASK = 50_000
# A task that writes a folder per key makes some so many folders.
FOLDERS_PER_TASK = 250

# Tasks for each core that list folders.
LISTING_TASKS_PER_CORE = 4
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

# A side is broadcast only when it is proven to hold at most this many rows.
BROADCAST_ROWS = 100_000


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators need; safe to repeat."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and intermediate tables.

    A temporary folder stands in only for a local master, where the driver's
    disk is the executors' disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="shelltrace-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so later stages survive lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/shelltrace/{name}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a columnar table in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_tasks(keyed: DataFrame, column: str) -> int:
    """Tasks to write a folder for each value of ``column``."""
    spark = keyed.sparkSession
    least = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )
    folders = keyed.agg(F.approx_count_distinct(column)).first()[0]
    return max(least, -(-folders // FOLDERS_PER_TASK))


def by_folder(df: DataFrame, column: str, tasks: int) -> DataFrame:
    """``df`` with a folder's rows in one task, in exactly ``tasks`` tasks.

    Without a number Spark merges partitions by their bytes, and the time to
    make files is that of their number: many small folders are one task's.
    """
    return df.repartition(tasks, column)


@contextmanager
def listing_by_cores(spark: SparkSession) -> Iterator[None]:
    """List the folders of files opened within in a few tasks for each core.

    Spark takes a task for each folder, up to 10,000, and a task costs more to
    start than a folder to list. A number that is set stays.
    """
    if spark.conf.get(_LISTING, None) is not None:
        yield
        return
    tasks = LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    spark.conf.set(_LISTING, str(tasks))
    try:
        yield
    finally:
        spark.conf.unset(_LISTING)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for input that Spark cannot split far enough.

    A file of one row group, or a compressed log, is one task however many
    cores wait. Input with enough splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def spread_rows(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Tasks of about ``rows_per_task`` rows, for work that costs much a row.

    A columnar file splits at its row groups only, which may be few and long,
    whatever number of splits is planned. Rows are counted from its footers.
    """
    tasks = -(-df.count() // rows_per_task)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism))


def broadcast_if_bounded(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``dim`` for broadcast only when it has at most ``max_rows`` rows."""
    if dim.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(dim)
    return dim

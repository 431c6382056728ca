"""Session helpers: where intermediate tables and checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see, as the cluster names it.

    A private temporary folder is used only where the setting is absent and the master is
    local (unit tests); on a cluster a missing setting is an error.
    """
    configured = spark.conf.get(SHARED_DIR_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SHARED_DIR_KEY} to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="tabloom-")
    spark.conf.set(SHARED_DIR_KEY, fallback)
    return fallback


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/tabloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and return a scan of it.

    The scan is columnar, so later passes read only the columns they use, and it survives the
    loss of executors without recomputing the plan above it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """The file system of a URI and the path in it; runs in tasks, where no JVM is at hand."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that are no longer needed."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            remove(table.sparkSession, folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int, rows_per_task: int = 50_000) -> DataFrame:
    """Fewer partitions for few rows, so that iterating learners do not pay for empty tasks.

    A no-op on large tables: partitions are only ever merged, and not below one per core once
    there is a task's worth of rows.
    """
    wanted = -(-rows // rows_per_task)
    return df.coalesce(max(1, wanted if wanted == 1 else max(wanted, df.sparkSession.sparkContext.defaultParallelism)))


def least_tasks(spark: SparkSession, rows: int, rows_per_task: int = 50_000) -> int:
    """One task for few rows, otherwise one per core at least; more than four per core are no use."""
    cores, wanted = spark.sparkContext.defaultParallelism, -(-rows // rows_per_task)
    return 1 if wanted <= 1 else max(cores, min(wanted, 4 * cores))


def spread(df: DataFrame, rows: int, rows_per_task: int = 50_000) -> DataFrame:
    """As `sized`, but rows that too few partitions hold are dealt out again: a file of one row group is one partition.

    For scans and tables in memory, whose partitions are known before they run.
    """
    least = least_tasks(df.sparkSession, rows, rows_per_task)
    return df.repartition(least) if df.rdd.getNumPartitions() < least else sized(df, rows, rows_per_task)

"""Where intermediate and output tables go."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as the cluster names it.

    A cluster must set ``spark.checkpoint.dir`` to storage all its nodes see;
    only a single-machine session without the setting gets a folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all nodes share")
        folder = tempfile.mkdtemp(prefix="newsweave-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, for tables one query writes and reads back."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write a table that several steps read, and read it back.

    Later steps prune its columns, and a lost executor costs a re-read of files
    on shared storage instead of the work that made them. The shuffles that led to
    it have done their work: Spark drops their files once its driver finds that
    nothing refers to them, which can take hours unless it is told to look.
    """
    spark = frame.sparkSession
    path = work_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    return spark.read.parquet(path)


def forget(table: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    spark = table.sparkSession
    remove_folders(spark, sorted({file.rpartition("/")[0] for file in table.inputFiles()}))


@contextmanager
def rows_at_once(spark: SparkSession, n: int):
    """So many rows travel to Python at once while tables are written inside: rows that hold lists may be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def folder_exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders directly below a path, on whatever store it is; no file is opened."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in files.listStatus(root) if s.isDirectory()]


def remove_folders(spark: SparkSession, folders: list[str]) -> None:
    """Remove folders that this library wrote."""
    for folder in folders:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_report(report: DataFrame, path: str, by: str | None = None) -> None:
    """A report as JSON lines, in one folder per topic or source when ``by`` names it.

    Members stay one line each: a topic with very many of them is many lines, not
    one huge nested row.
    """
    writer = report.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)

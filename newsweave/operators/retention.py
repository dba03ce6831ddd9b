"""Tables laid out by day, and the sweep that keeps them short.

Days that are over are dropped as folders, the day that the limit falls into is written anew, and no
other file is read or touched: a sweep costs one day, however long the table is.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsweave.sinks import child_folders, materialize, remove_folders

DAY = "day"


def write_by_day(rows: DataFrame, at: str, path: str, mode: str = "overwrite") -> None:
    """Store a table with one folder per UTC day of ``at``; rows without a time have a folder of their own.

    Rows are dealt by day first, so a day is few files; adaptive execution splits a busy day.
    """
    dated = rows.withColumn(DAY, F.to_date(at))
    dated.hint("rebalance", F.col(DAY)).write.mode(mode).partitionBy(DAY).parquet(path)


def read_by_day(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table with its ``day``; a filter on it prunes folders.

    ``schema`` (without the day) is needed where a sweep may have left no file.
    """
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, {DAY} DATE")
    return reader.option("basePath", path).parquet(path)


def day_folders(spark: SparkSession, path: str) -> dict[date | None, str]:
    """Folders of a table by their day, from a listing of its root; no file is opened."""
    found: dict[date | None, str] = {}
    for folder in child_folders(spark, path):
        name = folder.rpartition("/")[2]
        if name.startswith(f"{DAY}="):
            value = name[len(DAY) + 1 :]
            found[None if value.startswith("__HIVE") else date.fromisoformat(value)] = folder
    return found


def sweep(spark: SparkSession, path: str, at: str, now: datetime, days: int) -> dict[str, list[date]]:
    """Delete rows older than ``days`` before ``now`` (UTC) and say which days were dropped and which rewritten.

    Folders of days that are over are removed. Of the day that holds the limit the younger rows are stored
    elsewhere first and then take the folder's place by a dynamic partition overwrite; a sweep that is
    run again finds nothing left to do. Rows without a time stay.
    """
    limit = now.replace(tzinfo=timezone.utc) - timedelta(days=days)
    folders = day_folders(spark, path)
    over = sorted(d for d in folders if d is not None and d < limit.date())
    remove_folders(spark, [folders[d] for d in over])
    rewritten: list[date] = []
    boundary = limit.date()
    if boundary in folders:
        edge = F.lit(limit.isoformat()).cast("timestamp")
        rows = read_by_day(spark, path).filter(F.col(DAY) == F.lit(boundary))
        if not rows.filter(F.col(at) < edge).isEmpty():
            kept = materialize(rows.filter(F.col(at) >= edge), "boundary-day")
            rewritten.append(boundary)
            if kept.isEmpty():
                remove_folders(spark, [folders[boundary]])
            else:
                kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    return {"dropped": over, "rewritten": rewritten}


def day_files(spark: SparkSession, path: str, at: str) -> DataFrame:
    """(day, file, n): rows of every file, for reports that compare a table before and after a sweep."""
    rows = read_by_day(spark, path, f"{at} TIMESTAMP").select(DAY, F.col("_metadata.file_name").alias("file"), F.col(at))
    return rows.groupBy(DAY, "file").agg(F.count("*").alias("n"))


def sweep_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(day, n_before, n_after, same_files) of two ``day_files`` listings."""
    left = before.select(DAY, "file", F.col("n").alias("n_before"))
    right = after.select(DAY, "file", F.col("n").alias("n_after"))
    both = left.join(right, left[DAY].eqNullSafe(right[DAY]) & (left["file"] == right["file"]), "full")
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    same: Column = F.every(F.col("n_before").isNotNull() & F.col("n_after").isNotNull() & (F.col("n_before") == F.col("n_after")))
    return both.groupBy(F.coalesce(left[DAY], right[DAY]).alias(DAY)).agg(total("n_before"), total("n_after"), same.alias("same_files"))

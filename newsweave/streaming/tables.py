"""Tables that streaming jobs write batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from newsweave.sinks import child_folders, folder_exists, materialize, remove_folders, work_path


class BatchTable:
    """A Parquet table with one folder per micro-batch.

    A batch that is run again after a failure overwrites its own folder and
    reads only the folders of earlier batches, so each batch counts once.
    """

    def __init__(self, spark: SparkSession, schema: str, path: str | None = None, name: str = "stream"):
        self.spark = spark
        self.schema = schema
        self.path = path or work_path(spark, name)
        # The first folder is empty and gives the table its schema; a table that is there already goes on.
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/batch=-1")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those of the batches before the given one."""
        rows = self.spark.read.schema(f"{self.schema}, batch BIGINT").parquet(self.path)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def latest(self, keys: list[str], before: int | None = None) -> DataFrame:
        """The row of the last batch for every key."""
        rows = self.read(before)
        rest = [c for c in rows.columns if c not in keys]
        return (
            rows.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), "batch").alias("row"))
            .select(*keys, "row.*")
            .drop("batch")
        )


class DayTable:
    """The newest row of every key, laid out by day.

    ``day`` is SQL over the key columns that gives a whole number. A batch reads and writes only the days
    its rows belong to, each as a new version beside the one before, which a repeated batch starts from
    again; older versions go. What a batch costs hangs on those days and not on the stream's age.
    """

    def __init__(self, spark: SparkSession, schema: str, keys: list[str], day: str, path: str | None = None, name: str = "days"):
        self.spark, self.schema, self.keys = spark, schema, keys
        self.day = F.coalesce(F.expr(day).cast("bigint"), F.lit(-1))
        self.path = path or work_path(spark, name)
        self.columns = spark.createDataFrame([], schema).columns

    def versions(self) -> dict[int, dict[int, str]]:
        """Folders by day and batch."""
        if not folder_exists(self.spark, self.path):
            return {}
        days = {int(f.rpartition("day=")[2]): f for f in child_folders(self.spark, self.path) if "/day=" in f}
        return {d: {int(v.rpartition("batch=")[2]): v for v in child_folders(self.spark, f)} for d, f in days.items()}

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows = materialize(rows.select(*self.columns).withColumn("day", self.day), "day-rows")
        touched = {r["day"] for r in rows.select("day").distinct().collect()}
        if not touched:
            return
        held = {d: {b: f for b, f in found.items() if b < batch_id} for d, found in self.versions().items() if d in touched}
        before = self._rows([found[max(found)] for found in held.values() if found])
        kept = before.join(rows, [before[k].eqNullSafe(rows[k]) for k in self.keys], "left_anti").withColumn("day", self.day)
        (
            kept.unionByName(rows).withColumn("batch", F.lit(batch_id)).write.partitionBy("day", "batch")
            .mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        )
        remove_folders(self.spark, [f for found in held.values() for b, f in found.items() if b < max(found)])

    def read(self) -> DataFrame:
        return self._rows([found[max(found)] for found in self.versions().values() if found])


def read_table_stream(spark: SparkSession, folder: str, name: str, **options) -> DataFrame:
    """Stream over the files of one table, stored as one file or as a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # Written as a pattern: a stream takes a plain path for a folder.
    return spark.readStream.schema(schema).options(**options).parquet(f"{folder}/{name}.parque[t]")


# Values a percentile sketch keeps: it misses a rank by at most one in so many rows.
SKETCH = 100_000


def exact_cuts(moments: DataFrame, slices: int) -> list[float]:
    """The values of ``moment`` at the ranks ceil(n * i / slices), exactly.

    A sketch gives two values around each rank; the next round sketches only what lies between them. A
    round leaves a few rows in 100 000, so two or three are enough, and only counts and cuts are collected.
    """
    n = moments.count()
    if n == 0:
        return []
    cuts = []
    for i in range(1, slices):
        part, size, rank = moments, n, -(-n * i // slices)
        while len(cuts) < i:
            share = (rank - 0.5) / size
            near = [max(0.0, share - 2 / SKETCH), share, min(1.0, share + 2 / SKETCH)]
            values = part.agg(F.percentile_approx("moment", near, SKETCH).alias("v")).first()["v"]
            counts = part.agg(
                *[F.count_if(F.col("moment") < v) for v in values], *[F.count_if(F.col("moment") <= v) for v in values]
            ).first()
            places = list(zip(values, counts[:3], counts[3:]))
            cuts += [v for v, under, upto in places if under < rank <= upto][:1]
            # The others lie wholly before or after the rank.
            before = [(v, upto) for v, under, upto in places if upto < rank]
            after = [(v, under) for v, under, upto in places if under >= rank]
            if after:
                part, size = part.filter(F.col("moment") < after[0][0]), after[0][1]
            if before:
                part, size, rank = part.filter(F.col("moment") > before[-1][0]), size - before[-1][1], rank - before[-1][1]
    return cuts


def slices_of(frame: DataFrame, at: str, slices: int, exact: bool = False) -> list[DataFrame]:
    """A log cut by time into so many parts, oldest first; rows without a time come first.

    Parts are even but for one row in 100 000; where the cut itself shows in a result, ``exact`` puts it at its rank.
    """
    moment = F.col(at).cast("timestamp").cast("double") if dict(frame.dtypes)[at].startswith("timestamp") else F.col(at).cast("double")
    if exact:
        cuts = exact_cuts(frame.select(moment.alias("moment")).filter("moment IS NOT NULL"), slices)
    else:
        shares = [i / slices for i in range(1, slices)]
        cuts = frame.agg(F.percentile_approx(moment, shares, SKETCH).alias("cuts")).first()["cuts"] or []
    bounds = [None, *sorted(set(cuts)), None]
    parts = []
    for low, high in zip(bounds, bounds[1:]):
        after = F.lit(True) if low is None else moment > low
        until = F.lit(True) if high is None else moment <= high
        parts.append(frame.filter((after & until) | (moment.isNull() if low is None else F.lit(False))))
    return parts


class Landing:
    """A folder into which a log's files are put slice after slice, and the stream that reads it so.

    Every slice is the same number of files and every batch of the stream takes that many, so batches
    follow the log's time as they would if it was written while the stream ran.
    """

    def __init__(self, spark: SparkSession, schema, rows: int, slices: int, path: str | None = None):
        self.spark, self.schema = spark, schema
        self.path = path or work_path(spark, "landing")
        # Small slices are one file: each file must have a row, or it isn't written.
        self.files = spark.sparkContext.defaultParallelism if rows >= 100_000 * slices else 1

    def put(self, part: DataFrame) -> None:
        part.repartition(self.files).write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(self.path)


def landed(frame: DataFrame, at: str, slices: int = 4) -> DataFrame:
    """A table as a stream of so many batches in order of ``at``."""
    landing = Landing(frame.sparkSession, frame.schema, frame.count(), slices)
    for part in slices_of(frame, at, slices):
        landing.put(part)
    return landing.stream()


def run_to_end(writer: DataStreamWriter, spark: SparkSession, checkpoint: str | None = None) -> None:
    """Process everything that is there now, then stop.

    ``checkpoint`` is the folder that remembers what was read and the state; a later call with the
    same folder and tables goes on from there. Without one nothing is remembered.

    A stream fixes the number of its state partitions when it first starts, and
    adaptive execution cannot merge them later, so they follow the cores at hand.
    """
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        query = (
            writer.option("checkpointLocation", checkpoint or work_path(spark, "offsets"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)

"""Streaming jobs. Each takes a stream and the tables it keeps, and returns a writer to start.

Read offsets live in the stream's checkpoint; nothing else remembers what was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from newsweave import params as P
from newsweave.functions import text as X, times as T
from newsweave.operators import ingest as I, topics as TP, vectors as VC
from newsweave.sinks import child_folders, materialize, remove_folders, work_path
from newsweave.streaming import keyed as K
from newsweave.streaming.tables import BatchTable, DayTable


def deduplicate(stream: DataFrame, keys: list[str], sink: BatchTable) -> DataStreamWriter:
    """Append each key once.

    Repeats within the retention time are dropped from state; what repeats later
    still meets the key in the stored table.
    """
    days = P.RetentionParams().item_days
    fresh = (
        stream.withWatermark("ts", f"{days} days")
        .dropDuplicatesWithinWatermark(keys)
        .select(*keys)
    )

    def append(batch: DataFrame, batch_id: int) -> None:
        sink.write(I.new_only(batch, sink.read(batch_id), keys), batch_id)

    return fresh.writeStream.foreachBatch(append)


def append_items(stream: DataFrame, sink: BatchTable) -> DataStreamWriter:
    """Append items(doc_id, url_hash, source_id, content_hash) under both unique keys of the item table.

    What clashes with an earlier batch or with an item that goes in before it is skipped.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        sink.write(I.insert_ignore(batch, sink.read(batch_id).drop("batch")), batch_id)

    return stream.writeStream.foreachBatch(append)


def valid_recent_items(stream: DataFrame, now: Column, hours: int) -> DataFrame:
    """Items of the clustering window with a usable time; a missing or future one is replaced."""
    valid = T.reject_future(F.col("published_at"), now)
    start = now - F.expr(f"INTERVAL {hours} HOURS")
    return (
        stream.withWatermark("fetched_at", f"{hours} hours")
        .filter((F.col("fetched_at") >= start) & (F.col("fetched_at") <= now))
        .withColumn("item_at", T.effective_time(valid, F.col("fetched_at")))
    )


def sliding_counts(stream: DataFrame, key: str, sink: BatchTable | DayTable) -> DataStreamWriter:
    """Items per key in sliding six-hour windows; the newest batch of a window holds its count.

    A ``DayTable`` over (key, start_s) holds the newest counts only and rewrites the days a batch touches.
    """
    hours = P.VELOCITY_HOURS
    counted = (
        stream.withWatermark("ts", f"{hours} hours")
        .groupBy(key, F.window("ts", f"{hours} hours", "1 hour").alias("w"))
        .agg(F.count("*").alias("n"))
        .select(key, F.unix_timestamp("w.start").alias("start_s"), "n")
    )
    return counted.writeStream.outputMode("update").foreachBatch(sink.write)


def track_breaker(
    stream: DataFrame, sink: BatchTable, breaker: P.BreakerParams = P.BreakerParams(), lateness: str = "2 hours"
) -> DataStreamWriter:
    """Consecutive failures per source, from state that is kept by source; the newest batch of a source holds them."""
    return K.breaker_runs(stream, breaker, lateness).writeStream.outputMode("update").foreachBatch(sink.write)


def track_changes(
    stream: DataFrame, sink: BatchTable, idle_days: int = 90, lateness: str = "2 hours"
) -> DataStreamWriter:
    """Per address the last version seen and when it last changed, from state that is kept by address."""
    return K.change_states(stream, idle_days, lateness).writeStream.outputMode("update").foreachBatch(sink.write)


def settle_reviews(log: DataFrame, sink: BatchTable, lateness: str = "0 seconds") -> DataStreamWriter:
    """State of each review of a log (``keyed.review_events``); timers expire what nobody decided."""
    return K.review_states(log, lateness=lateness).writeStream.outputMode("update").foreachBatch(sink.write)


def match_responses(requests: DataFrame, responses: DataFrame, hours: int = 24) -> DataFrame:
    """Requests with the response that came within ``hours``.

    Both sides forget rows the watermark has passed; a request without answer
    is given out with nulls once its time is over.
    """
    asked = requests.withWatermark("asked_at", f"{hours} hours")
    answered = responses.withWatermark("answered_at", f"{hours} hours").withColumnRenamed(
        "request_id", "answers"
    )
    in_time = (F.col("answered_at") >= F.col("asked_at")) & (
        F.col("answered_at") <= F.col("asked_at") + F.expr(f"INTERVAL {hours} HOURS")
    )
    return asked.join(
        answered, (F.col("request_id") == F.col("answers")) & in_time, "leftOuter"
    ).drop("answers")


LINKS = "doc_id BIGINT, topic_id BIGINT, similarity DOUBLE, is_new BOOLEAN"


class TopicTables:
    """What incremental topic assignment keeps: links, and the topics in play as sums over their members.

    Links are only written. The sums are one version per batch, of the topics that the window still
    reaches; a batch reads the version before it and the oldest versions go, so neither the work nor the
    state grows with the stream's age.
    """

    SUMS = {
        "terms": "topic_id BIGINT, term STRING, total BIGINT",
        "names": "topic_id BIGINT, name STRING, entity STRING",
        "topics": "topic_id BIGINT, size BIGINT, first_item_at TIMESTAMP, last_item_at TIMESTAMP",
    }

    def __init__(self, spark, links: BatchTable | None = None, path: str | None = None):
        self.spark = spark
        self.links = links or BatchTable(spark, LINKS, name="topic-links")
        self.path = path or work_path(spark, "topic-sums")

    def _folder(self, part: str, batch_id: int) -> str:
        return f"{self.path}/{part}/version={batch_id}"

    def read(self, part: str, before: int) -> DataFrame:
        """The version of the batch before; none before the first."""
        if before == 0:
            return self.spark.createDataFrame([], self.SUMS[part])
        return self.spark.read.schema(self.SUMS[part]).parquet(self._folder(part, before - 1))

    def write(self, part: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(self._folder(part, batch_id))

    def forget(self, batch_id: int) -> None:
        """Drop the version that no repeated batch can ask for any more."""
        if batch_id >= 2:
            remove_folders(self.spark, [self._folder(part, batch_id - 2) for part in self.SUMS])

    def versions(self) -> list[int]:
        return sorted(int(f.rpartition("=")[2]) for f in child_folders(self.spark, f"{self.path}/topics"))


def _topic_sums(links: DataFrame, postings: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """What a batch's members add to the sums of their topics."""
    members = links.select("doc_id", "topic_id")
    named = nodes.select("doc_id", "item_at", "entities").join(members, "doc_id")
    return {
        "terms": postings.join(members, "doc_id").groupBy("topic_id", "term").agg(F.sum("w").alias("total")),
        "names": named.select("topic_id", F.explode("entities").alias("entity"))
        .groupBy("topic_id", F.lower("entity").alias("name")).agg(F.min("entity").alias("entity")),
        "topics": named.groupBy("topic_id").agg(
            F.count("*").alias("size"), F.min("item_at").alias("first_item_at"), F.max("item_at").alias("last_item_at")
        ),
    }


def _added(before: DataFrame, new: DataFrame, part: str) -> DataFrame:
    both = before.unionByName(new)
    if part == "terms":
        return both.groupBy("topic_id", "term").agg(F.sum("total").alias("total"))
    if part == "names":
        return both.groupBy("topic_id", "name").agg(F.min("entity").alias("entity"))
    return both.groupBy("topic_id").agg(
        F.sum("size").alias("size"), F.min("first_item_at").alias("first_item_at"), F.max("last_item_at").alias("last_item_at")
    )


def assign_topics(
    stream: DataFrame, tables: TopicTables, tp: P.TopicParams = P.TopicParams(), closed: DataFrame | None = None
) -> DataStreamWriter:
    """Items(doc_id, title, content, item_at) to topics, batch by batch, each batch as one run of the job.

    A batch's items of the window whose title describes one event are grouped with the topics in play and
    with each other, and what is new is merged as in ``cluster_run``. In play are the topics of earlier
    batches whose last item the window reaches and that ``closed`` (topic_id) doesn't name, read anew by
    each batch. Weights come from the batch. An item that is delivered again within the window is dropped
    by the stream's own state.
    """
    hours = F.expr(f"INTERVAL {tp.window_hours} HOURS")

    def assign(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch.select("doc_id", "title", "content", "item_at"), "batch-items")
        latest = rows.agg(F.max("item_at").alias("now"))
        last = tables.read("topics", batch_id).agg(F.max("last_item_at").alias("now"))
        start = latest.unionByName(last).agg((F.max("now") - hours).alias("start"))
        alive = materialize(
            tables.read("topics", batch_id).join(F.broadcast(start)).filter(F.col("last_item_at") >= F.col("start")).drop("start"),
            "live-topics",
        )
        before = {
            part: tables.read(part, batch_id).join(alive.select("topic_id"), "topic_id", "left_semi") for part in ("terms", "names")
        } | {"topics": alive}
        fresh = materialize(
            rows.join(F.broadcast(start)).filter(F.col("item_at") >= F.col("start")).drop("start")
            .filter((F.length("title") >= tp.min_title_chars) & ~X.is_multi_event(F.col("title"))),
            "fresh-items",
        )
        if fresh.isEmpty():
            added = before
        else:
            postings = materialize(VC.item_postings(fresh), "batch-postings")
            nodes = materialize(TP.item_nodes(fresh, postings), "batch-nodes")
            stored = materialize(_in_play(before, postings.select("term", "df").distinct(), closed), "stored-topics")
            grouped = TP.group_items(nodes, stored, tp)
            links = materialize(TP.merge_groups(grouped, nodes, postings, stored, tp), "batch-topics")
            added = {part: _added(before[part], new, part) for part, new in _topic_sums(links, postings, nodes).items()}
            tables.links.write(links.select("doc_id", "topic_id", "similarity", "is_new"), batch_id)
        for part, sums in added.items():
            tables.write(part, sums.select(*[c.split()[0] for c in tables.SUMS[part].split(", ")]), batch_id)
        tables.forget(batch_id)

    once = stream.withWatermark("item_at", f"{tp.window_hours} hours").dropDuplicatesWithinWatermark(["doc_id"])
    return once.writeStream.foreachBatch(assign)


def _in_play(sums: dict[str, DataFrame], frequencies: DataFrame, closed: DataFrame | None) -> DataFrame:
    """Nodes of the topics that items may join, from their sums."""
    topics = sums["topics"]
    if closed is not None:
        topics = topics.join(closed.select("topic_id"), "topic_id", "left_anti")
    means = (
        sums["terms"].join(topics.select("topic_id", "size"), "topic_id")
        .select("topic_id", "term", F.floor(F.col("total") / F.col("size") + 0.5).cast("bigint").alias("raw"))
        .filter("raw > 0")
    )
    names = sums["names"].groupBy("topic_id").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    return TP.topic_nodes(means, frequencies, names, topics.select("topic_id", "first_item_at"))

"""Streaming jobs over several micro-batches agree with the batch operators."""

import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from newsweave.operators import ingest as I, lifecycle as L
from newsweave.plans.corpus import Corpus
from newsweave.streaming import jobs as J, keyed as K
from newsweave.streaming.tables import BatchTable, run_to_end, slices_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark, SF)


def in_files(frame, folder, n, by, sizes=None):
    """Write a table as n files in order of ``by`` and read it back one file per batch."""
    spark = frame.sparkSession
    ordered = frame.orderBy(by).collect()
    sizes = sizes or [-(-len(ordered) // n)] * n
    for i in range(n):
        part = spark.createDataFrame(ordered[sum(sizes[:i]) : sum(sizes[: i + 1])], frame.schema)
        part.coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):  # the file source takes older files first
            if name.endswith(".parquet") and not name.startswith("b"):
                os.rename(f"{folder}/{name}", f"{folder}/b{i}-{name}")
                os.utime(f"{folder}/b{i}-{name}", (1_700_000_000 + i * 60,) * 2)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def as_set(frame):
    return {tuple(r) for r in frame.collect()}


def test_breaker(spark, corpus, tmp_path):
    sink = BatchTable(spark, K.BREAKER)
    run_to_end(J.track_breaker(in_files(corpus.attempts, tmp_path / "in", 4, "ts"), sink), spark)
    columns = ("source_id", "failures", "disabled_until")
    assert sink.read().select("batch").distinct().count() >= 4
    assert as_set(sink.latest(["source_id"]).select(*columns)) == as_set(I.breaker_state(corpus.attempts).select(*columns))


def attempts(spark, rows):
    frame = spark.createDataFrame(rows, "at INT, source_id BIGINT, event_id BIGINT, ok BOOLEAN, minute INT")
    return frame.withColumn("ts", F.expr("TIMESTAMP '2026-09-01 10:00:00'") + F.make_interval(mins="minute")).drop("minute")


def test_late_attempts_take_their_place_and_timers_enable_again(spark, tmp_path):
    rows = [
        (1, 7, 1, False, 0), (1, 7, 2, False, 10), (1, 7, 3, False, 20),  # off until 16:20
        (1, 8, 4, False, 0), (1, 8, 5, False, 30), (1, 8, 6, True, 40),
        (2, 8, 7, False, 35),  # came late, before the stored success: says nothing
        (2, 9, 8, False, 30), (2, 9, 9, False, 50),
        (3, 9, 10, True, 40),  # a late success between two failures
        (4, 5, 11, True, 60 * 12),  # the clock goes on
        (5, 5, 12, True, 60 * 12 + 1),
    ]
    sink = BatchTable(spark, K.BREAKER)
    stream = in_files(attempts(spark, rows), tmp_path / "in", 5, "at", [6, 3, 1, 1, 1]).drop("at")
    run_to_end(J.track_breaker(stream, sink), spark)
    seen = [(r["batch"], r["source_id"], r["failures"], r["enabled"]) for r in sink.read().orderBy("batch").collect()]
    last = {r["source_id"]: r for r in sink.latest(["source_id"]).collect()}
    assert {k: r["failures"] for k, r in last.items()} == {5: 0, 7: 3, 8: 0, 9: 1}
    assert [e for _, s, _, e in seen if s == 7] == [False, True]  # off, then enabled by the timer
    assert last[7]["disabled_until"] == last[7]["last_failure_at"] + timedelta(hours=6)


def test_changes(spark, corpus, tmp_path):
    sink = BatchTable(spark, K.CHANGES)
    run_to_end(J.track_changes(in_files(corpus.fetches, tmp_path / "in", 3, "ts"), sink), spark)
    columns = ("url", "n_fetches", "n_unchanged", "last_changed_at", "last_etag")
    assert as_set(sink.latest(["url"]).select(*columns)) == as_set(I.fetch_changes(corpus.fetches).select(*columns))


def test_a_late_fetch_counts_where_it_belongs_and_idle_addresses_are_forgotten(spark, tmp_path):
    rows = [(1, "u", 1, 5, 0), (1, "u", 2, 6, 20), (2, "u", 3, 6, 10), (2, "v", 4, None, 11), (3, "v", 5, None, 30), (4, "w", 6, 1, 60 * 24 * 3), (5, "w", 7, 1, 60 * 24 * 3 + 1)]
    frame = spark.createDataFrame(rows, "at INT, url STRING, event_id BIGINT, etag BIGINT, minute INT")
    fetches = frame.withColumn("ts", F.expr("TIMESTAMP '2026-09-01 10:00:00'") + F.make_interval(mins="minute")).drop("minute")
    sink = BatchTable(spark, K.CHANGES)
    run_to_end(J.track_changes(in_files(fetches, tmp_path / "in", 5, "at", [2, 2, 1, 1, 1]).drop("at"), sink, idle_days=2), spark)
    columns = ("url", "n_fetches", "n_unchanged", "last_changed_at", "last_etag")
    latest = sink.latest(["url"])
    assert as_set(latest.select(*columns)) == as_set(I.fetch_changes(fetches.drop("at")).select(*columns))
    assert {r["url"] for r in latest.filter("idle").collect()} == {"u", "v"}


def test_keys_share_entries_of_the_state_store(spark, tmp_path):
    ids = spark.range(6000).select(
        F.when(F.col("id") % 3000 > 0, F.col("id") % 3000).alias("source_id"), F.col("id").alias("event_id"),
        (F.col("id") % 7 == 0).alias("ok"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("ts"),
    )
    sink = BatchTable(spark, K.BREAKER)
    query = J.track_breaker(in_files(ids, tmp_path / "in", 2, "ts"), sink).trigger(availableNow=True)
    query = query.option("checkpointLocation", str(tmp_path / "offsets")).start()
    query.awaitTermination()
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= K.BUCKETS
    columns = ("source_id", "failures", "disabled_until")
    latest = as_set(sink.latest(["source_id"]).select(*columns))
    known = ids.filter("source_id IS NOT NULL")
    assert latest == as_set(I.breaker_state(known).select(*columns)) | {(None, 1, None)} and len(latest) == 3000


def test_large_versions_stay_exact_beside_missing_ones(spark, tmp_path):
    rows = [("u", 1, 9007199254740993, 0), ("u", 2, None, 1), ("u", 3, 9007199254740993, 2)]
    frame = spark.createDataFrame(rows, "url STRING, event_id BIGINT, etag BIGINT, minute INT")
    fetches = frame.withColumn("ts", F.expr("TIMESTAMP '2026-09-01 10:00:00'") + F.make_interval(mins="minute")).drop("minute")
    sink = BatchTable(spark, K.CHANGES)
    run_to_end(J.track_changes(in_files(fetches, tmp_path / "in", 1, "ts"), sink), spark)
    assert [r["last_etag"] for r in sink.latest(["url"]).collect()] == [9007199254740993]


def test_reviews(spark, corpus, tmp_path):
    queue = corpus.reviews.withColumn("article_id", F.col("article_id").cast("string")).cache()
    presses = corpus.decisions.select("event_id", "payload", "chat_id", "ts")
    log = K.review_events(queue, presses, "desk").join(queue.select("article_id"), "article_id", "left_semi")
    log = log.filter(F.col("ts") <= corpus.now).select("article_id", "event_id", "decision", "ts")
    tick = spark.range(1).select(F.lit("").alias("article_id"), F.lit(-1).cast("bigint").alias("event_id"), F.lit("tick").alias("decision"), (corpus.now + F.expr("INTERVAL 1 SECOND")).alias("ts"))
    sink = BatchTable(spark, K.REVIEWS)
    run_to_end(J.settle_reviews(in_files(log.unionByName(tick), tmp_path / "in", 3, "ts"), sink), spark)
    settled = L.settle_reviews(queue, L.parse_decisions(presses, "desk"), corpus.now)
    assert as_set(sink.latest(["article_id"]).select("article_id", "status")) == as_set(settled.select("article_id", "status"))


def test_reviews_expire_by_timer_and_the_first_decision_stays(spark, tmp_path):
    rows = [
        (1, "a", -1, None, 0), (1, "b", -1, None, 0), (1, "c", 1, "approved", 5),  # c is pressed before it is known
        (2, "c", -1, None, 3), (2, "a", 2, "rejected", 60), (2, "a", 3, "approved", 61),
        (3, "a", 4, "approved", 70), (4, "d", -1, None, 300), (5, "d", 5, "approved", 301), (6, "b", 6, "approved", 302), (7, "x", 7, "approved", 900),
    ]
    frame = spark.createDataFrame(rows, "at INT, article_id STRING, event_id BIGINT, decision STRING, minute INT")
    log = frame.withColumn("ts", F.expr("TIMESTAMP '2026-09-01 10:00:00'") + F.make_interval(mins="minute")).drop("minute")
    sink = BatchTable(spark, K.REVIEWS)
    run_to_end(J.settle_reviews(in_files(log, tmp_path / "in", 7, "at", [3, 3, 1, 1, 1, 1, 1]).drop("at"), sink, "10 minutes"), spark)
    final = {r["article_id"]: r["status"] for r in sink.latest(["article_id"]).collect()}
    assert final == {"a": "rejected", "b": "expired", "c": "approved", "d": "approved"}


def test_each_key_is_stored_once_over_batches(spark, corpus, tmp_path):
    rows = corpus.fetches.select("url", "etag", "ts")
    sink = BatchTable(spark, "url STRING, etag BIGINT")
    run_to_end(J.deduplicate(in_files(rows, tmp_path / "in", 4, "ts"), ["url", "etag"], sink), spark)
    stored = [tuple(r) for r in sink.read().drop("batch").collect()]
    assert len(stored) == len(set(stored)) and set(stored) == as_set(rows.select("url", "etag").distinct())


def test_a_repeated_batch_counts_once(spark):
    table = BatchTable(spark, "id INT")
    rows = spark.createDataFrame([(1,), (2,)], "id INT")
    table.write(rows, 0)
    table.write(rows, 0)
    assert table.read().count() == 2 and table.read(0).count() == 0


def test_unanswered_requests_are_given_out_when_their_time_is_over(spark, tmp_path):
    day = lambda d: F.expr(f"TIMESTAMP '2026-09-0{d} 10:00:00'")
    asked = spark.range(3).select(F.col("id").cast("string").alias("request_id"), day(1).alias("asked_at"))
    asked = asked.union(spark.range(1).select(F.lit("late"), day(8)))
    answered = spark.range(1).select(F.lit("1").alias("request_id"), day(2).alias("answered_at"))
    answered = answered.union(spark.range(1).select(F.lit("x"), day(8)))
    out = BatchTable(spark, "request_id STRING, asked_at TIMESTAMP, answered_at TIMESTAMP")
    matched = J.match_responses(
        in_files(asked, tmp_path / "q", 2, "asked_at"), in_files(answered, tmp_path / "a", 2, "answered_at")
    )
    run_to_end(matched.writeStream.foreachBatch(out.write), spark)
    found = {(r["request_id"], r["answered_at"] is not None) for r in out.read().collect()}
    assert found == {("0", False), ("1", True), ("2", False)}


def test_topics_over_batches(spark, tmp_path):
    from test_topics import REPORTS, items

    first = items(spark, [REPORTS[0], REPORTS[3]])
    second = items(spark, [REPORTS[1], REPORTS[2], REPORTS[4], REPORTS[0]], hours=1)
    rows = first.union(second).select("doc_id", "title", "content", "item_at")
    stream = in_files(rows, tmp_path / "in", 3, "item_at")
    tables = J.TopicTables(spark)
    run_to_end(J.assign_topics(stream, tables), spark)
    found = {r["doc_id"]: r["topic_id"] for r in tables.links.read().collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    # The item that came twice is linked once.
    assert tables.links.read().count() == 5


def test_topics_leave_the_state_with_the_window(spark, tmp_path):
    from test_topics import REPORTS, items

    batches = [items(spark, [(10 * i + r[0], *r[1:]) for r in part], hours=24 * 2 * i) for i, part in enumerate([REPORTS[:2], REPORTS[2:4], REPORTS[:1], REPORTS[1:2]])]
    rows = batches[0].union(batches[1]).union(batches[2]).union(batches[3]).select("doc_id", "title", "content", "item_at")
    tables = J.TopicTables(spark)
    closed = spark.createDataFrame([(21,)], "topic_id BIGINT")
    window = J.P.TopicParams(window_hours=3 * 24)
    run_to_end(J.assign_topics(in_files(rows, tmp_path / "in", 4, "item_at", [2, 2, 1, 1]), tables, window, closed), spark)
    found = {r["doc_id"]: r["topic_id"] for r in tables.links.read().collect()}
    # The story goes on while the window reaches its last item; a closed topic takes nothing more.
    assert found == {1: 1, 2: 1, 13: 1, 14: 14, 21: 1, 32: 1}
    last = tables.versions()
    assert len(last) <= 2  # no version is kept that no batch can read
    live = {r["topic_id"]: r["size"] for r in tables.read("topics", last[-1] + 1).collect()}
    assert live == {1: 5}


def test_a_closed_topic_takes_no_items(spark, tmp_path):
    from test_topics import REPORTS, items

    rows = items(spark, REPORTS[:1]).union(items(spark, REPORTS[1:2], hours=1)).select("doc_id", "title", "content", "item_at")
    tables = J.TopicTables(spark)
    closed = spark.createDataFrame([(1,)], "topic_id BIGINT")
    run_to_end(J.assign_topics(in_files(rows, tmp_path / "in", 2, "item_at"), tables, closed=closed), spark)
    assert {r["doc_id"]: r["topic_id"] for r in tables.links.read().collect()} == {1: 1, 2: 2}


def test_a_stopped_stream_goes_on_where_it_was(spark, corpus, tmp_path):
    schema = K.BREAKER
    source, table, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    early = corpus.attempts.filter("ts < TIMESTAMP '2024-01-15'")
    run_to_end(J.track_breaker(in_files(early, source, 2, "ts"), BatchTable(spark, schema, table)), spark, checkpoint)
    batches = BatchTable(spark, schema, table).read().select("batch").distinct().count()
    late = corpus.attempts.filter("ts >= TIMESTAMP '2024-01-15'").orderBy("ts").collect()
    spark.createDataFrame(late, corpus.attempts.schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(corpus.attempts.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    sink = BatchTable(spark, schema, table)
    run_to_end(J.track_breaker(stream, sink), spark, checkpoint)
    assert sink.read().select("batch").distinct().count() == batches + 1  # the old files are not read again
    columns = ("source_id", "failures", "disabled_until")
    assert as_set(sink.latest(["source_id"]).select(*columns)) == as_set(I.breaker_state(corpus.attempts).select(*columns))


def test_items_are_appended_under_both_keys_over_batches(spark, tmp_path):
    schema = "doc_id BIGINT, url_hash STRING, source_id STRING, content_hash STRING"
    rows = [(1, "u1", "s", "c1"), (2, "u2", "s", "c1"), (3, "u2", "s", "c3"), (4, "u4", "t", "c1"), (5, "u1", "t", "c5"), (6, "u6", "s", "c3")]
    frame = spark.createDataFrame(rows, schema)
    sink = BatchTable(spark, schema)
    run_to_end(J.append_items(in_files(frame, tmp_path / "in", 3, "doc_id"), sink), spark)
    assert sorted(r["doc_id"] for r in sink.read().collect()) == [1, 3, 4]


def test_day_table_writes_only_the_days_a_batch_touches(spark):
    from newsweave.sinks import work_path
    from newsweave.streaming.tables import DayTable

    path = work_path(spark, "days-test")
    schema = "user_id BIGINT, start_s BIGINT, n BIGINT"
    table = DayTable(spark, schema, ["user_id", "start_s"], "start_s div 86400", path)
    assert table.read().count() == 0
    frame = lambda rows: spark.createDataFrame(rows, schema)
    table.write(frame([(1, 10, 1), (2, 20, 1), (None, 20, 4), (1, 86400, 2)]), 0)
    first = table.versions()
    table.write(frame([(1, 10, 5), (None, 20, 6), (3, 30, 1)]), 1)
    expected = {(1, 10, 5), (2, 20, 1), (None, 20, 6), (3, 30, 1), (1, 86400, 2)}
    assert {tuple(r) for r in table.read().collect()} == expected and table.read().count() == 5
    assert table.versions()[1] == first[1]
    # The same batch again, as after a failure, starts from the version before it.
    table.write(frame([(1, 10, 5), (None, 20, 6), (3, 30, 1)]), 1)
    assert {tuple(r) for r in table.read().collect()} == expected and table.read().count() == 5
    table.write(frame([(9, 11, 1)]), 2)
    table.write(frame([]), 3)
    # Another session's table over the same folder goes on.
    again = DayTable(spark, schema, ["user_id", "start_s"], "start_s div 86400", path)
    assert {tuple(r) for r in again.read().collect()} == expected | {(9, 11, 1)}
    assert sorted(again.versions()[0]) == [1, 2] and sorted(again.versions()[1]) == [0]


def test_exact_slices_are_cut_at_the_rank(spark):
    n = 1_000_001
    log = spark.range(n).select(F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(n)) / 3).alias("ts"))
    assert [part.count() for part in slices_of(log, "ts", 4, exact=True)] == [250001, 250000, 250000, 250000]
    ties = spark.range(90).select(F.timestamp_seconds(F.floor(F.col("id") / 40)).alias("ts"))
    assert [part.count() for part in slices_of(ties, "ts", 2, exact=True)] == [80, 10]

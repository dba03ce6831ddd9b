"""Streaming jobs over the shared tables, read back when everything is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave import params as P
from newsweave.plans import views as V
from newsweave.plans.registry import CHECKS, plan
from newsweave.plans import editorial_plans, ingest_plans, topic_plans  # noqa: F401  (their checks are reused below)
from newsweave.sinks import materialize, work_path
from newsweave.streaming import jobs as J, keyed as K
from newsweave.streaming.tables import BatchTable, DayTable, Landing, landed, run_to_end, slices_of


@plan("stream_dedup", "SELECT DISTINCT url, etag FROM v_fetches")
def stream_dedup(c):
    sink = BatchTable(c.spark, "url STRING, etag BIGINT", name="dedup")
    run_to_end(J.deduplicate(landed(c.fetches.select("url", "etag", "ts"), "ts"), ["url", "etag"], sink), c.spark)
    return sink.read().drop("batch")


@plan(
    "stream_item_dedup",
    # The rows one after the other, each against what went in before it.
    """WITH RECURSIVE n AS (SELECT doc_id, url_hash, concat(source_id, '/', content_hash) AS content, row_number() OVER (ORDER BY doc_id) AS step FROM v_hashed),
    walk(step, urls, contents, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false
      UNION ALL SELECT step, CASE WHEN ok THEN list_append(urls, url_hash) ELSE urls END, CASE WHEN ok THEN list_append(contents, content) ELSE contents END, ok
      FROM (SELECT n.*, w.urls, w.contents, NOT list_contains(w.urls, n.url_hash) AND NOT list_contains(w.contents, n.content) AS ok
        FROM walk w JOIN n ON n.step = w.step + 1))
    SELECT doc_id FROM n JOIN walk USING (step) WHERE kept""",
)
def stream_item_dedup(c):
    schema = "doc_id BIGINT, url_hash STRING, source_id STRING, content_hash STRING"
    sink = BatchTable(c.spark, schema, name="items")
    items = materialize(ingest_plans.hashed(c).select("doc_id", "url_hash", "source_id", "content_hash"), "hashed")
    run_to_end(J.append_items(landed(items, "doc_id"), sink), c.spark)
    return sink.read().select("doc_id")


@plan(
    "stream_late_data",
    f"""SELECT doc_id, source_id, item_s FROM v_timed WHERE fetched_s >= {V.NOW - 36 * 3600} AND fetched_s <= {V.NOW}""",
)
def stream_late_data(c):
    sink = BatchTable(c.spark, "doc_id BIGINT, source_id STRING, item_s BIGINT", name="late")
    arrived = landed(c.items.select("doc_id", "source_id", "fetched_at", "published_at"), "fetched_at")
    items = J.valid_recent_items(arrived, c.now, 36).select("doc_id", "source_id", F.unix_timestamp("item_at").alias("item_s"))
    run_to_end(items.writeStream.foreachBatch(sink.write), c.spark)
    return sink.read().drop("batch")


@plan(
    "stream_velocity",
    """SELECT user_id, h - k * 3600 AS start_s, count(*) AS n
    FROM (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS h FROM events), (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k)
    GROUP BY 1, 2""",
)
def stream_velocity(c):
    sink = DayTable(
        c.spark, "user_id BIGINT, start_s BIGINT, n BIGINT", ["user_id", "start_s"], "start_s div 86400", name="velocity"
    )
    run_to_end(J.sliding_counts(landed(c.events.select("user_id", "ts"), "ts"), "user_id", sink), c.spark)
    return sink.read()


@plan("stream_breaker")
def stream_breaker(c):
    sink = BatchTable(c.spark, K.BREAKER, name="breaker")
    run_to_end(J.track_breaker(landed(c.attempts, "ts"), sink), c.spark)
    return sink.latest(["source_id"]).select(
        "source_id", "failures", F.unix_timestamp("disabled_until").alias("disabled_until_s")
    )


@plan("stream_changes")
def stream_changes(c):
    sink = BatchTable(c.spark, K.CHANGES, name="changes")
    run_to_end(J.track_changes(landed(c.fetches, "ts"), sink), c.spark)
    return sink.latest(["url"]).select(
        "url", "n_fetches", "n_unchanged",
        F.unix_timestamp("last_changed_at").alias("last_changed_s"), "last_etag",
    )


@plan("stream_reviews")
def stream_reviews(c):
    """The log ends with a tick of the clock, which belongs to no article and lets the timers run until then."""
    sink = BatchTable(c.spark, K.REVIEWS, name="reviews")
    log = K.review_events(c.reviews, c.decisions, "desk")
    tick = c.spark.range(1).select(
        F.lit("").alias("article_id"), F.lit(-1).cast("bigint").alias("event_id"), F.lit("tick").alias("decision"),
        (c.now + F.expr("INTERVAL 1 SECOND")).alias("ts"),
    )
    known = log.filter(F.col("ts") <= c.now).join(
        c.reviews.select(F.col("article_id").cast("string").alias("article_id")), "article_id", "left_semi"
    )
    run_to_end(J.settle_reviews(landed(known.select(*tick.columns).unionByName(tick), "ts"), sink), c.spark)
    return sink.latest(["article_id"]).select(
        "article_id", "status", F.unix_timestamp("sent_at").alias("sent_s")
    )


@plan(
    "stream_results",
    """SELECT q.conv_id, q.turn, length(q.text) AS n_asked, length(a.text) AS n_answered FROM conversations q
    LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'""",
)
def stream_results(c):
    at = lambda turn: F.timestamp_seconds(
        F.lit(1704067200) + F.col("conv_id") * 600 + turn * 60
    )
    key = lambda turn: F.concat_ws("-", F.col("conv_id"), turn)
    turns = lambda role: c.table("conversations").filter(F.col("role") == role)
    asked = turns("user").select(
        key(F.col("turn")).alias("request_id"), at(F.col("turn")).alias("asked_at"),
        "conv_id", "turn", F.length("text").cast("bigint").alias("n_asked"),
    )
    answered = turns("assistant").select(
        key(F.col("turn") - 1).alias("request_id"), at(F.col("turn")).alias("answered_at"),
        F.length("text").cast("bigint").alias("n_answered"),
    )
    sink = BatchTable(
        c.spark, "conv_id BIGINT, turn BIGINT, n_asked BIGINT, n_answered BIGINT", name="results"
    )
    matched = J.match_responses(landed(asked, "asked_at"), landed(answered, "answered_at")).select("conv_id", "turn", "n_asked", "n_answered")
    run_to_end(matched.writeStream.foreachBatch(sink.write), c.spark)
    # Requests whose time is over come out of the stream with nulls; the last ones are still
    # open when the log ends. Both are unanswered.
    answers = sink.read().filter("n_answered IS NOT NULL").select("conv_id", "turn", "n_answered")
    requests = c.table("conversations").filter("role = 'user'").select(
        "conv_id", "turn", F.length("text").cast("bigint").alias("n_asked")
    )
    return requests.join(answers, ["conv_id", "turn"], "left")


# Three batches by time; a topic is in play for twelve days after its last item.
CUTS = [V.NOW - 20 * V.DAY, V.NOW - 9 * V.DAY]
WINDOW_DAYS = 12


def _stream_topics_sql() -> str:
    """One run of the job per batch, its weights from its own items, against what the runs before it left."""
    names = "SELECT topic_id, list_distinct(list(lower(entity))) AS names FROM v_top_entities JOIN {links} USING (doc_id) GROUP BY 1"
    bounds = [None, *CUTS, None]
    ctes = []
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        p = f"b{k}_"
        after = "" if low is None else f" AND item_s >= {low}"
        until = "" if high is None else f" AND item_s < {high}"
        seen = "".join(f" UNION ALL SELECT topic_id, doc_id FROM b{j}_done" for j in range(k))
        units = "".join(f" UNION ALL SELECT * FROM b{j}_unit" for j in range(k))
        ctes.append(
            f"""{p}now AS MATERIALIZED (SELECT max(item_s) - {WINDOW_DAYS * V.DAY} AS start_s FROM v_timed WHERE true{until}),
    {p}fr AS MATERIALIZED (SELECT doc_id, item_s FROM v_timed, {p}now
      WHERE item_s >= start_s{after}{until} AND length(title) >= 20 AND NOT {topic_plans.MULTI_SQL}),
    {p}tf AS MATERIALIZED (SELECT v_tf.* FROM v_tf JOIN {p}fr USING (doc_id)),
    {p}raw AS MATERIALIZED (SELECT doc_id, term, CAST(floor((1 + ln(tf)) * (ln(((SELECT greatest(1, count(*)) FROM {p}fr) + 1) / (df + 1)) + 1) * 100000 + 0.5) AS BIGINT) AS raw
      FROM {p}tf JOIN (SELECT term, count(*) AS df FROM {p}tf GROUP BY 1) USING (term)),
    {p}unit AS MATERIALIZED (SELECT r.doc_id, term, CAST(floor(raw * 100000000 / sqrt(ss) + 0.5) AS BIGINT) AS w
      FROM {p}raw r JOIN (SELECT doc_id, CAST(sum(raw * raw) AS BIGINT) AS ss FROM {p}raw GROUP BY 1) n USING (doc_id)),
    {p}seen AS MATERIALIZED (SELECT 0::BIGINT AS topic_id, 0::BIGINT AS doc_id WHERE false{seen}),
    {p}units AS MATERIALIZED (SELECT 0::BIGINT AS doc_id, '' AS term, 0::BIGINT AS w WHERE false{units}),
    {p}pool_start AS MATERIALIZED (SELECT topic_id, min(item_s) AS start_s FROM {p}seen JOIN v_timed USING (doc_id) GROUP BY 1
      HAVING max(item_s) >= (SELECT start_s FROM {p}now)),
    {p}links AS MATERIALIZED (SELECT * FROM {p}seen JOIN {p}pool_start USING (topic_id)),
    {p}mean AS MATERIALIZED (SELECT topic_id, term, CAST(floor(sum(w) / any_value(size) + 0.5) AS BIGINT) AS raw FROM {p}units JOIN {p}links USING (doc_id)
      JOIN (SELECT topic_id, count(*) AS size FROM {p}links GROUP BY 1) USING (topic_id) GROUP BY 1, 2 HAVING raw > 0),
    {p}pool_unit AS MATERIALIZED (SELECT topic_id, term, CAST(floor(raw * 100000000 / sqrt(ss) + 0.5) AS BIGINT) AS w
      FROM {p}mean JOIN (SELECT topic_id, CAST(sum(raw * raw) AS BIGINT) AS ss FROM {p}mean GROUP BY 1) USING (topic_id)),
    {p}pool_names AS MATERIALIZED ({names.format(links=p + "links")}),
    {topic_plans._run_ctes(p, p + "unit", p + "pool")}"""
        )
    union = " UNION ALL ".join(f"SELECT {k} AS batch, * FROM b{k}_done" for k in range(len(bounds) - 1))
    return f"WITH RECURSIVE {', '.join(ctes)} {union}"


@plan("stream_topics", _stream_topics_sql())
def stream_topics(c):
    tables = J.TopicTables(c.spark)
    items = materialize(c.timed.select("doc_id", "title", "content", "item_at"), "timed")
    landing = Landing(c.spark, items.schema, items.count(), len(CUTS) + 1)
    seconds = F.unix_timestamp("item_at")
    bounds = [None, *CUTS, None]
    for low, high in zip(bounds, bounds[1:]):
        part = items if low is None else items.filter(seconds >= low)
        landing.put(part if high is None else part.filter(seconds < high))
    run_to_end(J.assign_topics(landing.stream(), tables, P.TopicParams(window_hours=24 * WINDOW_DAYS)), c.spark)
    return tables.links.read().filter("batch >= 0").select(F.col("batch").cast("int").alias("batch"), "doc_id", "topic_id", "similarity", "is_new")


@plan(
    "stream_resume",
    """WITH t AS (SELECT quantile_disc(epoch(ts), 0.5) AS half FROM v_attempts)
    SELECT 1 AS run, count(*) AS n_read, count(*) FILTER (WHERE NOT ok) AS n_applied FROM v_attempts, t WHERE epoch(ts) <= half
    UNION ALL SELECT 2, 0, 0
    UNION ALL SELECT 3, count(*), count(*) FILTER (WHERE NOT ok) FROM v_attempts, t WHERE epoch(ts) > half""",
)
def stream_resume(c):
    """One stream, stopped and started again over the same checkpoint: half the log, nothing new, the other half.

    What was read is remembered also where nothing of it was applied.
    """
    slices = slices_of(c.attempts, "ts", 2, exact=True)
    landing = Landing(c.spark, c.attempts.schema, c.attempts.count(), 2)
    read = BatchTable(c.spark, "run BIGINT, event_id BIGINT, applied BOOLEAN", name="offsets-read")
    offsets = work_path(c.spark, "offsets")
    for run, part in enumerate([slices[0], None, slices[1] if len(slices) > 1 else None], 1):
        if part is not None:
            landing.put(part)
        rows = landing.stream().select(F.lit(run).cast("bigint").alias("run"), "event_id", (~F.col("ok")).alias("applied"))
        run_to_end(rows.writeStream.foreachBatch(read.write), c.spark, offsets)
    counted = read.read().groupBy("run").agg(F.count("*").alias("n_read"), F.count_if("applied").alias("n_applied"))
    runs = c.spark.range(1, 4).withColumnRenamed("id", "run")
    return runs.join(counted, "run", "left").na.fill(0)


# A stream that has seen everything must agree with the batch job on the same rows.
for stream, batch in (
    ("stream_breaker", "breaker_replay"),
    ("stream_changes", "unchanged_docs"),
    ("stream_reviews", "expire_reviews"),
):
    CHECKS[stream] = CHECKS[batch]

"""Table maintenance: upserts, versions, reviews, retention, constraint checks.

Tables are read, changed and returned as a new DataFrame; the caller writes the
result beside the old version and swaps. Returning instead of writing is also
how a dry run works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsweave import params as P


def one_per_key(changes: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """The last change of each key by ``order``; without one the largest row, so reruns agree."""
    row = F.struct(*[c for c in changes.columns if c not in key])
    last = changes.groupBy(*key).agg(F.max_by(row, row if order is None else order).alias("_row"))
    return last.select(*key, "_row.*")


def upsert(
    target: DataFrame, changes: DataFrame, key: list[str], columns: list[str], order: Column | None = None
) -> DataFrame:
    """Update ``columns`` of rows whose key is in ``changes``, keep the others, add new rows.

    Of several changes of one key the last by ``order`` counts.
    """
    fresh = one_per_key(changes, key, order).select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns]).withColumn(
        "_changed", F.lit(True)
    )
    joined = target.join(fresh, key, "full")
    replaced = {
        c: F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns
    }
    return joined.withColumns(replaced).select(*target.columns)


def set_columns(target: DataFrame, keys: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Set columns of the rows named in ``keys``: mark covered, needs-flagship, collected."""
    marked = target.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    changed = {c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}
    return marked.withColumns(changed).select(*target.columns)


def new_links(links: DataFrame, stored: DataFrame) -> DataFrame:
    """Topic links an append may add; known and repeated ones are skipped."""
    return links.dropDuplicates(["topic_id", "doc_id"]).join(
        stored.select("topic_id", "doc_id"), ["topic_id", "doc_id"], "left_anti"
    )


def remove_rows(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


# --- numbering and running counts without gathering a key -----------------------------------


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """1-based position of each row among its key's rows by (ts, event_id).

    Rows are numbered inside a key and day; the counts of the key's earlier
    days come from a table with one row per key and day.
    """
    dated = rows.withColumn("_day", F.to_date("ts"))
    in_day = Window.partitionBy(key, "_day").orderBy("ts", "event_id")
    earlier = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        dated.groupBy(key, "_day")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(key, "_day", "_before")
    )
    return (
        dated.withColumn("_in_day", F.row_number().over(in_day))
        .join(days, [key, "_day"])
        .withColumn(name, F.col("_before") + F.col("_in_day"))
        .drop("_day", "_in_day", "_before")
    )


def trailing_count(rows: DataFrame, key: str, at: str, hours: int, name: str) -> DataFrame:
    """Rows of the same key in the ``hours`` up to and including each row.

    Every row is counted in its own time block and offered to the next one, so
    a window frame never spans more than two blocks of a key.
    """
    seconds = F.unix_timestamp(at)
    width = hours * 3600
    block = F.floor(seconds / width)
    offered = rows.withColumn("_block", F.explode(F.array(block, block + 1))).withColumn(
        "_own", F.col("_block") == block
    ).withColumn("_s", seconds)
    frame = Window.partitionBy(key, "_block").orderBy("_s").rangeBetween(-width, Window.currentRow)
    return (
        offered.withColumn(name, F.count("*").over(frame))
        .filter("_own")
        .drop("_block", "_own", "_s")
    )


# --- article versions -------------------------------------------------------------------------


def apply_article_updates(
    articles: DataFrame, updates: DataFrame, history: DataFrame, now: Column, order: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """New article table and history after one update per article, the last by ``order``.

    The replaced version goes to the history, the revision rises by one, cost
    adds up, and the slug (the public address) stays.
    """
    text = ["title", "lead", "body"]
    fresh = one_per_key(updates, ["article_id"], order).select(
        "article_id",
        *[F.col(c).alias(f"_new_{c}") for c in text],
        F.col("cost_usd").alias("_new_cost"),
        F.col("reason"),
    )
    joined = articles.join(fresh, "article_id", "left")
    hit = F.col("reason").isNotNull()
    old = joined.filter(hit).select(
        "article_id", "revision", *text, "reason", F.col("cost_usd")
    )
    cost = F.col("cost_usd") + F.coalesce("_new_cost", F.lit(0))
    new = joined.withColumns(
        {
            **{c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in text},
            "revision": F.col("revision") + F.when(hit, 1).otherwise(0),
            "cost_usd": cost.cast(articles.schema["cost_usd"].dataType),
            "last_update_at": F.when(hit, now).otherwise(F.col("last_update_at")),
        }
    ).select(*articles.columns)
    return new, history.unionByName(old, allowMissingColumns=True)


# --- reviews -------------------------------------------------------------------------------------


def parse_decisions(events: DataFrame, chat_id: str) -> DataFrame:
    """Button presses(event_id, ts, payload, chat_id) of the desk to decisions; others are dropped."""
    parts = F.split("payload", ":")
    action, target = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    decision = F.when(action == "odobri", "approved").when(action == "odbij", "rejected")
    return (
        events.withColumn("decision", decision)
        .withColumn("article_id", target)
        .filter(
            F.col("decision").isNotNull()
            & (F.coalesce("article_id", F.lit("")) != "")
            & (F.col("chat_id") == chat_id)
        )
        .select("event_id", "article_id", "decision", "ts")
    )


def first_decision(decisions: DataFrame) -> DataFrame:
    """The decision that counts per article: the first one."""
    order = F.struct("ts", "event_id")
    return decisions.groupBy("article_id").agg(
        F.min_by("decision", order).alias("decision"), F.min("ts").alias("decided_at")
    )


def apply_decisions(articles: DataFrame, decisions: DataFrame) -> DataFrame:
    """Articles(article_id, ...) with status and publish time after the first decision."""
    first = first_decision(decisions)
    status = F.when(F.col("decision") == "approved", "published").when(
        F.col("decision") == "rejected", "rejected"
    )
    return articles.join(first, "article_id", "left").select(
        *articles.columns,
        F.coalesce(status, F.lit("pending_review")).alias("status"),
        F.when(F.col("decision") == "approved", F.col("decided_at")).alias("published_at"),
        "decided_at",
    )


def settle_reviews(
    reviews: DataFrame, decisions: DataFrame, now: Column, hours: int = P.REVIEW_TIMEOUT_HOURS
) -> DataFrame:
    """Reviews(article_id, sent_at): decided within the time-out, expired, or still pending."""
    deadline = F.col("sent_at") + F.expr(f"INTERVAL {hours} HOURS")
    in_time = (
        reviews.join(decisions, "article_id")
        .filter((F.col("ts") >= F.col("sent_at")) & (F.col("ts") < deadline))
        .select("article_id", "event_id", "decision", "ts")
    )
    settled = reviews.join(first_decision(in_time), "article_id", "left")
    status = F.when(F.col("decision").isNotNull(), F.col("decision")).when(
        deadline <= now, "expired"
    )
    return settled.select(
        "article_id", "sent_at", F.coalesce(status, F.lit("pending")).alias("status"), "decided_at"
    )


def awaiting_submission(articles: DataFrame, queue: DataFrame, limit: int) -> DataFrame:
    waiting = articles.filter("status = 'pending_review'").join(
        queue.select("article_id"), "article_id", "left_anti"
    )
    return waiting.orderBy("created_at", "article_id").limit(limit)


# --- covers --------------------------------------------------------------------------------------


def cover_is_stale() -> Column:
    """Never drawn, or drawn before the article's last update."""
    return (
        F.when(F.col("cover_url").isNull(), True)
        .when(F.col("last_update_at").isNull(), False)
        .when(F.col("cover_at").isNull(), True)
        .otherwise(F.col("cover_at") < F.col("last_update_at"))
    )


def articles_needing_cover(articles: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """Articles without a cover first, then recently updated ones with a stale cover.

    Three top-k lists of ``limit`` rows; the table is never sorted as a whole.
    """
    live = articles.filter("status <> 'rejected'")
    missing = (
        live.filter(F.col("cover_url").isNull())
        .orderBy(F.desc("created_at"), "article_id")
        .limit(limit)
        .select("article_id", F.lit(1).alias("turn"), F.col("created_at").alias("at"))
    )
    week_ago = now - F.expr("INTERVAL 7 DAYS")
    outdated = (
        live.filter((F.col("last_update_at") >= week_ago) & F.col("cover_url").isNotNull() & cover_is_stale())
        .orderBy(F.desc("last_update_at"), "article_id")
        .limit(limit)
        .select("article_id", F.lit(2).alias("turn"), F.col("last_update_at").alias("at"))
    )
    return missing.unionByName(outdated).orderBy("turn", F.desc("at"), "article_id").limit(limit)


# --- evidence for updates --------------------------------------------------------------------------


def topics_needing_update(
    topics: DataFrame,
    articles: DataFrame,
    members: DataFrame,
    now: Column,
    up: P.UpdateParams = P.UpdateParams(),
) -> DataFrame:
    """Covered topics that gathered enough new sources since their article's last version.

    An article stays out only when its revision is above the maximum, so one
    more version than the maximum is possible.
    """
    start = now - F.expr(f"INTERVAL {up.window_hours} HOURS")
    live = topics.filter((F.col("status") == "covered") & (F.col("last_item_at") >= start))
    since = articles.filter(F.col("revision") <= up.max_revisions).select(
        "topic_id",
        "article_id",
        "revision",
        F.coalesce("last_update_at", "created_at").alias("since"),
    )
    fresh = (
        members.select("topic_id", "source_id", "added_at")
        .join(live.select("topic_id", "title_sample").join(since, "topic_id"), "topic_id")
        .filter(F.col("added_at") > F.col("since"))
    )
    return (
        fresh.groupBy("topic_id", "article_id", "revision", "since", "title_sample", "source_id")
        .agg(F.count("*").alias("n"))
        .groupBy("topic_id", "article_id", "revision", "since", "title_sample")
        .agg(F.sum("n").alias("new_items"), F.count("*").alias("new_sources"))
        .filter(F.col("new_sources") >= up.min_new_sources)
    )


def update_queue(candidates: DataFrame, limits: P.LimitParams = P.LimitParams()) -> DataFrame:
    """Half of a run's articles at most, those with the most new sources first."""
    cap = max(1, limits.per_run // 2)
    return candidates.orderBy(F.desc("new_sources"), "topic_id").limit(cap)


# --- retention and checks ----------------------------------------------------------------------------


def expired(rows: DataFrame, at: str, now: Column, days: int) -> Column:
    return F.col(at) < now - F.expr(f"INTERVAL {days} DAYS")


def retention_plan(tables: dict[str, tuple[DataFrame, str, int]], now: Column) -> DataFrame:
    """Dry run of the sweep: per table and day, how many rows go and how many stay."""
    plans = None
    for name, (rows, at, days) in sorted(tables.items()):
        old = expired(rows, at, now, days)
        counted = rows.groupBy(
            F.lit(name).alias("table_name"), F.date_format(at, "yyyy-MM-dd").alias("day")
        ).agg(F.count_if(old).alias("n_expired"), F.count_if(~old).alias("n_kept"))
        plans = counted if plans is None else plans.unionByName(counted)
    return plans


def cascade_links(links: DataFrame, items: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Links whose item (and topic) still exists."""
    kept = links.join(items.select("doc_id"), "doc_id", "left_semi")
    return kept if topics is None else kept.join(topics.select("topic_id"), "topic_id", "left_semi")


def detach_articles(articles: DataFrame, topics: DataFrame) -> DataFrame:
    """Articles outlive their topic: the reference becomes null."""
    alive = topics.select(F.col("topic_id").alias("_alive")).distinct()
    return articles.join(alive, F.col("topic_id") == F.col("_alive"), "left").withColumn(
        "topic_id", F.col("_alive")
    ).drop("_alive")


def not_in(column: str, allowed: tuple[str, ...]) -> Column:
    """Rule broken by rows whose value is missing or none of those allowed."""
    return F.col(column).isNull() | ~F.col(column).isin(*allowed)


def violations(rows: DataFrame, broken: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """(rule, n_violations) of all rules of one table, from one pass over it.

    ``broken`` names conditions that no row may meet, ``unique`` keys that no two rows may share; each
    shared key counts once. A row gives one entry per broken rule and one per key, and one aggregate
    counts them all. Rows with a null in a key share it with others that have the same nulls.
    """
    unique = unique or {}
    entry = lambda rule, key: F.struct(F.lit(rule).alias("rule"), key.alias("key"))
    none = F.lit(None).cast("string")
    entries = [F.when(condition, entry(rule, none)) for rule, condition in broken.items()]
    entries += [entry(rule, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})) for rule, keys in unique.items()]
    found = rows.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*")
    counted = found.groupBy("rule", "key").agg(F.count("*").alias("n"))
    shared = F.when(F.col("n") > 1, 1).otherwise(0)
    totals = counted.groupBy("rule").agg(F.sum(F.when(F.col("rule").isin(*unique), shared).otherwise(F.col("n"))).alias("n"))
    rules = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r) for r in [*broken, *unique]])).alias("rule"))
    return rules.join(totals, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_violations"))


def orphans(rule: str, rows: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """(rule, n_violations): rows whose key the parent table doesn't have."""
    bad = rows.select(key).join(parent.select(key), key, "left_anti")
    return bad.agg(F.count("*").alias("n_violations")).select(F.lit(rule).alias("rule"), "n_violations")


def quality_report(parts: list[DataFrame]) -> DataFrame:
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


# --- run log ------------------------------------------------------------------------------------------


def open_run(spark: SparkSession, command: str, now: Column) -> DataFrame:
    """The log row of a run that starts."""
    return spark.range(1).select(F.lit(command).alias("command"), now.alias("started_at"))


def close_run(run: DataFrame, ok: bool, stats: dict[str, float], errors: list[str], now: Column):
    """The log row of a finished run; at most 50 error messages are kept."""
    pairs = [F.lit(v) for k, n in stats.items() for v in (k, float(n))]
    messages = F.array(*[F.lit(e) for e in errors]) if errors else F.array().cast("array<string>")
    return run.withColumns(
        {
            "finished_at": now,
            "ok": F.lit(ok),
            "stats": F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>"),
            "errors": F.slice(messages, 1, 50),
        }
    )

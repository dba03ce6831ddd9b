"""From channel candidates to new item rows: fallback, dedup, anti joins, run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsweave import params as P
from newsweave.functions import text as X, times as T, urls as U
from newsweave.sinks import materialize


def channel_fallback(candidates: DataFrame) -> DataFrame:
    """Keep, per source, the candidates of the best channel that gave any.

    The best rank per source is a grouped minimum (combined in the tasks) that
    is joined back, so a source with very many candidates is never gathered.
    """
    best = candidates.groupBy("source_id").agg(F.min("channel_rank").alias("channel_rank"))
    return candidates.join(best, ["source_id", "channel_rank"])


def normalize_candidates(candidates: DataFrame, now: Column) -> DataFrame:
    """Canonical address, fingerprint, plain title and summary, valid publish time."""
    return (
        candidates.withColumn("canonical_url", U.canonical_url(F.col("url")))
        .filter(F.col("canonical_url").isNotNull())
        .withColumn("url_hash", U.url_fingerprint(F.col("canonical_url")))
        .withColumn("title", X.strip_html(F.col("title")))
        .withColumn("summary", X.strip_html(F.col("summary")))
        .withColumn("published_at", T.reject_future(F.col("published_at"), now))
    )


def last_wins(candidates: DataFrame, key: str = "canonical_url", order: str = "seq") -> DataFrame:
    """One row per key: the one seen last. Duplicates fold inside the tasks before the shuffle."""
    rest = [c for c in candidates.columns if c != key]
    return (
        candidates.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("row"))
        .select(key, "row.*")
    )


def first_wins(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the smallest in the given order."""
    rest = [c for c in items.columns if c not in keys]
    return (
        items.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
        .select(*keys, "row.*")
    )


def batch_content_dedup(items: DataFrame) -> DataFrame:
    """Within a batch, one item per source and content: the newest, then the lowest id.

    The same text from two sources stays: that is the signal topics are built from.
    """
    newest_first = [-F.coalesce(F.unix_timestamp("published_at"), F.lit(0)), F.col("doc_id")]
    return first_wins(items, ["source_id", "content_hash"], newest_first)


def newest_per_source(items: DataFrame, limit: int = P.ITEMS_PER_SOURCE) -> DataFrame:
    """The newest items of each source, undated ones last.

    The rank filter lets Spark keep only ``limit`` rows per source in each task
    before the shuffle.
    """
    order = Window.partitionBy("source_id").orderBy(
        F.col("published_at").desc_nulls_last(), "doc_id"
    )
    return items.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def new_only(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet; the stored side is reduced to its keys."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


#: Plain rounds of settling clashes before chains of them are looked for.
PLAIN_ROUNDS = 2


def insert_ignore(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows an append may add under both unique keys of the item table.

    url_hash is unique everywhere, content_hash per source. Rows go in by id, and a row is
    skipped if it clashes with a stored row or with one that went in before it; a skipped row
    stops no other. A null key clashes with nothing. Rows alone under both keys go in at once; the
    others are settled in rounds, whose number grows with the logarithm of a chain of clashes.
    """
    content = ["source_id", "content_hash"]
    offered = materialize(new_only(new_only(rows, stored, ["url_hash"]), stored, content), "offered")
    marked = offered
    for keys, flag in ((["url_hash"], "_u"), (content, "_c")):
        many = offered.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
        marked = marked.join(many.select(*keys, F.lit(True).alias(flag)), keys, "left")
    clashing = F.coalesce("_u", "_c").isNotNull()
    marked = materialize(marked.select(*rows.columns, clashing.alias("_clashing")), "marked")
    added = marked.filter(~F.col("_clashing")).drop("_clashing")
    open_rows, rounds = marked.filter("_clashing").drop("_clashing"), 0
    while not open_rows.isEmpty():
        rounds += 1
        placed = materialize(_placed(open_rows, content), "placed")
        ids = placed.filter("doc_id = _first_u AND doc_id = _first_c").select("doc_id")
        if rounds > PLAIN_ROUNDS:
            ids = ids.unionByName(_chained(placed, ids))
        first = materialize(open_rows.join(ids, "doc_id", "left_semi"), "added")
        added = added.unionByName(first)
        # A row behind one that only its own group can stop is out: either of them has taken the group.
        left = placed.filter("doc_id <= _until_u AND doc_id <= _until_c").select(*rows.columns)
        left = left.join(first.select("doc_id"), "doc_id", "left_anti").select(*rows.columns)
        open_rows = materialize(new_only(new_only(left, first, ["url_hash"]), first, content), "offered")
    return added


def _placed(rows: DataFrame, content: list[str]) -> DataFrame:
    """Open rows with the first row of both of their groups, and the row with which each group is taken for sure.

    A row that is first in one group can be stopped by the other group alone. If it is, that group is
    taken; if not, it takes it. ``_until`` is the first such row of a group.
    """
    never = F.lit(2**63 - 1)
    keys = {"u": ["url_hash"], "c": content}
    placed = rows
    for side, own in keys.items():
        first = rows.filter(F.col(own[-1]).isNotNull()).groupBy(*own).agg(F.min("doc_id").alias(f"_first_{side}"))
        placed = placed.join(first, own, "left").withColumn(f"_first_{side}", F.coalesce(f"_first_{side}", "doc_id"))
    for side, other in (("u", "c"), ("c", "u")):
        own = keys[side]
        taken = F.min(F.when(F.col("doc_id") == F.col(f"_first_{other}"), F.col("doc_id")))
        until = placed.groupBy(*own).agg(taken.alias(f"_until_{side}"))
        placed = placed.join(until, own, "left").withColumn(f"_until_{side}", F.coalesce(f"_until_{side}", never))
    return placed


def _chained(placed: DataFrame, first: DataFrame) -> DataFrame:
    """Ids of the rows that go in because the row before them in a chain of clashes does not.

    A row that is first in one group and second in the other is the opposite of the row before it. Such
    pointers are doubled until they reach the start of their chain; where that goes in, every row at an
    even distance does.
    """
    pointers = None
    for side, other, own in (("u", "c", ["url_hash"]), ("c", "u", ["source_id", "content_hash"])):
        pairs = (
            placed.filter(F.col("doc_id") > F.col(f"_first_{side}"))
            .groupBy(*own)
            .agg(F.min("doc_id").alias("id"), F.min(f"_first_{side}").alias("root"))
            .select("id", "root")
        )
        single = placed.filter(F.col("doc_id") == F.col(f"_first_{other}")).select(F.col("doc_id").alias("id"))
        pairs = pairs.join(single, "id", "left_semi")
        pointers = pairs if pointers is None else pointers.unionByName(pairs)
    pointers = materialize(pointers.withColumn("steps", F.lit(1).cast("bigint")), "chains")
    while True:
        further = pointers.select(F.col("id").alias("root"), F.col("root").alias("_root"), F.col("steps").alias("_steps"))
        moved = materialize(pointers.join(further, "root", "left"), "chains")
        pointers = moved.select(
            "id", F.coalesce("_root", "root").alias("root"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")
        )
        if moved.filter("_root IS NOT NULL").isEmpty():
            break
    started = pointers.join(first.select(F.col("doc_id").alias("root")), "root", "left_semi")
    return started.filter("steps % 2 = 0").select(F.col("id").alias("doc_id"))


def build_rows(candidates: DataFrame) -> DataFrame:
    """Item rows from candidates joined to their page (page_title, page_text, page_method).

    The page's text counts when it has enough words, else the channel's summary
    stands in. Rows without title, or with neither text nor a real title, go.
    """
    enough = (F.col("page_method") != "none") & (
        X.count_words(F.col("page_text")) >= P.MIN_ARTICLE_WORDS
    )
    enough = F.coalesce(enough, F.lit(False))
    text = F.when(enough, F.col("page_text")).otherwise(F.coalesce("summary", F.lit("")))
    title = F.when(enough, F.coalesce("page_title", "title")).otherwise(F.col("title"))
    method = F.when(enough, F.col("page_method")).otherwise("feed")
    rows = (
        candidates.withColumns({"_text": text, "_title": title, "_method": method})
        .filter(X.first_present([F.col("_title")]).isNotNull())
        .filter((F.col("_text") != "") | (F.length("_title") >= 15))
    )
    return rows.select(
        *[c for c in candidates.columns if c not in ("title", "page_title", "page_text", "page_method", "content")],
        F.col("_title").alias("title"),
        F.when(F.col("_text") != "", F.col("_text")).alias("content"),
        X.count_words(F.col("_text")).alias("word_count"),
        X.content_fingerprint(F.col("_title"), F.col("_text")).alias("content_hash"),
        F.when(F.col("_text") == "", "none").otherwise(F.col("_method")).alias("extraction"),
    )


def apply_crawl_policy(items: DataFrame, policy: DataFrame) -> DataFrame:
    """Mark items whose address the site's longest matching rule disallows.

    Policy(host, path_prefix, allow) holds a handful of rules per host.
    """
    address = F.col("url")
    matched = (
        items.select("doc_id", U.host(address).alias("host"), U.path(address).alias("path"))
        .join(policy, "host", "left")
        .filter(F.col("path_prefix").isNull() | F.col("path").startswith(F.col("path_prefix")))
        .groupBy("doc_id")
        .agg(F.max_by("allow", F.length("path_prefix")).alias("allow"))
    )
    return items.join(matched, "doc_id", "left").withColumn(
        "allowed", F.coalesce("allow", F.lit(True))
    ).drop("allow")


def runnable_sources(sources: DataFrame, now: Column) -> DataFrame:
    off = F.col("disabled_until") > now
    return sources.filter(~F.coalesce(off, F.lit(False)))


def with_angle(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Viewpoint of each item's source; unknown sources count as mainstream."""
    angles = sources.select("source_id", F.col("angle").alias("source_angle"))
    return (
        items.join(angles, "source_id", "left")
        .withColumn("angle", F.coalesce("source_angle", F.lit(P.DEFAULT_ANGLE)))
        .drop("source_angle")
    )


#: Counters that a source's log row carries and a run adds up.
SUMMED = ("checked", "unchanged", "candidates", "new_urls", "extracted", "inserted", "duplicates", "errors")


def run_totals(log: DataFrame, by: str) -> DataFrame:
    """The twelve totals of a run from log(by, channel, started_at, finished_at and the counters), a row per source."""
    return log.groupBy(by).agg(
        F.count("*").alias("sources"),
        F.count_if(F.col("channel") == "sitemap").alias("by_sitemap"),
        F.count_if(F.col("channel") == "none").alias("without_candidates"),
        *[F.sum(c).alias(c) for c in SUMMED],
        (F.unix_timestamp(F.max("finished_at")) - F.unix_timestamp(F.min("started_at"))).alias("seconds"),
    )


# --- per-source and per-address state ---------------------------------------------------------


def breaker_state(attempts: DataFrame, breaker: P.BreakerParams = P.BreakerParams()) -> DataFrame:
    """Consecutive failures per source and until when it is switched off.

    Only failures after the last success count, so two grouped aggregates and a
    join replace a walk through each source's whole log.
    """
    last_success = attempts.filter("ok").groupBy("source_id").agg(
        F.max(F.struct("ts", "event_id")).alias("success")
    )
    failing = attempts.filter(~F.col("ok")).join(last_success, "source_id", "left")
    failed_after = failing.filter(
        F.col("success").isNull() | (F.struct("ts", "event_id") > F.col("success"))
    )
    failures = failed_after.groupBy("source_id").agg(
        F.count("*").alias("failures"), F.max("ts").alias("last_failure_at")
    )
    off_until = F.col("last_failure_at") + F.expr(f"INTERVAL {breaker.disable_hours} HOURS")
    return (
        attempts.select("source_id").distinct()
        .join(failures, "source_id", "left")
        .select(
            "source_id",
            F.coalesce("failures", F.lit(0)).alias("failures"),
            F.when(F.col("failures") >= breaker.max_failures, off_until).alias("disabled_until"),
        )
    )


def with_previous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Previous ``value`` of the same key in (ts, event_id) order.

    Rows are ordered inside one key and day; the first row of a day takes the
    last value of the key's previous day, from a table with one row per key and
    day. No task ever orders the whole history of a busy key.
    """
    day = F.to_date("ts")
    dated = rows.withColumn("_day", day)
    in_day = Window.partitionBy(key, "_day").orderBy("ts", "event_id")
    across = Window.partitionBy(key).orderBy("_day")
    day_end = (
        dated.groupBy(key, "_day")
        .agg(F.max_by(value, F.struct("ts", "event_id")).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(across))
        .select(key, "_day", "_carried")
    )
    return (
        dated.withColumn("_n", F.row_number().over(in_day))
        .withColumn("_before", F.lag(value).over(in_day))
        .join(day_end, [key, "_day"])
        .withColumn("previous", F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_before")))
        .drop("_day", "_n", "_before", "_carried")
    )


def with_fetch_state(addresses: DataFrame, state: DataFrame) -> DataFrame:
    """Addresses with the etag and last-modified value their next request should carry."""
    return addresses.join(state.select("url", "etag", "last_modified"), "url", "left")


def fetch_changes(fetches: DataFrame) -> DataFrame:
    """Per address: fetches, how many found the same version, when it last changed."""
    compared = with_previous(fetches, "url", "etag")
    same = F.col("previous").isNotNull() & (F.col("previous") == F.col("etag"))
    return compared.groupBy("url").agg(
        F.count("*").alias("n_fetches"),
        F.count_if(same).alias("n_unchanged"),
        F.max(F.when(~same, F.col("ts"))).alias("last_changed_at"),
        F.max_by("etag", F.struct("ts", "event_id")).alias("last_etag"),
    )


# --- discovery ----------------------------------------------------------------------------------


def source_verdicts(crawl: DataFrame) -> DataFrame:
    """How a source can be read: rss, sitemap, scrape, or not at all (blocked, error)."""
    per_host = crawl.groupBy("host").agg(
        F.max("feed_items").alias("feed_items"),
        F.max("news_entries").alias("news_entries"),
        F.min_by("homepage_status", "page_id").alias("homepage_status"),
        F.min_by("robots_state", "page_id").alias("robots_state"),
        F.count("*").alias("n_probes"),
    )
    status = F.col("homepage_status")
    verdict = (
        F.when(F.col("robots_state") == "blocked", "blocked")
        .when(F.col("robots_state") == "error", "error")
        .when(F.col("feed_items") > 0, "rss")
        .when(F.col("news_entries") > 0, "sitemap")
        .when(status.isin(403, 429), "blocked")
        .when(status < 400, "scrape")
        .otherwise("error")
    )
    return per_host.withColumn("verdict", verdict)


def choose_feeds(feeds: DataFrame, limit: int = P.FEEDS_PER_SOURCE) -> DataFrame:
    """Feeds(source, url, item_count): the shallowest, then the fullest; no comment feeds."""
    usable = feeds.filter(
        (F.col("item_count") > 0) & ~U.is_comment_feed(F.col("url"))
    ).withColumn("depth", U.path_depth(F.col("url")))
    order = Window.partitionBy("source").orderBy("depth", F.desc("item_count"), "url", "feed_id")
    return usable.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)

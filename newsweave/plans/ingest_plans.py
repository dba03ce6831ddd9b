"""Ingest, dedup, state and discovery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.functions import text as X, urls as U
from newsweave.operators import ingest as I, topics as TP
from newsweave.plans import views as V
from newsweave.plans.registry import plan
from newsweave.sources import pages as PG

KNOWN_URLS = f"SELECT DISTINCT {V.canonical('url')} AS canonical FROM v_known"
V.VIEWS["v_clean"] = f"""
SELECT doc_id, source_id, {V.canonical('url')} AS canonical_url, {V.strip_html('title')} AS title,
  {V.strip_html('summary')} AS summary, content, channel_rank, seq,
  CASE WHEN published_s <= {V.NOW + V.DAY} THEN published_s END AS published_s
FROM v_candidates
"""
V.VIEWS["v_hashed"] = f"""
SELECT doc_id, source_id, sha256(lower({V.canonical('url')})) AS url_hash,
  {V.content_hash('title', 'content')} AS content_hash, fetched_s,
  CASE WHEN published_s <= {V.NOW + V.DAY} THEN published_s END AS published_s FROM v_items
"""


def hashed(c):
    valid = I.T.reject_future(F.col("published_at"), c.now)
    return c.items.select(
        "doc_id",
        "source_id",
        U.url_fingerprint(U.canonical_url(F.col("url"))).alias("url_hash"),
        X.content_fingerprint(F.col("title"), F.col("content")).alias("content_hash"),
        "fetched_at",
        valid.alias("published_at"),
    )


def stored_and_new(c):
    rows = hashed(c)
    return (
        rows.filter(F.col("fetched_at") < c.known_until),
        rows.filter(F.col("fetched_at") >= c.known_until),
    )


@plan(
    "channel_fallback",
    """SELECT source_id, channel_rank, count(*) AS n FROM (
      SELECT *, min(channel_rank) OVER (PARTITION BY source_id) AS best FROM v_candidates)
    WHERE channel_rank = best GROUP BY 1, 2""",
)
def channel_fallback(c):
    kept = I.channel_fallback(c.candidates)
    return kept.groupBy("source_id", F.col("channel_rank").cast("bigint").alias("channel_rank")).agg(
        F.count("*").alias("n")
    )


@plan(
    "candidates_last_wins",
    """SELECT canonical_url, doc_id, seq, title, published_s FROM v_clean
    QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY seq DESC) = 1""",
)
def candidates_last_wins(c):
    kept = I.last_wins(I.normalize_candidates(c.candidates.drop("content"), c.now))
    return kept.select(
        "canonical_url", "doc_id", "seq", "title", F.unix_timestamp("published_at").alias("published_s")
    )


@plan(
    "batch_content_dedup",
    """SELECT source_id, content_hash, doc_id FROM v_hashed
    QUALIFY row_number() OVER (PARTITION BY source_id, content_hash
      ORDER BY coalesce(published_s, 0) DESC, doc_id) = 1""",
)
def batch_content_dedup(c):
    return I.batch_content_dedup(hashed(c)).select("source_id", "content_hash", "doc_id")


@plan(
    "new_urls",
    f"""SELECT doc_id, {V.canonical('url')} AS canonical FROM v_new
    WHERE {V.canonical('url')} NOT IN ({KNOWN_URLS})""",
)
def new_urls(c):
    canonical = U.canonical_url(F.col("url")).alias("canonical")
    return I.new_only(
        c.new.select("doc_id", canonical), c.known.select(canonical), ["canonical"]
    ).select("doc_id", "canonical")


@plan(
    "new_content",
    f"""SELECT h.doc_id, h.source_id, h.content_hash FROM v_hashed h
    WHERE h.fetched_s >= {V.KNOWN_UNTIL} AND NOT EXISTS (SELECT 1 FROM v_hashed k
      WHERE k.fetched_s < {V.KNOWN_UNTIL} AND k.source_id = h.source_id AND k.content_hash = h.content_hash)""",
)
def new_content(c):
    stored, new = stored_and_new(c)
    return I.new_only(new, stored, ["source_id", "content_hash"]).select(
        "doc_id", "source_id", "content_hash"
    )


@plan(
    "insert_dedup_counts",
    # The rows one after the other, each against what is stored and what went in before it.
    f"""WITH RECURSIVE k AS (SELECT url_hash, concat(source_id, '/', content_hash) AS content FROM v_hashed WHERE fetched_s < {V.KNOWN_UNTIL}),
    n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS step, url_hash NOT IN (SELECT url_hash FROM k) AND content NOT IN (SELECT content FROM k) AS fresh
      FROM (SELECT *, concat(source_id, '/', content_hash) AS content FROM v_hashed WHERE fetched_s >= {V.KNOWN_UNTIL})),
    walk(step, urls, contents, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false
      UNION ALL SELECT n.step, CASE WHEN ok THEN list_append(urls, url_hash) ELSE urls END, CASE WHEN ok THEN list_append(contents, content) ELSE contents END, ok
      FROM (SELECT n.*, w.urls, w.contents, n.fresh AND NOT list_contains(w.urls, n.url_hash) AND NOT list_contains(w.contents, n.content) AS ok
        FROM walk w JOIN n ON n.step = w.step + 1) n)
    SELECT n.source_id, count(*) FILTER (WHERE w.kept) AS inserted, count(*) FILTER (WHERE NOT w.kept) AS duplicates
    FROM n JOIN walk w ON w.step = n.step GROUP BY 1""",
)
def insert_dedup_counts(c):
    stored, new = stored_and_new(c)
    added = I.insert_ignore(new, stored).groupBy("source_id").agg(F.count("*").alias("inserted"))
    offered = new.groupBy("source_id").agg(F.count("*").alias("offered"))
    inserted = F.coalesce("inserted", F.lit(0))
    return offered.join(added, "source_id", "left").select(
        "source_id", inserted.alias("inserted"), (F.col("offered") - inserted).alias("duplicates")
    )


@plan(
    "newest_n_per_source",
    """SELECT doc_id, source_id, row_number() OVER (PARTITION BY source_id
      ORDER BY published_s DESC NULLS LAST, doc_id) AS rank FROM v_items QUALIFY rank <= 25""",
)
def newest_n_per_source(c):
    return I.newest_per_source(c.items.select("doc_id", "source_id", "published_at")).select(
        "doc_id", "source_id", F.col("rank").cast("bigint").alias("rank")
    )


@plan(
    "newest_per_source",
    "SELECT source_id, max(item_s) AS newest_s, count(published_s) AS n_dated FROM v_timed GROUP BY 1",
)
def newest_per_source(c):
    return c.timed.groupBy("source_id").agg(
        F.unix_timestamp(F.max("item_at")).alias("newest_s"),
        F.count("published_at").alias("n_dated"),
    )


_BLOCKWORDS = V.n_words("block")
_PAGE_TEXT = (
    "trim(regexp_replace(CASE WHEN e > 0 THEN ltrim(substr(block, least(250, length(block)) - e + 2)) "
    "ELSE block END, '(?i)^[0-9]+ +komentar[ai]?([^a-z0-9_][ :.-]*|$)', ''))"
)


@plan(
    "item_rows",
    f"""WITH p AS (SELECT page_id AS doc_id, {_PAGE_TEXT} AS body FROM (SELECT *, instr(reverse(left(block, 250)), '»') AS e FROM v_page_text)),
    j AS (SELECT i.doc_id, i.title, i.summary, p.body, coalesce(p.body <> '' AND {V.n_words('p.body')} >= 60, false) AS enough
      FROM v_items i LEFT JOIN p USING (doc_id)),
    r AS (SELECT doc_id, title, CASE WHEN enough THEN body ELSE coalesce(summary, '') END AS text, enough FROM j)
    SELECT doc_id, title, {V.n_words('text')} AS word_count, {V.content_hash('title', 'text')} AS content_hash,
      CASE WHEN text = '' THEN 'none' WHEN enough THEN 'readability' ELSE 'feed' END AS extraction
    FROM r WHERE trim(title) <> '' AND (text <> '' OR length(title) >= 15)""",
)
def item_rows(c):
    pages = PG.extract_articles(c.spread("pages").select("page_id", "url", "html"), c.now).select(
        F.col("page_id").alias("doc_id"),
        F.col("text").alias("page_text"),
        F.col("method").alias("page_method"),
        F.lit(None).cast("string").alias("page_title"),
    )
    rows = I.build_rows(
        c.items.select("doc_id", "title", "summary").join(pages, "doc_id", "left")
    )
    return rows.select(
        "doc_id", "title", F.col("word_count").cast("bigint").alias("word_count"),
        "content_hash", "extraction",
    )


@plan(
    "crawl_policy",
    f"""WITH pol AS (SELECT host, '/' AS prefix, true AS allow FROM (SELECT DISTINCT host FROM v_crawl)
      UNION ALL SELECT DISTINCT {V.url_host('url')}, regexp_extract({V.url_path('url')}, '^/[^/]*/'), length({V.url_host('url')}) % 2 = 0 FROM pages),
    m AS (SELECT c.page_id, max_by(pol.allow, length(pol.prefix)) AS allow FROM v_crawl c
      JOIN pol ON pol.host = c.host AND starts_with({V.url_path('c.url')}, pol.prefix) GROUP BY 1)
    SELECT page_id AS doc_id, coalesce(allow, true) AS allowed FROM v_crawl LEFT JOIN m USING (page_id)""",
)
def crawl_policy(c):
    url = F.col("url")
    hosts = c.crawl.select("host", "url")
    rules = (
        hosts.select("host", F.lit("/").alias("path_prefix"), F.lit(True).alias("allow"))
        .unionByName(
            hosts.select(
                "host",
                F.regexp_extract(U.path(url), "^/[^/]*/", 0).alias("path_prefix"),
                (F.length("host") % 2 == 0).alias("allow"),
            )
        )
        .distinct()
    )
    items = c.crawl.select(F.col("page_id").alias("doc_id"), "url")
    return I.apply_crawl_policy(items, rules).select("doc_id", "allowed")


@plan(
    "runnable_sources",
    f"SELECT source_id, angle, homepage FROM v_sources WHERE disabled_until_s IS NULL OR disabled_until_s <= {V.NOW}",
)
def runnable_sources(c):
    return I.runnable_sources(c.sources, c.now).select("source_id", "angle", "homepage")


@plan(
    "items_by_angle",
    "SELECT angle, count(*) AS n, count(DISTINCT source_id) AS n_sources FROM v_items GROUP BY 1",
)
def items_by_angle(c):
    labelled = I.with_angle(c.items.select("doc_id", "source_id"), c.sources)
    return (
        labelled.groupBy("angle", "source_id").agg(F.count("*").alias("n"))
        .groupBy("angle")
        .agg(F.sum("n").alias("n"), F.count("*").alias("n_sources"))
    )


def _multi(title: str) -> str:
    parts = f"list_transform(string_split({title}, ';'), lambda p: {V.collapse('p')})"
    return f"(len({parts}) > 1 AND len(list_filter({parts}, lambda p: len(string_split(p, ' ')) < 4)) = 0)"


@plan(
    "cluster_input",
    f"""SELECT doc_id, source_id, title, fetched_s FROM v_items
    WHERE fetched_s >= {V.NOW - 36 * 3600} AND fetched_s <= {V.NOW} AND length(title) >= 20 AND NOT {_multi('title')}
      AND doc_id NOT IN (SELECT doc_id FROM v_links JOIN v_articles USING (topic_id))""",
)
def cluster_input(c):
    taken = c.links.join(c.articles.select("topic_id"), "topic_id", "left_semi")
    picked = TP.clustering_input(
        c.items.select("doc_id", "source_id", "title", "fetched_at"), taken, c.now
    )
    return picked.select(
        "doc_id", "source_id", "title", F.unix_timestamp("fetched_at").alias("fetched_s")
    )


@plan(
    "recent_items_window",
    f"""SELECT doc_id, source_id, title, fetched_s FROM v_items
    WHERE fetched_s >= {V.NOW - 36 * 3600} AND published_s IS NOT NULL""",
)
def recent_items_window(c):
    start = c.now - F.expr("INTERVAL 36 HOURS")
    return c.items.filter((F.col("fetched_at") >= start) & F.col("published_at").isNotNull()).select(
        "doc_id", "source_id", "title", F.unix_timestamp("fetched_at").alias("fetched_s")
    )


@plan("latest_items", "SELECT doc_id, title, fetched_s FROM v_items ORDER BY fetched_s DESC, doc_id LIMIT 50")
def latest_items(c):
    newest = c.items.orderBy(F.desc("fetched_at"), "doc_id").limit(50)
    return newest.select("doc_id", "title", F.unix_timestamp("fetched_at").alias("fetched_s"))


@plan(
    "storage_snapshot",
    """SELECT count(*) AS n_items, min(fetched_s) AS oldest_s, (SELECT count(*) FROM v_topics) AS n_topics,
    (SELECT count(*) FROM v_articles) AS n_articles, (SELECT count(*) FROM events) AS n_events FROM v_items""",
)
def storage_snapshot(c):
    count = lambda frame, name: frame.agg(F.count("*").alias(name))
    items = c.items.agg(
        F.count("*").alias("n_items"), F.unix_timestamp(F.min("fetched_at")).alias("oldest_s")
    )
    return (
        items.crossJoin(count(c.links.select("topic_id").distinct(), "n_topics"))
        .crossJoin(count(c.articles, "n_articles"))
        .crossJoin(count(c.events, "n_events"))
    )


@plan(
    "ingest_summary",
    """WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS checked, min(ts) AS a, max(ts) AS z,
      count(*) FILTER (WHERE event_type = 'signup') AS unchanged, count(*) FILTER (WHERE event_type = 'view') AS candidates,
      count(*) FILTER (WHERE event_type = 'view' AND value > 50) AS new_urls, count(*) FILTER (WHERE event_type = 'view' AND value > 75) AS extracted,
      count(*) FILTER (WHERE event_type = 'purchase') AS inserted, count(*) FILTER (WHERE event_type = 'click') AS duplicates,
      count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1, 2)
    SELECT day, count(*) AS sources, count(*) FILTER (WHERE candidates > 0 AND user_id % 3 = 0) AS by_sitemap,
      count(*) FILTER (WHERE candidates = 0) AS without_candidates, CAST(sum(checked) AS BIGINT) AS checked, CAST(sum(unchanged) AS BIGINT) AS unchanged,
      CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(new_urls) AS BIGINT) AS new_urls, CAST(sum(extracted) AS BIGINT) AS extracted,
      CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(errors) AS BIGINT) AS errors,
      CAST(floor(epoch(max(z))) - floor(epoch(min(a))) AS BIGINT) AS seconds FROM l GROUP BY 1""",
)
def ingest_summary(c):
    """Events stand for fetches: a user is a source, a day a run, an event's type what the fetch found."""
    kind, value = F.col("event_type"), F.col("value")
    log = c.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("source_id")).agg(
        F.count("*").alias("checked"),
        F.count_if(kind == "signup").alias("unchanged"),
        F.count_if(kind == "view").alias("candidates"),
        F.count_if((kind == "view") & (value > 50)).alias("new_urls"),
        F.count_if((kind == "view") & (value > 75)).alias("extracted"),
        F.count_if(kind == "purchase").alias("inserted"),
        F.count_if(kind == "click").alias("duplicates"),
        F.count_if(kind == "error").alias("errors"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("finished_at"),
    )
    channel = F.when(F.col("candidates") == 0, "none").when(F.col("source_id") % 3 == 0, "sitemap").otherwise("feed")
    return I.run_totals(log.withColumn("channel", channel), "day")


@plan(
    "breaker_replay",
    """WITH s AS (SELECT source_id, max((ts, event_id)) AS success FROM v_attempts WHERE ok GROUP BY 1),
    f AS (SELECT a.source_id, count(*) AS failures, max(ts) AS last_at FROM v_attempts a LEFT JOIN s USING (source_id)
      WHERE NOT a.ok AND (s.success IS NULL OR (a.ts, a.event_id) > s.success) GROUP BY 1)
    SELECT d.source_id, coalesce(failures, 0) AS failures,
      CASE WHEN failures >= 3 THEN CAST(floor(epoch(last_at)) AS BIGINT) + 21600 END AS disabled_until_s
    FROM (SELECT DISTINCT source_id FROM v_attempts) d LEFT JOIN f USING (source_id)""",
)
def breaker_replay(c):
    return I.breaker_state(c.attempts).select(
        "source_id", "failures", F.unix_timestamp("disabled_until").alias("disabled_until_s")
    )


@plan(
    "unchanged_docs",
    """WITH l AS (SELECT *, lag(etag) OVER (PARTITION BY url ORDER BY ts, event_id) AS previous FROM v_fetches)
    SELECT url, count(*) AS n_fetches, count(*) FILTER (WHERE previous = etag) AS n_unchanged,
      CAST(floor(epoch(max(CASE WHEN previous IS NULL OR previous <> etag THEN ts END))) AS BIGINT) AS last_changed_s,
      max_by(etag, (ts, event_id)) AS last_etag FROM l GROUP BY 1""",
)
def unchanged_docs(c):
    changes = I.fetch_changes(c.fetches)
    return changes.select(
        "url", "n_fetches", "n_unchanged",
        F.unix_timestamp("last_changed_at").alias("last_changed_s"), "last_etag",
    )


@plan(
    "source_verdict",
    """WITH h AS (SELECT host, max(feed_items) AS feed_items, max(news_entries) AS news_entries, count(*) AS n_probes,
      min_by(homepage_status, page_id) AS homepage_status, min_by(robots_state, page_id) AS robots_state
      FROM v_crawl GROUP BY 1)
    SELECT host, n_probes, CASE WHEN robots_state = 'blocked' THEN 'blocked' WHEN robots_state = 'error' THEN 'error'
      WHEN feed_items > 0 THEN 'rss' WHEN news_entries > 0 THEN 'sitemap'
      WHEN homepage_status IN (403, 429) THEN 'blocked' WHEN homepage_status < 400 THEN 'scrape' ELSE 'error' END AS verdict
    FROM h""",
)
def source_verdict(c):
    return I.source_verdicts(c.crawl).select("host", "n_probes", "verdict")


@plan(
    "feed_choice",
    rf"""WITH f AS (SELECT page_id, regexp_extract({V.url_host('url')}, '[^.]*[.][^.]*$') AS source, url, page_id % 9 AS item_count,
      len(list_filter(string_split({V.url_path('url')}, '/'), lambda s: s <> '')) AS depth FROM pages)
    SELECT source, url, depth, item_count, row_number() OVER (PARTITION BY source ORDER BY depth, item_count DESC, url, page_id) AS rank
    FROM f WHERE item_count > 0 AND NOT regexp_matches(url, '(?i)/comments/feed|comments-feed|/feed/comments') QUALIFY rank <= 5""",
)
def feed_choice(c):
    url = F.col("url")
    feeds = c.spread("pages").select(
        F.col("page_id").alias("feed_id"), U.root_domain(url).alias("source"), "url",
        (F.col("page_id") % 9).alias("item_count"),
    )
    chosen = I.choose_feeds(feeds)
    return chosen.select(
        "source", "url", F.col("depth").cast("bigint").alias("depth"), "item_count",
        F.col("rank").cast("bigint").alias("rank"),
    )

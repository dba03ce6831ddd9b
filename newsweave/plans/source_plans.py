"""Queries over documents in the formats the readers take, built from the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsweave import params as P
from newsweave.functions import html as H, text as X, times as T
from newsweave.operators import ingest as I, lifecycle as L, material as M
from newsweave.plans import views as V
from newsweave.plans.editorial_plans import _updates, seconds
from newsweave.plans.registry import plan
from newsweave.sinks import work_path, write_report
from newsweave.sources import config, feeds, sitemaps

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ISO_SQL = "strftime(make_timestamp({s} * CAST(1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ')"


def joined(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def escaped(text: Column) -> Column:
    return X.escape_html(text)


# --- feeds and sitemaps ---------------------------------------------------------------------


@plan(
    "feed_items",
    f"""WITH i AS (SELECT doc_id, {V.strip_html('title')} AS title, url, {ISO_SQL.format(s='fetched_s')} AS stamp FROM v_items)
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' ELSE 'rdf' END AS kind, CAST(0 AS BIGINT) AS position, title, url AS link, stamp AS published FROM i
    UNION ALL SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'rss' ELSE 'atom' END, 1, 'drugi', concat('https://drugi.example/', doc_id), NULL FROM i WHERE doc_id % 3 < 2""",
)
def feed_items(c):
    """A feed per item: its kind goes by the id; the second entry has only a title and an address."""
    at, title, url = F.date_format("fetched_at", ISO), escaped(F.col("title")), escaped(F.col("url"))
    second = joined("https://drugi.example/", F.col("doc_id"))
    rss = joined(
        "<rss><channel><title>r</title><item><title>", title, "</title><link>", url, "</link><pubDate>", at,
        '</pubDate></item><item><title>drugi</title><guid isPermaLink="true">', second, "</guid></item></channel></rss>",
    )
    atom = joined(
        '<feed xmlns="http://www.w3.org/2005/Atom"><title type="text">a</title><entry><title>', title,
        '</title><link rel="self" href="x"/><link rel="alternate" href="', url, '"/><updated>', at,
        '</updated></entry><entry><title>drugi</title><link href="', second, '"/></entry></feed>',
    )
    rdf = joined(
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/">'
        "<channel><title>d</title></channel><item><title>", title, "</title><link>", url, "</link><dc:date>", at,
        "</dc:date></item></rdf:RDF>",
    )
    kind = F.col("doc_id") % 3
    body = F.when(kind == 0, rss).when(kind == 1, atom).otherwise(rdf)
    documents = c.items.select("doc_id", body.alias("body"), F.lit("text/xml").alias("content_type"))
    return feeds.feed_items(documents).select(
        "doc_id", "kind", F.col("position").cast("bigint").alias("position"), "title", "link", "published"
    )


def urlset(*entries: tuple) -> Column:
    parts: list = ['<urlset xmlns:news="http://www.google.com/schemas/sitemap-news/0.9">']
    for loc, lastmod, title in entries:
        news = () if title is None else ("<news:news><news:title>", title, "</news:title></news:news>")
        parts += ["<url><loc>", loc, "</loc><lastmod>", lastmod, "</lastmod>", *news, "</url>"]
    return joined(*parts, "</urlset>")


@plan(
    "sitemap_entries",
    f"""WITH i AS (SELECT doc_id, url, {V.collapse('title')} AS title, {ISO_SQL.format(s='fetched_s')} AS stamp FROM v_items)
    SELECT doc_id, 'urlset' AS kind, CAST(0 AS BIGINT) AS position, url AS loc, title, stamp AS published FROM i WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 'urlset', 1, concat('https://d.example/', doc_id), NULL, stamp FROM i WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 'index', 0, concat('https://d.example/', doc_id, '.xml'), NULL, stamp FROM i WHERE doc_id % 2 = 1""",
)
def sitemap_entries(c):
    at, own = F.date_format("fetched_at", ISO), joined("https://d.example/", F.col("doc_id"))
    plain = urlset((escaped(F.col("url")), at, escaped(X.collapse_whitespace(F.col("title")))), (own, at, None))
    index = joined("<sitemapindex><sitemap><loc>", own, ".xml</loc><lastmod>", at, "</lastmod></sitemap></sitemapindex>")
    documents = c.items.select("doc_id", F.when(F.col("doc_id") % 2 == 0, plain).otherwise(index).alias("body"))
    return sitemaps.sitemap_entries(documents).select(
        "doc_id", "kind", F.col("position").cast("bigint").alias("position"), "loc", "title", "published"
    )


@plan(
    "sitemap_children",
    """WITH s AS (SELECT concat('https://', source_id, '.example/') AS base FROM v_sources),
    d AS (SELECT base, unnest(['news-1', 'vesti-2', 'sam']) AS name FROM s)
    SELECT concat(base, name, '.xml') AS url, CASE WHEN name <> 'sam' THEN concat(base, 'index.xml') END AS index_url,
      concat(base, name, '/1') AS loc FROM d""",
)
def sitemap_children(c):
    """Per source an index of four sitemaps, two of which are read, and one sitemap that no index lists."""
    base = c.sources.select(joined("https://", F.col("source_id"), ".example/").alias("base"))
    names = ["news-1", "about", "vesti-2", "latest-3"]
    listed = joined("<sitemapindex>", *[p for n in names for p in ("<sitemap><loc>", F.col("base"), f"{n}.xml</loc></sitemap>")], "</sitemapindex>")
    index = base.select(joined(F.col("base"), "index.xml").alias("url"), listed.alias("body"))
    child = base.select("base", F.explode(F.array(*map(F.lit, [*names, "sam"]))).alias("name"))
    entry = urlset((joined(F.col("base"), F.col("name"), "/1"), F.lit("2026-01-01"), None))
    children = child.select(joined(F.col("base"), F.col("name"), ".xml").alias("url"), entry.alias("body"))
    return sitemaps.expand_indexes(index.unionByName(children)).select("url", "index_url", "loc")


# --- pages ------------------------------------------------------------------------------------


@plan(
    "feed_links",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site FROM pages)
    SELECT page_id, concat(site, '/feed/', page_id) AS feed FROM p UNION ALL SELECT page_id, concat('https://atom.example/', page_id) FROM p""",
)
def feed_links(c):
    number = F.col("page_id")
    head = joined(
        "<link rel='alternate' type='application/rss+xml' href='/feed/", number, "'>",
        '<link type="application/atom+xml" rel="alternate" href="https://atom.example/', number, '#x">',
        '<link rel="alternate" hreflang="en" href="/en"><link rel="alternate" type="application/rss+xml" href="/feed/', number, '">',
    )
    pages = c.spread("pages").select("page_id", "url", F.concat(head, F.col("html")).alias("html"))
    return pages.select("page_id", F.explode(H.feed_links(F.col("html"), F.col("url"))).alias("feed"))


@plan(
    "meta_fields",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('naslov ', page_id) ELSE concat('drugi ', page_id) END AS title,
    CASE WHEN page_id % 3 = 0 THEN concat('opis ', page_id) END AS description, concat('autor & ', page_id) AS author FROM pages""",
)
def meta_fields(c):
    number = F.col("page_id")
    head = joined(
        '<META name="twitter:title" content="drugi ', number, '"><meta itemprop=author content="autor &amp; ', number, '">',
        F.when(number % 2 == 0, joined("<meta content='naslov ", number, "' property='og:title'/>")).otherwise("<meta property='og:title' content=' '>"),
        F.when(number % 3 == 0, joined('<meta name="description" content="opis ', number, '">')).otherwise(""),
    )
    metas = c.spread("pages").select("page_id", H.meta_tags(F.concat(head, F.col("html"))).alias("m"))
    one = lambda *names: H.meta_content(F.col("m"), names)
    return metas.select(
        "page_id", one("og:title", "twitter:title").alias("title"), one("description").alias("description"),
        one("article:author", "author").alias("author"),
    )


@plan(
    "jsonld_fields",
    f"SELECT doc_id, md5({V.strip_html('text')}) AS body_md5, concat('2026-01-0', 1 + doc_id % 9) AS published FROM documents",
)
def jsonld_fields(c):
    """The text as linked data, inside as many graphs as the id says."""
    article = F.to_json(
        F.struct(
            F.lit("NewsArticle").alias("@type"), F.col("text").alias("articleBody"),
            joined("2026-01-0", 1 + F.col("doc_id") % 9).alias("datePublished"),
        )
    )
    node = article
    deep = [node]
    for _ in range(4):
        node = joined('{"@graph": [{"@type": "Organization"}, [', node, "]]}")
        deep.append(node)
    body = F.element_at(F.array(*deep), (F.col("doc_id") % 5 + 1).cast("int"))
    safe = F.regexp_replace(body, "</script", "<\\\\/script")
    pages = c.spread("documents").select(
        "doc_id", joined('<script type="application/ld+json">', safe, "</script>").alias("html")
    )
    nodes = H.jsonld_nodes(F.col("html"))
    found = pages.select("doc_id", nodes.alias("nodes"))
    return found.select(
        "doc_id", F.md5(H.article_body(F.col("nodes"))).alias("body_md5"), H.linked_date(F.col("nodes")).alias("published")
    )


# --- configuration ---------------------------------------------------------------------------


def config_path(c) -> str:
    """A configuration file of all sources, on the shared work folder."""
    n, source = F.col("n"), F.col("source_id")
    entry = F.struct(
        source.alias("id"),
        F.upper(source).alias("name"),
        F.col("homepage"),
        F.col("angle"),
        (n % 6 != 0).alias("enabled"),
        F.when(n % 2 == 0, F.array(F.concat(F.col("homepage"), F.lit("feed")))).otherwise(F.array().cast("array<string>")).alias("feeds"),
        F.when(n % 3 == 0, F.array(F.concat(F.col("homepage"), F.lit("news.xml")))).alias("newsSitemaps"),
        F.when(
            n % 5 == 0,
            F.struct(F.array("homepage").alias("listingUrls"), F.lit("^/vest").alias("linkPattern"), F.lit(10).alias("maxLinksPerRun")),
        ).alias("scrape"),
    )
    path = work_path(c.spark, "sources-config")
    whole = c.sources.agg(F.array_sort(F.collect_list(entry)).alias("sources"))
    whole.select(F.to_json(F.struct(F.lit(1).alias("version"), "sources")).alias("value")).coalesce(1).write.text(path)
    return path


V.VIEWS["v_config"] = """
SELECT source_id AS id, upper(source_id) AS name, angle, homepage, n % 6 <> 0 AS enabled, (n % 2 = 0)::BIGINT AS n_feeds,
  (n % 3 = 0)::BIGINT AS n_sitemaps, n % 5 = 0 AS scraped FROM v_sources
"""


@plan("source_rows", "SELECT id, name, angle, homepage, enabled, n_feeds, n_sitemaps, scraped FROM v_config")
def source_rows(c):
    return config.read_sources(c.spark, config_path(c)).select(
        "id", "name", "angle", "homepage", "enabled", F.size("feeds").cast("bigint").alias("n_feeds"),
        F.size("news_sitemaps").cast("bigint").alias("n_sitemaps"), F.col("scrape").isNotNull().alias("scraped"),
    )


@plan("active_sources", "SELECT id FROM v_config WHERE enabled AND (n_feeds > 0 OR n_sitemaps > 0 OR scraped)")
def active_sources(c):
    return config.active_sources(config.read_sources(c.spark, config_path(c))).select("id")


@plan(
    "source_sync",
    """SELECT c.id, c.name, c.angle, c.homepage, c.enabled, CASE WHEN s.n % 4 <> 0 THEN s.disabled_until_s END AS disabled_until_s
    FROM v_config c JOIN v_sources s ON s.source_id = c.id""",
)
def source_sync(c):
    """Stored sources with old names; those divisible by four are not stored yet."""
    stored = c.sources.filter("n % 4 <> 0").select(
        F.col("source_id").alias("id"), F.lit("staro").alias("name"), F.lit("x").alias("angle"), F.lit("x").alias("homepage"),
        F.lit(False).alias("enabled"), "disabled_until",
    )
    synced = config.sync_sources(stored, config.read_sources(c.spark, config_path(c)))
    return synced.select("id", "name", "angle", "homepage", "enabled", seconds("disabled_until").alias("disabled_until_s"))


# --- dates and fetch state ----------------------------------------------------------------------


@plan("feed_dates", "SELECT doc_id, CASE WHEN doc_id % 7 <> 6 THEN fetched_s END AS at_s FROM v_items")
def feed_dates(c):
    at = F.col("fetched_at")
    form = F.col("doc_id") % 7
    written = (
        F.when(form == 0, F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss Z"))
        .when(form == 1, F.date_format(at, "EEE, d MMM yyyy HH:mm:ss 'GMT'"))
        .when(form == 2, F.date_format(at, "d MMM yyyy HH:mm:ss"))
        .when(form == 3, F.date_format(at, ISO))
        .when(form == 4, F.date_format(at + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(form == 5, F.date_format(at - F.expr("INTERVAL 5 HOURS"), "dd MMM yyyy  HH:mm:ss '-0500'"))
        .otherwise(F.concat(F.lit("juče "), F.date_format(at, "HH:mm")))
    )
    return c.items.select("doc_id", seconds(T.parse_feed_date(written)).alias("at_s"))


@plan(
    "fetch_state",
    """WITH last AS (SELECT url, max_by(etag, (ts, event_id)) AS etag, CAST(floor(epoch(max(ts))) AS BIGINT) AS at_s FROM v_fetches GROUP BY 1),
    a AS (SELECT DISTINCT concat('https://site', user_id, '.example/', p) AS url FROM events, (SELECT unnest(['feed', 'atom']) AS p))
    SELECT a.url, last.etag, last.at_s AS last_modified FROM a LEFT JOIN last USING (url)""",
)
def fetch_state(c):
    """Addresses of all sites' two feeds, with what their next request should carry."""
    order = F.struct("ts", "event_id")
    state = c.fetches.groupBy("url").agg(F.max_by("etag", order).alias("etag"), seconds(F.max("ts")).alias("last_modified"))
    site = c.events.select("user_id").distinct()
    both = F.array(*[joined("https://site", F.col("user_id"), f".example/{p}") for p in ("feed", "atom")])
    addresses = site.select(F.explode(both).alias("url"))
    return I.with_fetch_state(addresses, state)


# --- batches, updates, marks and reports ----------------------------------------------------------


@plan("response_topics", "SELECT custom_id, topic_id, result_type FROM v_batches WHERE topic_id % 3 <> 0")
def response_topics(c):
    """Answers find their topic through the maps of the batches that asked."""
    batches = M.request_batches(c.batches.select("topic_id", "custom_id", "model"), 20)
    named = batches.withColumn("batch_id", joined(F.col("model"), "-", F.col("batch_no")))
    where = named.select("batch_id", F.explode("topic_map").alias("custom_id", "_topic"))
    answers = c.batches.filter("topic_id % 3 <> 0").select("custom_id", "result_type").join(where.drop("_topic"), "custom_id")
    return M.responses_with_topic(named, answers).select("custom_id", "topic_id", "result_type")


@plan(
    "article_updates",
    """SELECT 'new' AS side, a.article_id, a.revision + (u.article_id IS NOT NULL)::INT AS revision,
      CASE WHEN u.article_id IS NOT NULL THEN concat('nova verzija ', u.new_items) ELSE a.title END AS title
    FROM v_articles a LEFT JOIN v_updates u USING (article_id)
    UNION ALL SELECT 'old', a.article_id, a.revision, a.title FROM v_articles a JOIN v_updates u USING (article_id)""",
)
def article_updates(c):
    """Each article that gathered evidence is updated; two updates are offered and the later one counts."""
    found = _updates(c).select("article_id", "new_items")
    offered = found.select("article_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("at"), "new_items")
    updates = offered.select(
        "article_id", F.when(F.col("at") == 2, joined("nova verzija ", F.col("new_items"))).otherwise("međuverzija").alias("title"),
        F.lit("uvod").alias("lead"), F.lit("telo").alias("body"), F.lit(0.01).alias("cost_usd"), F.lit("novi izvori").alias("reason"), "at",
    )
    articles = c.costed.select(
        "article_id", "revision", "title", "lead", "body", F.col("total_cost").cast("double").alias("cost_usd"), "last_update_at"
    )
    history = articles.limit(0).select("article_id", "revision", "title", "lead", "body", F.lit("").alias("reason"), "cost_usd")
    new, old = L.apply_article_updates(articles, updates, history, c.now, F.col("at"))
    rows = lambda frame, side: frame.select(F.lit(side).alias("side"), "article_id", F.col("revision").cast("bigint"), "title")
    return rows(new, "new").unionByName(rows(old, "old"))


@plan(
    "mark_covered",
    """SELECT topic_id, CASE WHEN article_id IS NOT NULL THEN 'covered' ELSE 'open' END AS status,
    CASE WHEN article_id IS NOT NULL THEN false ELSE needs_flagship END AS needs_flagship FROM v_topics""",
)
def mark_covered(c):
    stored = c.topics.select("topic_id", F.lit("open").alias("status"), "needs_flagship")
    written = c.articles.select("topic_id")
    return L.set_columns(stored, written, "topic_id", {"status": F.lit("covered"), "needs_flagship": F.lit(False)})


@plan(
    "run_log",
    f"""SELECT 'ingest' AS command, true AS ok, count(*) AS offered, count(*) FILTER (WHERE event_type = 'purchase') AS inserted,
    least(50, count(*) FILTER (WHERE event_type = 'error')) AS n_errors FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00'""",
)
def run_log(c):
    """The log row of the last day's run; of its errors fifty messages are kept."""
    last = c.events.filter("ts >= TIMESTAMP '2024-01-30 00:00:00'")
    totals = last.agg(F.count("*").alias("offered"), F.count_if(F.col("event_type") == "purchase").alias("inserted")).first().asDict()
    failed = last.filter("event_type = 'error'").orderBy("event_id").limit(60).select("event_id").collect()
    run = L.close_run(L.open_run(c.spark, "ingest", c.now), True, totals, [f"događaj {r['event_id']}" for r in failed], c.now)
    count = lambda key: F.col("stats")[key].cast("bigint").alias(key)
    return run.select("command", "ok", count("offered"), count("inserted"), F.size("errors").cast("bigint").alias("n_errors"))


@plan(
    "discovery_report",
    """WITH h AS (SELECT host, max(feed_items) AS f, max(news_entries) AS e, min_by(homepage_status, page_id) AS s, min_by(robots_state, page_id) AS r
      FROM v_crawl GROUP BY 1)
    SELECT host, CASE WHEN r = 'blocked' THEN 'blocked' WHEN r = 'error' THEN 'error' WHEN f > 0 THEN 'rss' WHEN e > 0 THEN 'sitemap'
      WHEN s IN (403, 429) THEN 'blocked' WHEN s < 400 THEN 'scrape' ELSE 'error' END AS verdict, f AS feed_items FROM h""",
)
def discovery_report(c):
    """The report as it is written, one folder per verdict, and read again."""
    path = work_path(c.spark, "discovery")
    write_report(I.source_verdicts(c.crawl), path, "verdict")
    return c.spark.read.schema("host STRING, feed_items BIGINT, verdict STRING").json(path).select("host", "verdict", "feed_items")


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.ANGLE_LABELS.items())


@plan(
    "update_prompts",
    rf"""WITH m AS (SELECT v.*, u.title_sample AS topic_title FROM v_members v JOIN v_updates u USING (topic_id) WHERE v.added_s > u.since_s),
    r AS (SELECT *, {V.n_words('content')} AS word_count FROM m),
    k AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY word_count DESC, doc_id) AS rank FROM r),
    s AS (SELECT topic_id, any_value(topic_title) AS topic_title, string_agg(concat('## Novi izveštaj ', rank, ' — ', CASE angle {_LABELS} END, chr(10),
        'Objavljeno: ', strftime(make_timestamp(item_s * CAST(1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.000Z'), chr(10), chr(10),
        'Naslov: ', {V.collapse('title')}, CASE WHEN content <> '' THEN concat(chr(10), chr(10), left({V.collapse('content')}, 1600)) ELSE '' END, chr(10)),
        chr(10) ORDER BY rank) FILTER (WHERE rank <= 8) AS reports, count(*) AS n_reports FROM k GROUP BY 1)
    SELECT s.topic_id, s.n_reports, md5(regexp_replace(concat('# Dopuna već objavljenog članka', chr(10), chr(10), 'Tema: ', s.topic_title, chr(10), chr(10),
      '## Članak koji se dopunjuje (verzija ', a.revision, ')', chr(10), chr(10), 'Naslov: ', a.title, chr(10), chr(10), 'Uvod: ', a.lead, chr(10), chr(10),
      a.body, chr(10), chr(10), 'Sledi ', s.n_reports, ' NOVIH izveštaja koji su stigli posle te verzije. Ugradi ono što je stvarno novo, po pravilima za dopunu. Vrati ceo članak, ne samo izmene.',
      chr(10), chr(10), s.reports), '^{V.WS}+|{V.WS}+$', '', 'g')) AS message_md5
    FROM s JOIN v_articles a USING (topic_id)""",
)
def update_prompts(c):
    """Requests to extend articles with the reports that came after their last version."""
    due = _updates(c).select("topic_id", "title_sample", "since")
    members = (
        c.members.join(due.select("topic_id", "since"), "topic_id")
        .filter(F.col("added_at") > F.col("since"))
        .withColumn("word_count", X.count_words(F.col("content")))
    )
    none = F.array().cast("array<string>")
    topics = due.select("topic_id", "title_sample", none.alias("keywords"), none.alias("entities"))
    messages = M.prompt_messages(topics, members, c.articles.select("topic_id", "title", "lead", "body", "revision"))
    return messages.select("topic_id", "n_reports", F.md5("message").alias("message_md5"))

"""Derived news tables as SQL, for the checks.

The shared tables hold no news feed, so the checks and the Spark plans derive
the same item, topic, article and log tables from them; ``corpus.py`` holds
the Spark side. Times are epoch seconds here and timestamps there.
"""

from __future__ import annotations

NOW = 1706659200  # 2024-01-31 00:00:00 UTC
DAY = 86400
KNOWN_UNTIL = 1705363200  # 2024-01-16: everything fetched before is already stored

# Whitespace class of functions.text.WS, in RE2 spelling.
WS = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}+', ' ', 'g'))"


def n_words(expr: str) -> str:
    c = collapse(f"coalesce({expr}, '')")
    return f"CAST(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END AS BIGINT)"


def latin(expr: str) -> str:
    for a, b in (("љ", "lj"), ("њ", "nj"), ("џ", "dž"), ("Љ", "Lj"), ("Њ", "Nj"), ("Џ", "Dž")):
        expr = f"replace({expr}, '{a}', '{b}')"
    return (
        f"translate({expr}, 'абвгдђежзијклмнопрстћуфхцчшАБВГДЂЕЖЗИЈКЛМНОПРСТЋУФХЦЧШ',"
        " 'abvgdđežzijklmnoprstćufhcčšABVGDĐEŽZIJKLMNOPRSTĆUFHCČŠ')"
    )


def fold(expr: str) -> str:
    return (
        f"replace(replace(translate({expr}, 'čćžšČĆŽŠ', 'cczsCCZS'), 'đ', 'dj'), 'Đ', 'Dj')"
    )


def match_key(expr: str) -> str:
    return f"lower({fold(latin(expr))})"


def strip_html(expr: str) -> str:
    e = f"regexp_replace({expr}, '(?is)<script.*?</script>', ' ', 'g')"
    e = f"regexp_replace({e}, '(?is)<style.*?</style>', ' ', 'g')"
    e = f"regexp_replace({e}, '<[^>]+>', ' ', 'g')"
    for entity, char in (
        ("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "''"),
        ("&lt;", "<"), ("&gt;", ">"),
    ):
        e = f"regexp_replace({e}, '(?i){entity}', '{char}', 'g')"
    return collapse(e)


def content_hash(title: str, text: str) -> str:
    joined = f"coalesce({title}, '') || chr(10) || coalesce({text}, '')"
    return (
        f"sha256(regexp_replace(lower({collapse(joined)}), '[^\\p{{L}}\\p{{N}} ]', '', 'g'))"
    )


PARTS = r"^(?i:(https?):)//([^/?#]*)([^?#]*)(\?[^#]*)?"
TRACKING = (
    r"(?i)^(utm_|fbclid$|gclid$|gbraid$|wbraid$|yclid$|msclkid$|igshid$|mc_|_ga$|ref$"
    r"|ref_src$|source$|src$)"
)


def url_host(expr: str) -> str:
    """Host without www., user info and port."""
    e = f"lower(regexp_replace(regexp_extract({expr}, '{PARTS}', 2), '^.*@', ''))"
    return f"regexp_replace(regexp_replace({e}, '^www[.]', ''), ':[0-9]*$', '')"


def url_path(expr: str) -> str:
    return f"regexp_extract({expr}, '{PARTS}', 3)"


def canonical(expr: str) -> str:
    """Canonical form of an absolute address without a port."""
    bare = f"regexp_replace({url_path(expr)}, '/+$', '')"
    pairs = (
        f"list_filter(string_split(regexp_replace(regexp_extract({expr}, '{PARTS}', 4), '^[?]', ''),"
        f" '&'), lambda p: p <> '' AND NOT regexp_matches(regexp_extract(p, '^([^=]*)', 1), '{TRACKING}'))"
    )
    named = f"list_transform({pairs}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)"
    query = f"array_to_string(list_sort({named}), '&')"
    return (
        f"lower(regexp_extract({expr}, '{PARTS}', 1)) || '://' || {url_host(expr)} || "
        f"CASE WHEN {bare} = '' THEN '/' ELSE {bare} END || "
        f"CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"
    )


def half_up(expr: str, decimals: int) -> str:
    k = 10**decimals
    return f"floor(({expr}) * {k} + 0.5) / {k}"


ANGLE = (
    "CASE {n} % 4 WHEN 0 THEN 'provladin' WHEN 1 THEN 'kriticki' WHEN 2 THEN 'mejnstrim' "
    "ELSE 'agencija' END"
)
# Shared by both engines: title, address and times of an item from its document.
HEADLINE = r"substr(regexp_extract(text, '^[^.\n]*', 0), 1, 160)"
TITLE = (
    "concat(CASE WHEN doc_id % 29 = 0 THEN 'UŽIVO: ' ELSE '' END, "
    "CASE WHEN doc_id % 31 = 0 THEN 'Вучић Љубав Џеп ' ELSE '' END, "
    "CASE WHEN doc_id % 23 = 0 THEN concat(headline, '; ', headline) ELSE headline END)"
)
URL = (
    "concat('https://www.portal', CAST(n % 4 AS STRING), '.example/', lang, '/', "
    "CAST(CAST(floor(doc_id / 12) AS BIGINT) AS STRING), '/', "
    "CASE WHEN doc_id % 2 = 0 THEN '?utm_source=x&b=2&a=1' ELSE '#top' END)"
)
FETCHED = "1704067200 + (doc_id * 7919) % 2592000"
PUBLISHED = (
    "CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 41 = 0 THEN fetched_s + 259200 "
    "ELSE fetched_s - doc_id % 1800 END"
)
TOPIC = "doc_id - doc_id % (1 + CAST(floor(doc_id / 60) AS BIGINT) % 6)"

TRENDING = half_up(
    "distinct_sources * (1 + 0.5 * greatest(0, distinct_angles - 1)) * (1 + recent_items / 2) "
    f"* exp(-greatest(0, ({NOW} - last_s) / 3600) / 12)",
    2,
)

VIEWS: dict[str, str] = {}

VIEWS["v_items"] = f"""
SELECT doc_id, source AS source_id, n, {ANGLE.format(n='n')} AS angle, lang, n_chars,
       {TITLE} AS title, substr(text, 1, 200) AS summary, text AS content, {URL} AS url,
       fetched_s, CAST({PUBLISHED} AS BIGINT) AS published_s
FROM (SELECT *, CAST(substr(source, 4) AS INT) AS n, {HEADLINE} AS headline,
             {FETCHED} AS fetched_s FROM documents)
"""

# A publish time more than a day ahead is dropped; the fetch time stands in.
VIEWS["v_timed"] = f"""
SELECT *, coalesce(CASE WHEN published_s <= {NOW + DAY} THEN published_s END, fetched_s) AS item_s
FROM v_items
"""

VIEWS["v_sources"] = f"""
SELECT source_id, any_value(n) AS n, any_value(angle) AS angle,
       concat('https://portal', any_value(n) % 4, '.example/') AS homepage,
       CASE WHEN any_value(n) % 6 = 0 THEN {NOW} + 21600 END AS disabled_until_s
FROM v_items GROUP BY source_id
"""

# Feed and sitemap entries of the same story, before canonicalisation.
VIEWS["v_candidates"] = f"""
SELECT i.doc_id, i.source_id, i.n, i.url, i.title, i.summary, i.published_s, i.content,
       c.channel_rank, i.doc_id * 2 + c.channel_rank AS seq
FROM v_items i CROSS JOIN (VALUES (1), (2), (3)) c(channel_rank)
WHERE (c.channel_rank = 1 AND i.n % 5 <> 0) OR (c.channel_rank = 2 AND i.n % 7 <> 0)
   OR c.channel_rank = 3
"""

VIEWS["v_known"] = f"SELECT * FROM v_items WHERE fetched_s < {KNOWN_UNTIL}"
VIEWS["v_new"] = f"SELECT * FROM v_items WHERE fetched_s >= {KNOWN_UNTIL}"

VIEWS["v_links"] = f"""
SELECT {TOPIC} AS topic_id, doc_id, fetched_s AS added_s FROM documents
JOIN (SELECT doc_id AS d, fetched_s FROM v_items) ON d = doc_id
"""

VIEWS["v_members"] = """
SELECT l.topic_id, l.added_s, t.* FROM v_links l JOIN v_timed t USING (doc_id)
"""

VIEWS["v_rollup"] = f"""
SELECT topic_id, count(*) AS size, count(DISTINCT source_id) AS distinct_sources,
       count(DISTINCT angle) AS distinct_angles,
       array_to_string(list_sort(list(DISTINCT angle)), ',') AS angles,
       min(item_s) AS first_s, max(item_s) AS last_s,
       count(*) FILTER (WHERE item_s >= {NOW} - 21600) AS recent_items,
       min(added_s) AS first_added_s, min_by(title, doc_id) AS title_sample
FROM v_members GROUP BY topic_id
"""

VIEWS["v_scored"] = f"SELECT *, {TRENDING} AS trending_score FROM v_rollup"

# Every topic that passes the gates was written about an hour after it appeared,
# except the newest ones.
VIEWS["v_articles"] = f"""
SELECT topic_id AS article_id, topic_id, first_added_s + 3600 AS created_s,
       CASE WHEN topic_id % 2 = 1 THEN 'flagship' ELSE 'default' END AS model,
       m.input_tokens, 1200 + topic_id % 500 AS output_tokens,
       CASE WHEN topic_id % 7 = 0 THEN 4096 END AS cache_creation_tokens,
       CASE WHEN topic_id % 7 <> 0 THEN 4096 END AS cache_read_tokens,
       CASE WHEN topic_id % 5 <> 0 THEN first_added_s + 7200 + 3600 * (topic_id % 4) END
         AS last_update_s,
       1 + topic_id % 7 AS revision, title_sample AS title, m.lead, m.body,
       coalesce(m.toxic, 0) = 1 AS sensitive,
       CASE WHEN topic_id % 6 <> 0 THEN concat('covers/', topic_id, '.png') END AS cover_url,
       CASE WHEN topic_id % 4 <> 0 THEN first_added_s + 9000 END AS cover_s,
       CASE WHEN topic_id % 16 = 0 THEN 'rejected' WHEN coalesce(m.toxic, 0) = 1
         THEN 'pending_review' ELSE 'published' END AS status,
       CASE topic_id % 6 WHEN 0 THEN 'politika' WHEN 1 THEN 'ekonomija' WHEN 2 THEN 'drustvo'
         WHEN 3 THEN 'sport' WHEN 4 THEN 'region' ELSE 'svet' END AS category
FROM v_rollup JOIN (
  SELECT l.topic_id AS t, CAST(sum(n_chars) AS BIGINT) AS input_tokens,
         max(toxic) AS toxic, min_by(summary, doc_id) AS lead, min_by(content, doc_id) AS body
  FROM v_links l JOIN v_items USING (doc_id) LEFT JOIN labels USING (doc_id) GROUP BY 1
) m ON m.t = topic_id
WHERE size >= 3 AND distinct_sources >= 3 AND distinct_angles >= 2
  AND first_added_s < {NOW} - 43200
"""


def cost(tokens: str, price: str, factor: str = "1", share: str = "1") -> str:
    return (
        f"CAST(CAST(CAST(coalesce({tokens}, 0) AS DECIMAL(14,0)) * CAST({price} AS DECIMAL(4,0)) "
        f"* CAST({factor} AS DECIMAL(4,2)) * CAST({share} AS DECIMAL(3,2)) AS DECIMAL(30,4)) "
        "* CAST(0.000001 AS DECIMAL(6,6)) AS DECIMAL(24,10))"
    )


PRICE_IN = "CASE model WHEN 'flagship' THEN 2 WHEN 'premium' THEN 5 ELSE 1 END"
PRICE_OUT = "CASE model WHEN 'flagship' THEN 10 WHEN 'premium' THEN 25 ELSE 5 END"


def total_cost(share: str = "1") -> str:
    return " + ".join(
        (
            cost("input_tokens", PRICE_IN, "1", share),
            cost("output_tokens", PRICE_OUT, "1", share),
            cost("cache_creation_tokens", PRICE_IN, "1.25", share),
            cost("cache_read_tokens", PRICE_IN, "0.1", share),
        )
    )


VIEWS["v_costed"] = f"SELECT *, {total_cost()} AS total_cost FROM v_articles"

VIEWS["v_topics"] = """
SELECT s.*, a.article_id, s.topic_id % 13 = 0 AS needs_flagship,
       CASE WHEN a.article_id IS NOT NULL THEN 'covered'
            WHEN s.size = 1 AND s.topic_id % 19 = 0 THEN 'rejected' ELSE 'open' END AS status
FROM v_scored s LEFT JOIN v_articles a ON a.topic_id = s.topic_id
"""

VIEWS["v_attempts"] = """
SELECT event_id, user_id AS source_id, event_type <> 'error' AS ok, ts FROM events
"""

VIEWS["v_decisions"] = """
SELECT event_id, user_id AS article_id, ts,
       CASE event_type WHEN 'purchase' THEN concat('odobri:', user_id)
                       WHEN 'error' THEN concat('odbij:', user_id)
                       ELSE concat(event_type, ':', user_id) END AS payload,
       CASE WHEN event_type = 'signup' THEN 'other' ELSE 'desk' END AS chat_id
FROM events
"""

# One review request per article, two weeks into the log.
VIEWS["v_reviews"] = """
SELECT user_id AS article_id, min(ts) + INTERVAL 14 DAY + INTERVAL (user_id % 5) HOUR AS sent_at
FROM events GROUP BY user_id
"""

VIEWS["v_fetches"] = """
SELECT event_id, concat('https://site', user_id, '.example/feed') AS url, ts,
       CAST(floor(value / 25) AS BIGINT) AS etag
FROM events
"""

VIEWS["v_crawl"] = f"""
SELECT page_id, url, {url_host('url')} AS host,
       CASE page_id % 9 WHEN 7 THEN 'blocked' WHEN 8 THEN 'error' WHEN 3 THEN 'missing'
            ELSE 'ok' END AS robots_state,
       CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 404 ELSE 503 END
         AS homepage_status,
       CASE WHEN page_id % 5 = 0 THEN page_id % 9 ELSE 0 END AS feed_items,
       CASE WHEN page_id % 3 = 0 THEN page_id % 4 ELSE 0 END AS news_entries
FROM pages
"""

VIEWS["v_batches"] = """
SELECT topic_id, topic_id % 10 AS batch_id, concat('tema-', topic_id) AS custom_id, model,
       input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens,
       CASE topic_id % 8 WHEN 1 THEN 'errored' WHEN 2 THEN 'expired' WHEN 3 THEN 'canceled'
            ELSE 'succeeded' END AS result_type,
       CASE WHEN topic_id % 16 = 1 THEN 'invalid_request' ELSE 'overloaded' END AS error_type,
       topic_id % 8 <> 5 AS schema_ok,
       topic_id % 10 < 5 AS submitted
FROM v_articles
"""

"""Text, URL, date and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.functions import html as H, text as X, times as T, urls as U
from newsweave.plans import views as V
from newsweave.plans.registry import plan
from newsweave.sources import pages as PG

HEAD = "replace(coalesce(title, ''), '.', '')"

# --- URLs -----------------------------------------------------------------------------------


@plan("canonical_urls", f"SELECT page_id, {V.canonical('url')} AS canonical FROM pages")
def canonical_urls(c):
    return c.spread("pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@plan(
    "url_hash_groups",
    f"""SELECT sha256(lower(canonical)) AS url_hash, count(*) AS n, min(doc_id) AS first_id
    FROM (SELECT doc_id, {V.canonical('url')} AS canonical FROM v_items) GROUP BY 1""",
)
def url_hash_groups(c):
    hashed = c.items.select(
        "doc_id", U.url_fingerprint(U.canonical_url(F.col("url"))).alias("url_hash")
    )
    return hashed.groupBy("url_hash").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_id")
    )


@plan(
    "content_hash_groups",
    f"""SELECT {V.content_hash('title', 'content')} AS content_hash, count(*) AS n,
    count(DISTINCT source_id) AS n_sources FROM v_items GROUP BY 1""",
)
def content_hash_groups(c):
    hashed = c.items.select(
        X.content_fingerprint(F.col("title"), F.col("content")).alias("content_hash"), "source_id"
    )
    return (
        hashed.groupBy("content_hash", "source_id")
        .agg(F.count("*").alias("n"))
        .groupBy("content_hash")
        .agg(F.sum("n").alias("n"), F.count("*").alias("n_sources"))
    )


@plan(
    "same_site_links",
    rf"""WITH l AS (SELECT i.doc_id, {V.url_host('i.url')} AS h, {V.url_host('s.homepage')} AS hh,
      {V.url_host('i.url')} AS ch, p.host AS ph
      FROM v_items i JOIN v_sources s USING (source_id)
      JOIN (SELECT page_id, {V.url_host('url')} AS host FROM pages) p ON p.page_id = i.doc_id),
    r AS (SELECT doc_id, regexp_extract(h, '[^.]*[.][^.]*$') AS h, regexp_extract(hh, '[^.]*[.][^.]*$') AS hh,
      regexp_extract(ph, '[^.]*[.][^.]*$') AS ph FROM l)
    SELECT doc_id, h = hh AS item_on_site, ph = hh OR ph = h AS page_on_site FROM r""",
)
def same_site_links(c):
    pages = c.spread("pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("page"))
    joined = (
        c.items.select("doc_id", "source_id", "url")
        .join(c.sources.select("source_id", "homepage"), "source_id")
        .join(pages, "doc_id")
    )
    url, home, page = F.col("url"), F.col("homepage"), F.col("page")
    return joined.select(
        "doc_id",
        U.same_site(url, home, home).alias("item_on_site"),
        U.same_site(page, home, url).alias("page_on_site"),
    )


# --- normalisation ----------------------------------------------------------------------------


@plan(
    "fold_text",
    f"""SELECT doc_id, {V.latin('title')} AS latin, {V.fold('title')} AS folded,
    md5({V.match_key('content')}) AS match_key FROM v_items""",
)
def fold_text(c):
    return c.items.select(
        "doc_id",
        X.to_latin(F.col("title")).alias("latin"),
        X.fold_diacritics(F.col("title")).alias("folded"),
        F.md5(X.match_key(F.col("content"))).alias("match_key"),
    )


STEM_SQL = (
    "regexp_replace({w}, '^(.{{4,}}?)("
    + "|".join(sorted(X.P.SUFFIXES, key=len, reverse=True))
    + ")$', '\\1')"
)


@plan(
    "stem_words",
    f"""SELECT {STEM_SQL.format(w='w')} AS stem, count(*) AS n, count(DISTINCT w) AS n_forms
    FROM (SELECT unnest(string_split_regex({V.match_key('content')}, '[^a-z0-9]+')) AS w FROM v_items)
    WHERE w <> '' GROUP BY 1""",
)
def stem_words(c):
    forms = (
        c.items.select(F.explode(F.split(X.match_key(F.col("content")), "[^a-z0-9]+")).alias("w"))
        .filter("w <> ''")
        .groupBy("w")
        .agg(F.count("*").alias("n"))
    )
    return forms.groupBy(X.stem(F.col("w")).alias("stem")).agg(
        F.sum("n").alias("n"), F.count("*").alias("n_forms")
    )


PARTS_SQL = f"list_transform(string_split(title, ';'), lambda p: {V.collapse('p')})"
MULTI_SQL = (
    f"(len({PARTS_SQL}) > 1 AND len(list_filter({PARTS_SQL}, "
    "lambda p: len(string_split(p, ' ')) < 4)) = 0)"
)
LIVE_SQL = (
    f"regexp_matches({V.match_key('title')}, "
    "'(^|[^a-z0-9_])(uzivo|blog|live)([^a-z0-9_]|$)|minut po minut|sta se desava')"
)


@plan(
    "title_flags",
    f"""SELECT doc_id, {MULTI_SQL} AS multi_event, {LIVE_SQL} AS live_blog,
    {MULTI_SQL} OR {LIVE_SQL} AS unsuitable FROM v_items""",
)
def title_flags(c):
    title = F.col("title")
    return c.items.select(
        "doc_id",
        X.is_multi_event(title).alias("multi_event"),
        X.is_live_blog(title).alias("live_blog"),
        X.unsuitable_as_topic_title(title).alias("unsuitable"),
    )


@plan("word_counts", f"SELECT doc_id, {V.n_words('content')} AS n_words, {V.n_words('title')} AS n_title_words FROM v_items")
def word_counts(c):
    return c.items.select(
        "doc_id",
        X.count_words(F.col("content")).cast("bigint").alias("n_words"),
        X.count_words(F.col("title")).cast("bigint").alias("n_title_words"),
    )


@plan("strip_html", f"SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT page_id, {V.strip_html('html')} AS t FROM pages)")
def strip_html(c):
    text = c.spread("pages").select("page_id", X.strip_html(F.col("html")).alias("t"))
    return text.select(
        "page_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars")
    )


def _clean_title_sql(expr: str) -> str:
    sql = f"SELECT doc_id, {V.collapse(expr)} AS t FROM v_items"
    for _ in range(3):
        sql = (
            "SELECT doc_id, CASE WHEN length(s) >= 20 THEN s ELSE t END AS t FROM (SELECT doc_id, t,"
            f" regexp_replace(t, ' +[|—–-] +[^|—–-]{{2,40}}$', '') AS s FROM ({sql}))"
        )
    return f"SELECT doc_id, CASE WHEN t <> '' THEN t END AS title FROM ({sql})"


TAILED = "concat(title, ' - ', lang, ' vesti | Portal ', source_id)"


@plan("clean_titles", _clean_title_sql(TAILED))
def clean_titles(c):
    return c.items.select("doc_id", X.clean_title(F.expr(TAILED)).alias("title"))


CRUMBED = (
    "concat(CASE WHEN doc_id % 3 = 0 THEN 'Početna » Vesti » ' ELSE '' END, "
    "CASE WHEN doc_id % 2 = 0 THEN '12 komentara: ' ELSE '' END, content)"
)


@plan(
    "clean_body",
    rf"""WITH a AS (SELECT doc_id, {V.collapse(CRUMBED)} AS t FROM v_items),
    b AS (SELECT doc_id, t, instr(reverse(left(t, 250)), '»') AS e FROM a),
    d AS (SELECT doc_id, CASE WHEN e > 0 THEN ltrim(substr(t, least(250, length(t)) - e + 2)) ELSE t END AS t FROM b),
    f AS (SELECT doc_id, trim(regexp_replace(t, '(?i)^[0-9]+ +komentar[ai]?([^a-z0-9_][ :.-]*|$)', '')) AS t FROM d)
    SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars FROM f""",
)
def clean_body(c):
    text = c.items.select("doc_id", X.clean_body(F.expr(CRUMBED)).alias("t"))
    return text.select(
        "doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars")
    )


@plan(
    "slugs",
    f"""WITH a AS (SELECT doc_id, item_s, translate(replace(lower(title), 'đ', 'dj'),
      '{X.ACCENTED}', '{X.BASE}') AS t FROM v_timed),
    b AS (SELECT doc_id, item_s, regexp_replace(left(regexp_replace(regexp_replace(t, '[^a-z0-9]+', '-', 'g'),
      '^-+|-+$', '', 'g'), 70), '-+$', '') AS s FROM a)
    SELECT doc_id, concat(CASE WHEN s = '' THEN 'clanak' ELSE s END, '-',
      strftime(make_timestamp(item_s * CAST(1000000 AS BIGINT)), '%Y-%m-%d')) AS slug FROM b""",
)
def slugs(c):
    return c.timed.select("doc_id", X.slugify(F.col("title"), F.col("item_at")).alias("slug"))


def _fit_sql(limit: int) -> str:
    return f"""WITH a AS (SELECT doc_id, {V.collapse('content')} AS c, content, 400 AS lim FROM v_items),
    b AS (SELECT *, left(c, {limit}) AS cut, left(content, lim) AS tcut FROM a),
    d AS (SELECT *, regexp_extract(cut, '^(.*) ', 1) AS head,
      length(regexp_extract(tcut, '(?s)^(.*[.])[ \\n]', 1)) AS stop FROM b)
    SELECT doc_id, CASE WHEN length(c) <= {limit} THEN c ELSE
      regexp_replace(CASE WHEN length(head) > {limit} * 0.6 THEN head ELSE cut END, '[,.;:–-]$', '') || '…' END AS fitted,
      CASE WHEN length(content) <= lim THEN content ELSE
      regexp_replace(CASE WHEN stop - 1 > lim * 0.5 THEN left(tcut, stop) ELSE tcut END, '{V.WS}+$', '')
      || chr(10) || chr(10) || '[…tekst je skraćen za poruku; ceo je u bazi]' END AS trimmed FROM d"""


@plan("truncate_text", _fit_sql(150))
def truncate_text(c):
    return c.items.select(
        "doc_id",
        X.fit_title(F.col("content"), 150).alias("fitted"),
        X.trim_to_length(F.col("content"), F.lit(400)).alias("trimmed"),
    )


@plan(
    "stable_bucket",
    """SELECT bucket, count(*) AS n FROM (SELECT list_reduce(
      list_transform(string_split(k, ''), lambda ch: CAST(ord(ch) AS BIGINT)),
      lambda acc, code: (xor(acc, code) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) % 3 AS bucket
    FROM (SELECT concat('clanak-', doc_id) AS k FROM documents)) GROUP BY 1""",
)
def stable_bucket(c):
    key = F.concat(F.lit("clanak-"), F.col("doc_id"))
    return (
        c.table("documents")
        .groupBy(X.stable_bucket(key).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


RAW_CATEGORY = (
    "CASE doc_id % 8 WHEN 0 THEN 'Politika' WHEN 1 THEN 'HRONIKA' WHEN 2 THEN 'Crna  hronika' "
    "WHEN 3 THEN 'Друштво' WHEN 4 THEN 'biznis, finansije' WHEN 5 THEN 'Svijet/Evropa' "
    "WHEN 6 THEN lang ELSE 'ekonomija' END"
)
_SYN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.P.CATEGORY_SYNONYMS.items())


@plan(
    "category_repair",
    f"""SELECT doc_id, CASE WHEN k IN ('politika','ekonomija','drustvo','sport','region','svet') THEN k
      ELSE coalesce(CASE k {_SYN} END, CASE regexp_extract(k, '^[^ ,/]*') {_SYN} END, raw) END AS category
    FROM (SELECT doc_id, raw, {V.collapse(V.match_key('raw'))} AS k
      FROM (SELECT doc_id, {RAW_CATEGORY} AS raw FROM documents))""",
)
def category_repair(c):
    return c.table("documents").select(
        "doc_id", X.normalize_category(F.expr(RAW_CATEGORY)).alias("category")
    )


def merged_sql(paragraphs: str) -> str:
    """Short paragraphs joined to the previous one, a short first one to the next."""
    m = (
        f"list_reduce(list_transform({paragraphs}, lambda p: [p]), lambda acc, x: "
        "CASE WHEN length(x[1]) < 200 AND len(acc) > 0 THEN list_concat(acc[:-2], [acc[-1] || ' ' || x[1]]) "
        "ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[]))"
    )
    return (
        f"list_transform([{m}], lambda m: CASE WHEN len(m) > 1 AND length(m[1]) < 200 "
        "THEN list_concat([m[1] || ' ' || m[2]], m[3:]) ELSE m END)[1]"
    )


_PARAGRAPHS = (
    f"list_filter(list_transform(string_split(content, chr(10)), lambda p: regexp_replace(p, '^{V.WS}+|{V.WS}+$', '', 'g')), "
    "lambda p: p <> '')"
)


@plan(
    "paragraph_merge",
    f"""SELECT doc_id, len(m) AS n_paragraphs, md5(array_to_string(m, chr(10) || chr(10))) AS text_md5
    FROM (SELECT doc_id, {merged_sql(_PARAGRAPHS)} AS m FROM v_items)""",
)
def paragraph_merge(c):
    merged = c.items.select("doc_id", X.merge_paragraphs(F.split("content", "\n")).alias("m"))
    return merged.select(
        "doc_id",
        F.size("m").cast("bigint").alias("n_paragraphs"),
        F.md5(X.paragraphs_to_text(F.col("m"))).alias("text_md5"),
    )


# --- names -----------------------------------------------------------------------------------

STOP_SQL = ", ".join(f"'{w}'" for w in X.P.STOP_WORDS)
BODY = "coalesce(content, '')"
V.VIEWS["v_entities"] = rf"""
SELECT doc_id, e AS entity, count(*) AS n FROM (
  SELECT doc_id, trim(unnest(string_split_regex(array_to_string(list_transform(
    string_split_regex(regexp_replace({V.latin(f"concat(title, '. ', {BODY})")},
      '([.!?]){V.WS}+', '\1' || chr(10), 'g'), '\n+'),
    lambda s: array_to_string(list_transform(string_split({V.collapse('s')}, ' '),
      lambda w, i: CASE WHEN i > 1 AND regexp_matches(
          regexp_replace(w, '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g'), '^\p{{Lu}}\p{{L}}{{2,}}')
        THEN regexp_replace(w, '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g') ELSE chr(1) END), ' ') || ' ' || chr(1)),
    ' '), ' ?\x01 ?'))) AS e FROM v_items)
WHERE length({V.match_key('e')}) >= 4 AND {V.match_key('e')} NOT IN ({STOP_SQL})
GROUP BY doc_id, e
"""
V.VIEWS["v_top_entities"] = """
SELECT doc_id, entity, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, entity) AS rank
FROM v_entities
"""


@plan("entity_counts", "SELECT doc_id, entity, n, rank FROM v_top_entities")
def entity_counts(c):
    text = F.concat(F.col("title"), F.lit(". "), F.coalesce("content", F.lit("")))
    counted = X.entity_counts(X.entity_runs(text))
    return c.items.select("doc_id", F.posexplode(counted).alias("at", "c")).select(
        "doc_id", "c.entity", F.col("c.n").cast("bigint").alias("n"),
        (F.col("at") + 1).cast("bigint").alias("rank"),
    )


# --- times -----------------------------------------------------------------------------------


@plan(
    "valid_publish_time",
    f"""SELECT doc_id, CASE WHEN published_s <= {V.NOW + V.DAY} THEN published_s END AS published_s,
    coalesce(CASE WHEN published_s <= {V.NOW + V.DAY} THEN published_s END, fetched_s) AS item_s FROM v_items""",
)
def valid_publish_time(c):
    valid = T.reject_future(F.col("published_at"), c.now)
    return c.items.select(
        "doc_id",
        F.unix_timestamp(valid).alias("published_s"),
        F.unix_timestamp(T.effective_time(valid, F.col("fetched_at"))).alias("item_s"),
    )


# Daylight saving time in the zone of the news desk: last Sunday of March to last
# Sunday of October, 01:00 UTC.
def _offset_sql(utc: str) -> str:
    march = "make_timestamp(CAST(y AS BIGINT), 3, 31, 1, 0, 0.0) - to_days(CAST(dayofweek(make_date(CAST(y AS BIGINT), 3, 31)) AS INT))"
    october = "make_timestamp(CAST(y AS BIGINT), 10, 31, 1, 0, 0.0) - to_days(CAST(dayofweek(make_date(CAST(y AS BIGINT), 10, 31)) AS INT))"
    return f"CASE WHEN {utc} >= epoch({march}) AND {utc} < epoch({october}) THEN 7200 ELSE 3600 END"


WALL = "doc_id, 2020 + doc_id % 8 AS y, 1 + doc_id % 12 AS mo, 1 + doc_id % 31 AS d, doc_id % 24 AS h, doc_id % 60 AS mi"


@plan(
    "wall_clock_utc",
    f"""WITH w AS (SELECT {WALL} FROM documents),
    nv AS (SELECT *, epoch(TRY_CAST(printf('%04d-%02d-%02d', y, mo, d) AS TIMESTAMP)) + h * 3600 + mi * 60 AS naive FROM w),
    f AS (SELECT *, {_offset_sql('naive')} AS o1 FROM nv),
    g AS (SELECT *, {_offset_sql('(naive - o1)')} AS o2 FROM f)
    SELECT doc_id, CAST(naive - o2 AS BIGINT) AS utc_s FROM g""",
)
def wall_clock_utc(c):
    wall = c.table("documents").selectExpr(*WALL.split(", "))
    part = lambda n: F.col(n).cast("int")
    utc = T.wall_clock_to_utc(part("y"), part("mo"), part("d"), part("h"), part("mi"))
    return wall.select("doc_id", F.unix_timestamp(utc).alias("utc_s"))


# A printed date in the middle of the text: valid, too old, impossible, or without time.
DATED = (
    "concat(content, ' Objavljeno 32.13.2024. ', "
    "CASE WHEN doc_id % 5 = 0 THEN '1.2.2019.' WHEN doc_id % 5 = 1 THEN 'juče' ELSE '' END, ' ', "
    "CAST(1 + doc_id % 31 AS STRING), '. 1. 2024', "
    "CASE WHEN doc_id % 2 = 0 THEN ', 09:07' ELSE '.' END, ' kraj ', '3.1.2024.')"
)


@plan(
    "visible_dates",
    rf"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all({DATED},
        '(\d{{1,2}})\.\s?(\d{{1,2}})\.\s?(\d{{4}})\.?(?:[\s,]+(\d{{1,2}}):(\d{{2}}))?')) AS m,
        generate_subscripts(regexp_extract_all({DATED},
        '(\d{{1,2}})\.\s?(\d{{1,2}})\.\s?(\d{{4}})\.?(?:[\s,]+(\d{{1,2}}):(\d{{2}}))?'), 1) AS i FROM v_items),
    b AS (SELECT doc_id, i, string_split_regex(trim(m, '. '), '[^0-9]+') AS p FROM a),
    d AS (SELECT doc_id, i, epoch(TRY_CAST(printf('%s-%s-%s', p[3], lpad(p[2], 2, '0'), lpad(p[1], 2, '0')) AS TIMESTAMP))
      + coalesce(CAST(p[4] AS INT), 12) * 3600 + coalesce(CAST(p[5] AS INT), 0) * 60 AS naive, CAST(p[3] AS INT) AS y FROM b),
    e AS (SELECT doc_id, i, naive - {_offset_sql('(naive - 3600)')} AS utc_s FROM d)
    SELECT i.doc_id, CAST(min_by(utc_s, i) AS BIGINT) AS visible_s FROM documents i
    LEFT JOIN e ON e.doc_id = i.doc_id AND utc_s <= {V.NOW + V.DAY} AND utc_s >= {V.NOW - 30 * V.DAY}
    GROUP BY i.doc_id""",
)
def visible_dates(c):
    found = T.visible_date(F.expr(DATED), c.now)
    return c.items.select("doc_id", F.unix_timestamp(found).alias("visible_s"))


_MONTHS = "[" + ", ".join(f"'{m}'" for m in X.P.MONTHS) + "]"


@plan(
    "date_labels",
    f"""SELECT event_id, concat(day(l), '. ', {_MONTHS}[month(l)], ' ', year(l), '.') AS label
    FROM (SELECT event_id, ts + INTERVAL 1 HOUR AS l FROM events)""",
)
def date_labels(c):
    return c.events.select("event_id", T.date_label(F.col("ts")).alias("label"))


@plan(
    "age_labels",
    f"""SELECT doc_id, CASE WHEN m < 0 THEN 'u budućnosti (loš datum u feedu)'
      WHEN m < 60 THEN concat('pre ', m, ' min')
      WHEN m < 2880 THEN concat('pre ', CAST(floor(m / 60 + 0.5) AS BIGINT), ' h')
      ELSE concat('pre ', CAST(floor(m / 1440 + 0.5) AS BIGINT), ' dana') END AS label
    FROM (SELECT doc_id, CAST(floor(({V.NOW} - coalesce(published_s, fetched_s)) / 60 + 0.5) AS BIGINT) AS m FROM v_items)""",
)
def age_labels(c):
    age = T.age_label(F.coalesce("published_at", "fetched_at"), c.now)
    return c.items.select("doc_id", age.alias("label"))


# --- pages ------------------------------------------------------------------------------------


def _block_sql(expr: str) -> str:
    for tag in ("figure", "figcaption", "aside", "nav", "footer", "script", "style"):
        expr = f"regexp_replace({expr}, '(?is)<{tag}[ >].*?</{tag}>', ' ', 'g')"
    expr = (
        f"regexp_replace({expr}, '(?is)<div[^>]*class=\"(?:[^\"]* )?(?:related|banner)"
        "(?: [^\"]*)?\"[^>]*>.*?</div>', ' ', 'g')"
    )
    expr = f"regexp_replace({expr}, '(?i)<(?:p|h2|h3|li)(?: [^>]*)?>', chr(2), 'g')"
    expr = f"regexp_replace({expr}, '(?i)</(?:p|h2|h3|li)>', chr(3), 'g')"
    parts = f"regexp_extract_all({expr}, '\\x02([^\\x02\\x03]*)', 1)"
    clean = f"list_transform({parts}, lambda p: {V.strip_html('p')})"
    return f"array_to_string(list_filter({clean}, lambda p: length(p) > 1), ' ')"


ARTICLE_BLOCK = (
    "regexp_extract(html, '(?is)<article(?: [^>]*)?>(.*?)(?:</article>|<footer[ >]|</body>|$)', 1)"
)
V.VIEWS["v_page_text"] = (
    f"SELECT page_id, url, html, coalesce({_block_sql(ARTICLE_BLOCK)}, '') AS block FROM pages"
)
_CLEAN_BLOCK = (
    "trim(regexp_replace(CASE WHEN e > 0 THEN ltrim(substr(block, least(250, length(block)) - e + 2)) "
    "ELSE block END, '(?i)^[0-9]+ +komentar[ai]?([^a-z0-9_][ :.-]*|$)', ''))"
)


@plan(
    "container_text",
    f"""SELECT page_id, CASE WHEN w >= 60 THEN md5(block) END AS text_md5,
      CASE WHEN w >= 60 THEN w ELSE 0 END AS n_words
    FROM (SELECT page_id, block, {V.n_words('block')} AS w FROM v_page_text)""",
)
def container_text(c):
    text = c.spread("pages").select(
        "page_id", H.container_text(F.col("html"), ["article"]).alias("text")
    )
    found = F.when(F.col("text") != "", F.md5("text"))
    return text.select(
        "page_id", found.alias("text_md5"),
        X.count_words(F.col("text")).cast("bigint").alias("n_words"),
    )


def _title_sql(expr: str) -> str:
    sql = f"SELECT *, {expr} AS t FROM v_page_text"
    for _ in range(3):
        sql = (
            "SELECT * EXCLUDE (t, s), CASE WHEN length(s) >= 20 THEN s ELSE t END AS t FROM (SELECT *,"
            f" regexp_replace(t, ' +[|—–-] +[^|—–-]{{2,40}}$', '') AS s FROM ({sql}))"
        )
    return sql


_PAGE_TITLE = V.strip_html("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")


@plan(
    "page_extract",
    f"""SELECT page_id, CASE WHEN t <> '' THEN t END AS title, left(regexp_extract(html, '<html lang="([^"]*)"', 1), 5) AS language,
      md5(body) AS text_md5, {V.n_words('body')} AS n_words,
      CASE WHEN length(body) > 0 THEN 'readability' ELSE 'none' END AS method
    FROM (SELECT *, {_CLEAN_BLOCK} AS body FROM (SELECT *, instr(reverse(left(block, 250)), '»') AS e
      FROM ({_title_sql(_PAGE_TITLE)})))""",
)
def page_extract(c):
    pages = c.spread("pages").select("page_id", "url", "html")
    extracted = PG.extract_articles(pages, c.now)
    return extracted.select(
        "page_id", "title", "language", F.md5("text").alias("text_md5"),
        X.count_words(F.col("text")).cast("bigint").alias("n_words"), "method",
    )


@plan(
    "extract_method_counts",
    f"""SELECT method, count(*) AS n, CAST(sum(w) AS BIGINT) AS n_words FROM (
      SELECT CASE WHEN {V.n_words('block')} >= 60 THEN 'container' WHEN length(block) >= length(whole) AND block <> '' THEN 'container'
        WHEN {V.n_words('whole')} >= 60 THEN 'readability' WHEN whole <> '' THEN 'readability' ELSE 'none' END AS method,
        CASE WHEN {V.n_words('block')} >= 60 THEN {V.n_words('block')} ELSE {V.n_words('whole')} END AS w
      FROM (SELECT block, {V.strip_html('html')} AS whole FROM v_page_text)) GROUP BY 1""",
)
def extract_method_counts(c):
    html = F.col("html")
    chosen = H.choose_text(
        [
            (H.block_text(H.container_block(html, "article")), "container"),
            (H.visible_text(html), "readability"),
        ]
    )
    picked = c.spread("pages").select(chosen.alias("chosen"))
    return picked.groupBy(F.col("chosen.method").alias("method")).agg(
        F.count("*").alias("n"),
        F.sum(X.count_words(F.col("chosen.text"))).alias("n_words"),
    )


_HREFS = (
    "regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)', 1)"
)


_SITE_SQL = f"regexp_extract({V.url_host('url')}, '[^.]*[.][^.]*$')"


@plan(
    "link_harvest",
    # A source is a site; its budget of 40 links is spent over all its pages, in order.
    rf"""WITH h AS (SELECT page_id, url, {_SITE_SQL} AS source_id, unnest({_HREFS}) AS raw, generate_subscripts({_HREFS}, 1) AS i FROM pages),
    a AS (SELECT page_id, i, url, source_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site,
      trim(regexp_replace(raw, '^["'']|["'']$', '', 'g')) AS href FROM h),
    b AS (SELECT *, CASE WHEN regexp_matches(href, '^https?://') THEN href ELSE site || href END AS u FROM a
      WHERE regexp_matches(href, '^(https?:/)?/')),
    d AS (SELECT source_id, min((page_id, i)) AS first, {V.canonical('u')} AS link FROM b
      WHERE regexp_matches({V.url_path('u')}, '^/[A-Za-z]{{3,}}')
        AND regexp_extract({V.url_host('u')}, '[^.]*[.][^.]*$') = source_id GROUP BY source_id, 3)
    SELECT source_id, link, row_number() OVER (PARTITION BY source_id ORDER BY first) - 1 AS position
    FROM d QUALIFY position < 40""",
)
def link_harvest(c):
    listings = c.spread("pages").select(
        U.root_domain(F.col("url")).alias("source_id"), F.col("page_id").alias("listing_id"), "url", "html"
    )
    rules = listings.select("source_id").distinct().select(
        "source_id",
        F.concat(F.lit("https://"), "source_id", F.lit("/")).alias("homepage"),
        F.lit("^/[A-Za-z]{3,}").alias("link_pattern"),
        F.lit(None).cast("string").alias("link_class"),
        F.lit(40).alias("max_links"),
    )
    links = PG.harvest_links(listings, rules)
    return links.select("source_id", "link", F.col("position").cast("bigint").alias("position"))


@plan(
    "segment_stats",
    rf"""WITH p AS (SELECT page_id, {V.url_host('url')} AS host, url,
      list_filter(string_split({V.url_path('url')}, '/'), lambda s: s <> '') AS parts FROM pages),
    g AS (SELECT regexp_extract(host, '[^.]*[.][^.]*$') AS domain, parts[1] AS segment, count(*) AS n_links,
      min_by(url, page_id) AS sample FROM p WHERE len(parts) >= 2
      AND lower(parts[1]) NOT IN ({", ".join(f"'{s}'" for s in X.P.IGNORED_SEGMENTS)}) GROUP BY 1, 2)
    SELECT domain, segment, n_links, sample, row_number() OVER (PARTITION BY domain ORDER BY n_links DESC, segment) AS rank
    FROM g QUALIFY rank <= 6""",
)
def segment_stats(c):
    url = F.col("url")
    links = c.spread("pages").select(
        U.root_domain(url).alias("domain"), F.col("page_id").alias("position"), url.alias("link")
    )
    return PG.section_statistics(links, "domain").withColumn("rank", F.col("rank").cast("bigint"))

"""Scoring, selection, cost, prompt material and article lifecycle queries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsweave import params as P
from newsweave.functions import text as X, urls as U
from newsweave.functions.times import round_half_up
from newsweave.operators import ingest as I, lifecycle as L, material as M, scoring as SC, topics as TP
from newsweave.operators import retention as R, vectors as VC
from newsweave.plans import views as V
from newsweave.plans.ingest_plans import hashed
from newsweave.plans.registry import plan
from newsweave.sinks import materialize, work_path

HOUR = 3600
seconds = F.unix_timestamp


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


# --- topics -----------------------------------------------------------------------------------


@plan(
    "topic_rollup",
    "SELECT topic_id, size, distinct_sources, distinct_angles, angles, first_s, last_s, recent_items FROM v_rollup",
)
def topic_rollup(c):
    rolled = SC.topic_rollup(c.members.select("topic_id", "source_id", "angle", "item_at"), c.now)
    return rolled.select(
        "topic_id", "size", big("distinct_sources"), big("distinct_angles"),
        F.array_join("angles", ",").alias("angles"),
        seconds("first_item_at").alias("first_s"), seconds("last_item_at").alias("last_s"),
        "recent_items",
    )


@plan("trending_score", "SELECT topic_id, trending_score FROM v_scored")
def trending_score(c):
    return c.scored.select("topic_id", "trending_score")


REASONS_SQL = """list_filter([
  CASE WHEN distinct_sources < 3 THEN concat('javlja je ', distinct_sources, ' izvora, traži se najmanje 3') END,
  CASE WHEN distinct_angles < 2 THEN concat('pokriven je ', distinct_angles, ' ugao, traži se najmanje 2 različita') END,
  CASE WHEN size < 3 THEN concat('ima ', size, ' tekstova, traži se najmanje 3') END], lambda r: r IS NOT NULL)"""


@plan(
    "quality_gates",
    f"""SELECT topic_id, len(r) = 0 AS passes, array_to_string(r, '; ') AS reasons
    FROM (SELECT topic_id, {REASONS_SQL} AS r FROM v_rollup)""",
)
def quality_gates(c):
    return SC.with_gates(c.rollup).select(
        "topic_id", "passes", F.array_join("reasons", "; ").alias("reasons")
    )


@plan(
    "velocity_window",
    """SELECT topic_id, doc_id, count(*) OVER (PARTITION BY topic_id ORDER BY item_s
      RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS n_trailing FROM v_members""",
)
def velocity_window(c):
    rows = c.members.select("topic_id", "doc_id", "item_at")
    return L.trailing_count(rows, "topic_id", "item_at", P.VELOCITY_HOURS, "n_trailing").select(
        "topic_id", "doc_id", "n_trailing"
    )


@plan(
    "top_topics",
    "SELECT topic_id, trending_score, size FROM v_scored WHERE size >= 3 ORDER BY trending_score DESC, topic_id LIMIT 25",
)
def top_topics(c):
    return (
        c.scored.filter("size >= 3").orderBy(F.desc("trending_score"), "topic_id").limit(25)
        .select("topic_id", "trending_score", "size")
    )


@plan(
    "open_topics",
    """SELECT topic_id, trending_score FROM v_topics WHERE status = 'open' AND article_id IS NULL
    ORDER BY trending_score DESC, topic_id LIMIT 60""",
)
def open_topics(c):
    waiting = c.topics.filter((F.col("status") == "open") & F.col("article_id").isNull())
    return waiting.orderBy(F.desc("trending_score"), "topic_id").limit(60).select(
        "topic_id", "trending_score"
    )


@plan(
    "open_topic_pool",
    f"""SELECT topic_id, status, last_s FROM v_topics WHERE status IN ('open', 'covered')
    AND last_s >= {V.NOW - 36 * HOUR}""",
)
def open_topic_pool(c):
    return TP.topic_pool(c.topics, c.now).select(
        "topic_id", "status", seconds("last_item_at").alias("last_s")
    )


@plan(
    "topic_report",
    f"""WITH t AS (SELECT *, {REASONS_SQL} AS r, row_number() OVER (ORDER BY trending_score DESC, topic_id) AS topic_rank
      FROM v_scored WHERE size >= 2 QUALIFY topic_rank <= 40)
    SELECT t.topic_rank, t.topic_id, t.trending_score, len(t.r) = 0 AS passes, array_to_string(t.r, '; ') AS reasons,
      m.doc_id, m.source_id, m.title, m.item_s FROM t JOIN v_members m USING (topic_id)""",
)
def topic_report(c):
    top = SC.with_gates(c.scored.filter("size >= 2")).orderBy(
        F.desc("trending_score"), "topic_id"
    ).limit(40)
    order = SC.Window.orderBy(F.desc("trending_score"), "topic_id")
    ranked = top.withColumn("topic_rank", F.row_number().over(order).cast("bigint")).select(
        "topic_rank", "topic_id", "trending_score", "passes",
        F.array_join("reasons", "; ").alias("reasons"),
    )
    # The report's topics are its fixed number of best ones: a bounded side.
    return F.broadcast(ranked).join(
        c.members.select("topic_id", "doc_id", "source_id", "title", seconds("item_at").alias("item_s")),
        "topic_id",
    )


# --- selection ----------------------------------------------------------------------------------

# Quotas of a larger desk, so that every branch of the selection occurs in the data.
LIMITS = P.LimitParams(per_day=40, flagship_per_day=6, per_run=12, monthly_budget=1_000_000.0)

V.VIEWS["v_candidates_open"] = f"""
SELECT topic_id, trending_score, needs_flagship, {REASONS_SQL} AS r FROM v_topics WHERE status = 'open'
"""
_DAY = V.NOW - 3 * V.DAY  # selection runs at noon of the day three days before the end
_NOON = _DAY + 43200


@plan(
    "topic_selection",
    f"""WITH q AS (SELECT *, greatest(0, 40 - written - updated) AS left_today FROM (SELECT
        count(*) FILTER (WHERE created_s >= {_DAY} AND created_s <= {_NOON}) AS written,
        count(*) FILTER (WHERE last_update_s >= {_DAY} AND last_update_s <= {_NOON}) AS updated,
        count(*) FILTER (WHERE created_s >= {_DAY} AND created_s <= {_NOON} AND model = 'flagship') AS flagship,
        coalesce(sum(CASE WHEN created_s >= 1704067200 AND created_s <= {_NOON} THEN total_cost END), 0) AS spend FROM v_costed)),
    qq AS (SELECT *, CASE WHEN spend >= 1000000 THEN 0 ELSE least(12, left_today) END AS room, greatest(0, 6 - flagship) AS strong_left FROM q),
    p AS (SELECT topic_id, row_number() OVER (ORDER BY trending_score DESC, topic_id) AS rank,
      sum(CASE WHEN needs_flagship THEN 0 ELSE 1 END) OVER (ORDER BY trending_score DESC, topic_id) AS plain
      FROM v_candidates_open WHERE len(r) = 0)
    SELECT c.topic_id, c.trending_score, coalesce(p.rank <= room, false) AS selected,
      CASE WHEN p.rank <= room THEN CASE WHEN needs_flagship OR plain <= strong_left THEN 'flagship' ELSE 'default' END END AS tier,
      CASE WHEN len(c.r) > 0 THEN array_to_string(c.r, '; ') WHEN p.rank <= room THEN ''
        WHEN spend >= 1000000 THEN 'mesečni budžet je dostignut'
        WHEN left_today <= 12 THEN concat('dnevna granica od 40 članaka je dostignuta (danas napisano ', written + updated, ')')
        ELSE 'ciklus je popunjen (12 članaka)' END AS reasons
    FROM v_candidates_open c LEFT JOIN p USING (topic_id), qq""",
)
def topic_selection(c):
    noon = F.timestamp_seconds(F.lit(_NOON))
    articles = c.costed.withColumn("cost_usd", F.col("total_cost"))
    quota = SC.quota_state(articles, noon, LIMITS)
    candidates = SC.with_gates(c.topics.filter("status = 'open'")).select(
        "topic_id", "trending_score", "needs_flagship", "passes", "reasons"
    )
    chosen = SC.select_topics(candidates, quota, LIMITS)
    return chosen.withColumn("reasons", F.array_join("reasons", "; "))


@plan(
    "budget_cutoff",
    """WITH q AS (SELECT article_id AS id, created_s, CAST(total_cost AS DOUBLE) AS cost_usd,
      coalesce(sum(total_cost) OVER (ORDER BY created_s, article_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      row_number() OVER (ORDER BY created_s, article_id) AS k FROM v_costed QUALIFY k <= 100)
    SELECT id, cost_usd, CAST(before AS DOUBLE) AS spent_before, before < 0.5 AS runs FROM q""",
)
def budget_cutoff(c):
    queue = c.costed.select(
        F.col("article_id").alias("id"), F.col("created_at").alias("position_key"),
        F.col("total_cost").alias("cost_usd"),
    )
    cut = SC.budget_cutoff(queue, 0.5, 100)
    return cut.select(
        "id", F.col("cost_usd").cast("double"), F.col("spent_before").cast("double"), "runs"
    )


# --- cost and counters ------------------------------------------------------------------------------


@plan(
    "call_cost",
    f"""SELECT article_id, CAST(total_cost AS DOUBLE) AS total_cost, CAST({V.total_cost('0.5')} AS DOUBLE) AS batch_cost FROM v_costed""",
)
def call_cost(c):
    usage = c.articles.select(
        "article_id", "model", "input_tokens", "output_tokens", "cache_creation_tokens",
        "cache_read_tokens",
    )
    full = SC.call_cost(usage)
    half = SC.call_cost(
        full.select(*usage.columns, F.col("total_cost").alias("full_cost")), batch=True
    )
    return half.select(
        "article_id",
        F.col("full_cost").cast("double").alias("total_cost"),
        F.col("total_cost").cast("double").alias("batch_cost"),
    )


@plan(
    "model_cost_compare",
    f"""SELECT model, n AS n_articles, {V.half_up('s / n', 6)} AS average_cost, {V.half_up('s / n * 900', 4)} AS monthly_estimate
    FROM (SELECT model, count(*) AS n, CAST(sum(total_cost) AS DOUBLE) AS s FROM v_costed GROUP BY 1)""",
)
def model_cost_compare(c):
    compared = SC.model_comparison(c.costed)
    return compared.select(
        "model", "n_articles",
        round_half_up(F.col("average_cost").cast("double"), 6).alias("average_cost"),
        round_half_up(F.col("monthly_estimate").cast("double"), 4).alias("monthly_estimate"),
    )


@plan(
    "monthly_spend",
    """SELECT strftime(make_timestamp(created_s * CAST(1000000 AS BIGINT)), '%Y-%m') AS month,
    CAST(sum(CAST(total_cost AS DECIMAL(20,6))) AS DOUBLE) AS spend FROM v_costed GROUP BY 1""",
)
def monthly_spend(c):
    spent = SC.monthly_spend(
        c.costed.withColumn("cost_usd", F.col("total_cost").cast("decimal(20,6)"))
    )
    return spent.select(
        F.date_format("month", "yyyy-MM").alias("month"), F.col("spend").cast("double")
    )


@plan(
    "daily_output",
    """SELECT strftime(make_timestamp(created_s * CAST(1000000 AS BIGINT)), '%Y-%m-%d') AS day, count(*) AS written,
    count(*) FILTER (WHERE model = 'flagship') AS flagship_written FROM v_articles GROUP BY 1""",
)
def daily_output(c):
    return SC.daily_output(c.articles).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@plan(
    "length_gate",
    f"""SELECT article_id, topic_id, w AS word_count, w < 350 AS needs_flagship
    FROM (SELECT article_id, topic_id, {V.n_words("concat(coalesce(lead, ''), ' ', coalesce(body, ''))")} AS w FROM v_articles)""",
)
def length_gate(c):
    return SC.length_gate(c.articles.select("article_id", "topic_id", "lead", "body")).select(
        "article_id", "topic_id", big("word_count"), "needs_flagship"
    )


# --- updates --------------------------------------------------------------------------------------

# The evidence window of the whole two weeks before now.
UPDATES = P.UpdateParams(window_hours=14 * 24)
V.VIEWS["v_updates"] = f"""
SELECT t.topic_id, a.article_id, a.revision, coalesce(a.last_update_s, a.created_s) AS since_s, t.title_sample,
  count(*) AS new_items, count(DISTINCT m.source_id) AS new_sources
FROM v_topics t JOIN v_articles a USING (topic_id) JOIN v_members m USING (topic_id)
WHERE t.status = 'covered' AND t.last_s >= {V.NOW - 14 * V.DAY} AND a.revision <= 5
  AND m.added_s > coalesce(a.last_update_s, a.created_s)
GROUP BY ALL HAVING count(DISTINCT m.source_id) >= 2
"""


def _updates(c):
    return L.topics_needing_update(
        c.topics.select("topic_id", "title_sample", "status", "last_item_at"),
        c.articles.select("topic_id", "article_id", "revision", "last_update_at", "created_at"),
        c.members, c.now, UPDATES,
    )


@plan("topics_needing_update", "SELECT topic_id, article_id, revision, since_s, new_items, new_sources FROM v_updates")
def topics_needing_update(c):
    return _updates(c).select(
        "topic_id", "article_id", "revision", seconds("since").alias("since_s"),
        "new_items", "new_sources",
    )


@plan(
    "update_queue",
    "SELECT topic_id, article_id, new_sources FROM v_updates ORDER BY new_sources DESC, topic_id LIMIT 6",
)
def update_queue(c):
    return L.update_queue(_updates(c), LIMITS).select("topic_id", "article_id", "new_sources")


@plan(
    "article_versions",
    """SELECT user_id AS article_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision,
    event_id = max_by(event_id, (ts, event_id)) OVER (PARTITION BY user_id) AS is_latest FROM events WHERE event_type = 'purchase'""",
)
def article_versions(c):
    updates = c.events.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("article_id"), "event_id", "ts"
    )
    latest = updates.groupBy("article_id").agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("latest")
    )
    return L.numbered(updates, "article_id", "revision").join(latest, "article_id").select(
        "article_id", "event_id", "revision", (F.col("event_id") == F.col("latest")).alias("is_latest")
    )


# --- prompt material ---------------------------------------------------------------------------------

_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.ANGLE_LABELS.items())
V.VIEWS["v_counted"] = f"SELECT *, {V.n_words('content')} AS word_count FROM v_members"
V.VIEWS["v_keywords8"] = """
SELECT topic_id, string_agg(keyword, ', ' ORDER BY rank) AS line FROM (
  SELECT h.topic_id, h.rank, min_by(s.surface, (m.item_s, m.doc_id)) AS keyword
  FROM (SELECT topic_id, term, row_number() OVER (PARTITION BY topic_id ORDER BY raw DESC, term) AS rank
        FROM v_mean QUALIFY rank <= 8) h
  JOIN v_members m USING (topic_id) JOIN v_surface s ON s.doc_id = m.doc_id AND s.term = h.term GROUP BY 1, 2)
GROUP BY 1
"""
V.VIEWS["v_entities10"] = """
SELECT topic_id, string_agg(entity, ', ' ORDER BY rank) AS line FROM (
  SELECT topic_id, entity, row_number() OVER (PARTITION BY topic_id ORDER BY seen, entity) AS rank
  FROM v_seen QUALIFY rank <= 10) GROUP BY 1
"""


@plan(
    "prompt_material",
    rf"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY word_count DESC, doc_id) AS rank FROM v_counted),
    s AS (SELECT topic_id, string_agg(concat('## Izveštaj ', rank, ' — ', CASE angle {_LABELS} END, chr(10),
        'Objavljeno: ', strftime(make_timestamp(item_s * CAST(1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.000Z'), chr(10), chr(10),
        'Naslov: ', {V.collapse('title')}, CASE WHEN content <> '' THEN concat(chr(10), chr(10), left({V.collapse('content')}, 1600)) ELSE '' END, chr(10)),
        chr(10) ORDER BY rank) FILTER (WHERE rank <= 8) AS reports, count(*) AS n_reports FROM r GROUP BY 1)
    SELECT t.topic_id, s.n_reports, md5(regexp_replace(concat('# Materijal za jedan članak', chr(10), chr(10), 'Tema: ', t.title_sample, chr(10),
      CASE WHEN k.line IS NOT NULL THEN concat('Ključne reči iz izveštaja: ', k.line, chr(10)) ELSE '' END,
      CASE WHEN e.line IS NOT NULL THEN concat('Imena i nazivi koji se pominju: ', e.line, chr(10)) ELSE '' END, chr(10),
      'Sledi ', s.n_reports, ' nezavisnih izveštaja o istom događaju. Označeni su uglom iz kog izveštavaju. Napiši jedan članak po uredničkim pravilima.',
      chr(10), chr(10), s.reports), '^{V.WS}+|{V.WS}+$', '', 'g')) AS message_md5
    FROM v_rollup t JOIN s USING (topic_id) LEFT JOIN v_keywords8 k USING (topic_id) LEFT JOIN v_entities10 e USING (topic_id)
    WHERE t.size >= 3 AND t.distinct_sources >= 3 AND t.distinct_angles >= 2""",
)
def prompt_material(c):
    # Only topics that pass are written: everything below is worked out for their members alone.
    passing = materialize(SC.with_gates(c.rollup).filter("passes").select("topic_id", "title_sample"), "passing")
    members = c.members.join(passing.select("topic_id"), "topic_id", "left_semi").withColumn(
        "word_count", X.count_words(F.col("content"))
    )
    links = c.links.join(passing.select("topic_id"), "topic_id", "left_semi")
    means = VC.centroids(VC.item_weights(c.items), links)
    heaviest = materialize(TP.heaviest_terms(means), "heaviest-terms")
    ranked = TP.topic_keywords(members, heaviest, TP.keyword_spellings(members, heaviest))
    keywords = ranked.groupBy("topic_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("k")
    ).select("topic_id", F.transform("k", lambda s: s["keyword"]).alias("keywords"))
    names = TP.topic_entities(VC.item_entities(members), 10)
    topics = passing.join(keywords, "topic_id", "left").join(names, "topic_id", "left")
    messages = M.prompt_messages(topics, members)
    return messages.select("topic_id", "n_reports", F.md5("message").alias("message_md5"))


@plan(
    "batch_requests",
    """WITH n AS (SELECT model, greatest(1, CAST(ceil(count(*) / 20) AS BIGINT)) AS nb FROM v_batches GROUP BY 1)
    SELECT b.model, CAST(concat('0x', left(md5(custom_id), 8)) AS BIGINT) % nb AS batch_no, count(*) AS request_count,
      array_to_string(list_sort(list(custom_id)), ',') AS custom_ids
    FROM v_batches b JOIN n USING (model) GROUP BY 1, 2""",
)
def batch_requests(c):
    batches = M.request_batches(c.batches.select("topic_id", "custom_id", "model"), 20)
    return batches.select(
        "model", "batch_no", "request_count",
        F.array_join(F.array_sort(F.map_keys("topic_map")), ",").alias("custom_ids"),
    )


@plan(
    "batch_results",
    f"""WITH o AS (SELECT *, result_type = 'succeeded' AND schema_ok AS ok, {V.total_cost('0.5')} AS cost FROM v_batches)
    SELECT batch_id, model, count(*) FILTER (WHERE ok) AS n_succeeded, count(*) FILTER (WHERE NOT ok) AS n_failed,
      count(*) FILTER (WHERE NOT ok AND NOT (result_type = 'errored' AND error_type = 'invalid_request')) AS n_retryable,
      CAST(sum(CASE WHEN ok THEN cost ELSE 0 END) AS DOUBLE) AS cost_usd FROM o GROUP BY 1, 2""",
)
def batch_results(c):
    return M.batch_results(c.batches).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@plan(
    "not_in_flight",
    "SELECT topic_id FROM v_topics WHERE topic_id NOT IN (SELECT topic_id FROM v_batches WHERE submitted)",
)
def not_in_flight(c):
    flying = c.batches.filter("submitted").select("topic_id")
    return I.new_only(c.topics.select("topic_id"), flying, ["topic_id"])


@plan(
    "awaiting_review",
    """SELECT article_id, created_s FROM v_articles WHERE status = 'pending_review'
    AND article_id NOT IN (SELECT article_id FROM v_reviews) ORDER BY created_s, article_id LIMIT 50""",
)
def awaiting_review(c):
    waiting = L.awaiting_submission(
        c.articles.select("article_id", "status", "created_at"), c.reviews, 50
    )
    return waiting.select("article_id", seconds("created_at").alias("created_s"))


@plan(
    "article_rows",
    f"""WITH a AS (SELECT *, translate(replace(lower(title), 'đ', 'dj'), '{X.ACCENTED}', '{X.BASE}') AS t FROM v_articles),
    b AS (SELECT *, regexp_replace(left(regexp_replace(regexp_replace(t, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 70), '-+$', '') AS s FROM a)
    SELECT topic_id, concat(CASE WHEN s = '' THEN 'clanak' ELSE s END, '-2024-01-31') AS slug, category,
      CASE WHEN sensitive THEN 'pending_review' ELSE 'draft' END AS status,
      {V.n_words("concat(coalesce(lead, ''), ' ', coalesce(body, ''))")} AS word_count, model FROM b""",
)
def article_rows(c):
    return M.article_rows(c.articles, c.now).select(
        "topic_id", "slug", "category", "status", big("word_count"), "model"
    )


_RAW_CAT = (
    "CASE conv_id % 6 WHEN 0 THEN 'Politika' WHEN 1 THEN 'HRONIKA' WHEN 2 THEN 'biznis, finansije' "
    "WHEN 3 THEN 'horoskop' WHEN 4 THEN 'Друштво' ELSE 'sport' END"
)
# Sentences become paragraphs: many are short, so merging has work to do.
_PARAS = "string_split_regex(text, '[.] |\\n')"
V.VIEWS["v_responses"] = rf"""
SELECT conv_id, turn, raw_category, paras,
  CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 'lead' END AS lead, conv_id % 7 <> 0 AS has_notes
FROM (SELECT conv_id, turn, {_RAW_CAT} AS raw_category, list_filter(list_transform({_PARAS}, lambda p: {{trim}}), lambda p: p <> '') AS paras
  FROM conversations WHERE role = 'assistant')
""".replace("{trim}", f"regexp_replace(p, '^{V.WS}+|{V.WS}+$', '', 'g')")
V.VIEWS["v_merged"] = """
SELECT *, CASE WHEN len(m) > 1 AND length(m[1]) < 200 THEN list_concat([m[1] || ' ' || m[2]], m[3:]) ELSE m END AS body FROM (
  SELECT *, list_reduce(list_transform(paras, lambda p: [p]), lambda acc, x:
    CASE WHEN length(x[1]) < 200 AND len(acc) > 0 THEN list_concat(acc[:-2], [acc[-1] || ' ' || x[1]]) ELSE list_concat(acc, x) END,
    CAST([] AS VARCHAR[])) AS m FROM v_responses)
"""
_SYN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.CATEGORY_SYNONYMS.items())
_CAT = (
    f"CASE WHEN k IN ('politika','ekonomija','drustvo','sport','region','svet') THEN k ELSE coalesce(CASE k {_SYN} END, "
    f"CASE regexp_extract(k, '^[^ ,/]*') {_SYN} END, raw_category) END"
)


@plan(
    "response_repair",
    f"""WITH a AS (SELECT *, {V.collapse(V.match_key('raw_category'))} AS k FROM v_merged), b AS (SELECT *, {_CAT} AS category FROM a)
    SELECT conv_id, turn, category, len(body) AS n_paragraphs, md5(array_to_string(body, chr(10) || chr(10))) AS body_md5,
      (category <> raw_category)::BIGINT + (len(body) < len(paras))::BIGINT + (NOT has_notes)::BIGINT AS n_repairs,
      (lead IS NULL)::BIGINT + (category NOT IN ('politika','ekonomija','drustvo','sport','region','svet'))::BIGINT
      + (len(body) < 4)::BIGINT + (len(body) > 9)::BIGINT + len(list_filter(body, lambda p: length(p) < 200)) AS n_problems FROM b""",
)
def response_repair(c):
    text = c.table("conversations").filter("role = 'assistant'")
    notes = F.when(F.col("conv_id") % 7 != 0, F.array().cast("array<string>"))
    answer = F.struct(
        F.lit("naslov").alias("title"),
        F.when(F.col("conv_id") % 5 != 0, F.lit("lead")).alias("lead"),
        F.filter(
            F.transform(F.split("text", "[.] |\n"), lambda p: F.regexp_replace(p, f"^{X.WS}+|{X.WS}+$", "")),
            lambda p: p != "",
        ).alias("body"),
        F.expr(_RAW_CAT).alias("category"),
        F.lit(False).alias("sensitive"),
        F.lit(False).alias("sourcesDiverge"),
        F.array().cast("array<string>").alias("keywords"),
        notes.alias("notes"),
    )
    repaired = M.repair_responses(text.select("conv_id", "turn", F.to_json(answer).alias("raw")))
    return repaired.select(
        "conv_id", "turn", "category", F.size("body").cast("bigint").alias("n_paragraphs"),
        F.md5(X.paragraphs_to_text(F.col("body"))).alias("body_md5"),
        F.size("repairs").cast("bigint").alias("n_repairs"),
        F.size("problems").cast("bigint").alias("n_problems"),
    )


def _escape(e: str) -> str:
    return f"replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@plan(
    "review_outbox",
    rf"""WITH a AS (SELECT article_id, body, category, model, {V.n_words('body')} AS w, topic_id, concat('{M.REVIEW_HEAD}', chr(10), chr(10),
        '<b>', {_escape('title')}, '</b>', chr(10), chr(10), {_escape('lead')}, chr(10)) AS head FROM v_articles WHERE status = 'pending_review'),
    b AS (SELECT *, greatest(300, 3500 - length(head)) AS room FROM a), d AS (SELECT *, left(body, room) AS cut FROM b),
    e AS (SELECT *, length(regexp_extract(cut, '(?s)^(.*[.])[ \n]', 1)) AS stop FROM d),
    f AS (SELECT *, CASE WHEN length(body) <= room THEN body ELSE concat(regexp_replace(CASE WHEN stop - 1 > room * 0.5 THEN left(cut, stop) ELSE cut END,
      '{V.WS}+$', ''), chr(10), chr(10), '[…tekst je skraćen za poruku; ceo je u bazi]') END AS shown FROM e)
    SELECT article_id, md5(concat(head, chr(10), {_escape('shown')}, chr(10), chr(10), '———', chr(10), 'Razlog: nije naveden', chr(10), 'Rubrika: ', category,
      ' · ', w, ' reči · model: ', model, ' · izvora: ', n, chr(10), chr(10), '{M.REVIEW_NOTE}')) AS message_md5
    FROM f JOIN (SELECT topic_id, distinct_sources AS n FROM v_rollup) USING (topic_id)""",
)
def review_outbox(c):
    sources = c.rollup.select("topic_id", F.col("distinct_sources").alias("source_count"))
    pending = (
        c.articles.filter("status = 'pending_review'")
        .join(sources, "topic_id")
        .withColumn("word_count", X.count_words(F.col("body")))
        .withColumn("sensitivity_reason", F.lit(None).cast("string"))
    )
    message = pending.select("article_id", M.review_message().alias("m"))
    return message.select("article_id", F.md5("m").alias("message_md5"))


# --- maintenance ---------------------------------------------------------------------------------------


@plan(
    "stale_covers",
    f"""WITH a AS (SELECT article_id, 1 AS turn, created_s AS at_s FROM v_articles WHERE status <> 'rejected' AND cover_url IS NULL
      ORDER BY created_s DESC, article_id LIMIT 20),
    d AS (SELECT article_id, 2 AS turn, last_update_s AS at_s FROM v_articles WHERE status <> 'rejected' AND last_update_s >= {V.NOW - 7 * V.DAY}
      AND cover_url IS NOT NULL AND (cover_s IS NULL OR cover_s < last_update_s) ORDER BY last_update_s DESC, article_id LIMIT 20)
    SELECT article_id, turn, at_s FROM (SELECT * FROM a UNION ALL SELECT * FROM d) ORDER BY turn, at_s DESC, article_id LIMIT 20""",
)
def stale_covers(c):
    return L.articles_needing_cover(c.articles, c.now).select(
        "article_id", big("turn"), seconds("at").alias("at_s")
    )


@plan(
    "upsert_links",
    f"""SELECT topic_id, doc_id FROM v_links WHERE doc_id NOT IN (SELECT doc_id FROM v_links WHERE added_s < {V.KNOWN_UNTIL})""",
)
def upsert_links(c):
    stored = c.links.filter(F.col("added_at") < c.known_until)
    offered = c.links.unionByName(c.links)  # a run that is repeated offers its links twice
    return L.new_links(offered, stored).select("topic_id", "doc_id")


@plan(
    "upsert_state",
    """WITH ch AS (SELECT topic_id, 'covered' AS status, article_id FROM v_topics WHERE article_id IS NOT NULL AND status = 'covered'),
    old AS (SELECT topic_id, 'open' AS status, needs_flagship, trending_score FROM v_topics WHERE size >= 2)
    SELECT coalesce(o.topic_id, ch.topic_id) AS topic_id, coalesce(ch.status, o.status) AS status, o.needs_flagship, o.trending_score
    FROM old o FULL JOIN ch ON ch.topic_id = o.topic_id""",
)
def upsert_state(c):
    stored = c.topics.filter("size >= 2").select(
        "topic_id", F.lit("open").alias("status"), "needs_flagship", "trending_score"
    )
    changes = c.topics.filter("status = 'covered'").select("topic_id", "status")
    return L.upsert(stored, changes, ["topic_id"], ["status"])


@plan(
    "retention_sweep",
    f"""SELECT 'items' AS table_name, strftime(make_timestamp(fetched_s * CAST(1000000 AS BIGINT)), '%Y-%m-%d') AS day,
      count(*) FILTER (WHERE fetched_s < {V.NOW - 10 * V.DAY}) AS n_expired, count(*) FILTER (WHERE fetched_s >= {V.NOW - 10 * V.DAY}) AS n_kept FROM v_items GROUP BY 1, 2
    UNION ALL SELECT 'runs', strftime(ts, '%Y-%m-%d'), count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-01 00:00:00'),
      count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-01 00:00:00') FROM events GROUP BY 1, 2""",
)
def retention_sweep(c):
    keep = P.RetentionParams()
    return L.retention_plan(
        {
            "items": (c.items, "fetched_at", keep.item_days),
            "runs": (c.events, "ts", keep.run_days),
        },
        c.now,
    )


SWEPT_AT = V.NOW + 7 * HOUR


def _swept(name: str, rows: str, at: str, days: int) -> str:
    day = f"date_trunc('day', make_timestamp(CAST({at} AS BIGINT) * 1000000))"
    edge = SWEPT_AT - days * V.DAY
    first = edge // V.DAY * V.DAY
    return f"""SELECT '{name}' AS table_name, strftime({day}, '%Y-%m-%d') AS day, count(*) AS n_before,
      count(*) FILTER (WHERE {at} >= {edge}) AS n_after, min({at}) >= {edge} AS same_files,
      CASE WHEN max({at}) < {first} THEN 'dropped' WHEN min({at}) < {edge} THEN 'rewritten' ELSE 'kept' END AS what FROM {rows} GROUP BY 1, 2"""


@plan(
    "retention_delete",
    _swept("items", "v_items", "fetched_s", 10) + " UNION ALL " + _swept("runs", "(SELECT floor(epoch(ts)) AS at_s FROM events)", "at_s", 30),
)
def retention_delete(c):
    """Two tables laid out by day and swept; files of the days that stay are the files that were there."""
    now = datetime(1970, 1, 1) + timedelta(seconds=SWEPT_AT)
    tables = {
        "items": (c.items.select("doc_id", "source_id", "url", "title", "fetched_at"), "fetched_at", 10),
        "runs": (c.events.select("event_id", "user_id", F.date_trunc("second", "ts").alias("ts")), "ts", 30),
    }
    parts = []
    for name, (rows, at, days) in tables.items():
        path = work_path(c.spark, f"by-day-{name}")
        R.write_by_day(rows, at, path)
        before = materialize(R.day_files(c.spark, path, at), "files-before")
        done = R.sweep(c.spark, path, at, now, days)
        report = R.sweep_report(before, R.day_files(c.spark, path, at))
        within = lambda days: F.col("day").isin(*days) if days else F.lit(False)
        parts.append(
            report.select(
                F.lit(name).alias("table_name"), F.date_format("day", "yyyy-MM-dd").alias("day"), "n_before", "n_after", "same_files",
                F.when(within(done["dropped"]), "dropped").when(within(done["rewritten"]), "rewritten").otherwise("kept").alias("what"),
            )
        )
    return parts[0].unionByName(parts[1])


@plan(
    "retention_cascade",
    f"""WITH it AS (SELECT doc_id FROM v_items WHERE fetched_s >= {V.NOW - 10 * V.DAY}),
    lk AS (SELECT topic_id, count(*) AS n_links FROM v_links WHERE doc_id IN (SELECT doc_id FROM it) GROUP BY 1)
    SELECT a.article_id, lk.topic_id, coalesce(lk.n_links, 0) AS n_links FROM v_articles a LEFT JOIN lk ON lk.topic_id = a.topic_id""",
)
def retention_cascade(c):
    old = L.expired(c.items, "fetched_at", c.now, P.RetentionParams().item_days)
    items = c.items.select("doc_id", "fetched_at")
    survivors = items.filter(~old)
    links = L.cascade_links(c.links, survivors)
    topics = links.groupBy("topic_id").agg(F.count("*").alias("n_links"))
    articles = L.detach_articles(c.articles.select("article_id", "topic_id"), topics)
    return articles.join(topics, "topic_id", "left").select(
        "article_id", "topic_id", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


@plan(
    "dq_report",
    f"""SELECT 'source angle' AS rule, count(*) AS n_violations FROM v_sources WHERE angle NOT IN ('provladin', 'kriticki', 'mejnstrim')
    UNION ALL SELECT 'item url unique', count(*) FROM (SELECT url_hash FROM v_hashed GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'item content unique per source', count(*) FROM (SELECT source_id, content_hash FROM v_hashed GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'item publish time', count(*) FROM v_items WHERE published_s IS NULL
    UNION ALL SELECT 'article status', count(*) FROM v_articles WHERE status NOT IN ('draft', 'published', 'rejected')
    UNION ALL SELECT 'label has document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM v_new)
    UNION ALL SELECT 'source id unique', count(*) FROM (SELECT source_id FROM v_sources GROUP BY 1 HAVING count(*) > 1)""",
)
def dq_report(c):
    items = L.violations(
        c.items.select(
            "source_id", "published_at", U.url_fingerprint(U.canonical_url(F.col("url"))).alias("url_hash"),
            X.content_fingerprint(F.col("title"), F.col("content")).alias("content_hash"),
        ),
        {"item publish time": F.col("published_at").isNull()},
        {"item url unique": ["url_hash"], "item content unique per source": ["source_id", "content_hash"]},
    )
    sources = L.violations(c.sources, {"source angle": L.not_in("angle", P.ANGLES[:3])}, {"source id unique": ["source_id"]})
    articles = L.violations(c.articles, {"article status": L.not_in("status", ("draft", "published", "rejected"))})
    return L.quality_report([items, sources, articles, L.orphans("label has document", c.table("labels"), c.new, "doc_id")])


# --- decisions --------------------------------------------------------------------------------------------

V.VIEWS["v_valid_decisions"] = """
SELECT event_id, split_part(payload, ':', 2) AS article_id, ts,
  CASE split_part(payload, ':', 1) WHEN 'odobri' THEN 'approved' ELSE 'rejected' END AS decision
FROM v_decisions WHERE chat_id = 'desk' AND split_part(payload, ':', 1) IN ('odobri', 'odbij')
"""


@plan(
    "decision_events",
    "SELECT event_id, article_id, decision FROM v_valid_decisions",
)
def decision_events(c):
    return L.parse_decisions(c.decisions, "desk").select("event_id", "article_id", "decision")


@plan(
    "apply_decisions",
    """WITH f AS (SELECT article_id, min_by(decision, (ts, event_id)) AS decision, min(ts) AS at FROM v_valid_decisions GROUP BY 1)
    SELECT a.article_id, CASE f.decision WHEN 'approved' THEN 'published' WHEN 'rejected' THEN 'rejected' ELSE 'pending_review' END AS status,
      CASE WHEN f.decision = 'approved' THEN CAST(floor(epoch(f.at)) AS BIGINT) END AS published_s
    FROM (SELECT DISTINCT user_id::VARCHAR AS article_id FROM events) a LEFT JOIN f USING (article_id)""",
)
def apply_decisions(c):
    articles = c.events.select(F.col("user_id").cast("string").alias("article_id")).distinct()
    decided = L.apply_decisions(articles, L.parse_decisions(c.decisions, "desk"))
    return decided.select("article_id", "status", seconds("published_at").alias("published_s"))


@plan(
    "expire_reviews",
    """WITH d AS (SELECT r.article_id, min_by(d.decision, (d.ts, d.event_id)) AS decision FROM v_reviews r
      JOIN v_valid_decisions d ON d.article_id = r.article_id::VARCHAR AND d.ts >= r.sent_at AND d.ts < r.sent_at + INTERVAL 2 HOUR GROUP BY 1)
    SELECT r.article_id::VARCHAR AS article_id, coalesce(d.decision, CASE WHEN r.sent_at + INTERVAL 2 HOUR <= TIMESTAMP '2024-01-31 00:00:00' THEN 'expired' ELSE 'pending' END) AS status,
      CAST(floor(epoch(r.sent_at)) AS BIGINT) AS sent_s FROM v_reviews r LEFT JOIN d USING (article_id)""",
)
def expire_reviews(c):
    reviews = c.reviews.withColumn("article_id", F.col("article_id").cast("string"))
    settled = L.settle_reviews(reviews, L.parse_decisions(c.decisions, "desk"), c.now)
    return settled.select("article_id", "status", seconds("sent_at").alias("sent_s"))

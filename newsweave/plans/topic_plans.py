"""Vectors, similarity, topics, titles and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave import params as P
from newsweave.functions.times import round_half_up
from newsweave.operators import moving, topics as TP, vectors as VC
from newsweave.plans import views as V
from newsweave.plans.registry import plan
from newsweave.plans.text_plans import BODY, LIVE_SQL, MULTI_SQL, STEM_SQL, STOP_SQL
from newsweave.sinks import ensure_checkpoint_dir, materialize

TP_DEFAULT = P.TopicParams()

# --- checking SQL: vectors -------------------------------------------------------------------

_WORDS = r"unnest(string_split_regex({text}, '[^\p{{L}}\p{{N}}]+'))"
_PIECE = (
    "list_filter(string_split_regex(word, '[^a-z0-9]+'), lambda p: length(p) >= 3 "
    f"AND p NOT IN ({STOP_SQL}) AND NOT (regexp_full_match(p, '[0-9]+') AND length(p) < 4))[1]"
)
V.VIEWS["v_tf"] = f"""
SELECT doc_id, {STEM_SQL.format(w='piece')} AS term, CAST(sum(weight) AS BIGINT) AS tf FROM (
  SELECT doc_id, weight, {_PIECE} AS piece FROM (
    SELECT doc_id, 3 AS weight, {_WORDS.format(text=V.match_key('title'))} AS word FROM v_items
    UNION ALL SELECT doc_id, 1, {_WORDS.format(text=V.match_key(BODY))} FROM v_items))
WHERE piece IS NOT NULL GROUP BY 1, 2
"""
V.VIEWS["v_df"] = "SELECT term, count(*) AS df FROM v_tf GROUP BY 1"
V.VIEWS["v_idf"] = (
    "SELECT term, df, ln(((SELECT greatest(1, count(*)) FROM v_items) + 1) / (df + 1)) + 1 AS idf FROM v_df"
)
V.VIEWS["v_raw"] = """
SELECT doc_id, term, CAST(floor((1 + ln(tf)) * idf * 100000 + 0.5) AS BIGINT) AS raw
FROM v_tf JOIN v_idf USING (term)
"""
V.VIEWS["v_unit"] = """
SELECT r.doc_id, term, CAST(floor(raw * 100000000 / sqrt(ss) + 0.5) AS BIGINT) AS w
FROM v_raw r JOIN (SELECT doc_id, CAST(sum(raw * raw) AS BIGINT) AS ss FROM v_raw GROUP BY 1) n USING (doc_id)
"""
V.VIEWS["v_names"] = """
SELECT doc_id, list_distinct(list(lower(entity))) AS names FROM v_top_entities GROUP BY 1
"""
# Centroids of all topics, and of the topics known before the new items arrived.
V.VIEWS["v_mean"] = """
SELECT topic_id, term, CAST(floor(sum(w) / any_value(size) + 0.5) AS BIGINT) AS raw
FROM v_unit JOIN v_links USING (doc_id)
JOIN (SELECT topic_id, count(*) AS size FROM v_links GROUP BY 1) USING (topic_id)
GROUP BY 1, 2 HAVING raw > 0
"""
V.VIEWS["v_known_links"] = f"SELECT * FROM v_links WHERE added_s < {V.KNOWN_UNTIL}"
V.VIEWS["v_known_mean"] = V.VIEWS["v_mean"].replace("v_links", "v_known_links")


def _stored(mean: str) -> str:
    return f"""
SELECT topic_id, term, CAST(floor(raw * 10000 / len + 0.5) AS BIGINT) AS raw FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY raw DESC, term) AS rank
  FROM {mean} QUALIFY rank <= 120)
JOIN (SELECT topic_id, sqrt(CAST(sum(raw * raw) AS BIGINT)) AS len FROM {mean} GROUP BY 1) USING (topic_id)
"""


V.VIEWS["v_stored"] = _stored("v_mean")
V.VIEWS["v_topic_unit"] = """
SELECT topic_id, term, CAST(floor(raw * 100000000 / sqrt(ss) + 0.5) AS BIGINT) AS w
FROM v_known_mean JOIN (SELECT topic_id, CAST(sum(raw * raw) AS BIGINT) AS ss FROM v_known_mean GROUP BY 1) USING (topic_id)
"""
V.VIEWS["v_seen"] = """
SELECT topic_id, entity, min((item_s, doc_id, rank)) AS seen, min(item_s) FILTER (WHERE added_s < {known}) AS k
FROM v_top_entities JOIN v_members USING (doc_id) GROUP BY 1, 2
""".format(known=V.KNOWN_UNTIL)
V.VIEWS["v_topic_names"] = f"""
SELECT topic_id, list_distinct(list(lower(entity))) AS names
FROM v_top_entities JOIN v_members USING (doc_id) WHERE added_s < {V.KNOWN_UNTIL} GROUP BY 1
"""
V.VIEWS["v_topic_start"] = (
    f"SELECT topic_id, min(item_s) AS start_s FROM v_members WHERE added_s < {V.KNOWN_UNTIL} GROUP BY 1"
)


def _overlap(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) "
        f"/ least(len({a}), len({b})) ELSE 0.0 END"
    )


# Every new item against every known topic it shares a term with, in full.
V.VIEWS["v_pairs"] = f"""
SELECT doc_id, topic_id, start_s, text_sim, entity_sim,
       floor((text_sim * 0.8 + entity_sim * 0.2) * 1000000 + 0.5) / 1000000 AS similarity FROM (
  SELECT d.doc_id, d.topic_id, s.start_s, floor(dot / 1e10 + 0.5) / 1e6 AS text_sim,
         {_overlap('i.names', 't.names')} AS entity_sim
  FROM (SELECT u.doc_id, c.topic_id, CAST(sum(u.w * c.w) AS BIGINT) AS dot
        FROM v_unit u JOIN v_topic_unit c USING (term) JOIN v_new n ON n.doc_id = u.doc_id GROUP BY 1, 2) d
  JOIN v_topic_start s USING (topic_id)
  LEFT JOIN v_names i ON i.doc_id = d.doc_id LEFT JOIN v_topic_names t ON t.topic_id = d.topic_id)
"""
V.VIEWS["v_similar"] = "SELECT * FROM v_pairs WHERE text_sim >= 0.19 AND similarity >= 0.38"


# --- Spark side --------------------------------------------------------------------------------


class Vectors:
    """Vectors of all items and of the known topics, shared by the plans of one query."""

    def __init__(self, c):
        ensure_checkpoint_dir(c.spark)
        self.c = c
        text = c.timed.select("doc_id", "title", "content", "item_at", "fetched_at")
        # One row per item with its vector, names and topics, read several times below.
        self.items = VC.item_table(text, keep=("fetched_at",), links=c.links)
        self.is_new = F.col("fetched_at") >= c.known_until
        self.known_links = c.links.filter(F.col("added_at") < c.known_until)

    def nodes(self, only=None):
        """Similarity nodes of all items, with weights from the whole corpus."""
        items = self.items if only is None else self.items.filter(only)
        return materialize(TP.signed(items.select("doc_id", "item_at", "entities", "vec")), "nodes")

    def topic_nodes(self):
        """Nodes of the known topics."""
        return TP.mean_nodes(TP.members_of(self.items, F.col("added_at") < self.c.known_until), self.known_links)


@plan("term_freq", "SELECT doc_id, term, tf FROM v_tf")
def term_freq(c):
    return VC.term_frequencies(c.items)


@plan("doc_freq", "SELECT term, df FROM v_df")
def doc_freq(c):
    return VC.document_frequencies(VC.term_frequencies(c.items))


@plan("idf", f"SELECT term, df, {V.half_up('idf', 6)} AS idf FROM v_idf")
def idf(c):
    tf = VC.term_frequencies(c.items)
    weights = VC.inverse_frequencies(VC.document_frequencies(tf), c.items)
    return weights.select("term", "df", round_half_up(F.col("idf"), 6).alias("idf"))


@plan(
    "tfidf_top_terms",
    """SELECT doc_id, term, w / 1e8 AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS rank
    FROM v_unit QUALIFY rank <= 10""",
)
def tfidf_top_terms(c):
    top = VC.top_terms(VC.item_weights(c.items), "doc_id", 10)
    return top.select(
        "doc_id", "term", (F.col("w") / 1e8).alias("weight"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@plan("topic_centroids", "SELECT topic_id, term, raw / 10000 AS weight FROM v_stored")
def topic_centroids(c):
    stored = VC.stored_centroids(VC.centroids(VC.item_weights(c.items), c.links))
    return stored.select("topic_id", "term", (F.col("raw") / 10000).alias("weight"))


@plan(
    "topic_entities",
    """SELECT topic_id, entity, row_number() OVER (PARTITION BY topic_id ORDER BY seen, entity) AS rank
    FROM v_seen QUALIFY rank <= 20""",
)
def topic_entities(c):
    named = VC.item_entities(c.members).select("topic_id", "doc_id", "item_at", "entities")
    lists = TP.topic_entities(named, TP_DEFAULT.topic_entities)
    return lists.select("topic_id", F.posexplode("entities").alias("at", "entity")).select(
        "topic_id", "entity", (F.col("at") + 1).cast("bigint").alias("rank")
    )


@plan(
    "topic_titles",
    f"""WITH cl AS (SELECT l.topic_id, u.doc_id, CAST(sum(u.w * m.raw) AS BIGINT) AS closeness FROM v_unit u
      JOIN v_links l USING (doc_id) JOIN v_mean m ON m.topic_id = l.topic_id AND m.term = u.term GROUP BY 1, 2),
    f AS (SELECT doc_id, title, {MULTI_SQL} OR {LIVE_SQL} AS unsuitable FROM v_items)
    SELECT l.topic_id, l.doc_id AS title_doc_id, f.title AS title_sample FROM v_links l JOIN f USING (doc_id)
    LEFT JOIN cl ON cl.topic_id = l.topic_id AND cl.doc_id = l.doc_id
    QUALIFY row_number() OVER (PARTITION BY l.topic_id ORDER BY unsuitable, coalesce(closeness, 0) DESC, l.doc_id) = 1
    """,
)
def topic_titles(c):
    # The weights lie by item already, so their topics are joined to them before they are stored.
    weights = materialize(VC.member_weights(VC.item_weights(c.items), c.links), "member-weights")
    means = VC.centroids(weights, None)
    return TP.topic_titles(c.members.select("topic_id", "doc_id", "title"), weights, means)


V.VIEWS["v_surface"] = rf"""
SELECT doc_id, term, min_by(word, pos) AS surface FROM (
  SELECT doc_id, pos, word, {STEM_SQL.format(w='piece')} AS term FROM (
    SELECT doc_id, pos, latin AS word, {_PIECE} AS piece FROM (
      SELECT doc_id, pos, latin, lower({V.fold('latin')}) AS word FROM (
        SELECT doc_id, unnest(ws) AS latin, generate_subscripts(ws, 1) AS pos FROM (
          SELECT doc_id, list_concat(string_split_regex({V.latin('title')}, '[^\p{{L}}\p{{N}}]+'),
            string_split_regex({V.latin(BODY)}, '[^\p{{L}}\p{{N}}]+')) AS ws FROM v_items))))
  WHERE piece IS NOT NULL) GROUP BY 1, 2
"""


@plan(
    "topic_keywords",
    """WITH h AS (SELECT topic_id, term, row_number() OVER (PARTITION BY topic_id ORDER BY raw DESC, term) AS rank
      FROM v_mean QUALIFY rank <= 8)
    SELECT h.topic_id, h.rank, min_by(s.surface, (m.item_s, m.doc_id)) AS keyword
    FROM h JOIN v_members m USING (topic_id) JOIN v_surface s ON s.doc_id = m.doc_id AND s.term = h.term GROUP BY 1, 2""",
)
def topic_keywords(c):
    means = VC.centroids(VC.item_weights(c.items), c.links)
    # Read for the spellings and for the ranks.
    heaviest = materialize(TP.heaviest_terms(means), "heaviest-terms")
    found = TP.topic_keywords(
        c.members.select("topic_id", "doc_id", "item_at"), heaviest, TP.keyword_spellings(c.members, heaviest)
    )
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@plan(
    "similar_pairs",
    "SELECT doc_id, topic_id, text_sim, entity_sim, similarity FROM v_similar",
)
def similar_pairs(c):
    v = Vectors(c)
    pairs = TP.item_topic_pairs(v.nodes(v.is_new), v.topic_nodes(), 0.38, 0.2)
    return pairs.select(
        F.col("l_id").alias("doc_id"), F.col("r_id").alias("topic_id"),
        "text_sim", "entity_sim", "similarity",
    )


_BEST = "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, start_s, topic_id) = 1"


@plan(
    "best_topic_per_item",
    f"SELECT doc_id, topic_id, similarity FROM v_pairs WHERE text_sim >= 0.19 {_BEST}",
)
def best_topic_per_item(c):
    v = Vectors(c)
    pairs = TP.item_topic_pairs(v.nodes(v.is_new), v.topic_nodes(), 0.0, 0.2, text_cut=0.19)
    return TP.best_topic(pairs)


@plan("assign_to_topics", f"SELECT doc_id, topic_id, similarity FROM v_similar {_BEST}")
def assign_to_topics(c):
    v = Vectors(c)
    return TP.assign_to_topics(v.nodes(v.is_new), v.topic_nodes())


_LEVELS = [0.30, 0.38, 0.50, 0.62]




def _sweep_sql() -> str:
    """The loop at each threshold, over the pairs that count there."""
    ctes, parts = [], []
    for i, t in enumerate(_LEVELS):
        ctes.append(
            f"""s{i} AS MATERIALIZED (SELECT DISTINCT doc_id FROM sp WHERE text_sim >= {t / 2!r} AND similarity >= {t!r}),
    e{i} AS MATERIALIZED (SELECT a, list(b) AS earlier, row_number() OVER (ORDER BY a_s, a) AS k FROM ip WHERE text_sim >= {t / 2!r} AND similarity >= {t!r}
      AND a NOT IN (SELECT doc_id FROM s{i}) AND b NOT IN (SELECT doc_id FROM s{i}) GROUP BY a, a_s),
    w{i}(k, followers) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
      SELECT e.k, CASE WHEN len(list_filter(e.earlier, lambda x: NOT list_contains(w.followers, x))) > 0 THEN list_append(w.followers, e.a) ELSE w.followers END
      FROM w{i} w JOIN e{i} e ON e.k = w.k + 1)"""
        )
        parts.append(
            f"""SELECT {t!r}::DOUBLE AS threshold, (SELECT count(*) FROM s{i}) AS joined_stored,
      (SELECT len(followers) FROM w{i} ORDER BY k DESC LIMIT 1) AS joined_new,
      (SELECT count(*) FROM v_new) - (SELECT count(*) FROM s{i}) - (SELECT len(followers) FROM w{i} ORDER BY k DESC LIMIT 1) AS opened"""
        )
    return f"""WITH RECURSIVE sp AS MATERIALIZED (SELECT doc_id, text_sim, similarity FROM v_pairs WHERE text_sim >= 0.15),
    nu AS MATERIALIZED (SELECT u.* FROM v_unit u JOIN v_new USING (doc_id)),
    ip AS MATERIALIZED (SELECT a, b, text_sim, floor((text_sim * 0.8 + entity_sim * 0.2) * 1000000 + 0.5) / 1000000 AS similarity, a_s FROM (
      SELECT d.a, d.b, ta.item_s AS a_s, floor(dot / 1e10 + 0.5) / 1e6 AS text_sim, {_overlap('i.names', 't.names')} AS entity_sim
      FROM (SELECT u.doc_id AS a, v.doc_id AS b, CAST(sum(u.w * v.w) AS BIGINT) AS dot FROM nu u JOIN nu v ON u.term = v.term AND u.doc_id <> v.doc_id GROUP BY 1, 2) d
      JOIN v_timed ta ON ta.doc_id = d.a JOIN v_timed tb ON tb.doc_id = d.b LEFT JOIN v_names i ON i.doc_id = d.a LEFT JOIN v_names t ON t.doc_id = d.b
      WHERE (tb.item_s, d.b) < (ta.item_s, d.a))),
    {", ".join(ctes)}
    {" UNION ALL ".join(parts)}"""


@plan("threshold_sweep", _sweep_sql())
def threshold_sweep(c):
    v = Vectors(c)
    return TP.threshold_sweep(v.nodes(v.is_new), v.topic_nodes(), _LEVELS)


# All items against all earlier items, then the sequential loop over the similar pairs.
V.VIEWS["v_item_pairs"] = f"""
SELECT a, b, floor((text_sim * 0.8 + entity_sim * 0.2) * 1000000 + 0.5) / 1000000 AS similarity, a_s, b_s FROM (
  SELECT d.a, d.b, ta.item_s AS a_s, tb.item_s AS b_s, floor(dot / 1e10 + 0.5) / 1e6 AS text_sim,
         {_overlap('i.names', 't.names')} AS entity_sim
  FROM (SELECT u.doc_id AS a, v.doc_id AS b, CAST(sum(u.w * v.w) AS BIGINT) AS dot
        FROM v_unit u JOIN v_unit v ON u.term = v.term AND u.doc_id <> v.doc_id GROUP BY 1, 2) d
  JOIN v_timed ta ON ta.doc_id = d.a JOIN v_timed tb ON tb.doc_id = d.b
  LEFT JOIN v_names i ON i.doc_id = d.a LEFT JOIN v_names t ON t.doc_id = d.b
  WHERE (tb.item_s, d.b) < (ta.item_s, d.a))
WHERE text_sim >= 0.19 AND similarity >= 0.38
"""


@plan(
    "rebuild_topics",
    """WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM v_item_pairs),
    nb AS MATERIALIZED (SELECT a, a_s, list(b) AS earlier, row_number() OVER (ORDER BY a_s, a) AS k FROM p GROUP BY 1, 2),
    step(k, followers) AS (
      SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
      UNION ALL
      SELECT nb.k, CASE WHEN len(list_filter(nb.earlier, lambda e: NOT list_contains(step.followers, e))) > 0
        THEN list_append(step.followers, nb.a) ELSE step.followers END
      FROM step JOIN nb ON nb.k = step.k + 1),
    f AS MATERIALIZED (SELECT unnest(followers) AS doc_id FROM (SELECT followers FROM step ORDER BY k DESC LIMIT 1)),
    joined AS (SELECT p.a AS doc_id, p.b AS topic_id, p.similarity FROM p
      WHERE p.a IN (SELECT doc_id FROM f) AND p.b NOT IN (SELECT doc_id FROM f)
      QUALIFY row_number() OVER (PARTITION BY p.a ORDER BY similarity DESC, b_s, b) = 1)
    SELECT doc_id, topic_id, similarity FROM joined
    UNION ALL SELECT doc_id, doc_id, 1.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)""",
)
def rebuild_topics(c):
    v = Vectors(c)
    return TP.group_items(v.nodes()).select("doc_id", "topic_id", "similarity")


# Topics that appeared after the known ones, against those and among themselves.
V.VIEWS["v_fresh_links"] = (
    "SELECT * FROM v_links WHERE topic_id NOT IN (SELECT topic_id FROM v_known_links)"
)
V.VIEWS["v_fresh_mean"] = V.VIEWS["v_mean"].replace("v_links", "v_fresh_links")
V.VIEWS["v_fresh_unit"] = V.VIEWS["v_topic_unit"].replace("v_known_mean", "v_fresh_mean")
V.VIEWS["v_fresh_names"] = V.VIEWS["v_topic_names"].replace(
    f"v_members USING (doc_id) WHERE added_s < {V.KNOWN_UNTIL}",
    "v_members USING (doc_id) WHERE topic_id IN (SELECT topic_id FROM v_fresh_links)",
)
V.VIEWS["v_fresh_start"] = (
    "SELECT topic_id, min(item_s) AS start_s FROM v_members "
    "WHERE topic_id IN (SELECT topic_id FROM v_fresh_links) GROUP BY 1"
)


def _topic_pairs(kind: str, also: str) -> str:
    return f"""
SELECT a, b, a_s, b_s FROM (
  SELECT d.a, d.b, ta.start_s AS a_s, tb.start_s AS b_s, floor(dot / 1e10 + 0.5) / 1e6 AS text_sim,
         {_overlap('na.names', 'nb.names')} AS entity_sim
  FROM (SELECT x.topic_id AS a, y.topic_id AS b, CAST(sum(x.w * y.w) AS BIGINT) AS dot
        FROM v_fresh_unit x JOIN v_{kind}_unit y USING (term) GROUP BY 1, 2) d
  JOIN v_fresh_start ta ON ta.topic_id = d.a JOIN v_{kind}_start tb ON tb.topic_id = d.b
  LEFT JOIN v_fresh_names na ON na.topic_id = d.a LEFT JOIN v_{kind}_names nb ON nb.topic_id = d.b)
WHERE text_sim >= 0.15 AND floor((text_sim * 0.8 + entity_sim * 0.2) * 1000000 + 0.5) / 1000000 >= 0.3 {also}
"""


# --- one run of the job: the unlinked items of the last four days, the covered topics in play, and what comes of them ---
RUN_FROM = V.NOW - 4 * V.DAY
V.VIEWS["v_run"] = f"""
SELECT doc_id FROM v_items WHERE fetched_s >= {RUN_FROM} AND fetched_s <= {V.NOW} AND length(title) >= 20 AND NOT {MULTI_SQL}
  AND doc_id NOT IN (SELECT doc_id FROM v_links WHERE added_s < {RUN_FROM})
"""
V.VIEWS["v_pool_links"] = f"""
SELECT l.* FROM v_links l JOIN v_topics t USING (topic_id) WHERE t.status = 'covered' AND t.last_s >= {RUN_FROM} AND l.added_s < {RUN_FROM}
"""
V.VIEWS["v_pool_mean"] = V.VIEWS["v_mean"].replace("v_links", "v_pool_links")
V.VIEWS["v_pool_unit"] = V.VIEWS["v_topic_unit"].replace("v_known_mean", "v_pool_mean")
V.VIEWS["v_pool_names"] = (
    "SELECT topic_id, list_distinct(list(lower(entity))) AS names FROM v_top_entities JOIN v_pool_links USING (doc_id) GROUP BY 1"
)
V.VIEWS["v_pool_start"] = (
    "SELECT topic_id, min(item_s) AS start_s FROM v_timed JOIN v_pool_links USING (doc_id) GROUP BY 1"
)


def _run_pairs(unit: str, key: str, other: str, other_key: str, names: str, other_names: str, least: float, cut: float) -> str:
    return f"""SELECT a, b, text_sim, floor((text_sim * 0.8 + entity_sim * 0.2) * 1000000 + 0.5) / 1000000 AS similarity FROM (
      SELECT d.a, d.b, floor(dot / 1e10 + 0.5) / 1e6 AS text_sim, {_overlap('na.names', 'nb.names')} AS entity_sim
      FROM (SELECT x.{key} AS a, y.{other_key} AS b, CAST(sum(x.w * y.w) AS BIGINT) AS dot FROM {unit} x JOIN {other} y USING (term) GROUP BY 1, 2) d
      LEFT JOIN {names} na ON na.{key} = d.a LEFT JOIN {other_names} nb ON nb.{other_key} = d.b)
    WHERE text_sim >= {cut} AND similarity >= {least}"""


def _run_ctes(p: str, unit: str, pool: str) -> str:
    """One run of the job as CTEs with a prefix: the items of ``fr`` against the topics of ``pool``, then the merge."""
    return f"""{p}fu AS MATERIALIZED (SELECT u.* FROM {unit} u JOIN {p}fr USING (doc_id)),
    {p}ps AS MATERIALIZED ({_run_pairs(f"{p}fu", "doc_id", f"{pool}_unit", "topic_id", "v_names", f"{pool}_names", 0.38, 0.19)}),
    {p}pn AS MATERIALIZED (SELECT p.*, x.item_s AS a_s, y.item_s AS b_s FROM ({_run_pairs(f"{p}fu", "doc_id", f"{p}fu", "doc_id", "v_names", "v_names", 0.38, 0.19)}) p
      JOIN {p}fr x ON x.doc_id = p.a JOIN {p}fr y ON y.doc_id = p.b WHERE (y.item_s, p.b) < (x.item_s, p.a)),
    {p}nb AS MATERIALIZED (SELECT a, list(b) AS earlier, row_number() OVER (ORDER BY any_value(a_s), a) AS k
      FROM {p}pn WHERE a NOT IN (SELECT a FROM {p}ps) GROUP BY a),
    {p}step(k, followers) AS (
      SELECT CAST(0 AS BIGINT), coalesce((SELECT list(DISTINCT a) FROM {p}ps), CAST([] AS BIGINT[]))
      UNION ALL
      SELECT nb.k, CASE WHEN len(list_filter(nb.earlier, lambda e: NOT list_contains({p}step.followers, e))) > 0
        THEN list_append({p}step.followers, nb.a) ELSE {p}step.followers END FROM {p}step JOIN {p}nb nb ON nb.k = {p}step.k + 1),
    {p}f AS MATERIALIZED (SELECT unnest(followers) AS doc_id FROM (SELECT followers FROM {p}step ORDER BY k DESC LIMIT 1)),
    {p}op AS (SELECT a, b, similarity, false AS is_new, start_s AS b_s FROM {p}ps JOIN {pool}_start ON topic_id = b
      UNION ALL SELECT a, b, similarity, true, b_s FROM {p}pn WHERE a IN (SELECT doc_id FROM {p}f) AND b NOT IN (SELECT doc_id FROM {p}f)),
    {p}g AS MATERIALIZED (SELECT a AS doc_id, b AS topic_id, similarity, is_new FROM {p}op
        QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, is_new, b_s, b) = 1
      UNION ALL SELECT doc_id, doc_id, 1.0, true FROM {p}fr WHERE doc_id NOT IN (SELECT doc_id FROM {p}f)),
    {p}nl AS MATERIALIZED (SELECT topic_id, doc_id, item_s FROM {p}g JOIN {p}fr USING (doc_id) WHERE is_new),
    {p}nm AS MATERIALIZED (SELECT topic_id, term, CAST(floor(sum(w) / any_value(size) + 0.5) AS BIGINT) AS raw FROM {unit} JOIN {p}nl USING (doc_id)
      JOIN (SELECT topic_id, count(*) AS size FROM {p}nl GROUP BY 1) USING (topic_id) GROUP BY 1, 2 HAVING raw > 0),
    {p}nu AS MATERIALIZED (SELECT topic_id, term, CAST(floor(raw * 100000000 / sqrt(ss) + 0.5) AS BIGINT) AS w
      FROM {p}nm JOIN (SELECT topic_id, CAST(sum(raw * raw) AS BIGINT) AS ss FROM {p}nm GROUP BY 1) USING (topic_id)),
    {p}nn AS MATERIALIZED (SELECT topic_id, list_distinct(list(lower(entity))) AS names FROM v_top_entities JOIN {p}nl USING (doc_id) GROUP BY 1),
    {p}ns AS MATERIALIZED (SELECT topic_id, min(item_s) AS start_s FROM {p}nl GROUP BY 1),
    {p}ms AS MATERIALIZED ({_run_pairs(f"{p}nu", "topic_id", f"{pool}_unit", "topic_id", f"{p}nn", f"{pool}_names", 0.3, 0.15)}),
    {p}mn AS MATERIALIZED (SELECT p.*, x.start_s AS a_s, y.start_s AS b_s FROM ({_run_pairs(f"{p}nu", "topic_id", f"{p}nu", "topic_id", f"{p}nn", f"{p}nn", 0.3, 0.15)}) p
      JOIN {p}ns x ON x.topic_id = p.a JOIN {p}ns y ON y.topic_id = p.b WHERE (y.start_s, p.b) < (x.start_s, p.a)),
    {p}mb AS MATERIALIZED (SELECT a, list(b) AS earlier, row_number() OVER (ORDER BY any_value(a_s), a) AS k
      FROM {p}mn WHERE a NOT IN (SELECT a FROM {p}ms) GROUP BY a),
    {p}merge(k, gone) AS (
      SELECT CAST(0 AS BIGINT), coalesce((SELECT list(DISTINCT a) FROM {p}ms), CAST([] AS BIGINT[]))
      UNION ALL
      SELECT mb.k, CASE WHEN len(list_filter(mb.earlier, lambda e: NOT list_contains({p}merge.gone, e))) > 0
        THEN list_append({p}merge.gone, mb.a) ELSE {p}merge.gone END FROM {p}merge JOIN {p}mb mb ON mb.k = {p}merge.k + 1),
    {p}mf AS MATERIALIZED (SELECT unnest(gone) AS topic_id FROM (SELECT gone FROM {p}merge ORDER BY k DESC LIMIT 1)),
    {p}mo AS (SELECT a, b, start_s AS b_s, 0 AS fresh FROM {p}ms JOIN {pool}_start ON topic_id = b
      UNION ALL SELECT a, b, b_s, 1 FROM {p}mn WHERE a IN (SELECT topic_id FROM {p}mf) AND b NOT IN (SELECT topic_id FROM {p}mf)),
    {p}mt AS (SELECT a, b FROM {p}mo QUALIFY row_number() OVER (PARTITION BY a ORDER BY fresh, b_s, b) = 1),
    {p}done AS MATERIALIZED (SELECT g.doc_id, coalesce(mt.b, g.topic_id) AS topic_id, g.similarity, g.is_new FROM {p}g g LEFT JOIN {p}mt mt ON mt.a = g.topic_id AND g.is_new)"""


@plan(
    "cluster_run",
    f"""WITH RECURSIVE fr AS MATERIALIZED (SELECT doc_id, item_s FROM v_run JOIN v_timed USING (doc_id)),
    {_run_ctes("", "v_unit", "v_pool")}
    SELECT * FROM done""",
)
def cluster_run(c):
    """The job over the last four days, whose items have no link yet, against topics that have an article."""
    window = P.TopicParams(window_hours=4 * 24)
    links = c.links.filter(F.col("added_at") < F.timestamp_seconds(F.lit(RUN_FROM)))
    topics = c.topics.filter("status = 'covered'").select("topic_id", "status", "last_item_at")
    items = c.timed.select("doc_id", "title", "content", "item_at", "fetched_at")
    return TP.cluster_run(items, links, topics, c.now, window)


V.VIEWS["v_stored_pairs"] = _topic_pairs("topic", "")
V.VIEWS["v_fresh_pairs"] = _topic_pairs("fresh", "AND (b_s, b) < (a_s, a)")


@plan(
    "merge_topics",
    """WITH RECURSIVE ps AS MATERIALIZED (SELECT * FROM v_stored_pairs), pn AS MATERIALIZED (SELECT * FROM v_fresh_pairs),
    nb AS MATERIALIZED (SELECT a, list(b) AS earlier, row_number() OVER (ORDER BY any_value(a_s), a) AS k
      FROM pn WHERE a NOT IN (SELECT a FROM ps) GROUP BY a),
    step(k, followers) AS (
      SELECT CAST(0 AS BIGINT), coalesce((SELECT list(DISTINCT a) FROM ps), CAST([] AS BIGINT[]))
      UNION ALL
      SELECT nb.k, CASE WHEN len(list_filter(nb.earlier, lambda e: NOT list_contains(step.followers, e))) > 0
        THEN list_append(step.followers, nb.a) ELSE step.followers END
      FROM step JOIN nb ON nb.k = step.k + 1),
    f AS MATERIALIZED (SELECT unnest(followers) AS topic_id FROM (SELECT followers FROM step ORDER BY k DESC LIMIT 1)),
    o AS (SELECT a, b, b_s, 0 AS fresh FROM ps UNION ALL SELECT a, b, b_s, 1 FROM pn
      WHERE a IN (SELECT topic_id FROM f) AND b NOT IN (SELECT topic_id FROM f))
    SELECT a AS topic_id, b AS target_id FROM o QUALIFY row_number() OVER (PARTITION BY a ORDER BY fresh, b_s, b) = 1""",
)
def merge_topics(c):
    v = Vectors(c)
    known = materialize(v.known_links.select("topic_id").distinct(), "known-topics")
    fresh = TP.members_of(v.items).join(known, "topic_id", "left_anti")
    return TP.merge_topics(TP.mean_nodes(fresh, c.links.join(known, "topic_id", "left_anti")), v.topic_nodes())


# The loop itself: item after item against every topic as it stands, stored topics counting as members of their size.
_MEAN_TEXT = "floor(CAST(list_sum(list_transform(range(1, len(js) + 1), lambda i: CASE WHEN home[js[i]] = t THEN ds[i] ELSE 0 END)) AS DOUBLE) / {size} / 1e10 + 0.5) / 1e6"
_SIZE_OF = "list_sum(list_transform(range(1, p), lambda q: CASE WHEN home[q] = t THEN al.weights[q] ELSE 0 END))"
_NAMES_OF = "list_distinct(flatten(list_transform(list_filter(range(1, p), lambda q: home[q] = t), lambda q: al.names[q])))"


@plan(
    "moving_topics",
    f"""WITH RECURSIVE sizes AS (SELECT topic_id, count(*) AS size FROM v_known_links GROUP BY 1),
    st AS MATERIALIZED (SELECT topic_id, size, coalesce(names, []) AS names, row_number() OVER (ORDER BY start_s, topic_id) AS p
      FROM v_topic_start JOIN sizes USING (topic_id) LEFT JOIN v_topic_names USING (topic_id) WHERE topic_id IN (SELECT topic_id FROM v_topic_unit)),
    nw AS MATERIALIZED (SELECT doc_id, coalesce(names, []) AS names, (SELECT count(*) FROM st) + row_number() OVER (ORDER BY item_s, doc_id) AS p
      FROM v_new JOIN v_timed USING (doc_id) LEFT JOIN v_names USING (doc_id)),
    nu AS MATERIALIZED (SELECT p, term, w FROM v_unit JOIN nw USING (doc_id)),
    dots AS (SELECT x.p AS a, y.p AS b, sum(x.w::HUGEINT * y.w) AS dot, 1 AS weight FROM nu x JOIN nu y ON x.term = y.term AND y.p < x.p GROUP BY 1, 2
      UNION ALL SELECT x.p, st.p, sum(x.w::HUGEINT * c.w) * any_value(size), any_value(size) FROM nu x JOIN v_topic_unit c USING (term) JOIN st USING (topic_id) GROUP BY 1, 2),
    asks AS MATERIALIZED (SELECT a AS p, list(b) AS js, list(dot) AS ds, list(b) FILTER (WHERE dot >= 1.8e15 * weight) AS near FROM dots GROUP BY 1),
    al AS MATERIALIZED (SELECT list(weight ORDER BY p) AS weights, list(names ORDER BY p) AS names
      FROM (SELECT p, size AS weight, names FROM st UNION ALL SELECT p, 1, names FROM nw)),
    walk(p, home, sims) AS (
      SELECT (SELECT count(*) FROM st), (SELECT coalesce(list(p ORDER BY p), []) FROM st), (SELECT coalesce(list(1.0::DOUBLE), []) FROM st)
      UNION ALL
      SELECT p, list_append(home, CASE WHEN best.s >= 0.38 THEN -best.m ELSE p END), list_append(sims, CASE WHEN best.s >= 0.38 THEN best.s ELSE 1.0 END) FROM (
        SELECT p, home, sims, list_aggregate(list_transform(list_filter(scored, lambda x: x.text >= 0.19),
          lambda x: {{'s': floor((x.text * 0.8 + x.overlap * 0.2) * 1000000 + 0.5) / 1000000, 'm': -x.t}}), 'max') AS best FROM (
          SELECT p, home, sims, list_transform(near_topics, lambda t: {{'t': t, 'text': {_MEAN_TEXT.format(size=_SIZE_OF)},
            'overlap': {_overlap("al.names[p]", _NAMES_OF)}}}) AS scored FROM (
            SELECT w.p + 1 AS p, w.home, w.sims, asks.js, asks.ds,
              list_distinct(list_transform(coalesce(asks.near, []), lambda j: w.home[j])) AS near_topics
            FROM walk w JOIN nw ON nw.p = w.p + 1 LEFT JOIN asks ON asks.p = w.p + 1), al))),
    done AS MATERIALIZED (SELECT home, sims FROM walk ORDER BY p DESC LIMIT 1),
    placed AS (SELECT nw.doc_id, nw.p, done.home[nw.p] AS h, done.sims[nw.p] AS similarity FROM nw, done)
    SELECT placed.doc_id, coalesce(st.topic_id, opener.doc_id) AS topic_id, similarity, st.topic_id IS NULL AS is_new
    FROM placed LEFT JOIN st ON st.p = h LEFT JOIN nw opener ON opener.p = h""",
)
def moving_topics(c):
    """New items against the known topics and each other, every mean moving with the items that join."""
    v = Vectors(c)
    sizes = v.known_links.groupBy(F.col("topic_id").alias("id")).agg(F.count("*").alias("size"))
    weights = v.items.filter("copy = 0").select("doc_id", F.inline("vec"))
    return moving.group_items_moving(v.nodes(v.is_new), weights, v.topic_nodes().join(sizes, "id"))

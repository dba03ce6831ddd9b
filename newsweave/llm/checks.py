"""SQL that must give the rows of the queries it can express."""

from __future__ import annotations

from newsweave.llm import quality
from newsweave.llm.common import LOWER, UPPER

WS = r"[\x20\x09-\x0D]"

LINES = rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
  k AS (SELECT *, translate(regexp_replace(line, '^{WS}+|{WS}+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l),
  f AS (SELECT key, true AS frequent FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(frequent) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE frequent IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id"""

_WORDS = rf"""SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{WS}+'), lambda w: w <> '') AS ws FROM documents)"""

PASSAGES = f"""WITH w AS MATERIALIZED ({_WORDS}),
  windows AS (SELECT doc_id, i, md5(string_agg(word, ' ') OVER here) AS h, count(*) OVER here AS n FROM w
    WINDOW here AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
  first AS (SELECT h, min((doc_id, i)) AS place FROM windows WHERE n = 20 GROUP BY h),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i, true AS removed
    FROM windows JOIN first USING (h) WHERE n = 20 AND (doc_id, i) > place),
  kept AS (SELECT doc_id, count(*) AS n_words, count(removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE removed IS NULL) AS text
    FROM w LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)"""

COPIES = rf"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '{WS}+', '', 'g') AS key FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY key) AS group_size,
  doc_id = first_value(doc_id) OVER best AS kept, sha256(key) AS text_sha256
FROM n WINDOW best AS (PARTITION BY key ORDER BY chars DESC, doc_id)"""


def _rules() -> str:
    entries = (
        f"{{'rule': '{rule}', 'value': CAST({measure} AS DOUBLE), 'cuts': [{', '.join(f'{c}::DOUBLE' for c in cuts)}]}}"
        for rule, measure, cuts in quality.RULES
    )
    return f"unnest([{', '.join(entries)}])"


_ALPHA = quality.ALPHA / len(quality.RULES)
_STATS = rf"""w AS MATERIALIZED ({_WORDS}),
  t AS (SELECT doc_id, i, CASE WHEN lead(word, 2) OVER d IS NOT NULL THEN concat(word, ' ', lead(word) OVER d, ' ', lead(word, 2) OVER d) END AS tri
    FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
  r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (
    SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM t WHERE tri IS NOT NULL) WHERE n > 1) GROUP BY 1),
  l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
  c AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM w GROUP BY 1),
  s AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
    SELECT doc_id, lang, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_lines, 0) AS n_lines,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols
    FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)))"""

QUALITY = f"""WITH {_STATS},
  q AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1),
  m AS (SELECT lang, quality = 1 AS good, {_rules()} AS e FROM s JOIN q USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL),
  x AS (SELECT lang, good, e.rule AS rule, e.value AS value, unnest(e.cuts) AS cutoff, generate_subscripts(e.cuts, 1) AS step FROM m),
  n AS (SELECT lang, rule, step, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND value > cutoff) AS k,
    count(*) FILTER (WHERE NOT good) AS n_bad, count(*) FILTER (WHERE NOT good AND value > cutoff) AS k_bad FROM x GROUP BY 1, 2, 3, 4),
  p AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - (CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END)
    - (CASE WHEN n = j THEN 0 ELSE lgamma(n - j + 1) END) + j * ln({_ALPHA}) + (n - j) * ln(1 - {_ALPHA})))) AS p,
    {quality.DELTA} / ((SELECT greatest(1, count(*)) FROM (SELECT DISTINCT lang FROM n)) * {len(quality.RULES)}) AS level FROM n),
  o AS (SELECT *, bool_and(n > 0 AND p <= level) OVER (PARTITION BY lang, rule ORDER BY step) AS ok FROM p),
  h AS (SELECT lang, rule, min(cutoff) AS cutoff FROM o WHERE ok AND k_bad > 0 AND k_bad * n >= {quality.LIFT} * k * n_bad GROUP BY 1, 2),
  v AS (SELECT doc_id, bool_or(e.value > h.cutoff) AS rejected FROM (SELECT doc_id, lang, {_rules()} AS e FROM s) z
    JOIN h ON h.lang IS NOT DISTINCT FROM z.lang AND h.rule = z.e.rule GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM s LEFT JOIN v USING (doc_id)"""


_TURNS = r"""k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
      list_prepend(4294967295, list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind FROM conversations),
  names AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
  d AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
      CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM k) x JOIN names ON x.conv_id IS NOT DISTINCT FROM names.conv_id),
  o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
  rows_ AS MATERIALIZED (SELECT c, i, turn, role, text, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before,
      CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault FROM o)"""

CONVERSATIONS = f"""WITH RECURSIVE {_TURNS},
  steps(q, initial, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
  gap(q, cost, audit, body, q2) AS (VALUES (0, 0, '', []::VARCHAR[], 0), (1, 0, '', [], 1), (2, 0, '', [], 2), (3, 0, '', [], 3),
    (0, 3, 'I', ['user:'], 2), (1, 3, 'I', ['user:'], 2), (3, 3, 'I', ['user:'], 2), (2, 3, 'I', ['assistant:'], 3),
    (0, 6, 'II', ['user:', 'assistant:'], 3), (1, 6, 'II', ['user:', 'assistant:'], 3)),
  edits AS MATERIALIZED (
    SELECT c, i, q, q AS q2, 4 AS cost, 'D' AS audit, []::VARCHAR[] AS body FROM rows_, (SELECT unnest([0, 1, 2, 3]) AS q)
    UNION ALL SELECT c, i, q, q2, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', [concat(role, ':', text)]
      FROM rows_ JOIN steps USING (initial) WHERE fault IN ('none', 'truncated')
    UNION ALL SELECT c, i, q, q2, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', [concat(CASE steps.initial WHEN 'u' THEN 'user' ELSE 'assistant' END, ':', text)]
      FROM rows_, steps WHERE fault IN ('none', 'truncated') AND steps.initial <> 's'),
  walk(c, i, q, way) AS (SELECT c, 0::BIGINT, 0, {{'cost': 0, 'audit': '', 'body': []::VARCHAR[]}} FROM names
    UNION ALL SELECT w.c, w.i + 1, e.q2, min({{'cost': w.way.cost + g.cost + e.cost, 'audit': concat(w.way.audit, g.audit, e.audit), 'body': w.way.body || g.body || e.body}})
      FROM walk w JOIN gap g ON g.q = w.q JOIN edits e ON e.c = w.c AND e.i = w.i + 1 AND e.q = g.q2 GROUP BY 1, 2, 3),
  r AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
      count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
      count(*) FILTER (WHERE i > 1 AND concat(before, initial) NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY c),
  best AS (SELECT w.c, min({{'cost': w.way.cost + g.cost, 'audit': concat(w.way.audit, g.audit), 'body': w.way.body || g.body}}) AS way
    FROM walk w LEFT JOIN r USING (c) JOIN gap g ON g.q = w.q WHERE w.i = coalesce(r.n, 0) AND g.q2 IN (0, 3) GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(best.way.cost AS BIGINT) AS cost, best.way.audit AS audit, sha256(array_to_string(best.way.body, chr(10))) AS repaired_sha256
FROM names JOIN best USING (c) LEFT JOIN r USING (c)"""

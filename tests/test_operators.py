"""Relational operators on hand-made rows."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from newsweave import params as P
from newsweave.operators import ingest as I, lifecycle as L, material as M, scoring as S

NOW = datetime(2026, 9, 6, 12, tzinfo=timezone.utc)


def ago(hours):
    return NOW - timedelta(hours=hours)


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def score(spark, sources, angles, recent, newest_hours):
    frame = spark.range(1).select(
        S.trending_score(
            F.lit(sources), F.lit(angles), F.lit(recent), F.lit(ago(newest_hours)), F.lit(NOW)
        ).alias("s")
    )
    return frame.first()["s"]


def test_trending_order(spark):
    assert score(spark, 3, 1, 3, 0) < score(spark, 3, 3, 3, 0)
    assert score(spark, 3, 3, 0, 12) < score(spark, 3, 3, 3, 0) / 2
    assert score(spark, 0, 0, 0, 0) == 0
    # 1/e after twelve hours, not one half.
    assert score(spark, 10, 1, 0, 12) == 3.68


@pytest.mark.parametrize("sources, angles, size, n_reasons", [(3, 2, 4, 0), (3, 1, 3, 1), (1, 1, 1, 3)])
def test_quality_gates(spark, sources, angles, size, n_reasons):
    frame = spark.createDataFrame(
        [(sources, angles, size)], "distinct_sources INT, distinct_angles INT, size INT"
    )
    row = S.with_gates(frame).first()
    assert len(row["reasons"]) == n_reasons and row["passes"] == (n_reasons == 0)


def candidates(spark, specs):
    return spark.createDataFrame(
        [(i, float(s), f, p, [] if p else ["kapija"]) for i, s, f, p in specs],
        "topic_id INT, trending_score DOUBLE, needs_flagship BOOLEAN, passes BOOLEAN, reasons ARRAY<STRING>",
    )


def quota(spark, room, strong, written=0, binds=True, over=False):
    return spark.createDataFrame(
        [(written, room, binds, strong, over)],
        "written_today INT, room INT, daily_binds BOOLEAN, flagship_left INT, over_budget BOOLEAN",
    )


def test_selection_takes_the_strongest_and_saves_the_tier_quota(spark):
    topics = candidates(
        spark, [(1, 9, False, True), (2, 8, True, True), (3, 7, False, True), (4, 6, False, True), (5, 10, False, False)]
    )
    limits = P.LimitParams(per_day=10, per_run=3)
    chosen = {r["topic_id"]: r for r in S.select_topics(topics, quota(spark, 3, 1), limits).collect()}
    assert [chosen[i]["tier"] for i in (1, 2, 3, 4)] == ["flagship", "flagship", "default", None]
    assert chosen[4]["reasons"] == ["dnevna granica od 10 članaka je dostignuta (danas napisano 0)"]
    assert chosen[5]["reasons"] == ["kapija"] and not chosen[5]["selected"]


def test_selection_names_the_run_limit_when_the_day_has_room(spark):
    topics = candidates(spark, [(1, 9, False, True), (2, 8, False, True)])
    limits = P.LimitParams(per_run=1)
    full = S.select_topics(topics, quota(spark, 1, 3, binds=False), limits).filter("NOT selected").first()
    assert full["reasons"] == ["ciklus je popunjen (1 članaka)"]


def test_quota_state(spark):
    articles = spark.createDataFrame(
        [(ago(1), None, "flagship", 2.0), (ago(2), ago(1), "default", 1.5), (ago(30), None, "default", 1.0), (ago(24 * 40), None, "default", 99.0)],
        "created_at TIMESTAMP, last_update_at TIMESTAMP, model STRING, cost_usd DOUBLE",
    )
    row = S.quota_state(articles, F.lit(NOW), P.LimitParams(monthly_budget=4.6)).first()
    assert (row["written_today"], row["room"], row["flagship_left"], row["over_budget"]) == (3, 5, 2, False)
    broke = S.quota_state(articles, F.lit(NOW), P.LimitParams(monthly_budget=4.5)).first()
    assert broke["room"] == 0 and broke["over_budget"]


def test_call_cost(spark):
    usage = spark.createDataFrame(
        [("default", 1_000_000, 1_000_000, None, None), ("flagship", 1_000_000, 0, 0, 1_000_000), ("?", 0, 0, 1_000_000, None)],
        "model STRING, input_tokens BIGINT, output_tokens BIGINT, cache_creation_tokens BIGINT, cache_read_tokens BIGINT",
    )
    full = {r["model"]: float(r["total_cost"]) for r in S.call_cost(usage).collect()}
    assert full == {"default": 6.0, "flagship": 2.2, "?": 1.25}
    half = {r["model"]: float(r["total_cost"]) for r in S.call_cost(usage, batch=True).collect()}
    assert half == {m: c / 2 for m, c in full.items()}


def test_request_usage_adds_calls(spark):
    calls = spark.createDataFrame(
        [("r", "default", 1, 2, None, 4), ("r", "default", 10, 20, 30, None)],
        "request_id STRING, model STRING, input_tokens INT, output_tokens INT, cache_creation_tokens INT, cache_read_tokens INT",
    )
    assert tuple(S.request_usage(calls).first()) == ("r", "default", 11, 22, 30, 4)


def test_budget_cutoff_may_overshoot_once(spark):
    queue = spark.createDataFrame([(1, 1, 0.4), (2, 2, 0.4), (3, 3, 0.4)], "id INT, position_key INT, cost_usd DOUBLE")
    assert rows(S.budget_cutoff(queue, 0.5, 10), "id", "runs") == [(1, True), (2, True), (3, False)]


# --- ingest -------------------------------------------------------------------------------


def test_insert_ignore_under_both_unique_keys(spark):
    schema = "doc_id INT, source_id STRING, url_hash STRING, content_hash STRING"
    stored = spark.createDataFrame([(0, "a", "u0", "c0")], schema)
    offered = spark.createDataFrame(
        [(1, "a", "u0", "c1"), (2, "a", "u2", "c0"), (3, "b", "u3", "c0"), (4, "b", "u3", "c9"), (5, "b", "u5", "c0")], schema
    )
    assert rows(I.insert_ignore(offered, stored), "doc_id") == [(3,)]


def test_crawl_policy_longest_prefix(spark):
    items = spark.createDataFrame([(1, "https://a.rs/x/1"), (2, "https://a.rs/y"), (3, "https://b.rs/")], "doc_id INT, url STRING")
    policy = spark.createDataFrame([("a.rs", "/", True), ("a.rs", "/x/", False)], "host STRING, path_prefix STRING, allow BOOLEAN")
    assert rows(I.apply_crawl_policy(items, policy), "doc_id", "allowed") == [(1, False), (2, True), (3, True)]


def test_with_previous_and_numbered_cross_day_borders(spark):
    events = spark.createDataFrame(
        [("k", i, ago(40 - 10 * i), i // 2) for i in range(5)] + [("l", 9, ago(1), 7)],
        "key STRING, event_id INT, ts TIMESTAMP, v INT",
    )
    previous = I.with_previous(events, "key", "v")
    assert rows(previous, "key", "event_id", F.coalesce("previous", F.lit(-1))) == [
        ("k", 0, -1), ("k", 1, 0), ("k", 2, 0), ("k", 3, 1), ("k", 4, 1), ("l", 9, -1)]
    assert rows(L.numbered(events, "key", "n"), "key", "n") == [("k", 1), ("k", 2), ("k", 3), ("k", 4), ("k", 5), ("l", 1)]


def test_breaker_counts_after_the_last_success(spark):
    attempts = spark.createDataFrame(
        [("a", 1, ago(9), False), ("a", 2, ago(8), True), ("a", 3, ago(7), False), ("b", 4, ago(3), False), ("b", 5, ago(2), False),
         ("b", 6, ago(1), False), ("c", 7, ago(1), True)],
        "source_id STRING, event_id INT, ts TIMESTAMP, ok BOOLEAN",
    )
    state = {r["source_id"]: r for r in I.breaker_state(attempts).collect()}
    assert [state[s]["failures"] for s in "abc"] == [1, 3, 0]
    assert state["a"]["disabled_until"] is None
    assert state["b"]["disabled_until"].replace(tzinfo=timezone.utc) == NOW + timedelta(hours=5)


def test_feed_choice_prefers_shallow_then_full(spark):
    feeds = spark.createDataFrame(
        [("s", i, u, n) for i, (u, n) in enumerate([
            ("https://s.rs/feed", 5), ("https://s.rs/sport/feed", 50), ("https://s.rs/rss", 9), ("https://s.rs/prazan", 0),
            ("https://s.rs/comments/feed", 99)])],
        "source STRING, feed_id INT, url STRING, item_count INT",
    )
    chosen = I.choose_feeds(feeds).orderBy("rank").collect()
    assert [r["url"] for r in chosen] == ["https://s.rs/rss", "https://s.rs/feed", "https://s.rs/sport/feed"]


def test_unknown_source_counts_as_mainstream(spark):
    items = spark.createDataFrame([(1, "a"), (2, "x")], "doc_id INT, source_id STRING")
    sources = spark.createDataFrame([("a", "agencija")], "source_id STRING, angle STRING")
    assert rows(I.with_angle(items, sources), "doc_id", "angle") == [(1, "agencija"), (2, "mejnstrim")]


# --- lifecycle ----------------------------------------------------------------------------


def test_upsert_keeps_other_columns_and_can_set_null(spark):
    schema = "id INT, a STRING, b STRING"
    target = spark.createDataFrame([(1, "x", "keep"), (2, "y", "keep")], schema)
    changes = spark.createDataFrame([(2, None, "new"), (3, "z", "new")], schema)
    assert {r["id"]: (r["a"], r["b"]) for r in L.upsert(target, changes, ["id"], ["a"]).collect()} == {
        1: ("x", "keep"), 2: (None, "keep"), 3: ("z", None)}


def test_article_update_moves_old_version_to_history(spark):
    articles = spark.createDataFrame(
        [(1, "slug", "t", "l", "b", 1, 0.5, None), (2, "s2", "t", "l", "b", 3, 0.1, None)],
        "article_id INT, slug STRING, title STRING, lead STRING, body STRING, revision INT, cost_usd DOUBLE, last_update_at TIMESTAMP",
    )
    updates = spark.createDataFrame(
        [(1, "t2", "l2", "b2", 0.25, "novi izvori")],
        "article_id INT, title STRING, lead STRING, body STRING, cost_usd DOUBLE, reason STRING",
    )
    history = spark.createDataFrame([], "article_id INT, revision INT, title STRING, lead STRING, body STRING, reason STRING, cost_usd DOUBLE")
    new, log = L.apply_article_updates(articles, updates, history, F.lit(NOW))
    assert rows(new, "article_id", "slug", "title", "revision", "cost_usd") == [(1, "slug", "t2", 2, 0.75), (2, "s2", "t", 3, 0.1)]
    assert rows(log, "article_id", "revision", "title", "reason") == [(1, 1, "t", "novi izvori")]


@pytest.mark.parametrize(
    "url, drawn, updated, stale",
    [(None, None, None, True), ("u", 1, None, False), ("u", None, 1, True), ("u", 2, 1, True), ("u", 1, 2, False)],
)
def test_cover_is_stale(spark, url, drawn, updated, stale):
    at = lambda h: None if h is None else ago(h)
    frame = spark.createDataFrame(
        [(url, at(drawn), at(updated))], "cover_url STRING, cover_at TIMESTAMP, last_update_at TIMESTAMP"
    )
    assert frame.select(L.cover_is_stale().alias("s")).first()["s"] is stale


def test_decisions(spark):
    events = spark.createDataFrame(
        [(1, "odobri:7", "desk", ago(3)), (2, "odbij:7", "desk", ago(2)), (3, "odbij:8", "other", ago(1)), (4, "nesto:8", "desk", ago(1)),
         (5, "odobri:", "desk", ago(1)), (6, "odbij:9", "desk", ago(1))],
        "event_id INT, payload STRING, chat_id STRING, ts TIMESTAMP",
    )
    decisions = L.parse_decisions(events, "desk")
    assert rows(L.first_decision(decisions), "article_id", "decision") == [("7", "approved"), ("9", "rejected")]
    reviews = spark.createDataFrame([("7", ago(4)), ("8", ago(4)), ("9", ago(5)), ("10", ago(1))], "article_id STRING, sent_at TIMESTAMP")
    settled = L.settle_reviews(reviews, decisions, F.lit(NOW))
    assert rows(settled, "article_id", "status") == [("10", "pending"), ("7", "approved"), ("8", "expired"), ("9", "expired")]


def test_one_version_above_the_maximum_is_possible(spark):
    topics = spark.createDataFrame([(i, "t", "covered", ago(1)) for i in (1, 2)], "topic_id INT, title_sample STRING, status STRING, last_item_at TIMESTAMP")
    articles = spark.createDataFrame(
        [(1, 1, 5, None, ago(5)), (2, 2, 6, None, ago(5))], "topic_id INT, article_id INT, revision INT, last_update_at TIMESTAMP, created_at TIMESTAMP")
    members = spark.createDataFrame([(t, s, ago(1)) for t in (1, 2) for s in "ab"], "topic_id INT, source_id STRING, added_at TIMESTAMP")
    assert rows(L.topics_needing_update(topics, articles, members, F.lit(NOW)), "topic_id", "new_sources") == [(1, 2)]


def test_close_run_keeps_fifty_errors(spark):
    run = spark.createDataFrame([("ingest", ago(1))], "command STRING, started_at TIMESTAMP")
    row = L.close_run(run, False, {"inserted": 3}, [f"e{i}" for i in range(60)], F.lit(NOW)).first()
    assert row["stats"] == {"inserted": 3.0} and len(row["errors"]) == 50 and row["ok"] is False


# --- material -----------------------------------------------------------------------------


def test_prompt_names_viewpoints_not_publishers(spark):
    members = spark.createDataFrame(
        [(1, i, "Portal", "kriticki", f"Naslov {i}", None if i == 0 else "x " * 2000, "sažetak", ago(1), 1000 - i) for i in range(10)],
        "topic_id INT, doc_id INT, source_id STRING, angle STRING, title STRING, content STRING, summary STRING, item_at TIMESTAMP, word_count INT",
    )
    topics = spark.createDataFrame([(1, "Tema", ["budžet"], [])], "topic_id INT, title_sample STRING, keywords ARRAY<STRING>, entities ARRAY<STRING>")
    message = M.prompt_messages(topics, members).first()["message"]
    assert message.startswith("# Materijal za jedan članak\n\nTema: Tema\nKljučne reči iz izveštaja: budžet\n\nSledi 10 nezavisnih")
    assert "Portal" not in message and "## Izveštaj 8 — izvor kritičan prema vlasti" in message
    assert "## Izveštaj 9" not in message and "sažetak" in message and "Imena i nazivi" not in message
    article = spark.createDataFrame([(1, "Stari", "uvod", "telo", 2)], "topic_id INT, title STRING, lead STRING, body STRING, revision INT")
    update = M.prompt_messages(topics, members, article).first()["message"]
    assert update.startswith("# Dopuna već objavljenog članka") and "(verzija 2)" in update and "## Novi izveštaj 1" in update


def test_request_batches_stay_near_their_size(spark):
    requests = spark.range(250).select(
        F.col("id").alias("topic_id"), F.concat(F.lit("tema-"), "id").alias("custom_id"), F.lit("default").alias("model"))
    batches = M.request_batches(requests, 100).withColumn("status", F.lit("submitted")).withColumn("batch_id", F.col("batch_no"))
    sizes = [r["request_count"] for r in batches.collect()]
    assert len(sizes) == 3 and sum(sizes) == 250 and max(sizes) < 120
    steps = requests.withColumn("topic_id", F.col("topic_id") * 1000)
    assert M.request_batches(steps, 25).count() == 10
    assert M.topics_in_flight(batches).count() == 250
    answers = spark.createDataFrame([(b, "tema-3") for b in range(3)], "batch_id BIGINT, custom_id STRING")
    assert [r["topic_id"] for r in M.responses_with_topic(batches, answers).collect()] == [3]


def test_repair_responses(spark):
    import json

    good = {"title": "t", "lead": "l", "body": ["a" * 200] * 4 + ["kratko"], "category": "Društvo", "sensitive": True,
            "sensitivityReason": "", "sourcesDiverge": False, "bothSides": {}, "keywords": None}
    frame = spark.createDataFrame([(1, json.dumps(good)), (2, "nije json"), (3, json.dumps({"title": "t", "category": "x"}))], "id INT, raw STRING")
    out = {r["id"]: r for r in M.repair_responses(frame).collect()}
    assert out[1]["problems"] == [] and out[1]["category"] == "drustvo" and len(out[1]["body"]) == 4
    assert out[1]["both_sides"] is None and out[1]["sensitivity_reason"] is None and len(out[1]["repairs"]) == 6
    assert out[2]["problems"] == ["odgovor nije objekat"]
    assert "category: van spiska" in out[3]["problems"] and "lead: izostaje" in out[3]["problems"]


def test_review_messages(spark):
    frame = spark.createDataFrame(
        [("A < B & C", "uvod", "Rečenica jedna. " * 500, "sport", None, 1000, "default", 3, "approved", NOW)],
        "title STRING, lead STRING, body STRING, category STRING, sensitivity_reason STRING, word_count INT, model STRING, source_count INT, decision STRING, decided_at TIMESTAMP",
    )
    row = frame.select(M.review_message().alias("m"), M.decided_message().alias("d")).first()
    assert "<b>A &lt; B &amp; C</b>" in row["m"] and "Razlog: nije naveden" in row["m"] and "izvora: 3" in row["m"]
    assert "[…tekst je skraćen" in row["m"] and len(row["m"]) < 4096
    assert row["d"].startswith("✅ <b>Odobreno") and "6. 9. 2026. 14:00:00 · rubrika: sport" in row["d"]


def test_outcome_routing(spark):
    frame = spark.createDataFrame(
        [(1, "errored", "invalid_request", True), (2, "errored", "overloaded", True), (3, "expired", None, True), (4, "canceled", None, True),
         (5, "succeeded", None, False), (6, "succeeded", None, True)],
        "id INT, result_type STRING, error_type STRING, schema_ok BOOLEAN",
    )
    assert rows(M.route_outcomes(frame), "id", "succeeded", "retryable") == [
        (1, False, False), (2, False, True), (3, False, True), (4, False, True), (5, False, True), (6, True, False)]


# --- tables -------------------------------------------------------------------------------


def test_sync_keeps_breaker_state(spark):
    from newsweave.sources.config import sync_sources

    stored = spark.createDataFrame(
        [("a", "A", "agencija", "https://a.rs", True, 2), ("b", "B", "agencija", "https://b.rs", True, 1)],
        "id STRING, name STRING, angle STRING, homepage STRING, enabled BOOLEAN, consecutive_failures INT",
    )
    configured = stored.filter("id = 'a'").withColumn("name", F.lit("Novi")).drop("consecutive_failures")
    configured = configured.union(spark.sql("SELECT 'c', 'C', 'kriticki', 'https://c.rs', true"))
    assert {r["id"]: (r["name"], r["consecutive_failures"]) for r in sync_sources(stored, configured).collect()} == {
        "a": ("Novi", 2), "b": ("B", 1), "c": ("C", None)}


def test_set_columns_and_remove_rows(spark):
    topics = spark.createDataFrame([(1, "open", None), (2, "open", None)], "topic_id INT, status STRING, article_id INT")
    hit = spark.createDataFrame([(2,), (2,)], "topic_id INT")
    marked = L.set_columns(topics, hit, "topic_id", {"status": F.lit("covered"), "article_id": F.lit(9)})
    assert {tuple(r) for r in marked.collect()} == {(1, "open", None), (2, "covered", 9)}
    assert rows(L.remove_rows(topics, hit, "topic_id"), "topic_id") == [(1,)]


def test_run_log_and_reports(spark, tmp_path):
    from newsweave.sinks import write_report

    run = L.close_run(L.open_run(spark, "ingest", F.lit(NOW)), True, {}, [], F.lit(NOW)).first()
    assert run["command"] == "ingest" and run["ok"] and run["errors"] == [] and run["stats"] is None
    report = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "topic_rank INT, doc_id INT")
    write_report(report, str(tmp_path / "r"), "topic_rank")
    assert spark.read.json(str(tmp_path / "r")).count() == 3


def test_fetch_state_is_optional(spark):
    addresses = spark.createDataFrame([("u",), ("v",)], "url STRING")
    state = spark.createDataFrame([("u", "e1", None)], "url STRING, etag STRING, last_modified STRING")
    assert {tuple(r) for r in I.with_fetch_state(addresses, state).collect()} == {("u", "e1", None), ("v", None, None)}


def test_cascade_and_detach(spark):
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "topic_id INT, doc_id INT")
    kept = L.cascade_links(links, spark.createDataFrame([(10,)], "doc_id INT"))
    assert rows(kept, "topic_id", "doc_id") == [(1, 10)]
    articles = spark.createDataFrame([(5, 1), (6, 2)], "article_id INT, topic_id INT")
    assert {tuple(r) for r in L.detach_articles(articles, kept).select("article_id", "topic_id").collect()} == {(5, 1), (6, None)}


@pytest.mark.parametrize(
    "offered, inserted",
    [
        ([(1, "u1", "c0"), (2, "u1", "c9")], [2]),
        ([(1, "u1", "c1"), (2, "u2", "c1"), (3, "u2", "c3")], [1, 3]),
        ([(1, "u1", "c1"), (2, "u2", "c1"), (3, "u2", "c3"), (4, "u4", "c3"), (5, "u0", "c7")], [1, 3]),
        ([], []),
    ],
)
def test_a_skipped_row_stops_no_other(spark, offered, inserted):
    schema = "doc_id INT, url_hash STRING, content_hash STRING, source_id STRING"
    stored = spark.createDataFrame([(0, "u0", "c0", "s")], schema)
    rows_in = spark.createDataFrame([(*r, "s") for r in offered], schema)
    assert sorted(r["doc_id"] for r in I.insert_ignore(rows_in, stored).collect()) == inserted


def test_the_last_of_several_changes_counts(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, v STRING")
    changes = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "z", 1), (3, "w", 5)], "id INT, v STRING, at INT")
    assert rows(L.upsert(target, changes, ["id"], ["v"], F.col("at")), "id", "v") == [(1, "x"), (2, "b"), (3, "w")]
    articles = spark.createDataFrame([(1, 1, "t", "l", "b", 0.5, None)], "article_id INT, revision INT, title STRING, lead STRING, body STRING, cost_usd DOUBLE, last_update_at TIMESTAMP")
    updates = spark.createDataFrame([(1, "t2", "l", "b", 0.1, "r", 1), (1, "t3", "l", "b", 0.2, "r", 2)], "article_id INT, title STRING, lead STRING, body STRING, cost_usd DOUBLE, reason STRING, at INT")
    history = spark.createDataFrame([], "article_id INT, revision INT, title STRING, lead STRING, body STRING, reason STRING, cost_usd DOUBLE")
    new, old = L.apply_article_updates(articles, updates, history, F.lit(NOW), F.col("at"))
    assert rows(new, "article_id", "revision", "title") == [(1, 2, "t3")] and old.count() == 1


def test_a_stale_cover_behind_many_fresh_ones_is_found(spark):
    fresh = [(i, "published", "c", ago(1), ago(1), ago(50)) for i in range(30)]
    stale = [(99, "published", "c", ago(30), ago(20), ago(60))]
    frame = spark.createDataFrame(fresh + stale, "article_id INT, status STRING, cover_url STRING, cover_at TIMESTAMP, last_update_at TIMESTAMP, created_at TIMESTAMP")
    assert [r["article_id"] for r in L.articles_needing_cover(frame, F.lit(NOW)).collect()] == [99]


def test_the_lead_counts_towards_the_length(spark):
    frame = spark.createDataFrame([(1, "x " * 100, "y " * 260), (2, None, "y " * 260)], "article_id INT, lead STRING, body STRING")
    assert rows(S.length_gate(frame), "article_id", "word_count", "needs_flagship") == [(1, 360, False), (2, 260, True)]


def test_response_types_and_both_panels(spark):
    import json

    good = {"title": "t", "lead": "l", "body": ["a" * 200] * 4, "category": "sport", "sensitive": False, "sensitivityReason": None,
            "sourcesDiverge": True, "bothSides": {"officialLabel": "a", "officialText": "b", "criticalLabel": "c", "criticalText": "d"},
            "keywords": ["x"], "notes": []}
    half = {**good, "bothSides": {"officialLabel": "a", "officialText": "b"}}
    typed = {**good, "title": 7, "sensitive": "da", "keywords": "x", "category": "Sport"}
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate((good, half, typed, {**good, "category": "vremeplov"}))], "id INT, raw STRING")
    out = {r["id"]: r for r in M.repair_responses(frame).collect()}
    assert out[0]["problems"] == []
    assert out[1]["problems"] == ["bothSides.criticalLabel: izostaje", "bothSides.criticalText: izostaje"]
    assert set(out[2]["problems"]) == {"title: pogrešan tip", "sensitive: pogrešan tip", "keywords: pogrešan tip"}
    assert any("svedena na" in n for n in out[2]["repairs"]) and out[3]["problems"] == ["category: van spiska"]


def one_after_the_other(rows_in):
    urls, contents, kept = set(), set(), []
    for doc, source, url, content in sorted(rows_in):
        if (url is None or url not in urls) and (content is None or (source, content) not in contents):
            urls.add(url)
            contents.add((source, content))
            kept.append(doc)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_insert_ignore_equals_row_by_row(spark, seed):
    import random

    rng = random.Random(seed)
    keys = 8 + seed * 20
    rows_in = [
        (i, rng.choice("ab"), f"u{rng.randrange(keys)}", None if rng.random() < 0.03 else f"c{rng.randrange(keys)}") for i in range(120)
    ]
    schema = "doc_id INT, source_id STRING, url_hash STRING, content_hash STRING"
    offered = spark.createDataFrame(rows_in, schema)
    found = I.insert_ignore(offered, offered.limit(0))
    assert [r["doc_id"] for r in found.orderBy("doc_id").collect()] == one_after_the_other(rows_in)


def test_a_long_chain_of_clashes_is_settled_in_few_rounds(spark, monkeypatch):
    rows_in = [(i, "s", f"u{i // 2}", f"c{(i + 1) // 2}") for i in range(1000)]  # each row clashes with the next
    rows_in += [(2000 + i, "t", f"x{i}", f"y{i}") for i in range(50)]  # clash with nothing
    calls, plain = [], I._placed
    monkeypatch.setattr(I, "_placed", lambda rows, keys: calls.append(rows.count()) or plain(rows, keys))
    schema = "doc_id INT, source_id STRING, url_hash STRING, content_hash STRING"
    offered = spark.createDataFrame(rows_in, schema)
    found = I.insert_ignore(offered, offered.limit(0))
    assert [r["doc_id"] for r in found.orderBy("doc_id").collect()] == one_after_the_other(rows_in)
    assert len(calls) < 20 and max(calls) <= 1000

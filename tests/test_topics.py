"""Similarity join and topic grouping against plain loops."""

import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from newsweave import params as P
from newsweave.operators import similarity as S, topics as TP, vectors as V

START = datetime(2026, 9, 6, 10, tzinfo=timezone.utc)
SCHEMA = "doc_id BIGINT, source_id STRING, angle STRING, title STRING, content STRING, item_at TIMESTAMP"


def corpus(spark, n, seed, copies=0):
    """Random stories with shared vocabulary, names and a flood of near copies of one story."""
    rng = random.Random(seed)
    vocabulary = [f"rec{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    people = ["Marko", "Jovan", "Petar", "Milica", "Jelena"]
    rows = []
    stories = []
    for i in range(n):
        if stories and rng.random() < 0.45:
            words = list(rng.choice(stories))
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [vocabulary[min(119, int(rng.expovariate(0.03)))] for _ in range(18)]
        stories.append(words)
        body = " ".join(words[6:]) + " rekao je " + rng.choice(people)
        rows.append((i, f"s{i % 5}", "agencija", " ".join(words[:6]), body, START + timedelta(minutes=rng.randrange(400))))
    flood = stories[0]
    for j in range(copies):
        words = list(flood)
        words[j % len(words)] = f"dopuna{j}"
        rows.append((n + j, "s0", "agencija", " ".join(words[:6]), " ".join(words[6:]), START + timedelta(minutes=500)))
    rows.append((n + copies, "s1", "agencija", "", "", START))  # without any term
    rows.append((n + copies + 1, "s1", "agencija", "", "", START))
    return spark.createDataFrame(rows, SCHEMA)


def nodes_of(items):
    return TP.item_nodes(items, V.item_postings(items)).cache()


def brute(a, b, weight=0.2):
    """Text and combined similarity of two collected nodes, by definition."""
    wa, wb = a["weights"] or {}, b["weights"] or {}
    text = int(sum(w * wb.get(t, 0) for t, w in wa.items()) / 1e10 + 0.5) / 1e6
    ea, eb = {e.lower() for e in a["entities"]}, {e.lower() for e in b["entities"]}
    shared = len(ea & eb) / min(len(ea), len(eb)) if ea and eb else 0.0
    return text, int((text * (1 - weight) + shared * weight) * 1e6 + 0.5) / 1e6


def moment(node):
    return (node["item_at"], node["doc_id"])


def sequential(nodes, threshold):
    """The plain loop: oldest first, best earlier leader or a topic of its own."""
    leaders, result = [], {}
    for node in sorted(nodes, key=moment):
        best = None
        for leader in leaders:
            text, similarity = brute(node, leader)
            if text >= threshold / 2 and similarity >= threshold and (best is None or similarity > best[1]):
                best = (leader["doc_id"], similarity)
        if best is None:
            leaders.append(node)
            best = (node["doc_id"], 1.0)
        result[node["doc_id"]] = best
    return result


@pytest.mark.parametrize("threshold", [0.30, 0.38, 0.62])
def test_join_finds_exactly_the_similar_pairs(spark, threshold):
    nodes = nodes_of(corpus(spark, 150, seed=int(threshold * 100)))
    single = TP.distinct_nodes(nodes).drop("last").cache()
    found = {(r["l_id"], r["r_id"]): r["similarity"] for r in S.similarity_join(single, single, threshold).collect()}
    rows = [r.asDict() | {"item_at": r["ord"]["at"], "doc_id": r["id"]} for r in single.collect()]
    expected = {}
    for a in rows:
        for b in rows:
            if moment(b) < moment(a):
                text, similarity = brute(a, b)
                if text >= threshold / 2 and similarity >= threshold:
                    expected[(a["id"], b["id"])] = similarity
    assert found == expected and len(expected) > 20


# One step; many small steps; salting of every term.
@pytest.mark.parametrize("meetings, salt", [(None, S.MEETINGS_PER_SALT), (150, 2_000_000), (10**9, 3)])
def test_grouping_equals_the_sequential_loop(spark, monkeypatch, meetings, salt):
    monkeypatch.setattr(S, "MEETINGS_PER_SALT", salt)
    nodes = nodes_of(corpus(spark, 60, seed=7, copies=25))
    expected = sequential([r.asDict() for r in nodes.collect()], 0.38)
    grouped = TP.group_items(nodes, None, P.TopicParams(), meetings)
    assert {r["doc_id"]: (r["topic_id"], r["similarity"]) for r in grouped.collect()} == expected
    assert len({t for t, _ in expected.values()}) < len(expected) - 20


def test_looking_up_which_terms_are_spread_shuffles_no_posting(spark, monkeypatch):
    monkeypatch.setattr(S, "MEETINGS_PER_SALT", 3)
    single = TP.distinct_nodes(nodes_of(corpus(spark, 40, seed=5))).cache()
    for side in S._spread(S._postings(single, "l", 0.1), S._postings(single, "r", 0.1)):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and not re.search(r"Exchange hashpartitioning\(term#\d+, lane", plan)


def test_exact_copies_at_one_instant_form_one_topic(spark):
    rows = [(i, f"s{i}", "agencija", "Požar na planini gasi se", "vatrogasci gase veliki požar na planini", START) for i in range(40)]
    nodes = nodes_of(spark.createDataFrame(rows, SCHEMA))
    assert TP.distinct_nodes(nodes).count() == 1
    grouped = TP.group_items(nodes, None, P.TopicParams(), 10).collect()
    assert {r["topic_id"] for r in grouped} == {0}


REPORTS = [
    (1, "a", "provladin", "Požar na Suvoj planini stavljen pod kontrolu",
     "Vatrogasci su stavili pod kontrolu požar na Suvoj planini, saopštio je Sektor za vanredne situacije."),
    (2, "b", "kriticki", "Helikopteri gase požar na Suvoj planini",
     "Helikopteri gase požar na Suvoj planini, a vatrogasci brane kuće, kaže Sektor za vanredne situacije."),
    (3, "c", "agencija", "Пожар на Сувој планини стављен под контролу",
     "Ватрогасци су ставили под контролу пожар на Сувој планини, саопштио је Сектор за ванредне ситуације."),
    (4, "a", "provladin", "Narodna banka zadržala referentnu kamatnu stopu",
     "Izvršni odbor Narodne banke odlučio je da referentna kamatna stopa ostane nepromenjena."),
    (5, "b", "kriticki", "Reprezentacija pobedila u poslednjem kolu kvalifikacija",
     "Košarkaši su pobedili u neizvesnoj završnici i plasirali se na prvenstvo."),
]


def items(spark, rows, hours=0):
    return spark.createDataFrame([(*r, START + timedelta(hours=hours)) for r in rows], SCHEMA)


def test_reports_of_one_event_in_both_scripts_meet(spark):
    grouped = TP.group_items(nodes_of(items(spark, REPORTS)))
    topics = {r["doc_id"]: r["topic_id"] for r in grouped.collect()}
    assert topics == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_script_does_not_change_the_vector(spark):
    vectors = {r["doc_id"]: r["weights"] for r in nodes_of(items(spark, [REPORTS[0], REPORTS[2], REPORTS[3]])).collect()}
    dot = lambda a, b: sum(w * b.get(t, 0) for t, w in a.items()) / 1e16
    assert dot(vectors[1], vectors[3]) > 0.95 and dot(vectors[1], vectors[4]) < 0.15


def stored_topics(spark, rows):
    frame = items(spark, rows, hours=-5)
    postings = V.item_postings(frame)
    links = frame.select("doc_id", (F.col("doc_id") * 100).alias("topic_id"))
    stored = V.centroids(postings, links)
    named = V.item_entities(frame).join(links, "doc_id")
    times = named.groupBy("topic_id").agg(F.min("item_at").alias("first_item_at"))
    return stored, TP.topic_entities(named.select("topic_id", "doc_id", "item_at", "entities")), times


def test_later_report_joins_the_stored_topic(spark):
    stored, names, times = stored_topics(spark, [REPORTS[0]])
    later = items(spark, [REPORTS[1], REPORTS[2], REPORTS[3]])
    frequencies = V.item_postings(later).select("term", "df").distinct()
    topics = TP.topic_nodes(stored, frequencies, names, times).cache()
    grouped = {r["doc_id"]: r for r in TP.group_items(nodes_of(later), topics).collect()}
    assert grouped[2]["topic_id"] == 100 and not grouped[2]["is_new"]
    assert grouped[3]["topic_id"] == 100 and grouped[4]["topic_id"] == 4 and grouped[4]["is_new"]


def test_merge_goes_to_the_earliest_and_never_joins_two_stored(spark):
    stored, names, times = stored_topics(spark, [REPORTS[0], REPORTS[2]])  # the same story twice
    new = items(spark, [(2, *REPORTS[1][1:]), (4, *REPORTS[3][1:])])
    postings = V.item_postings(new)
    links = new.select("doc_id", F.col("doc_id").alias("topic_id"))
    frequencies = postings.select("term", "df").distinct()
    named = V.item_entities(new).join(links, "doc_id").select("topic_id", "doc_id", "item_at", "entities")
    fresh = TP.topic_nodes(
        V.centroids(postings, links), frequencies, TP.topic_entities(named),
        named.groupBy("topic_id").agg(F.min("item_at").alias("first_item_at")),
    ).cache()
    merged = TP.merge_topics(fresh, TP.topic_nodes(stored, frequencies, names, times).cache())
    assert [tuple(r) for r in merged.collect()] == [(2, 100)]


def test_a_stored_topic_keeps_its_id_when_a_new_one_of_that_id_is_absorbed(spark):
    old = items(spark, [REPORTS[0], (50, *REPORTS[3][1:])], hours=-5)
    new = items(spark, [(2, *REPORTS[1][1:]), (4, *REPORTS[3][1:])])
    frame = old.unionByName(new).withColumn("fetched_at", F.col("item_at"))
    links = spark.createDataFrame([(100, 1), (2, 50)], "topic_id BIGINT, doc_id BIGINT")
    topics = spark.createDataFrame(
        [(t, "covered", START - timedelta(hours=5)) for t in (100, 2)], "topic_id BIGINT, status STRING, last_item_at TIMESTAMP"
    )
    tp = P.TopicParams(window_hours=48, join_threshold=0.9, merge_threshold=0.1)
    run = TP.cluster_run(frame, links, topics, F.lit(START), tp)
    # Item 2 opens topic 2, which goes to topic 100; item 4 joins the stored topic 2, which stays.
    assert {r["doc_id"]: (r["topic_id"], r["is_new"]) for r in run.collect()} == {2: (100, True), 4: (2, False)}


def test_title_of_a_topic_is_never_a_round_up_when_another_exists(spark):
    rows = [
        (1, "a", "agencija", "Prva važna vest o poplavi; druga važna vest o požaru", "poplava poplava nasip reka", START),
        (2, "b", "agencija", "UŽIVO: Poplava na reci", "poplava nasip reka", START),
        (3, "c", "agencija", "Reka probila nasip kod sela", "poplava nasip reka selo", START),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("topic_id", F.lit(1))
    postings = V.item_postings(frame)
    means = V.centroids(postings, frame.select("topic_id", "doc_id"))
    assert TP.topic_titles(frame, postings, means).first()["title_sample"] == "Reka probila nasip kod sela"


def test_rerun_gives_the_same_vectors(spark):
    frame = corpus(spark, 80, seed=3)
    one = sorted(map(str, V.item_postings(frame.repartition(3)).collect()))
    two = sorted(map(str, V.item_postings(frame.repartition(7)).collect()))
    assert one == two


def test_terms_and_names_far_into_a_text_count(spark):
    body = "rec " * 2000 + "dodekaedar je video " + " pa ".join(f"Osoba{chr(97 + i)}" for i in range(22)) + "."
    frame = items(spark, [(1, "a", "agencija", "Naslov sa dovoljno reči", body)])
    assert "dodekaedar" in {r["term"][:10] for r in V.term_frequencies(frame).collect()}
    assert len(V.item_entities(frame).first()["entities"]) == 22
    short = P.VectorParams(body_chars=1500, max_entities=15)
    assert "dodekaedar" not in {r["term"][:10] for r in V.term_frequencies(frame, short).collect()}


def test_long_chains_settle_in_a_few_rounds(spark, monkeypatch):
    import random as r

    rng = r.Random(7)
    n = 1000
    edges = {(i, i - 1) for i in range(1, n)}  # a running story
    edges |= {(i, i - 1) for i in range(2001, 2300)} | {(i, rng.randrange(2000, i)) for i in rng.sample(range(2010, 2300), 40)}
    nodes = [*range(n), *range(2000, 2300)]
    earlier = {}
    for a, b in edges:
        earlier.setdefault(a, []).append(b)
    leads = {}
    for i in sorted(nodes):
        leads[i] = not any(leads[b] for b in earlier.get(i, []))
    calls = []
    plain = S._chain_leaders
    monkeypatch.setattr(S, "_chain_leaders", lambda *a: calls.append(1) or plain(*a))
    found = S.first_independent(
        spark.createDataFrame(sorted(edges), "l_id BIGINT, r_id BIGINT"), spark.createDataFrame([(i,) for i in nodes], "id BIGINT")
    )
    assert sorted(r["id"] for r in found.collect()) == [i for i in sorted(nodes) if leads[i]]
    assert len(calls) < 20

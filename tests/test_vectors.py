"""Terms are counted in their rows, frequent ones weighted in place, spellings looked up for keywords only."""

import pytest
from pyspark.sql import functions as F

from newsweave.operators import topics as TP, vectors as V

ROWS = [
    (1, 10, "Most na reci", "Most je dug. Stari most preko reke i most preko reke"),
    (2, 10, "Reka", "reka raste, nasip popušta"),
    (3, 20, "Izbori", "Glasanje na izborima; izbori, glasanje"),
    (4, 20, "Ni", "je"),
    (5, 30, None, None),
]


@pytest.fixture
def items(spark):
    schema = "doc_id long, topic_id long, title string, content string"
    return spark.createDataFrame(ROWS, schema).withColumn("item_at", F.timestamp_seconds(F.col("doc_id")))


def plan_text(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_word_travels_to_be_counted(items):
    assert "Exchange" not in plan_text(V.term_frequencies(items))


def test_counts_are_those_of_a_plain_loop(items):
    found = {(r.doc_id, r.term): r.tf for r in V.term_frequencies(items).collect()}
    assert found[1, "most"] == 3 + 3
    assert sum(n for (doc, term), n in found.items() if doc == 2 and term.startswith("rek")) == 3 + 1
    assert not [k for k in found if k[0] in (4, 5)]


def test_rows_that_share_an_id_are_one_item(items):
    once = {(r.doc_id, r.term): r.tf for r in V.term_frequencies(items).collect()}
    twice = V.term_frequencies(items.union(items)).collect()
    assert len(twice) == len(once)
    assert {(r.doc_id, r.term): r.tf for r in twice} == {k: 2 * n for k, n in once.items()}


def test_the_number_of_broadcast_terms_changes_no_weight(items):
    rows = lambda n: sorted(map(str, V.item_postings(items, frequent=n).collect()))
    assert rows(0) == rows(1) == rows(3) == rows(1000)


def test_means_are_not_shuffled_again_for_the_size(items, spark):
    weights = spark.createDataFrame(V.item_weights(items).collect())
    text = plan_text(V.centroids(weights, items.select("topic_id", "doc_id")))
    # The only join is that of the links; what the aggregate makes is not joined.
    assert text.index("HashAggregate") < text.index("Join")


def test_spellings_of_heaviest_terms_only_give_the_same_keywords(items):
    means = V.centroids(V.item_weights(items), items.select("topic_id", "doc_id"))
    heaviest = TP.heaviest_terms(means)
    spelled = TP.keyword_spellings(items, heaviest)
    kept = {(r.topic_id, r.term) for r in heaviest.collect()}
    topic = {r[0]: r[1] for r in ROWS}
    assert {(topic[r.doc_id], r.term) for r in spelled.collect()} == kept
    rows = lambda m, s: sorted(map(str, TP.topic_keywords(items, m, s).collect()))
    assert rows(heaviest, spelled) == rows(means, V.surface_forms(items))


def test_titles_from_placed_weights_are_the_same_without_another_join_by_item(items):
    links, weights = items.select("topic_id", "doc_id"), V.item_weights(items)
    placed = V.member_weights(weights, links)
    assert sorted(map(str, V.centroids(placed, None).collect())) == sorted(map(str, V.centroids(weights, links).collect()))
    means = V.centroids(weights, links)
    rows = lambda w: sorted(map(str, TP.topic_titles(items, w, means).collect()))
    assert rows(placed) == rows(weights)


def test_an_items_rows_travel_as_one_per_task(spark):
    rows = [(i, f"Naslov vesti broj{i % 7}", " ".join(f"reč{chr(97 + j % 26)}{chr(97 + i % 5)}" for j in range(60))) for i in range(40)]
    items = spark.createDataFrame(rows, "doc_id BIGINT, title STRING, content STRING")
    postings = V.item_postings(items, frequent=20)
    plan = postings._jdf.queryExecution().executedPlan().toString()
    # By item rows are exchanged once, gathered; the windows find them there.
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "partial_collect_list(term" in plan
    assert sorted(map(str, postings.collect())) == sorted(map(str, V.item_postings(items).collect()))

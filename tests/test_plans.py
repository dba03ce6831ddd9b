"""The physical plans behave at scale: pruned scans, early limits, no cross joins."""

import re

import pytest

import __spark_entry__ as entry
from newsweave.plans.corpus import Corpus

SF = "/root/testdata/sf0.001"


def explain(frame):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_newest_n_trims_sources_before_the_shuffle(spark):
    text = explain(entry.queries()["newest_n_per_source"](spark, SF))
    assert text.count("WindowGroupLimit") >= 2
    assert re.search(r"ReadSchema: struct<doc_id:bigint,source:string>", text)


def test_day_window_reads_only_what_it_needs(spark):
    text = explain(entry.queries()["items_by_angle"](spark, SF))
    assert "text:string" not in text


@pytest.mark.parametrize(
    "name",
    ["topic_rollup", "candidates_last_wins", "insert_dedup_counts", "cluster_input", "breaker_replay", "unchanged_docs",
     "topics_needing_update", "retention_cascade", "upsert_state", "crawl_policy", "velocity_window", "topic_keywords"],
)
def test_no_cross_joins(spark, name):
    text = explain(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_aggregates_combine_in_the_tasks(spark):
    text = explain(entry.queries()["topic_rollup"](spark, SF))
    assert "partial_count" in text and "partial_min" in text


def test_a_filter_on_events_reaches_the_scan(spark):
    corpus = Corpus(spark, SF)
    text = explain(corpus.events.filter("event_type = 'error'").select("event_id"))
    assert "EqualTo(event_type,error)" in text and "props" not in text.split("ReadSchema")[1].split("\n")[0]


def test_term_frequencies_are_computed_once(spark):
    from newsweave.operators import vectors

    frame = vectors.item_postings(Corpus(spark, SF).items)
    frame.collect()
    assert "ReusedExchange" in explain(frame)

"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "canonical_urls", "url_hash_groups", "content_hash_groups", "strip_html", "stem_words",
    "entity_counts", "page_extract", "link_harvest", "candidates_last_wins", "insert_dedup_counts",
    "newest_n_per_source", "cluster_input", "breaker_replay", "unchanged_docs",
    "term_freq", "tfidf_top_terms", "topic_centroids", "topic_titles", "topic_keywords",
    "assign_to_topics", "rebuild_topics",
    "trending_score", "topic_selection", "topics_needing_update", "prompt_material",
    "batch_results", "response_repair", "retention_cascade", "apply_decisions",
    "stream_velocity", "stream_breaker",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("newsweave-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from newsweave.plans import runner

    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # session start-up is not a query
    timings: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        runner(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

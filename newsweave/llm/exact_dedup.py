"""Exact dedup with a split for heavy hitters, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsweave.llm.common import SPACE_CLASS, packed, same, whole_text
from newsweave.sinks import materialize

#: Digests with more than this share of all rows are surely found as heavy; at most 1 / SUPPORT winners are broadcast.
SUPPORT = 1e-3


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space; texts with one digest are copies."""
    return F.sha2(F.regexp_replace(text, SPACE_CLASS + "+", ""), 256)


def _winners(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays (longest text, smallest id, nulls last, first stored) and the group's size."""
    order = F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))
    best = F.min_by(F.struct("doc_id", "uid"), order)
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "group_size"
    )


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n, text_sha256, keep_id, group_size, kept.

    A Misra-Gries summary (``freqItems``, at most 1 / support counters per task) names the
    digests that may be frequent. Their sizes and winners are then counted exactly and
    broadcast, at most 1 / support rows, so copies of a frequent text are settled where they
    are read. What is left has no frequent digest and is grouped by an ordinary shuffle.

    Null texts are empty and copies of each other. A null doc_id comes after all others.
    Of rows equal in text and id exactly one stays. An empty table gives no rows.
    """
    rows = materialize(
        docs.select("doc_id", whole_text().alias("text")).select(
            "doc_id",
            F.length("text").cast("long").alias("n"),
            digest(F.col("text")).alias("digest"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "digests",
    )
    frequent = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    heavy = materialize(
        _winners(rows.join(F.broadcast(frequent), "digest", "left_semi")).filter("group_size > 1"), "heavy"
    )
    light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    settled = rows.join(F.broadcast(heavy), "digest").unionByName(light.join(_winners(light), "digest"))
    return settled.select(
        "doc_id",
        "n",
        F.col("digest").alias("text_sha256"),
        "keep_id",
        "group_size",
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
    )


def keep_one_copy(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Rows repeated in id and text are one row after it."""
    decided = materialize(exact_dedup(docs).filter("kept").select("doc_id", "n", "text_sha256"), "kept")
    tagged = packed(
        docs, doc_id=F.col("doc_id"), n=F.length(whole_text()).cast("long"), text_sha256=digest(whole_text())
    )
    keys = ("doc_id", "n", "text_sha256")
    decided = decided.hint("shuffle_hash")  # far smaller than the texts, which needn't be sorted
    left = tagged.join(decided, same(tagged, decided, *keys), "left_semi")
    repeats = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if repeats:  # only then rows can be equal in all keys
        left = left.dropDuplicates(keys)
    return left.select("row.*")

"""Line dedup over ranges of line hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsweave.llm.common import SPACES, ascii_lower, same, whole_text
from newsweave.sinks import materialize

#: A key's occurrences are split over so many slices of documents, so no task holds a whole frequent key.
SLICES = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", whole_text().alias("text")).withColumn("version", F.xxhash64("text"))


def line_occurrences(docs: DataFrame) -> DataFrame:
    """A row per line with a non-empty key: doc_id, version, pos, h1, h2. No text leaves the scan."""
    # Keys are made of the whole text at once: neither step crosses a line feed.
    lines = F.transform(_lines(ascii_lower(F.col("text"))), lambda line: F.btrim(line, F.lit(SPACES)))
    hashes = F.transform(
        lines,
        lambda key, at: F.when(
            key != "", F.struct(at.alias("pos"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))
        ),
    )
    found = _documents(docs).select("doc_id", "version", F.explode(F.filter(hashes, lambda h: h.isNotNull())).alias("line"))
    return found.select("doc_id", "version", "line.*")


def streamed(occurrences: DataFrame, slices: int = SLICES) -> DataFrame:
    """Occurrences in ranges of hashes, ordered by document and position within each.

    Adds ``first`` (first occurrence of the key in its slice), ``new_doc`` (first in its
    document) and ``slice_docs`` (documents of the slice that hold the key).
    """
    key = ("h1", "h2", "slice")
    ranged = occurrences.withColumn("slice", F.pmod(F.xxhash64("doc_id", "version"), F.lit(slices)))
    parts = int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranged.repartitionByRange(parts, *key)
    run = Window.partitionBy(*key).orderBy("doc_id", "version", "pos")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag(F.struct("doc_id", "version")).over(run)
    return (
        ranged.withColumn("first", F.row_number().over(run) == 1)
        .withColumn("new_doc", F.col("first") | ~before.eqNullSafe(F.struct("doc_id", "version")))
        .withColumn("slice_docs", F.sum(F.col("new_doc").cast("long")).over(whole))
    )


def frequent_keys(stream: DataFrame, min_docs: int) -> DataFrame:
    """Keys found in at least ``min_docs`` documents; one row per key and slice reaches the sum."""
    totals = stream.filter("first").groupBy("h1", "h2").agg(F.sum("slice_docs").alias("n_docs"))
    return totals.filter(F.col("n_docs") >= min_docs)


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """Lines to drop as one compressed bitmap per document: word number to 64 bits, words without a bit left out."""
    words = dropped.groupBy("doc_id", "version", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(63))).alias("bits")
    )
    return words.groupBy("doc_id", "version").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "bits")))).alias("dropped")
    )


def line_dedup(docs: DataFrame, min_docs: int = 10, slices: int = SLICES) -> DataFrame:
    """Bitmaps (doc_id, version, dropped) of documents that lose lines; ``docs`` needs doc_id and text.

    A line's key is the line without white space at its ends, A-Z in lower case. All lines of
    a key found in at least ``min_docs`` documents are dropped. Keys are compared by 128 bits.

    A null text is one empty line, and empty keys are never dropped. Rows that repeat id and
    text are one document; rows that share only the id are documents of their own.
    """
    occurrences = materialize(line_occurrences(docs), "lines")
    # Stored, so that a partition of one frequent key's lines can be split by the join.
    frequent = materialize(frequent_keys(streamed(occurrences, slices), min_docs), "frequent-lines")
    return drop_bitmaps(occurrences.join(frequent, ["h1", "h2"], "left_semi"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_dropped and the text of the kept lines."""
    base, small = _documents(docs), bitmaps.hint("shuffle_hash")
    joined = base.join(small, same(base, small, "doc_id", "version"), "left").select(base["doc_id"], base["text"], "dropped")
    lines = _lines(F.col("text"))

    def stays(line: Column, at: Column) -> Column:
        bits = F.coalesce(F.try_element_at("dropped", F.shiftright(at, 6)), F.lit(0).cast("long"))
        return F.call_function("shiftright", bits, at.bitwiseAND(63)).bitwiseAND(1) == 0

    kept = F.when(F.col("dropped").isNull(), lines).otherwise(F.filter(lines, stays))
    return joined.withColumn("lines", lines).withColumn("kept", kept).select(
        "doc_id",
        "text",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )

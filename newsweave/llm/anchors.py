"""Content-chosen places that equal passages share, and what the passage operators have in common.

Of every run of ``width`` grams the smallest hash is an anchor. A passage as long as the run
holds the run's anchor, and what is chosen hangs on the passage alone, so equal passages hold
their anchors at equal places. Comparing passages around equal anchors finds all equal ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsweave.llm.common import whole_text
from newsweave.sinks import materialize

#: Gram starts handled at once; long texts are cut into overlapping stretches.
STRETCH = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Grams with more than this share of all rows are surely found as heavy, at most 1 / SUPPORT of them.
SUPPORT = 1e-3
#: Rows of one hash that a task compares; larger groups are compared by digests of their windows.
MAX_GROUP = 20_000
#: Bits of the broadcast filter of repeated hashes (16 MB), words of 64 bits in one of its rows.
FILTER_BITS, ROW_WORDS = 1 << 27, 64


def mixed(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def minima(hashes: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of a text as (place, first run start, last run start), leftmost among equals."""
    runs = len(hashes) - width + 1
    for begin in range(0, max(runs, 0), STRETCH):
        part = hashes[begin : min(begin + STRETCH, runs) + width - 1]
        n = len(part) - width + 1
        key = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        key = np.concatenate([key, np.full(-len(key) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
        onward = np.minimum.accumulate(key, axis=1).ravel()
        back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(back[:n], onward[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [n - 1]])
        yield place[first] + begin, first + begin, last + begin


def keyed(docs: DataFrame) -> DataFrame:
    """id_key, version, text: two columns without nulls that name a document (its id and its text)."""
    id_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(
        id_key.alias("id_key"), F.xxhash64(F.col("doc_id").isNull(), whole_text()).alias("version"), whole_text().alias("text")
    )


def doc_id() -> Column:
    """The id as it was; null where the key stands for null."""
    return F.when(F.col("id_key") == F.lit(-(1 << 63)), F.lit(None)).otherwise(F.col("id_key")).alias("doc_id")


#: A row of an anchor; ``more`` holds its place and its last run start, counted from ``lo``: rows travel by the million.
GRAMS = "id_key long, version long, h long, lo int, more int"


def checked_width(length: int, gram: int) -> None:
    """An error for passages whose runs don't fit into the bits that an anchor's row has for them."""
    if not 0 <= length - gram < 1024:
        raise ValueError(f"a passage may be 0 to 1023 longer than its gram; got {length} and {gram}")


def gram_rows(docs: DataFrame, grams: Callable[[], Callable[[str], Iterator[tuple]]]) -> DataFrame:
    """One row per anchor of every text; ``grams()`` makes the function that finds them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = grams()
        for batch in batches:
            out = []
            for key, version, text in zip(batch["id_key"], batch["version"], batch["text"]):
                for h, place, lo, hi in find(text):
                    n = len(h)
                    more = (place - lo) * 1024 + (hi - lo)
                    out.append((np.full(n, key, np.int64), np.full(n, version, np.int64), h.view(np.int64), lo, more))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 5
            yield pd.DataFrame(dict(zip(["id_key", "version", "h", "lo", "more"], columns)))

    return keyed(docs).mapInPandas(run, GRAMS)


def maybe_repeated(grams: DataFrame, bits: int = FILTER_BITS, row_words: int = ROW_WORDS) -> DataFrame:
    """Grams without nearly all of those whose hash is met once.

    The hashes alone are counted first, and those met again set their bit in a filter of ``bits``
    bits, whatever the size of the table, which is broadcast. Grams whose bit isn't set go before
    their rows travel. What passes has to be counted: a full filter keeps single hashes too.
    """
    slot = F.pmod("h", F.lit(bits))
    row, word, bit = F.expr(f"h_slot div {row_words * 64}"), F.expr(f"h_slot div 64 % {row_words}"), F.col("h_slot") % 64
    again = grams.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(slot.alias("h_slot"))
    words = again.groupBy(row.alias("row"), word.cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("set")
    )
    rows = words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "set"))).alias("sets"))
    places = F.sequence(F.lit(0), F.lit(row_words - 1))
    rows = rows.select("row", F.transform(places, lambda i: F.coalesce(F.try_element_at("sets", i), F.lit(0).cast("long"))).alias("sets"))
    rows = materialize(rows, "filter")
    slotted = grams.withColumn("h_slot", slot).withColumn("row", row)
    met = F.getbit(F.get("sets", word.cast("int")), bit.cast("int")) == 1
    return slotted.join(F.broadcast(rows), "row").filter(met).drop("row", "h_slot", "sets")


def repeated(grams: DataFrame, support: float = SUPPORT, most: int = MAX_GROUP) -> tuple[DataFrame, DataFrame]:
    """Grams whose hash occurs again, apart: those of groups one task can compare, and those of larger ones.

    The most frequent hashes are found by a Misra-Gries summary, counted exactly and broadcast
    (at most 1 / support of them), so their rows are never brought together. Of the other hashes
    those that may occur again are shuffled once and counted.
    """
    grams = maybe_repeated(materialize(grams, "grams"))
    spotted = grams.freqItems(["h"], support).select(F.explode("h_freqItems").alias("h"))
    counts = grams.join(F.broadcast(spotted), "h", "left_semi").groupBy("h").count()
    heavy = materialize(counts.filter(F.col("count") > most).select("h"), "heavy")
    hot = grams.join(F.broadcast(heavy), "h", "left_semi")
    counted = grams.join(F.broadcast(heavy), "h", "left_anti").withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("h"))
    )
    comparable = counted.filter((F.col("n") > 1) & (F.col("n") <= most)).drop("n")
    return _unpacked(comparable), _unpacked(hot.unionByName(counted.filter(F.col("n") > most).drop("n")))


def _unpacked(grams: DataFrame) -> DataFrame:
    place, last = F.col("lo") + F.shiftright("more", 10), F.col("lo") + F.col("more").bitwiseAND(1023)
    return grams.select("id_key", "version", "h", place.alias("place"), "lo", last.alias("hi"))


def with_texts(docs: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Texts beside the rows of their documents; ``rows`` has one row per document.

    The smaller side is hashed, so texts aren't sorted; both uses in a plan read one shuffle of the texts.
    """
    return keyed(docs).join(rows.hint("shuffle_hash"), ["id_key", "version"], how)


def per_document(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per document with its distinct rows as parallel arrays; as long as the text at most."""
    sets = rows.groupBy("id_key", "version").agg(F.collect_set(F.struct(*columns)).alias("rows"))
    return sets.select("id_key", "version", *[F.col(f"rows.{c}").alias(c) for c in columns])


def spread_join(rows: DataFrame, verdicts: DataFrame, key: str, how: str, lanes: int = 16) -> DataFrame:
    """Join on a key of which one value may hold very many rows; ``verdicts`` has one row per key.

    Rows are dealt over lanes by their document, verdicts are repeated for each lane.
    """
    dealt = rows.withColumn("lane", F.pmod(F.xxhash64("id_key", "version"), F.lit(lanes)))
    copies = verdicts.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)).cast("array<bigint>")))
    return dealt.join(copies, [key, "lane"], how).drop("lane")


def spans_of(starts: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of ascending window starts as the stretch their windows cover."""
    if len(starts):
        cuts = np.flatnonzero(np.diff(starts) != 1) + 1
        for run in np.split(starts, cuts):
            yield int(run[0]), int(run[-1]) + length


def covered(n: int, lo, hi) -> np.ndarray:
    """A mask of the places inside spans, given as arrays of their ends or as None."""
    steps = np.zeros(n + 1, np.int32)
    if lo is not None:
        np.add.at(steps, lo, 1)
        np.add.at(steps, hi, -1)
    return np.cumsum(steps[:n]) > 0

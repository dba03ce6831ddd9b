"""Removal of repeated word passages by suffix automata."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newsweave.llm import anchors as A
from newsweave.llm.common import whole_text

#: Words of a window, words of the gram that chooses anchors.
LENGTH, GRAM = 20, 5
#: Words a broadcast reference may have, and words of one automaton of it.
MAX_REFERENCE, SHARD_WORDS = 2_000_000, 200_000
CACHE_WORDS = 1 << 19


class Automaton:
    """A suffix automaton over words of several passages, grown one passage at a time."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, size: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, q: int, word) -> int:
        clone = self._state(self.size[p] + 1, dict(self.next[q]))
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.size[last] + 1, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, word)
        return new

    def add(self, words: Iterable) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def statistics(self, words: Iterable) -> Iterator[int]:
        """For each word, the length of the longest known passage that ends there."""
        state = size = 0
        following, link, sizes = self.next, self.link, self.size
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                size = sizes[state]
            target = following[state].get(word)
            if target is not None:
                state, size = target, size + 1
            yield size


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        value = self[word] = xxh64_intdigest(word, 7)
        return value


def _finder(length: int, gram: int):
    def make():
        known = _WordHashes()

        def find(text: str) -> Iterator[tuple]:
            words = text.encode().split()
            if len(words) < length:
                return
            if len(known) > CACHE_WORDS:
                known.clear()
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            hashes = A.mixed(h[: len(h) - gram + 1])
            for i in range(1, gram):
                hashes = A.mixed(hashes * np.uint64(0x9FB21C651E98DF25) + h[i : len(h) - gram + 1 + i])
            for place, lo, hi in A.minima(hashes, length - gram + 1):
                yield hashes[place], place, lo, hi

        return find

    return make


PASSAGES = "h long, id_key long, version long, lo int, passage binary"
SPANS = "id_key long, version long, lo int, hi int"


def _passages(length: int):
    """The words of all windows that share an anchor, one passage per anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, version, text, *arrays in zip(*[batch[c] for c in ("id_key", "version", "text", "h", "lo", "hi")]):
                words = text.encode().split()
                for h, lo, hi in zip(*[a.tolist() for a in arrays]):
                    out.append((h, key, version, lo, b" ".join(words[lo : hi + length])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PASSAGES.split(", ")])

    return run


def _matched(length: int):
    """Walk the passages of one anchor after the other, earlier documents first.

    A passage seen before is removed whole. A new one is read against the automaton of the
    anchor's earlier passages and then added to it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, automaton, first, seen, before = None, None, None, set(), None
        for batch in batches:
            out = []
            for h, key, version, lo, passage in zip(*[batch[c] for c in ("h", "id_key", "version", "lo", "passage")]):
                if h != anchor:
                    anchor, automaton, first, seen, before = h, None, None, set(), None
                if (key, version, lo) == before:  # the same row of the table twice: one document
                    continue
                before, passage = (key, version, lo), bytes(passage)
                if passage in seen:
                    out.append((key, version, lo, lo + passage.count(b" ") + 1))
                    continue
                seen.add(passage)
                words = passage.split(b" ")
                if first is None:
                    first = words
                    continue
                if automaton is None:
                    automaton = Automaton()
                    automaton.add(first)
                ends = [i for i, size in enumerate(automaton.statistics(words)) if size >= length]
                starts = np.array(ends, np.int64) - length + 1
                out += [(key, version, lo + a, lo + b) for a, b in A.spans_of(starts, length)]
                automaton.add(words)
            yield pd.DataFrame(out, columns=["id_key", "version", "lo", "hi"])

    return run


def _window_digests(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            out = []
            for key, version, lo, passage in zip(*[batch[c] for c in ("id_key", "version", "lo", "passage")]):
                words = bytes(passage).split(b" ")
                for i in range(len(words) - length + 1):
                    out.append((xxh3_128_digest(b" ".join(words[i : i + length])), key, version, lo + i))
            yield pd.DataFrame(out, columns=["digest", "id_key", "version", "lo"])

    return run


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, text, lo, hi in zip(*[batch[c] for c in ("id_key", "text", "lo", "hi")]):
            words = text.encode().split()
            gone = A.covered(len(words), lo, hi)
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
            out.append((key, len(words), int(gone.sum()), b" ".join(kept).decode()))
        yield pd.DataFrame(out, columns=["id_key", "n_words", "n_removed", "kept"])


def _in_order(key: str = "id_key"):
    """Earlier documents first, those without an id last."""
    return F.col(key) == F.lit(-(1 << 63)), F.col(key), F.col("version")


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, support: float = A.SUPPORT, most: int = A.MAX_GROUP
) -> DataFrame:
    """Stretches (id_key, version, lo, hi) of words covered by windows that start earlier too.

    The reference of a document is all documents before it, which has no size bound, so its
    automata are not broadcast: they are shards by anchor, and every stretch of a document is
    sent to the one shard that can hold its windows. Passages of anchors with more than ``most``
    rows are compared across all tasks by digests.
    """
    A.checked_width(length, gram)
    rows, heavy = A.repeated(A.gram_rows(docs, _finder(length, gram)), support, most)

    def passages(of: DataFrame) -> DataFrame:
        return A.with_texts(docs, A.per_document(of, "h", "lo", "hi")).mapInPandas(_passages(length), PASSAGES)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = passages(rows).repartition(parts, "h").sortWithinPartitions("h", *_in_order(), "lo")
    return shards.mapInPandas(_matched(length), SPANS).unionByName(_heavy_spans(passages(heavy), length))


def _heavy_spans(passages: DataFrame, length: int) -> DataFrame:
    """Repeated stretches around anchors too frequent for one shard.

    Equal passages are one class, whose first row may stay; the windows of all others repeat
    it. Windows of different classes are compared by digests; all firsts are found by
    aggregates that combine in the tasks.
    """
    place = F.struct(_in_order()[0].alias("late"), "id_key", "version", "lo")
    placed = passages.withColumn("digest", F.unhex(F.md5("passage"))).withColumn("place", place)
    classes = placed.groupBy("digest").agg(F.min("place").alias("first"), F.first("passage").alias("passage"))
    others = A.spread_join(placed, classes.select("digest", "first"), "digest", "inner").filter("place > first")
    windows = classes.select("first.id_key", "first.version", "first.lo", "passage").mapInPandas(
        _window_digests(length), "digest binary, id_key long, version long, lo int"
    ).withColumn("place", place)
    earliest = windows.groupBy("digest").agg(F.min("place").alias("first"))
    later = A.spread_join(windows, earliest, "digest", "inner").filter("place > first")
    text = F.col("passage").cast("string")  # as text: a binary's length counts bytes
    words = F.length(text) - F.length(F.translate(text, " ", "")) + 1
    return others.select("id_key", "version", "lo", (F.col("lo") + words).cast("int").alias("hi")).unionByName(
        later.select("id_key", "version", "lo", (F.col("lo") + length).alias("hi"))
    )


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (text).

    The first copy of a passage stays; the order is that of doc_id (nulls last) and place.
    Windows are judged on the input. Null texts have no words. Rows that repeat id and text
    are one document and end alike; rows that share only the id are told apart by their text.
    """
    spans = A.per_document(repeated_spans(docs, **options), "lo", "hi")
    joined = A.with_texts(docs, spans, "left")
    return joined.mapInPandas(_kept, "id_key long, n_words long, n_removed long, kept string").select(
        A.doc_id(), "n_words", "n_removed", "kept"
    )


def remove_reference(docs: DataFrame, reference: DataFrame, length: int = LENGTH, max_words: int = MAX_REFERENCE) -> DataFrame:
    """Like ``remove_repeats`` against another, bounded table of texts, whose automata are broadcast.

    The reference's words are counted first; more than ``max_words`` is an error. Its texts are
    dealt to automata of ``SHARD_WORDS`` words; documents stream through each of them.
    """
    spark = docs.sparkSession
    texts = reference.select(whole_text().alias("text"))
    count = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    if (texts.agg(count.alias("n")).first()["n"] or 0) > max_words:
        raise ValueError(f"the reference has more than {max_words} words; use remove_repeats over a union instead")
    shards, filled = [Automaton()], 0
    for row in texts.toLocalIterator():
        words = row["text"].encode().split()
        if filled > SHARD_WORDS:
            shards.append(Automaton())
            filled = 0
        shards[-1].add(words)
        filled += len(words)
    shared = spark.sparkContext.broadcast(shards)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lo, hi = [], []
            for text in batch["text"]:
                words = text.encode().split()
                ends = {i for a in shared.value for i, size in enumerate(a.statistics(words)) if size >= length}
                spans = list(A.spans_of(np.array(sorted(ends), np.int64) - length + 1, length))
                lo.append(np.array([a for a, _ in spans], np.int64))
                hi.append(np.array([b for _, b in spans], np.int64))
            yield from _kept(iter([batch.assign(lo=lo, hi=hi)]))

    return A.keyed(docs).mapInPandas(run, "id_key long, n_words long, n_removed long, kept string").select(
        A.doc_id(), "n_words", "n_removed", "kept"
    )

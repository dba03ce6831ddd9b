"""Removal of long repeated byte strings by sorted suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newsweave.llm import anchors as A

#: Length of a repeated string, length of the gram that chooses suffixes.
LENGTH, GRAM = 400, 128
#: Suffixes sorted at once; groups of one leading gram stay together.
BUCKET = 20_000


def byte_grams(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``size`` bytes (a power of two), by doubling."""
    h = A.mixed(data.astype(np.uint64) + np.uint64(1))
    step = 1
    while step < size and len(h) > step:
        h = A.mixed(h[:-step] * np.uint64(0x9FB21C651E98DF25) + h[step:])
        step *= 2
    return h if step >= size else h[:0]


def _finder(length: int, gram: int):
    def find(text: str) -> Iterator[tuple]:
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) >= length:
            hashes = byte_grams(data, gram)
            for place, lo, hi in A.minima(hashes, length - gram + 1):
                yield hashes[place], place, lo, hi

    return lambda: find


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their big-endian words, and the bytes each shares with the row before it.

    A multikey quicksort on whole words: rows are split by the first word, and only rows still
    tied are split by the next.
    """
    n, depth = words.shape
    order, shared = np.arange(n), np.full(n, depth * 8, np.int64)
    if n:
        shared[0] = 0
    group = np.zeros(n, np.int64)  # place of the first row of the tie that a place belongs to
    active = np.arange(n)
    for d in range(depth):
        if not len(active):
            break
        rows = order[active]
        inner = np.lexsort((words[rows, d], group[active]))
        order[active] = rows = rows[inner]
        value, tie = words[rows, d], group[active]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (tie[1:] != tie[:-1])])
        split = np.flatnonzero(new[1:] & (tie[1:] == tie[:-1])) + 1
        differing = value[split] ^ value[split - 1]
        shared[active[split]] = d * 8 + _leading_zero_bytes(differing)
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(active)))
        group[active] = np.repeat(active[begin], sizes)
        active = active[np.repeat(sizes > 1, sizes)]
    return order, shared


def _leading_zero_bytes(value: np.ndarray) -> np.ndarray:
    octets = value.astype(">u8").view(np.uint8).reshape(-1, 8)
    return (octets != 0).argmax(axis=1)


def repeated_windows(left: list[bytes], right: list[bytes], length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For anchors with what stands before (reversed) and from them on, which windows around them repeat.

    Entry (o, i): the window that starts o bytes before anchor i occurs around another anchor
    too. Rows are sorted by what follows and by what precedes; for each o, windows are equal
    that share length - o bytes in the first order and o bytes in the second.
    """
    n, most = len(left), length - gram
    marks = np.zeros((most + 1, n), bool)

    def table(texts: list[bytes], width: int) -> np.ndarray:
        width = -(-width // 8) * 8
        return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), ">u8").reshape(n, -1).astype(np.uint64)

    after, before = multikey_order(table(right, length)), multikey_order(table(left, most))
    n_left = np.fromiter(map(len, left), np.int64, n)
    n_right = np.fromiter(map(len, right), np.int64, n)
    follows, precedes = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(most + 1):
        follows[after[0]] = np.cumsum(after[1] < length - o)
        precedes[before[0]] = np.cumsum(before[1] < o)
        there = np.flatnonzero((n_left >= o) & (n_right >= length - o))
        if len(there) < 2:
            continue
        key = follows[there] * (n + 1) + precedes[there]
        inner = np.argsort(key, kind="stable")
        same = key[inner[1:]] == key[inner[:-1]]
        twin = np.zeros(len(there), bool)
        twin[inner[1:]] |= same
        twin[inner[:-1]] |= same
        marks[o, there] = twin
    return marks


CONTEXTS = "id_key long, version long, place int, before binary, after binary"
PASSAGES = "digest binary, id_key long, version long, lo int, passage binary"
SPANS = "id_key long, version long, lo int, hi int"


def _contexts(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, version, text, places in zip(*[batch[c] for c in ("id_key", "version", "text", "place")]):
                data = text.encode()
                for at in places.tolist():
                    after = data[at : at + length]
                    before = data[max(0, at - length + gram) : at][::-1]
                    out.append((key, version, at, before, after))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CONTEXTS.split(", ")])

    return run


def _sorted_buckets(length: int, gram: int, bucket: int):
    """Sort what a range holds, bucket by bucket; a bucket ends only where the leading gram changes."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        marks = repeated_windows(list(frame["before"]), list(frame["after"]), length, gram)
        out = []
        for i in np.flatnonzero(marks.any(axis=0)):
            starts = int(frame["place"].iat[i]) - np.flatnonzero(marks[:, i])[::-1]
            key, version = frame["id_key"].iat[i], frame["version"].iat[i]
            out += [(key, version, lo, hi) for lo, hi in A.spans_of(starts, length)]
        return pd.DataFrame(out, columns=["id_key", "version", "lo", "hi"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= bucket:
                frame = pd.concat(held, ignore_index=True)
                after = frame["after"].to_numpy()
                cut, lead = len(frame), after[-1][:gram]
                while cut and after[cut - 1][:gram] == lead:
                    cut -= 1
                if cut:
                    yield solve(frame.iloc[:cut].reset_index(drop=True))
                held, size = [frame.iloc[cut:]], len(frame) - cut
        if size:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def _passages(length: int):
    """The bytes of all windows that an anchor was chosen for, and their 128-bit digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            out = []
            for key, version, text, *arrays in zip(*[batch[c] for c in ("id_key", "version", "text", "lo", "hi")]):
                data = text.encode()
                for lo, hi in zip(*[a.tolist() for a in arrays]):
                    passage = data[lo : hi + length]
                    out.append((xxh3_128_digest(passage), key, version, lo, passage))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PASSAGES.split(", ")])

    return run


def _window_digests(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            out = []
            for n, key, version, lo, passage in zip(*[batch[c] for c in ("n", "id_key", "version", "lo", "passage")]):
                for i in range(len(passage) - length + 1):
                    out.append((xxh3_128_digest(passage[i : i + length]), n, key, version, lo + i))
            yield pd.DataFrame(out, columns=["digest", "n", "id_key", "version", "lo"])

    return run


def _heavy_spans(passages: DataFrame, length: int) -> DataFrame:
    """Repeated stretches around anchors too frequent to be sorted in one place.

    Equal passages are one class: where a class has several, all its windows repeat. Windows
    of different classes are compared by digests; both counts sum up in the tasks first.
    """
    classes = passages.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.struct("id_key", "version", "lo", "passage")).alias("row")
    )
    several = A.spread_join(passages, classes.filter("n > 1").select("digest"), "digest", "left_semi")
    windows = classes.select("n", "row.*").mapInPandas(
        _window_digests(length), "digest binary, n long, id_key long, version long, lo int"
    )
    again = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("digest")
    single = A.spread_join(windows.filter("n = 1"), again, "digest", "left_semi")
    return several.select(
        "id_key", "version", "lo", (F.col("lo") + F.length("passage")).alias("hi")
    ).unionByName(single.select("id_key", "version", "lo", (F.col("lo") + length).alias("hi")))


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, text, lo, hi in zip(*[batch[c] for c in ("id_key", "text", "lo", "hi")]):
            data = np.frombuffer(text.encode(), np.uint8)
            gone = A.covered(len(data), lo, hi)
            edges = np.diff(np.concatenate([[0], gone.view(np.int8)]))
            out.append((key, len(data), int(gone.sum()), int((edges == 1).sum()), data[~gone].tobytes()))
        yield pd.DataFrame(out, columns=["id_key", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, support: float = A.SUPPORT, most: int = A.MAX_GROUP, bucket: int = BUCKET
) -> DataFrame:
    """Stretches (id_key, version, lo, hi) of bytes covered by strings of ``length`` bytes that occur elsewhere too.

    Only suffixes at anchors travel, and only those whose leading gram occurs again. Spark
    samples splitters of their leading grams and deals them to ranges; each range is sorted by
    a multikey quicksort and equal windows are read off the shared lengths. Suffixes of one
    leading gram never straddle ranges, except those of more than ``most`` rows: these are
    compared across all tasks by digests of their passages and windows.
    """
    A.checked_width(length, gram)
    rows, heavy = A.repeated(A.gram_rows(docs, _finder(length, gram)), support, most)
    contexts = A.with_texts(docs, A.per_document(rows, "place")).mapInPandas(_contexts(length, gram), CONTEXTS)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = F.substring("after", 1, gram)
    ranged = contexts.repartitionByRange(parts, lead).sortWithinPartitions(lead)
    passages = A.with_texts(docs, A.per_document(heavy, "lo", "hi")).mapInPandas(_passages(length), PASSAGES)
    return ranged.mapInPandas(_sorted_buckets(length, gram, bucket), SPANS).unionByName(_heavy_spans(passages, length))


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (binary).

    Every byte covered by a string that starts anywhere else too is removed, all copies alike;
    strings are judged on the input and never cross documents. Null texts are empty; texts
    shorter than the string lose nothing. Rows that repeat id and text are copies of each other.
    """
    spans = A.per_document(repeated_spans(docs, **options), "lo", "hi")
    joined = A.with_texts(docs, spans, "left")
    return joined.mapInPandas(_kept, "id_key long, n_bytes long, n_removed long, n_spans long, kept binary").select(
        A.doc_id(), "n_bytes", "n_removed", "n_spans", "kept"
    )

"""SimHash near-dedup by meeting in the middle of Hamming balls."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from newsweave.llm.common import packed, same, whole_text
from newsweave.llm.graph import components
from newsweave.sinks import materialize

#: Shingles whose bits are summed at once.
SLICE = 1 << 15


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text as a signed integer; 0 without words.

    A-Z are lower-cased, words are split at the six ASCII spaces, and a text of fewer words
    than a shingle is one shingle. A bit is 1 if it is set in over half of the shingles' hashes.
    """
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    begin, finish = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    for at in range(0, n, SLICE):
        part = [digest(joined[a:b], seed) for a, b in zip(begin[at : at + SLICE], finish[at : at + SLICE])]
        octets = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (long) of every row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "fingerprint": np.array([fingerprint(t, shingle) for t in batch["text"]], np.int64),
                }
            )

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return frame.mapInPandas(run, "doc_id long, fingerprint long")


def close_pairs(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints whose links have the components of all links within ``radius``.

    Each fingerprint emits every variant within half the radius; two fingerprints within the
    radius share one, and all that share one are within the radius of each other. Fingerprints
    of one variant are put in order and each is paired with the one before it, so a crowded
    variant gives a chain, not all pairs. Pairs are deduplicated and verified. The radius is even.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    masks = [0] + [sum(1 << b for b in c) for k in range(1, half + 1) for c in combinations(range(64), k)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    distinct = prints.select("fingerprint").distinct()
    variants = distinct.select(
        "fingerprint", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("variant")
    )
    order = Window.partitionBy("variant").orderBy("fingerprint")
    met = variants.select(F.lag("fingerprint").over(order).alias("a"), F.col("fingerprint").alias("b"))
    met = met.filter("a IS NOT NULL").distinct()
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (long), component_id.

    component_id is the smallest doc_id reachable over links; texts with one fingerprint are
    one node, whatever their number. Texts without words have fingerprint 0 and link like
    others; null texts are empty. Rows without an id take part but never name a component
    unless no other row does.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = materialize(components(close_pairs(prints, radius)), "roots")
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one_of_each(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row of ``docs`` per component, all columns: that of the smallest id, nulls last.

    Rows are told apart by id and text, so rows without an id and rows that share one are
    near copies like others; of rows equal in both one stays.
    """
    version = F.xxhash64(whole_text())
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), version.alias("version"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch["text"]], np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "version": batch["version"], "fingerprint": prints})

    prints = materialize(keyed.mapInPandas(run, "doc_id long, version long, fingerprint long"), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "version")
    nodes = prints.groupBy("fingerprint").agg(F.min(order).alias("least"))
    roots = materialize(components(close_pairs(prints, radius)), "roots")
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left")
    named = rooted.groupBy(F.coalesce("root", "fingerprint").alias("root")).agg(F.min("least").alias("least"))
    kept = materialize(named.select("least.doc_id", "least.version"), "kept-rows")
    # The rows' keys have no size bound but are far smaller than the texts, which needn't be sorted.
    kept = kept.hint("shuffle_hash")
    tagged = packed(docs, doc_id=F.col("doc_id").cast("long"), version=version)
    left = tagged.join(kept, same(tagged, kept, "doc_id", "version"), "left_semi")
    if prints.groupBy("doc_id", "version").count().filter("count > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id", "version"])
    return left.select("row.*")

"""Connected components of large sparse graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsweave.sinks import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``edges`` (a, b): the root is the smallest node reachable.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours to the smallest. Distances shrink geometrically, also
    along chains, so rounds grow with the logarithm of the longest chain. Steps are
    aggregates and joins; a node with very many neighbours is combined in the tasks first and
    its rows are dealt out again by the skew join. Each round is stored.
    """
    current = materialize(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v > u").distinct(), "edges"
    )
    state = _state(current)
    while True:
        both = current.select(F.col("v").alias("n"), F.col("u").alias("m")).union(current.select("u", "v"))
        least = both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("low"))
        large = (
            both.filter("m > n").join(least, "n").select(F.col("m").alias("v"), F.col("low").alias("u")).distinct()
        )
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(low, "v").select(F.when(F.col("u") == F.col("low"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("low").alias("u"))
        current = materialize(small.filter("v > u").distinct(), "edges")
        now = _state(current)
        if now == state:
            break
        state = now
    roots = current.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return current.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

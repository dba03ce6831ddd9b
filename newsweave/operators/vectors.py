"""TF-IDF vectors of items and topics.

Weights are kept as integers (raw weights in 1e-5, unit weights in 1e-8 steps).
Integer sums do not depend on the order in which tasks deliver them, so a task
that is run again after a lost executor gives exactly the same vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from newsweave import params as P
from newsweave.functions import text as X
from newsweave.functions.core import let
from newsweave.sinks import forget, materialize, rows_at_once

RAW = 100_000
UNIT = 100_000_000
# Terms whose weights are broadcast, so a few MB at any size; the others are joined.
FREQUENT_TERMS = 65_536
#: Items that are worked on in Python at once.
ITEMS_AT_ONCE = 1000


def scored_body(content: Column, vp: P.VectorParams) -> Column:
    body = F.coalesce(content, F.lit(""))
    return body if vp.body_chars is None else F.left(body, F.lit(vp.body_chars))


def _weighted_words(title: Column, content: Column, vp: P.VectorParams, prepare) -> Column:
    body = scored_body(content, vp)
    entry = lambda weight: lambda w: F.struct(
        w.alias("word"), F.lit(weight).alias("weight")
    )
    return F.concat(
        F.transform(X.words(prepare(title)), entry(vp.title_weight)),
        F.transform(X.words(prepare(body)), entry(1)),
    )


def term_counts(items: DataFrame, vp: P.VectorParams = P.VectorParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Items(doc_id, title, content) to (doc_id, counts array<struct<term, tf>>), one row per item, with the columns to ``keep``.

    A text is one row, so its words are counted there. No word travels.
    """

    of = lambda text: X.words(X.match_key(text))
    kept = ["doc_id", *keep]
    rows = items.select(*kept, of(F.col("title")).alias("title"), of(scored_body(F.col("content"), vp)).alias("body"))
    entry = items.sparkSession.createDataFrame([], "counts array<struct<term: string, tf: bigint>>").schema["counts"]
    return rows.mapInArrow(_counted(kept, vp), StructType([*[rows.schema[c] for c in kept], entry]))


def _counted(kept: list[str], vp: P.VectorParams):
    """Rows with the words of a text to its counted terms; each distinct word of some rows is looked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term_of = X.word_terms(vp)
        for whole in batches:
            for at in range(0, whole.num_rows, ITEMS_AT_ONCE):
                batch = whole.slice(at, ITEMS_AT_ONCE)
                (n_title, title), (n_body, body) = _columns(batch, "title"), _columns(batch, "body")
                words = pa.concat_arrays([title, body]).dictionary_encode()
                terms = pa.array([term_of(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
                # Words without a term have the number -1.
                number = terms.indices.fill_null(-1).to_numpy()[words.indices.to_numpy()].astype(np.int64)
                docs = np.arange(batch.num_rows, dtype=np.int64)
                doc = np.concatenate([np.repeat(docs, n_title), np.repeat(docs, n_body)])
                times = np.repeat([vp.title_weight, 1], [len(title), len(body)])
                some, n_terms = number >= 0, max(1, len(terms.dictionary))
                key, which = np.unique(doc[some] * n_terms + number[some], return_inverse=True)
                tf = np.bincount(which, times[some], len(key)).astype(np.int64)
                starts = np.concatenate([[0], np.cumsum(np.bincount(key // n_terms, minlength=batch.num_rows))])
                spelled = terms.dictionary.take(pa.array(key % n_terms))
                # An item without terms, or without a title, has no counts.
                none = (starts[1:] == starts[:-1]) | batch.column("title").is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(
                    pa.array(starts, pa.int32(), mask=np.append(none, False)), pa.StructArray.from_arrays([spelled, pa.array(tf)], ["term", "tf"])
                )
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists], [*kept, "counts"])

    return run


def _each_term(counts: DataFrame) -> DataFrame:
    tf = counts.select("doc_id", F.inline("counts"))
    return tf.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")) if _shared_ids(counts) else tf


def _shared_ids(counts: DataFrame) -> bool:
    """Whether rows share an id and so are one item; ids alone tell."""
    return not counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def term_frequencies(items: DataFrame, vp: P.VectorParams = P.VectorParams()) -> DataFrame:
    """Items(doc_id, title, content) to (doc_id, term, tf); title words count more."""
    return _each_term(term_counts(items, vp))


def surface_forms(
    items: DataFrame, vp: P.VectorParams = P.VectorParams(), wanted: DataFrame | None = None
) -> DataFrame:
    """(doc_id, term, surface): the first readable spelling of each term in an item.

    With ``wanted`` (doc_id, terms) only these terms are looked for: the other words never leave
    their task.
    """
    asked = items if wanted is None else items.join(wanted.select("doc_id", "terms"), "doc_id")
    terms = [] if wanted is None else ["terms"]
    occurrences = asked.select(
        "doc_id",
        *terms,
        F.posexplode(_weighted_words(F.col("title"), F.col("content"), vp, X.to_latin)).alias(
            "position", "entry"
        ),
    )
    spelled = occurrences.select(
        "doc_id",
        *terms,
        "position",
        F.col("entry.word").alias("surface"),
        F.explode(X.first_piece(F.lower(X.fold_diacritics(F.col("entry.word"))), vp)).alias("piece"),
    ).withColumn("term", X.stem(F.col("piece"), vp))
    kept = spelled if wanted is None else spelled.filter(F.array_contains("terms", F.col("term")))
    return kept.groupBy("doc_id", "term").agg(F.min_by("surface", "position").alias("surface"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    # Counting a column instead of rows keeps this plan's input identical to that of
    # the weights, so Spark computes the term frequencies once and reuses them.
    return tf.groupBy("term").agg(F.count("tf").alias("df"))


def idf_weight(df: Column, n_docs: Column) -> Column:
    return F.ln((n_docs + 1) / (df + 1)) + 1


def item_total(items: DataFrame) -> DataFrame:
    return items.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_docs"))


def inverse_frequencies(df: DataFrame, items: DataFrame) -> DataFrame:
    """(term, df, idf); the number of items is a one-row table."""
    return df.join(F.broadcast(item_total(items))).select(
        "term", "df", idf_weight(F.col("df"), F.col("n_docs")).alias("idf")
    )


def gathered(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows(key, columns) brought together by key, for windows over it to find them there.

    A key's rows of one task travel as one, its columns as lists: most of a row's bytes are its own
    frame and key. Values may not be null.
    """
    lists = rows.groupBy(key).agg(*[F.collect_list(c).alias(c) for c in columns])
    # Outer, as no list is empty and a test for that would build them twice.
    return lists.select(key, F.inline_outer(F.arrays_zip(*columns)))


def raw_weights(tf: DataFrame, frequencies: DataFrame, items: DataFrame, frequent: int = FREQUENT_TERMS) -> DataFrame:
    """(doc_id, term, df, raw) from tf(doc_id, term, tf) and frequencies(term, df), by item.

    The frequencies of the most frequent terms, ``frequent`` at most, which are most of the rows, are
    broadcast and the rows stay where they are. Only rows of rarer terms travel to meet theirs; ``tf``
    is read twice, so it should come from a stored table.
    """
    head = frequencies.orderBy(F.desc("df"), "term").limit(frequent)
    looked = tf.join(F.broadcast(head), "term", "left").select("doc_id", "term", "tf", "df")
    rare = looked.filter("df IS NULL").drop("df").join(frequencies, "term").select("doc_id", "term", "tf", "df")
    by_item = gathered(looked.filter("df IS NOT NULL").unionByName(rare), "doc_id", ["term", "tf", "df"])
    weight = (1 + F.ln("tf")) * idf_weight(F.col("df"), F.col("n_docs"))
    return by_item.join(F.broadcast(item_total(items))).select(
        "doc_id", "term", "df", F.floor(weight * RAW + 0.5).cast("bigint").alias("raw")
    )


def unit_weights(raw: DataFrame, key: str) -> DataFrame:
    """Long-form unit vectors: (key, term, df, w)."""
    whole = Window.partitionBy(key)
    return raw.withColumn(
        "w",
        F.floor(
            F.col("raw") * UNIT / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(whole)) + 0.5
        ).cast("bigint"),
    ).drop("raw")


def unit_postings(raw: DataFrame, key: str) -> DataFrame:
    """Long-form unit vectors: (key, term, df, w, upto).

    ``upto`` is the squared length of the vector from this term to the end of
    the global order (rare terms first, common last); the similarity join reads
    its prefix and its bounds from it. Both windows and the later collection
    per key share one shuffle, and each key holds one document's terms only.
    """
    from_common = Window.partitionBy(key).orderBy(F.desc("df"), F.desc("term")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return unit_weights(raw, key).withColumn("upto", F.sum(F.col("w") * F.col("w")).over(from_common))


def weights_of(vec: Column) -> Column:
    return F.map_from_entries(F.transform(vec, lambda s: F.struct(s["term"], s["w"])))


def collect_vectors(postings: DataFrame, key: str) -> DataFrame:
    """One row per key: ``vec`` array(term, w, upto) and ``weights`` map(term, w)."""
    return postings.groupBy(key).agg(
        F.collect_list(F.struct("term", "w", "upto")).alias("vec")
    ).withColumn("weights", weights_of(F.col("vec")))


def mean_vectors(totals: DataFrame, sizes: DataFrame) -> DataFrame:
    """(topic_id, vec) of topics from (topic_id, term, total) and (topic_id, size): unit vectors of the means.

    A large topic is reduced per task before its terms travel; its vector is one row, as long as its vocabulary.
    """
    lists = totals.groupBy("topic_id").agg(F.collect_list("term").alias("terms"), F.collect_list("total").alias("totals"))
    mean = lambda total: F.floor(total / F.col("size") + 0.5).cast("bigint")
    entries = F.filter(
        F.zip_with("terms", "totals", lambda t, n: F.struct(t.alias("term"), mean(n).alias("raw"))), lambda s: s["raw"] > 0
    )

    def unit(raw: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        length = F.sqrt(F.aggregate(raw, zero, lambda total, s: total + s["raw"] * s["raw"]))
        weight = lambda n: lambda s: F.floor(s["raw"] * UNIT / n + 0.5).cast("bigint")
        return let(length, lambda n: F.transform(raw, lambda s: F.struct(s["term"].alias("term"), weight(n)(s).alias("w"))))

    vectors = lists.join(sizes.select("topic_id", "size"), "topic_id").select("topic_id", let(entries, unit).alias("vec"))
    return vectors.filter(F.size("vec") > 0)


def member_totals(members: DataFrame) -> DataFrame:
    """(topic_id, term, total) of members(topic_id, vec)."""
    return members.select("topic_id", F.inline("vec")).groupBy("topic_id", "term").agg(F.sum("w").alias("total"))


def item_raw_weights(
    items: DataFrame, vp: P.VectorParams = P.VectorParams(), frequent: int = FREQUENT_TERMS
) -> DataFrame:
    counts = materialize(term_counts(items, vp), "term-counts")
    tf = _each_term(counts)
    return raw_weights(tf, document_frequencies(tf), counts, frequent)


# --- whole items ---------------------------------------------------------------------------

def _columns(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    """Sizes and values of a column of lists."""
    lists = batch.column(name)
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), lists.flatten()


def _head_rows(head: pa.Table, keep: list[str]):
    """Items with the numbers of their frequent terms, in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(head["term"].to_pylist(), pa.string())
        for batch in batches:
            sizes, counts = _columns(batch, "counts")
            at = pa.compute.index_in(counts.field("term"), value_set=known)
            found = at.is_valid().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(sizes)), sizes)[found]
            starts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(sizes)))]), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, values) for values in (at.drop_null(), counts.field("tf").filter(pa.array(found)).cast(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *lists], [*keep, "codes", "tfs"])

    return run


def _rare_rows(head: pa.Table):
    """(doc_id, term, tf) of the other terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(head["term"].to_pylist(), pa.string())
        for batch in batches:
            sizes, counts = _columns(batch, "counts")
            rare = pa.compute.is_in(counts.field("term"), value_set=known).to_numpy(zero_copy_only=False) == 0
            doc = np.repeat(np.arange(len(sizes)), sizes)[rare]
            some = counts.filter(pa.array(rare))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), some.field("term"), some.field("tf")], ["doc_id", "term", "tf"])

    return run


def _unit_rows(head: pa.Table, keep: list[str]):
    """Items with all their counts and inverse frequencies to their unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_terms, head_idf = head["term"].combine_chunks(), head["idf"].to_numpy()
        for batch in batches:
            (n_head, codes), (_, tfs) = _columns(batch, "codes"), _columns(batch, "tfs")
            n_rare, rare = _columns(batch, "rare")
            spelled = rare.field("term").dictionary_encode()
            terms = pa.concat_arrays([pa.array(head_terms.to_pylist(), pa.string()), spelled.dictionary.cast(pa.string())])
            docs = np.arange(batch.num_rows, dtype=np.int64)
            key = np.concatenate([np.repeat(docs, n_head), np.repeat(docs, n_rare)]) * len(terms)
            key += np.concatenate([codes.to_numpy(), spelled.indices.to_numpy() + len(head_terms)])
            idf = np.concatenate([head_idf[codes.to_numpy()], rare.field("idf").to_numpy()])
            # Rows that share an id are one item: their counts are added up.
            key, first, which = np.unique(key, return_index=True, return_inverse=True)
            tf = np.bincount(which, np.concatenate([tfs.to_numpy(), rare.field("tf").to_numpy()]), len(key))
            some, at = np.unique(tf, return_inverse=True)
            logs = np.array([1 + math.log(x) for x in some])
            raw = np.floor(logs[at] * idf[first] * RAW + 0.5).astype(np.int64)
            doc, term = key // len(terms), key % len(terms)
            sizes = np.bincount(doc, minlength=batch.num_rows)
            stops = np.cumsum(sizes)
            squares = np.concatenate([[0], np.cumsum(raw * raw)])
            length = np.sqrt((squares[stops] - squares[stops - sizes]).astype(np.float64))
            w = np.floor((raw * UNIT).astype(np.float64) / length[doc] + 0.5).astype(np.int64)
            entries = pa.StructArray.from_arrays([terms.take(pa.array(term)), pa.array(w)], ["term", "w"])
            starts = pa.array(np.concatenate([stops - sizes, stops[-1:]]), pa.int32(), mask=np.append(sizes == 0, False))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.ListArray.from_arrays(starts, entries)], [*keep, "vec"])

    return run


def item_vectors(counts: DataFrame, links: DataFrame | None = None, frequent: int = FREQUENT_TERMS) -> DataFrame:
    """Rows of ``term_counts``, a stored table, to (doc_id, copy, the other columns, vec array<struct<term, w>>), a stored table.

    ``vec`` is the unit vector, null without terms. Rows that share an id are one item, whose vector each
    of them has; ``copy`` numbers them from 0. With links(topic_id, doc_id, ...) the rows carry their item's
    links as ``topics``. All there is of an item comes together by its id in one exchange: of its frequent
    terms only numbers and counts travel, since their frequencies, ``frequent`` at most, are known to every
    task; its rarer terms meet theirs first.
    """
    spark = counts.sparkSession
    others = [c for c in counts.columns if c not in ("doc_id", "counts")]
    known = document_frequencies(_each_term(counts)).join(F.broadcast(item_total(counts)))
    known = materialize(known.select("term", "df", idf_weight(F.col("df"), F.col("n_docs")).alias("idf")), "frequencies")
    head = known.orderBy(F.desc("df"), "term").limit(frequent).select("term", "idf").toArrow()
    typed = lambda name: counts.schema[name]
    numbers = "codes array<int>, tfs array<int>"
    rare_kind = "array<struct<term: string, tf: bigint, idf: double>>"
    row = F.struct(*others) if others else F.struct(F.lit(True).alias("_row"))
    kept = ["doc_id", "item"]
    with rows_at_once(spark, ITEMS_AT_ONCE):
        shape = counts.select("doc_id", F.array(row).alias("item"), "counts")
        coded = shape.mapInArrow(
            _head_rows(head, kept), StructType([typed("doc_id"), shape.schema["item"], *spark.createDataFrame([], numbers).schema.fields])
        )
        rare = counts.select("doc_id", "counts").mapInArrow(
            _rare_rows(head), StructType([typed("doc_id"), *spark.createDataFrame([], "term string, tf bigint").schema.fields])
        )
        rare = rare.join(known.select("term", "idf"), "term").groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf", "idf")).alias("rare"))
        none = {"item": shape.schema["item"].dataType, "codes": "array<int>", "tfs": "array<int>", "rare": rare_kind, "topics": "array<bigint>"}
        if links is not None:
            link = F.struct(*[c for c in links.columns if c != "doc_id"])
            none["topics"] = links.select(F.array(link).alias("topics")).schema["topics"].dataType
        rows = None
        parts = [coded, rare] + ([] if links is None else [links.select("doc_id", F.array(link).alias("topics"))])
        for part in parts:
            full = part.select("doc_id", *[F.col(c) if c in part.columns else F.array().cast(kind).alias(c) for c, kind in none.items()])
            rows = full if rows is None else rows.unionByName(full)
        together = rows.groupBy("doc_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in none]).filter(F.size("item") > 0)
        carried = ["doc_id", "item", "topics"]
        out = StructType([*[together.schema[c] for c in carried], StructField("vec", spark.createDataFrame([], "vec array<struct<term: string, w: bigint>>").schema["vec"].dataType)])
        whole = together.mapInArrow(_unit_rows(head, carried), out)
        whole = whole.select("doc_id", "topics", "vec", F.posexplode("item").alias("copy", "item"))
        extra = [F.col(f"item.{c}").alias(c) for c in others]
        return materialize(whole.select("doc_id", "copy", *extra, *([] if links is None else ["topics"]), "vec"), "item-vectors")


def item_features(items: DataFrame, vp: P.VectorParams = P.VectorParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Stored (doc_id, item_at, keep, entities, counts) of items(doc_id, title, content, item_at): texts are read once."""
    kept = ("item_at", *keep, "entities")
    return materialize(term_counts(item_entities(items, vp), vp, kept), "item-features")


def item_table(
    items: DataFrame, vp: P.VectorParams = P.VectorParams(), keep: tuple[str, ...] = (), links: DataFrame | None = None
) -> DataFrame:
    """Stored (doc_id, copy, item_at, keep, entities, vec) of items, with their ``topics`` where links are given."""
    features = item_features(items, vp, keep)
    table = item_vectors(features, links)
    forget(features)
    return table


def item_weights(items: DataFrame, vp: P.VectorParams = P.VectorParams()) -> DataFrame:
    """(doc_id, term, w): what means and titles need of the items' unit vectors."""
    counts = materialize(term_counts(items, vp), "term-counts")
    vectors = item_vectors(counts)
    forget(counts)
    return vectors.filter("copy = 0").select("doc_id", F.inline("vec"))


def item_postings(
    items: DataFrame, vp: P.VectorParams = P.VectorParams(), frequent: int = FREQUENT_TERMS
) -> DataFrame:
    return unit_postings(item_raw_weights(items, vp, frequent), "doc_id")


def item_entities(items: DataFrame, vp: P.VectorParams = P.VectorParams()) -> DataFrame:
    text = F.concat(F.col("title"), F.lit(". "), scored_body(F.col("content"), vp))
    return items if "entities" in items.columns else items.withColumn("entities", X.entities(text, vp.max_entities, vp))


def top_terms(postings: DataFrame, key: str, limit: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("w"), "term")
    return postings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


# --- topic centroids ---------------------------------------------------------------------


def member_weights(postings: DataFrame, links: DataFrame) -> DataFrame:
    """(topic_id, size, doc_id, term, w): weights of the members, each with the size of its topic.

    The size goes with the links, which are few: the sums need no second shuffle for it.
    """
    sizes = links.groupBy("topic_id").agg(F.count("*").alias("size"))
    sized = links.select("topic_id", "doc_id").join(sizes, "topic_id")
    return postings.select("doc_id", "term", "w").join(sized, "doc_id")


def centroids(postings: DataFrame, links: DataFrame | None) -> DataFrame:
    """Mean of the members' unit vectors: (topic_id, term, raw).

    A large topic is reduced per task before the shuffle; what is left per topic
    is its vocabulary. Without links, ``postings`` are ``member_weights``.
    """
    members = postings if links is None else member_weights(postings, links)
    return (
        members.groupBy("topic_id", "term")
        .agg(F.sum("w").alias("total"), F.max("size").alias("size"))
        .select(
            "topic_id",
            "term",
            F.floor(F.col("total") / F.col("size") + 0.5).cast("bigint").alias("raw"),
        )
        .filter("raw > 0")
    )


def stored_centroids(mean: DataFrame, tp: P.TopicParams = P.TopicParams()) -> DataFrame:
    """What is kept of a centroid: its heaviest terms, as (topic_id, term, raw) in 1e-4."""
    # The vocabulary of one topic has no bound, so its length is a grouped sum.
    lengths = mean.groupBy("topic_id").agg(
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length")
    )
    order = Window.partitionBy("topic_id").orderBy(F.desc("raw"), "term")
    return (
        mean.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= tp.centroid_terms)
        .join(lengths, "topic_id")
        .withColumn(
            "raw", F.floor(F.col("raw") * 10000 / F.col("length") + 0.5).cast("bigint")
        )
        .drop("length", "rank")
    )

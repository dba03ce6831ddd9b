"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsweave.llm.common import packed, same, whole_text, words
from newsweave.sinks import materialize

#: Weights of the sources in code point order, repeating; null is the last source.
WEIGHTS = [3.0, 1.0, 2.0]
#: Words of a block, documents of a chunk, slots of an output shard.
BLOCK_WORDS, CHUNK_DOCS, SHARD_SLOTS = 64, 2_000, 65_536


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source its number, size and target: source, src, source_size, target.

    Targets share ``share`` of all words by weight and stop at ``most`` times the source's
    size; what stops is shared again. In order of most * size / weight the sources that stop
    come first, so one running sum finds the level at which the rest is shared.
    One row per source meets in one task, never one per document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("src", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    )
    capped = ranked.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everyone = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("ratio", "src").rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = capped.withColumn("level", left / F.sum("weight").over(onward))
    # The first source that does not stop sets the level for itself and all after it.
    levels = levels.withColumn("level", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everyone))
    return levels.select(
        "source",
        "src",
        "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def place(sizes: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS, chunk_docs: int = CHUNK_DOCS, seed: int = 0):
    """Documents laid end to end in pseudorandom order and cut into blocks.

    Returns the placed documents (src, chunk, rank, begin and their columns) and the chunks
    (src, chunk, first block, blocks). A source is split into chunks by a hash, so none is
    sorted whole; each chunk's last block may be short.
    """
    chunks = -(-sizes.count() // chunk_docs) or 1
    mixed = sizes.join(targets, same(sizes, targets, "source")).drop(targets["source"])
    mixed = mixed.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "version"), F.lit(chunks)).cast("int"))
    run = Window.partitionBy("src", "chunk").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", "version")
    placed = mixed.withColumn("rank", F.row_number().over(run)).withColumn(
        "begin", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    placed = materialize(placed, "placed")
    held = placed.groupBy("src", "chunk").agg(
        F.ceil(F.sum("size") / block_words).cast("long").alias("blocks"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
    )
    upto = Window.partitionBy("src").orderBy("chunk")
    per_chunk = held.withColumn("first", F.sum("blocks").over(upto) - F.col("blocks")).withColumn(
        "n_blocks", F.sum("blocks").over(Window.partitionBy("src"))
    )
    return placed, materialize(per_chunk.filter("blocks > 0"), "chunks")


def _permuted(slots: DataFrame, seed: int) -> DataFrame:
    """Adds ``block``: a permutation of the slot numbers 0 .. wide * high - 1 of each source and pass.

    Four rounds add a hash of one half of the number to the other half.
    """
    out = slots.withColumn("_left", F.col("slot") % F.col("wide")).withColumn("_right", F.expr("slot div wide"))
    for i in range(4):
        half, other, size = ("_right", "_left", "high") if i % 2 else ("_left", "_right", "wide")
        step = F.xxhash64(F.lit(seed + i), "src", "pass", other)
        out = out.withColumn(half, F.pmod(F.col(half) + F.pmod(step, F.col(size)), F.col(size)))
    return out.withColumn("block", F.col("_right") * F.col("wide") + F.col("_left")).drop("_left", "_right")


def draw_slots(chunks: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """The slots of the mix: src, pass, slot, shard, block.

    A source fills as many slots as its target needs. Each slot picks its output shard by a
    hash, so the source counts of the shards are multinomial draws whose sums are the sources'
    slots. Slots walk through a permutation of the source's block numbers, once per pass: all
    blocks are used before one is used again. Each chunk's row makes its share of the slots.
    The permuted range is the next rectangle of whole numbers; numbers past the last block are void.
    """
    sized = chunks.withColumn("wide", F.ceil(F.sqrt("n_blocks")).cast("long"))
    sized = sized.withColumn("high", F.ceil(F.col("n_blocks") / F.col("wide")).cast("long"))
    area = F.col("wide") * F.col("high")
    sized = sized.withColumn("area", area).withColumn("slots", F.round(F.col("target") / F.col("source_size") * area).cast("long"))
    share = F.col("slots") * F.col("blocks") / F.col("n_blocks")
    total = sized.agg(F.coalesce(F.sum(share), F.lit(0.0)).alias("n")).first()["n"]
    shards = max(1, -(-int(total) // shard_slots))

    def upto(block: Column) -> Column:
        return F.floor(F.col("slots") / F.col("n_blocks") * block).cast("long")

    last = F.when(F.col("first") + F.col("blocks") == F.col("n_blocks"), F.col("slots")).otherwise(upto(F.col("first") + F.col("blocks")))
    own = sized.withColumn("from", upto(F.col("first"))).withColumn("to", last).filter("to > from")
    # A fixed number of partitions: these few rows become very many, which adaptive planning doesn't foresee.
    own = own.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "chunk")
    slots = own.select("src", "wide", "high", "area", "n_blocks", F.explode(F.sequence("from", F.col("to") - 1)).alias("number"))
    slots = slots.withColumn("pass", F.expr("CAST(number div area AS INT)")).withColumn("slot", F.col("number") % F.col("area"))
    slots = _permuted(slots, seed + 10).filter("block < n_blocks")
    return slots.select("src", "pass", "number", F.pmod(F.xxhash64(F.lit(seed + 2), "src", "number"), F.lit(shards)).alias("shard"), "block")


def pieces(placed: DataFrame, chunks: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The part of a document in each block it touches: src, block, chunk, rank, from, to (words of the document)."""
    end = F.col("begin") + F.col("size")
    cut = placed.filter("size > 0").join(chunks.select("src", "chunk", "first"), ["src", "chunk"])
    cut = cut.withColumn("b", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((end - 1) / block_words))))
    return cut.select(
        "src",
        (F.col("first") + F.col("b")).alias("block"),
        "chunk",
        "rank",
        (F.greatest(F.col("b") * block_words, F.col("begin")) - F.col("begin")).alias("from"),
        (F.least((F.col("b") + 1) * block_words, end) - F.col("begin")).alias("to"),
    )


def mix(docs: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS, **options):
    """The placed documents and the pieces the mix takes of them, joined to slots by block number.

    ``docs`` needs doc_id, text and source. Null texts have no words and nothing is taken of
    them; null is a source of its own, the last. The order hangs on ids and sizes only, so
    reruns agree. Rows that repeat an id are laid out one after the other.
    """
    sizes = materialize(
        docs.select("doc_id", "source", word_count(whole_text()).alias("size"), F.xxhash64(whole_text()).alias("version")), "sizes"
    )
    placed, chunks = place(sizes, source_targets(sizes, **options), seed=seed)
    # Both sides are large, whatever their sources' sizes suggest.
    slots = draw_slots(chunks, shard_slots, seed)
    return placed, pieces(placed, chunks).join(slots.hint("merge"), ["src", "block"])


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target of its source, taken, n_shards (that hold its words)."""
    placed, used = mix(docs, **options)
    taken = used.groupBy("src", "chunk", "rank").agg(
        F.sum(F.col("to") - F.col("from")).alias("taken"), F.size(F.collect_set("shard")).cast("long").alias("n_shards")
    )
    found = placed.join(taken, ["src", "chunk", "rank"], "left")
    nothing = F.lit(0).cast("long")
    return found.select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", nothing).alias("taken"), F.coalesce("n_shards", nothing).alias("n_shards"),
    )


def mixed_shards(docs: DataFrame, **options) -> DataFrame:
    """The mix as output shards: a row per slot of a shard and piece of a document in its block.

    Columns: shard, slot_order (pseudorandom, orders a shard's slots), src, number (the slot), doc_id, from, to (words of
    the document), text (those words joined by one space). Slots chose their shards by themselves, so a shard's count of
    slots by source is a multinomial draw. Write it with ``partitionBy("shard")`` to get a folder per shard.
    Rows repeated in id and text give the same words, so one of them lends its text.
    """
    tagged = docs.select("doc_id", F.xxhash64(whole_text()).alias("version"), whole_text().alias("text"))
    texts = tagged.dropDuplicates(["doc_id", "version"])
    placed, used = mix(docs, **options)
    parts = used.join(placed.select("src", "chunk", "rank", "doc_id", "version"), ["src", "chunk", "rank"])
    cuts = parts.groupBy("doc_id", "version").agg(F.collect_list(F.struct("shard", "src", "number", "from", "to")).alias("cuts"))
    joined = texts.join(cuts.hint("shuffle_hash"), same(texts, cuts, "doc_id", "version")).select(
        texts["doc_id"], words(F.col("text")).alias("words"), F.explode("cuts").alias("cut")
    )
    cut = F.slice("words", (F.col("cut.from") + 1).cast("int"), (F.col("cut.to") - F.col("cut.from")).cast("int"))
    return joined.select(
        "cut.shard", F.xxhash64("cut.shard", "cut.src", "cut.number").alias("slot_order"), "cut.src", "cut.number", "doc_id",
        "cut.from", "cut.to", F.array_join(cut, " ").alias("text"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, all columns: a row per document and pass, its text cut to the words taken.

    A document taken whole keeps its text as it is; otherwise its taken words are joined by
    one space. ``n_chars``, where present, follows the text. Rows repeated in id and text are one document.
    """
    tagged = packed(docs, doc_id=F.col("doc_id"), version=F.xxhash64(whole_text()), text=whole_text())
    repeats = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if repeats:
        tagged = tagged.dropDuplicates(["doc_id", "version"])
        docs = tagged.select("row.*")
    placed, used = mix(docs, **options)
    parts = used.groupBy("src", "chunk", "rank", "pass").agg(
        F.array_sort(F.collect_list(F.struct("from", "to"))).alias("parts"), F.sum(F.col("to") - F.col("from")).alias("taken")
    )
    parts = parts.join(placed.select("src", "chunk", "rank", "doc_id", "version", "size"), ["src", "chunk", "rank"])
    parts = parts.select("doc_id", "version", "size", "parts", "taken").hint("shuffle_hash")
    joined = tagged.join(parts, same(tagged, parts, "doc_id", "version"))
    cut = F.array_join(
        F.flatten(F.transform("parts", lambda p: F.slice("_words", (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")))), " "
    )
    texts = joined.withColumn("_words", words(F.col("text"))).withColumn(
        "text", F.when(F.col("taken") == F.col("size"), F.col("text")).otherwise(cut)
    )
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return texts.select(row.alias("row")).select("row.*")

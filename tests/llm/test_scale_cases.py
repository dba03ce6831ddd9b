"""Long rows, hot ids and filters: cases that only a large table shows."""

import random
import string

import pytest
from pyspark.sql import functions as F

from newsweave.llm import anchors, mixing, secrets, substring_dedup, suffix_dedup


def _entropy_spans(spark, texts):
    found = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kinds = F.filter("found", lambda s: s["kind"] == "entropy")
    return {r[0]: [(s["start"], s["end"]) for s in r[1]] for r in found.select("doc_id", kinds).collect()}


def test_keys_of_letters_or_digits_alone_are_measured(spark):
    rng = random.Random(3)
    keys = ["".join(rng.choice(chars) for _ in range(40)) for chars in (string.ascii_letters, string.ascii_lowercase)]
    keys.append("k0000" + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) + "xxxxQ7")
    got = _entropy_spans(spark, keys)
    assert got == {i: [(0, len(k))] for i, k in enumerate(keys)}
    digits = spark.createDataFrame([("".join(rng.choice(string.digits) for _ in range(40)),), ("1234567890" * 4,)], "text string")
    assert [r[0] for r in digits.select(secrets._suspicious(F.col("text"))).collect()] == [True, False]


def test_names_and_placeholders_are_allowed(spark):
    texts = [
        "getElementByIdAndClassNameOfParent", "some/path-to/module_name12/file", "x" * 30, "0" * 30, "your-api-key-here-0000000000",
        "1234567890123456789012345", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "=" * 60, "-".join(["word"] * 5000),
    ]
    assert _entropy_spans(spark, texts) == {i: [] for i in range(len(texts))}


def test_spans_of_a_row_with_thousands_of_matches(spark):
    rng = random.Random(4)
    parts = []
    for i in range(3000):
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(30))
        parts.append(rng.choice([f"é{key}", f"token={key}", "%016x" % rng.getrandbits(64), "AKIA" + "ABCDEFGH12345678"]))
    text = " ".join(parts)
    found = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = [(s["start"], s["end"], s["kind"]) for s in found["found"]]
    base = [(s["start"], s["end"]) for s in found["base"]]
    places, at = [], 0
    for part in parts:
        places.append((at, at + len(part), part))
        at += len(part) + 1
    assert {s[:2] for s in spans if s[2] == "hex"} >= {(a, b) for a, b, p in places if len(p) == 16}
    added = [s for s in spans if s[2] == "entropy"]
    free = {(a + 1, b) for a, b, p in places if p.startswith("é")}
    assert {s[:2] for s in added} <= free and len(added) > 0.9 * len(free)
    touched = {x for a, b in base for x in range(a, b)}
    assert not any(x in touched for a, b, _ in added for x in range(a, b))


def test_the_filter_keeps_every_repeated_gram(spark):
    rng = random.Random(5)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    rows = [(i, i, h, 0, 0) for i, h in enumerate(hashes + hashes[:400])]
    frame = spark.createDataFrame(rows, anchors.GRAMS)
    repeated = set(hashes[:400])
    for bits in (1 << 27, 1 << 12):  # ample, and so small that it lets single hashes pass
        kept = anchors.maybe_repeated(frame, bits).collect()
        assert sorted(tuple(r) for r in kept if r["h"] in repeated) == sorted(r for r in rows if r[2] in repeated)
        assert len(kept) < 2000
    assert anchors.maybe_repeated(frame.limit(0)).count() == 0
    assert anchors.maybe_repeated(frame).columns == frame.columns


def test_shards_hold_the_words_taken_and_mix_the_sources(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(300)), f"s{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shards = mixing.mixed_shards(docs, shard_slots=200).cache()
    words = shards.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"), F.countDistinct("shard").alias("k"))
    taken = mixing.taken_words(docs, shard_slots=200).filter("taken > 0")
    assert {(r["doc_id"], r["n"], r["k"]) for r in words.collect()} == {(r["doc_id"], r["taken"], r["n_shards"]) for r in taken.collect()}
    counts = shards.groupBy("src", "shard").agg(F.countDistinct("number").alias("n")).collect()
    total = {}
    for r in counts:
        total.setdefault(r["src"], []).append(r["n"])
    for src, found in total.items():
        # Multinomial: every shard near its expected share, and not all alike.
        share = sum(found) / len(found)
        assert len(found) > 5 and all(abs(n - share) < 6 * share**0.5 + 1 for n in found) and len(set(found)) > 1
    texts = dict((r[0], r[1].split()) for r in rows)
    for r in shards.limit(200).collect():
        assert r["text"].split() == texts[r["doc_id"]][r["from"] : r["to"]]


def test_rows_without_an_id_are_spread_over_chunks(spark):
    rows = [(None, f"text number {i} of many", "s") for i in range(400)]
    sizes = spark.createDataFrame(rows, "doc_id long, text string, source string").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("version")
    )
    placed, _ = mixing.place(sizes, mixing.source_targets(sizes), chunk_docs=40)
    counts = [r["count"] for r in placed.groupBy("chunk").count().collect()]
    assert sum(counts) == 400 and len(counts) == 10 and max(counts) < 90


def test_passages_too_long_for_an_anchor_row_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for module in (suffix_dedup, substring_dedup):
        with pytest.raises(ValueError):
            module.repeated_spans(docs, length=5000)
        with pytest.raises(ValueError):
            module.repeated_spans(docs, length=4, gram=8)

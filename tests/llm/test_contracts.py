"""Every operator against plain loops, on hand-made rows and on the smallest tables."""

import random
import string

import brute
import duckdb
import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from newsweave.llm import exact_dedup, line_dedup, mixing, packing, pii, quality, secrets, simhash, substring_dedup, suffix_dedup
from newsweave.llm.queries import CHECKS, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def counts(spans, kinds):
    return [sum(k == kind for k, _, _ in spans) for kind in kinds]


EXPECTED = {
    "op2_line_dedup": brute.op2,
    "op5_suffix_dedup": brute.op5,
    "op7_simhash": brute.op7,
    "op8_substring_dedup": brute.op8,
    "op9_exact_dedup": brute.op9,
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_query_equals_loops(spark, small, name):
    same_rows(QUERIES[name](spark, SF), EXPECTED[name](small))


def test_query_rows_by_text(spark, small):
    base = QUERIES["op3_personal_data"](spark, SF).drop("spans")
    same_rows(base, [(d, *counts(s, brute.KINDS3), brute.sha(brute.spelled(s))) for d, t in small for s in [brute.op3(t)]])
    base = QUERIES["op4_secret_scan"](spark, SF).drop("spans")
    same_rows(base, [(d, *counts(s, brute.KINDS4), brute.sha(brute.spelled(s))) for d, t in small for s in [brute.op4(t)]])
    rated = QUERIES["op10_quality_rules"](spark, SF)
    same_rows(rated.drop("kept"), [(d, *brute.op10(t)) for d, t in small])
    assert rated.filter("base_failed AND kept").count() == 0


def test_line_dedup(nasty, pairs, empty):
    def run(docs):
        kept = line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs, 10, slices=3))
        return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))

    same_rows(run(nasty), brute.op2(pairs))
    same_rows(run(empty), [])


def test_first_occurrences_are_streamed_in_order(nasty):
    lines = line_dedup.line_occurrences(nasty)
    firsts = line_dedup.streamed(lines, slices=1).filter("first")
    assert firsts.count() == lines.select("h1", "h2").distinct().count()
    least = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "version", "pos")).alias("least"))
    assert firsts.join(least, ["h1", "h2"]).filter("struct(doc_id, version, pos) != least").count() == 0


def test_exact_dedup(nasty, pairs, empty):
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    same_rows(exact_dedup.exact_dedup(nasty).select(*columns), brute.op9(pairs))
    same_rows(exact_dedup.exact_dedup(empty).select(*columns), [])


def test_exact_dedup_keeps_one_of_equal_rows(nasty):
    twice = nasty.union(nasty)
    assert exact_dedup.exact_dedup(twice).filter("kept").count() == exact_dedup.exact_dedup(nasty).filter("kept").count()
    kept = exact_dedup.keep_one_copy(twice)
    assert kept.columns == nasty.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, k, *_ in brute.op9([tuple(r) for r in nasty.select("doc_id", "text").collect()]) if d == k)


def test_frequent_digests_take_the_broadcast_way(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    found = exact_dedup.exact_dedup(docs, support=0.01)
    assert found.filter("kept").count() == 2001
    assert found.filter("group_size = 1000 AND keep_id = 0").count() == 1000


@pytest.mark.parametrize("support", [1e-4, 1.0])
def test_suffix_dedup(nasty, pairs, empty, support):
    def run(docs):
        return suffix_dedup.remove_repeats(docs, support=support, bucket=50).select(
            "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)
        )

    same_rows(run(nasty), brute.op5(pairs))
    same_rows(run(empty), [])


def spliced(seed, n, alphabet, piece, pieces):
    """Texts made of shared and own pieces, cut at random."""
    rng = random.Random(seed)
    shared = ["".join(rng.choice(alphabet) for _ in range(piece)) for _ in range(pieces)]
    texts = []
    for _ in range(n):
        parts = [s[rng.randrange(piece // 2) : piece - rng.randrange(piece // 2)] if rng.random() < 0.7 else "".join(rng.choice(alphabet) for _ in range(piece // 2)) for s in rng.choices(shared, k=4)]
        texts.append("".join(parts))
    return texts


def test_suffix_dedup_finds_every_window(spark):
    rows = list(enumerate(spliced(3, 40, "ab cdé", 900, 6)))
    rows += [(100, rows[0][1][:399]), (101, rows[0][1][:400]), (102, rows[1][1]), (103, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute.op5(rows)
    for most in (20_000, 3, 1):  # down to 1 all groups are heavy
        found = suffix_dedup.remove_repeats(docs, bucket=7, most=most)
        same_rows(found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)), expected)


def test_substring_dedup(nasty, pairs, empty):
    def run(docs):
        return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))

    same_rows(run(nasty), brute.op8(pairs))
    same_rows(run(empty), [])


def test_substring_dedup_finds_every_window(spark):
    rng = random.Random(5)
    rows = []
    pool = [[f"ŵ{rng.randrange(40)}" for _ in range(60)] for _ in range(5)]
    for d in range(60):
        words = []
        for _ in range(3):
            part = rng.choice(pool)
            a = rng.randrange(30)
            words += part[a : a + rng.randrange(15, 31)] + [f"ŵ{rng.randrange(40)}" for _ in range(rng.randrange(4))]
        rows.append((rng.randrange(10**6), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute.op8(rows)
    for most in (20_000, 3, 1):
        found = substring_dedup.remove_repeats(docs, most=most)
        same_rows(found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)), expected)


def test_automaton_gives_matching_statistics():
    rng = random.Random(1)
    for _ in range(30):
        known = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(3)]
        query = [rng.randrange(3) for _ in range(40)]
        automaton = substring_dedup.Automaton()
        for words in known:
            automaton.add(words)
        parts = {tuple(w[a:b]) for w in known for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
        expected = [max((n for n in range(1, i + 2) if tuple(query[i + 1 - n : i + 1]) in parts), default=0) for i in range(40)]
        assert list(automaton.statistics(query)) == expected


def test_broadcast_reference(spark):
    docs = spark.createDataFrame([(1, "keep this " + " ".join(f"b{i}" for i in range(25)) + " end"), (2, None)], "doc_id long, text string")
    reference = spark.createDataFrame([(" ".join(f"b{i}" for i in range(30)),)], "text string")
    same_rows(substring_dedup.remove_reference(docs, reference), [(1, 28, 25, "keep this end"), (2, 0, 0, "")])
    with pytest.raises(ValueError):
        substring_dedup.remove_reference(docs, reference, max_words=10)


def test_multikey_order():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, (300, 6)).astype(np.uint64) << np.uint64(8)
    order, shared = suffix_dedup.multikey_order(words)
    rows = [bytes(words[i].astype(">u8").tobytes()) for i in order]
    assert rows == sorted(rows)
    for i in range(1, 300):
        equal = next((k for k in range(48) if rows[i][k] != rows[i - 1][k]), 48)
        assert shared[i] == equal


def test_simhash(nasty, pairs, empty):
    def run(docs):
        return simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")), "component_id")

    same_rows(run(nasty), brute.op7(pairs))
    same_rows(run(empty), [])
    assert simhash.keep_one_of_each(nasty).columns == nasty.columns


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_every_link_joins_its_fingerprints(spark, radius):
    from newsweave.llm.graph import components

    rng = random.Random(radius)
    prints = [rng.getrandbits(64) for _ in range(30)] + [0, 1, 3, 7, 2**63, 2**64 - 1]
    for _ in range(120):
        value = rng.choice(prints)
        for _ in range(rng.randrange(1, radius + 2)):
            value ^= 1 << rng.randrange(64)
        prints.append(value)
    signed = [p - 2**64 if p >> 63 else p for p in set(prints)]
    if radius == 4:
        signed = signed[:60]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    found = {r["node"]: r["root"] for r in components(simhash.close_pairs(frame, radius)).collect()}
    parent = {p: p for p in signed}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {p: found.get(p, p) for p in signed} == {p: root(p) for p in signed}


def test_components_of_a_chain_and_a_star(spark):
    from newsweave.llm.graph import components

    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(200)] + [(5, 5)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    same_rows(found, [(i, 0) for i in range(201)] + [(1000 + i, 1000) for i in range(201)])


def check_packing(rows, texts, window=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for t in texts]
    by_tokens, sequences = {}, {}
    for doc, start, length, crc, total, sequence, offset in rows:
        by_tokens.setdefault(doc, []).append((start, length, crc, total))
        sequences.setdefault(sequence, []).append((offset, length))
    assert len(by_tokens) == len(texts)
    for doc, parts in by_tokens.items():
        at, own = 0, ids[doc]
        for start, length, crc, total in sorted(parts):
            assert (start, total) == (at, len(own)) and brute.crc(own[start : start + length]) == crc
            at += length
        assert at == len(own)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return sum(map(len, ids)) / (window * len(sequences))


def test_packing(spark, pairs, nasty, empty):
    order = {d: i for i, (d, _) in enumerate(pairs)}
    rows = [tuple(r) for r in packing.pack(nasty.coalesce(1), tokenizer_path()).collect()]
    check_packing([(order[r[0]], *r[1:]) for r in rows], [t for _, t in pairs])
    assert packing.pack(empty, tokenizer_path()).count() == 0
    packed = [tuple(r) for r in QUERIES["op1_packing"](spark, SF).collect()]
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    assert check_packing(packed, [texts[i] for i in range(len(texts))]) > 0.99


def test_word_by_word_ids_equal_the_tokenizers(pairs):
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    odd = ["a\x1cb c\x1dd", "it's they're x　y  z", "é ́ x", "<|endoftext|>mid<|startoftext|> a", "ΟΔΟΣ ΟΔΟΣ. ſ K", "﻿​ a​b"]
    for text in odd + [t or "" for _, t in pairs]:
        assert ids.of(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [10, 2049, 3000])
def test_sum_of_squares_leaves_one_short_window(size):
    packer = packing.SumOfSquares(0, open_tokens=20_000)
    rows = []
    for doc in range(200):
        rows += packer.add(doc, np.arange(size + doc % 7, dtype="<u4"))
        assert packer.held <= 20_000 + 8192
    rows += packer.close()
    fill = {}
    for doc, start, length, _, total, sequence, offset in rows:
        fill[sequence] = fill.get(sequence, 0) + length
    assert sum(fill.values()) == sum(size + d % 7 for d in range(200))


def test_sum_of_squares_takes_the_best_level():
    rng = random.Random(4)
    packer = packing.SumOfSquares(0, window=32, open_tokens=10**9)
    levels = [0] * 33
    for doc in range(500):
        size = rng.randrange(1, 31)

        def after(level):
            counts = levels[:]
            counts[level] -= level > 0
            counts[level + size] += level + size < 32
            return sum(c * c for c in counts[1:])

        choices = [h for h in range(33 - size) if h == 0 or levels[h]]
        best = min(map(after, choices))
        list(packer.add(doc, np.zeros(size, "<u4")))
        levels = packer.counts.tolist()
        levels[32] = 0
        assert sum(c * c for c in levels[1:]) == best


def test_mixing(nasty, pairs, empty):
    source = {r["doc_id"]: r["source"] for r in nasty.collect()}
    rows = mixing.taken_words(nasty).collect()
    size = {d: len(brute.words(t)) for d, t in pairs}
    assert {r["doc_id"]: r["size"] for r in rows} == size and len(rows) == len(pairs)
    targets = water(source, size)
    for r in rows:
        assert r["target"] == pytest.approx(targets[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.taken_words(nasty).collect()))
    assert mixing.taken_words(empty).count() == 0


def water(source, size):
    """Targets by sharing again and again until none is above."""
    total = {}
    for d, s in source.items():
        total[s] = total.get(s, 0) + size[d]
    names = sorted(total, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(names)}
    target, open_, left = {s: 0.0 for s in names}, set(names), 1.5 * sum(total.values())
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= 2 * total[s]:
                left += target[s] - 2 * total[s]
                target[s] = 2.0 * total[s]
                open_.discard(s)
    return target


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.taken_words(docs).join(docs.select("doc_id", "source"), "doc_id")
    sums = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    for r in sums:
        assert r["taken"] == pytest.approx(r["target"], rel=0.02)


def test_mixed_documents_hold_the_words_taken(nasty):
    mixed = mixing.mixed_documents(nasty)
    assert mixed.columns == nasty.columns
    got = {r[0]: r[1] for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text")))).collect()}
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(nasty).collect()}
    assert got == {d: n for d, n in taken.items() if n}
    twice = mixing.mixed_documents(nasty.union(nasty))
    assert twice.count() == mixed.count()


def test_slots_walk_through_whole_permutations(nasty):
    sizes = nasty.select("doc_id", "source", mixing.word_count(F.coalesce("text", F.lit(""))).alias("size"), F.lit(0).alias("version"))
    placed, chunks = mixing.place(sizes, mixing.source_targets(sizes), chunk_docs=4)
    slots = mixing.draw_slots(chunks, shard_slots=50)
    uses = slots.groupBy("src", "pass", "block").count()
    assert uses.filter("count > 1").count() == 0
    blocks = {r["src"]: r["n_blocks"] for r in chunks.collect()}
    full = uses.join(slots.filter("pass > 0").select("src").distinct(), "src").filter("pass = 0").groupBy("src").count()
    assert all(r["count"] == blocks[r["src"]] for r in full.collect())


def test_personal_data(nasty, pairs, empty):
    rows = pii.find_personal_data(nasty).select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base")
    same_rows(rows, [(d, *counts(s, brute.KINDS3), brute.spelled(s)) for d, t in pairs for s in [brute.op3(t)]])
    assert pii.find_personal_data(empty).count() == 0


def test_base_personal_data_on_random_texts():
    rng = random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choice("a.@-+1203 4().\n_é²x") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute.op3(text), text
    assert pii.base_spans("1" * 200_000 + "@" * 50_000 + "a" * 200_000) == []


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


@pytest.mark.parametrize(
    "text, added",
    [
        ("call +1 (017) 555-7713 now, again 1 017 555 7713 please", ["1 017 555 7713"]),
        ("mail a.b55@mail9.example.com or a.b55 [at] mail9.example [dot] com", ["a.b55 [at] mail9.example [dot] com"]),
        ("card 4111 1111 1111 1111 and then 4111.1111.1111.1111", ["4111.1111.1111.1111"]),
        ("call +1 (017) 555-7713 about order 88273645 of 2024-01-02", []),
        ("orders 88273645 and 88273645, nothing else", []),
    ],
)
def test_repeats_take_the_label_of_what_they_repeat(field, text, added):
    base = pii.base_spans(text)
    assert [text[a:b] for _, a, b in pii.added_spans(text, base, field)] == added


def test_message_passing_is_exact_on_a_chain(field):
    from itertools import product

    found = [pii.Mention(i * 20, i * 20 + 10, 0, t, ) for i, t in enumerate(["555 010 99", "12345678", "a@b"])]
    links = np.array([(0, 1, 0), (1, 2, 2)])
    unary = np.stack([pii.features(m.text) for m in found]) @ field.unary.T
    total = np.zeros((3, pii.N_LABELS))
    for y in product(range(pii.N_LABELS), repeat=3):
        weight = np.exp(sum(unary[i, y[i]] for i in range(3)) + field.pairs[0, y[0], y[1]] + field.pairs[2, y[1], y[2]])
        for i in range(3):
            total[i, y[i]] += weight
    assert np.allclose(field.probabilities(found, links), total / total.sum(axis=1, keepdims=True), atol=1e-2)


def test_secrets(nasty, pairs, empty):
    found = secrets.find_secrets(nasty)
    same_rows(found.select("doc_id", secrets.spelled(F.array_sort("base"))), [(d, brute.spelled(brute.op4(t))) for d, t in pairs])
    assert secrets.find_secrets(empty).count() == 0


def test_base_secrets_on_random_texts(spark):
    rng = random.Random(8)
    parts = ["password", "TOKEN", "api_key", "apikey", "Secret", "passwd", " = ", ":", "=", '"', "'", " ", "AKIA", "AKIAAKIA", "ABCDEFGH1234567", "deadbeef01234567", "0123456789abcdef0", "x", "é", "abcdefghijkl", "/+", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(1500)]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    same_rows(found.select("doc_id", secrets.spelled(F.array_sort("base"))), [(d, brute.spelled(brute.op4(t))) for d, t in rows])


def test_entropy_adds_random_strings_and_spares_the_allowed(spark):
    rng = random.Random(9)
    random_string = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    rows = [
        (1, f"key material {random_string} end", True),
        (2, "averyverylongwordwithoutanydigitsinit", False),
        (3, "123e4567-e89b-12d3-a456-426614174000", False),
        (4, "path/to/some/module-name/version-12", False),
        (5, "sha256-" + random_string, False),
        (6, "12345678901234567890123456789", False),
        (7, "a1a1a1a1a1a1a1a1a1a1a1a1a1a1", False),
        (8, "EXAMPLE" + random_string, False),
    ]
    found = secrets.find_secrets(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    got = {r[0]: r[1] for r in found.select("doc_id", secrets.counted(F.col("found"), "entropy")).collect()}
    assert got == {d: int(hit) for d, _, hit in rows}


def test_window_entropy_equals_counting(spark):
    from collections import Counter
    from math import log2

    rng = random.Random(10)
    rows = [("".join(rng.choice("ab1Z%_é") for _ in range(rng.randrange(15, 60))),) for _ in range(60)]

    def entropy(text):
        return max((-sum(c / 20 * log2(c / 20) for c in Counter(text[i : i + 20]).values()) for i in range(len(text) - 19)), default=0.0)

    for text, value in spark.createDataFrame(rows, "s string").select("s", secrets.window_entropy(F.col("s"))).collect():
        assert value == pytest.approx(entropy(text), abs=1e-9)


def test_quality(nasty, pairs, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rated = quality.quality_rules(nasty, labels)
    same_rows(rated.select(*columns), [(d, *brute.op10(t)) for d, t in pairs])
    assert rated.filter("kept = base_failed").count() == 0
    assert quality.quality_rules(empty, labels.limit(0)).count() == 0
    assert quality.keep_good(nasty, labels.limit(0)).columns == nasty.columns


@pytest.mark.parametrize("k, n, p", [(0, 1, 0.5), (0, 3000, 0.01), (3, 1000, 0.01), (40, 5000, 0.01), (10, 10, 0.3), (900, 100_000, 0.01)])
def test_binomial_tail(spark, k, n, p):
    from math import exp, lgamma, log

    expected = sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log(1 - p)) for j in range(k + 1))
    row = spark.createDataFrame([(k, n)], "k long, n long").select(quality.binomial_tail(F.col("k"), F.col("n"), p).alias("p")).first()
    assert row["p"] == pytest.approx(expected, rel=1e-6)


def test_cut_offs_need_evidence(spark):
    """Symbols tell good from bad in a large stratum; a small one and a useless rule give no cut-off."""
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(i, body + ("".join(f" #{j}$" for j in range(60)) if i % 5 == 0 else ""), "en" if i < 5000 else "xx") for i in range(5100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("quality"))
    rated = quality.quality_rules(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    got = {(r[0], r[1]): r[2] for r in rated.groupBy("lang", "quality").agg(F.min("kept")).collect()}
    assert got == {("en", 1): True, ("en", 0): False, ("xx", 1): True, ("xx", 0): True}


def test_a_null_stratum_counts_in_the_correction(spark):
    """Good rows rejected in the only stratum: one more stratum, null or not, halves what its tests may spend."""
    measure = [("rule", "CAST(x AS DOUBLE)", [5.0])]
    rows = [(i, "en", 9 if i < 3 else 1, False) for i in range(900)] + [(1000 + i, "en", 9, False) for i in range(20)]
    other = lambda name: [(2000 + i, name, 1, False) for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(900)] + [(1000 + i, 0) for i in range(20)] + [(2000 + i, 1) for i in range(10)], "doc_id long, quality int")
    schema = "doc_id long, stratum string, x int, base_failed boolean"
    tail = spark.range(1).select(quality.binomial_tail(F.lit(3).cast("long"), F.lit(900).cast("long"), 0.01).alias("p")).first()["p"]

    def cut(more, delta):
        stats = spark.createDataFrame(rows + more, schema)
        return quality.choose_thresholds(stats, labels, 0.01, delta, 1.0, measure).count()

    assert cut([], tail * 1.5) == 1
    assert cut(other("de"), tail * 1.5) == cut(other(None), tail * 1.5) == 0
    assert cut(other("de"), tail * 2.5) == cut(other(None), tail * 2.5) == 1


@pytest.mark.parametrize("sf, name", [(SF, n) for n in sorted(CHECKS)] + [("/root/testdata/sf0.1", "op10_quality_rules")])
def test_query_equals_its_sql(spark, sf, name):
    import parity

    found = parity.spark_rows(QUERIES[name](spark, sf))
    assert found == parity.duck_rows(parity.connect(sf), CHECKS[name])


def test_rows_without_id_are_told_apart_by_more_than_32_bits(spark):
    shared = " ".join(f"w{i}" for i in range(200))
    first, second = f"p013117 {shared}", f"p265384 {shared}"  # equal in Spark's 32-bit hash
    rows = [(7, first), (None, first), (None, second)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert docs.filter("doc_id IS NULL").select(F.hash(F.lit(True), "text")).distinct().count() == 1
    loops = [(i, t) for i, (_, t) in enumerate(rows)]
    found = suffix_dedup.remove_repeats(docs).select("n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    same_rows(found, [r[1:] for r in brute.op5(loops)])
    found = substring_dedup.remove_repeats(docs).select("n_words", "n_removed", F.sha2("kept", 256))
    same_rows(found, [r[1:] for r in brute.op8(loops)])


def test_late_repeats_take_the_label_of_the_only_base_match(field):
    filler = " and some words that stand between the numbers of this text, sixty places at the least,"
    text = "call +1 (017) 555-7713" + (filler + " 1 017 555 7713") * 80
    base = pii.base_spans(text)
    assert len(base) == 1
    added = pii.added_spans(text, base, field)
    assert len(added) == 80 and all(kind == "phone" for kind, _, _ in added)
    late = text.replace("+1 (017) 555-7713", "1 017 555 7713") + filler + " +1 (017) 555-7713"
    assert len(pii.added_spans(late, pii.base_spans(late), field)) == 81


def test_links_reach_a_base_match_and_stay_linear():
    found = [pii.Mention(i * 100, i * 100 + 14, 4 * (i == 30), "1 017 555 7713") for i in range(60)]
    assert sorted(map(tuple, pii.edges(found).tolist())) == sorted((30, j, 1) for j in range(60) if j != 30)


def test_messages_pass_to_the_end_of_a_long_path():
    pairs = np.zeros((pii.N_TYPES, pii.N_LABELS, pii.N_LABELS))
    pairs[0] = 12 * np.eye(pii.N_LABELS)
    field = pii.Field(np.zeros((pii.N_LABELS, pii.N_FEATURES)), pairs)
    found = [pii.Mention(i * 20, i * 20 + 10, 4 * (i == 0), f"{12345678 + 1000 * i}") for i in range(200)]
    links = np.array([(i, i + 1, 0) for i in range(199)])
    assert field.probabilities(found, links)[-1, 4] > 0.98


@pytest.mark.parametrize("times", [1, 2])
def test_the_field_decides_without_a_base_match_too(field, times):
    address = "a.b55 [at] mail9.example [dot] com"
    text = " and ".join([address] * times)
    assert pii.base_spans(text) == []
    assert [text[a:b] for _, a, b in pii.added_spans(text, [], field)] == [address] * times
    assert pii.added_spans("order 88273645", [], field) == []


def test_buckets_end_between_grams_that_share_their_first_bytes(monkeypatch):
    import pandas as pd

    sizes = []
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda before, after, *_: sizes.append(len(after)) or np.zeros((1, len(after)), bool))
    after = [b"-" * 64 + f"{i // 2:0400d}".encode()[::-1][:336] for i in range(100)]
    frame = pd.DataFrame({"lead": [a[:32] for a in after], "id_key": 1, "version": 1, "place": range(100), "before": b"", "after": after})
    list(suffix_dedup._sorted_buckets(400, 128, 10)(frame.iloc[i : i + 5] for i in range(0, 100, 5)))
    assert sum(sizes) == 100 and max(sizes) <= 15


def test_one_near_copy_stays_without_ids_and_with_shared_ones(spark):
    long = " ".join(f"w{i}" for i in range(400))
    spaced, other = long.replace(" ", "  "), " ".join(f"x{i}" for i in range(400))
    rows = [(None, long), (None, long.upper()), (None, spaced), (5, other), (5, long + "\n"), (3, other + " "), (3, "own text"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in simhash.keep_one_of_each(docs).collect()]
    assert sorted(found, key=repr) == sorted([(5, long + "\n"), (3, other + " "), (3, "own text"), (None, "alone")], key=repr)
    assert simhash.keep_one_of_each(docs.union(docs)).count() == 4

"""Whitening, conversation repair and SentencePiece against plain loops and the libraries themselves."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from newsweave.llm import conversations, pieces, whitening
from newsweave.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- whitening ------------------------------------------------------------------------------


def steps_of(vectors):
    return np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000


def check_whitening(rows, ids, vectors, components=32):
    """Rows of one length of vector against doubles."""
    x = steps_of(vectors)
    n, dim = x.shape
    k = min(components, dim)
    sums = x.sum(axis=0)
    centred = (n * x - sums) / n
    covariance = centred.T @ centred / n
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted((i, c) for i in ids for c in range(1, k + 1))
    deviations = dict(zip(ids, ((n * x - sums) ** 2).sum(axis=1).tolist()))
    assert all(r["n"] == n and r["deviation"] == deviations[r["vec_id"]] for r in rows)
    at = {i: place for place, i in enumerate(ids)}
    got = np.empty((n, k))
    for r in rows:
        got[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(covariance)) - 1) < 1e-9
    want = centred @ directions / np.sqrt(values)
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-8
    measured = np.abs(got.T @ got / n - np.outer(got.mean(0), got.mean(0)) - np.eye(k)).max()
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and abs(rows[0]["identity_error"] - measured) < 1e-9
    assert rows[0]["identity_error"] < 1e-4


def test_whitening_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = QUERIES["op11_whitening"](spark, SF).collect()
    check_whitening(rows, [r["vec_id"] for r in table], [r["embedding"] for r in table])


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for rows, low, high in ((1, 0, 1), (64, -3, 5), (130, -(2**40), 2**41), (70, 2**61, 2**62), (65, 7, 8)):
        x = rng.integers(low, high, (rows, 5))
        sums, cross = whitening.plane_products(x)
        wide = [[int(v) for v in row] for row in x]
        assert sums == [sum(row[i] for row in wide) for i in range(5)]
        assert all(cross[i, j] == sum(row[i] * row[j] for row in wide) for i in range(5) for j in range(5))


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [[float(v) for v in rng.normal(0, 2, 6)] for _ in range(40)]
    good += [good[0]] * 3  # repeated vectors
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [])]
    short = [(800 + i, [float(i), float(i * i % 7)]) for i in range(9)]
    rows = list(enumerate(good)) + odd + short
    table = spark.createDataFrame([(i, v, 3, 4, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, component int, v string")
    found = whitening.whiten(table.repartition(3)).collect()
    check_whitening([r for r in found if r["vec_id"] < 800], list(range(len(good))), good)
    check_whitening([r for r in found if r["vec_id"] >= 800], [i for i, _ in short], [v for _, v in short])
    assert whitening.whiten(table.limit(0)).count() == 0
    two = whitening.whiten(table.filter("vec_id < 40"), components=2)
    assert two.count() == 80


def test_whitening_without_variance(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 3.0])], "vec_id long, embedding array<float>")
    rows = whitening.whiten(table).orderBy("vec_id", "component").collect()
    assert [(r["vec_id"], r["component"], r["deviation"]) for r in rows] == [(None, 1, 4096), (None, 2, 4096), (1, 1, 4096), (1, 2, 4096)]
    assert [abs(r["whitened"]) if r["whitened"] is not None else None for r in rows] == [1.0, None, 1.0, None]
    assert [r["explained"] for r in rows] == [1.0, 0.0, 1.0, 0.0]
    alone = whitening.whiten(table.limit(1)).collect()
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in alone} == {(None, 0.0, None, 0)}


def test_values_past_a_double_stay_exact(spark):
    big = 2.0**50
    table = spark.createDataFrame([(1, [big, 0.0]), (2, [-big, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(table).filter("component = 1").collect()
    assert all(r["deviation"] is None or r["deviation"] < 2**63 for r in rows) and {r["n"] for r in rows} == {3}


# --- conversations ----------------------------------------------------------------------------


def cheapest(rows):
    """Least (cost, audit, turns) over all edits, from the end."""

    @lru_cache(None)
    def go(at, place, inserted):
        found = []
        if at == len(rows) and place in (conversations.START, conversations.PAIR):
            found.append((0, "", ()))
        if inserted < 4:
            for name in ("user", "assistant"):
                after = conversations.STEPS.get((place, name[0]))
                if after is not None:
                    rest = go(at, after, inserted + 1)
                    if rest:
                        found.append((rest[0] + 3, "I" + rest[1], (f"{name}:", *rest[2])))
        if at < len(rows):
            role, text, fault = rows[at]
            rest = go(at + 1, place, 0)
            found.append((rest[0] + 4, "D" + rest[1], rest[2]))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                for letter, name, cost in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    after = conversations.STEPS.get((place, name[:1]))
                    if after is not None:
                        rest = go(at + 1, after, 0)
                        found.append((rest[0] + cost + extra, letter + rest[1], (f"{name}:{text}", *rest[2])))
        return min(found) if found else (10**9, "", ())

    return go(0, conversations.START, 0)


def reports(rows):
    """The contract in loops: (conv_id, turn, role, text) rows to reports."""
    kept = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        kept[conv] += [] if kind == 0 else [row, row] if kind == 3 else [row]
    out = []
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faulty = set(), []
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, lines = cheapest(tuple(faulty))
        count = lambda kind: sum(f == kind for _, _, f in faulty)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"),
                    count("truncated"), illegal, cost, audit, sha("\n".join(lines))))
    return out


def by_text(rows):
    return sorted(map(str, rows))


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op12_conversation_repair"](spark, SF).collect()
    assert by_text(tuple(r) for r in found) == by_text(reports(rows))


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(4)
    rows = []
    for conv in [None, -3, *range(60)]:
        for turn in range(rng.randrange(0, 14)):
            role = rng.choice(["user", "assistant", "system", "tool", "", "admin", "user", "assistant", None])
            text = rng.choice(["yes.", "no", "", "  \n", None, "so?!", "same.", "é…", "long " * 50 + "."])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None, 5]), role, text))
    rows += [(7, 3, "user", "same."), (7, 3, "user", "same.")]
    return spark.createDataFrame([(*r, 1, "z", True) for r in rows], "conv_id long, turn long, role string, text string, kind int, fault string, copy boolean")


def test_repair_of_odd_rows(spark, turns, monkeypatch):
    rows = [tuple(r)[:4] for r in turns.collect()]
    found = conversations.repair(conversations.damaged(turns.repartition(5)))
    assert by_text(tuple(r) for r in found.collect()) == by_text(reports(rows))
    assert conversations.repair(conversations.damaged(turns.limit(0))).count() == 0


def test_repaired_turns_give_the_hash(spark, turns):
    rows = conversations.damaged(turns)
    found = conversations.repair(rows)
    told = conversations.repaired_turns(rows.filter("here").drop("here"), found)
    line = F.struct("position", F.concat_ws(":", "role", "text").alias("line"))
    texts = told.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    hashed = texts.select("conv_id", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("h"))
    expected = {r["conv_id"]: r["repaired_sha256"] for r in found.collect()}
    got = {r["conv_id"]: r["h"] for r in hashed.collect()}
    assert {c: got.get(c, sha("")) for c in expected} == expected


@pytest.mark.parametrize("modulus, cut", [(conversations.MODULUS, 1024), (5, 1024), (conversations.MODULUS, 3), (7, 5)])
def test_audits_are_least_also_when_hashes_collide(monkeypatch, modulus, cut):
    monkeypatch.setattr(conversations, "MODULUS", modulus)
    monkeypatch.setattr(conversations, "CUT", cut)
    rng = random.Random(modulus + cut)
    for _ in range(400):
        rows = tuple(
            (rng.choice(["user", "assistant", "system", "tool", ""]), f"t{rng.randrange(9)}", rng.choice([None, None, "truncated", "blank", "duplicate"]))
            for _ in range(rng.randrange(16))
        )
        repair = conversations.Repair()
        for row in rows:
            repair.add(*row)
        cost, audit, lines = cheapest(rows)
        assert repair.close() == (cost, audit, sha("\n".join(lines)))


def test_a_long_conversation_holds_little(monkeypatch):
    repair = conversations.Repair()
    for i in range(20_000):
        repair.add("user" if i % 2 == 0 else "assistant", f"turn {i}.", None)
        assert max(w.edits.depth for w in repair.places.values()) <= conversations.CUT + 8
    assert repair.close()[:2] == (0, "K" * 20_000)


# --- pieces -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model(path):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def encoded(model, text):
    ids = model.encode(text or "") + [model.eos_id()]
    return ids, model.decode(ids)


def test_pieces_query(spark, model):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for doc, text in rows:
        ids, decoded = encoded(model, text)
        expected.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    same_rows(QUERIES["op13_sentencepiece"](spark, SF), expected)


def test_chunks_are_independent(path, model):
    own = pieces.chunker(path)
    assert own.cuts
    rng = random.Random(8)
    parts = [" ", "\n", "a", "the", "▁", "  ", "\t", "é", "\U0001f600", " word", "\n\n", "ing", "\x00", "<s>", "</s>", "<0x0A>", "中", ".", " \n", "　", "ﬁ"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        chunks = own.split(text)
        ids = own.encode(chunks) if chunks else []
        assert [i for part in ids for i in part] == model.encode(text)


@pytest.mark.parametrize("most", [1 << 20, 5, 0])
def test_pieces_of_odd_rows(spark, nasty, path, model, most):
    more = [(None, "a b"), (None, "a b"), (None, "a  b\nc "), (2, " "), (2, "\n"), (4, "▁▁ q"), (5, "中文 字\t\x00 end\n\n"), (6, "x" * 30_000 + " y"), (6, "x" * 30_000 + " y")]
    extra = spark.createDataFrame([(d, t, 1, "c", []) for d, t in more], "doc_id long, text string, same int, code string, rare array<string>")
    rows = nasty.select("doc_id", "text", F.lit(1).alias("same"), F.lit("c").alias("code"), F.array().cast("array<string>").alias("rare")).unionByName(extra)
    found = [(r["doc_id"], list(r["ids"]), r["decoded"]) for r in pieces.encode(rows, path, most).collect()]
    assert by_text(found) == by_text((r["doc_id"], *encoded(model, r["text"])) for r in rows.collect())
    assert pieces.encode(rows.limit(0), path, most).count() == 0


def test_the_frequent_part_is_bounded(spark, path):
    texts = spark.createDataFrame([(f"w{i % 40} common {'z' * 80}",) for i in range(400)], "text string")
    table = pieces.frequent_chunks(texts.repartition(3), path, 12)
    assert 0 < table.count() <= 12
    assert {"common"} < {r["chunk"] for r in pieces.frequent_chunks(texts, path, 100).collect()}
    assert table.filter("length(chunk) > 64").count() == 0


def test_a_model_whose_pieces_cross_spaces_takes_whole_texts(path, model, monkeypatch):
    own = pieces.Chunker(path)
    own.cuts = False
    text = "one two  three\nfour"
    assert own.split(text) == [text] and own.split("") == []
    assert own.encode([text]) == [model.encode(text)] and own.decode([model.encode(text)]) == [text]

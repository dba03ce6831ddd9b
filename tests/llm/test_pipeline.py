"""The pipeline's stages, each on what the one before it kept."""

import brute
import pytest

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def rows(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, rows(docs)
    names = [name for name, _ in corpus_pipeline.STAGES]
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(at)))
        docs = spark.read.parquet(str(tmp_path / str(at)))
        if at == 0:
            expected = [(d, t) for d, t in seen if not brute.op10(t)[-1]]  # too few labels here for more
        elif at == 1:
            kept = {d for d, keep, *_ in brute.op9(seen) if d == keep}
            expected = [(d, t) for d, t in seen if d in kept]
        elif at == 2:
            kept = {d for d, _, least in brute.op7(seen) if d == least}
            expected = [(d, t) for d, t in seen if d in kept]
        elif at == 3:
            now, sizes = rows(docs), {d: len(brute.words(t)) for d, t in seen}
            assert {d for d, _ in now} <= set(sizes)
            for d in sizes:
                assert sum(len(brute.words(t)) for e, t in now if e == d) <= 2 * sizes[d]
            total = sum(len(brute.words(t)) for _, t in now)
            assert total == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)
            expected = now
        else:
            pieces = [tuple(r) for r in docs.collect()]
            assert sum(p[2] for p in pieces if p[1] + p[2] <= p[4]) > 0
            assert sum(p[1] == 0 for p in pieces) == len(seen)
            break
        assert docs.columns == columns, name
        seen = rows(docs)
        assert sorted(seen) == sorted(expected), name
    assert len(names) == 5


def test_registered():
    assert "pipeline" in entry.queries()
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.LLM_QUERIES if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14))


def test_a_table_without_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name

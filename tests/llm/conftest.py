import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(6000))
PASSAGE = "the quick brown fox number " + " ".join(f"p{i}q{i * 7 % 31}" for i in range(120))
DOCS = [
    (1, "Alpha beta\nGamma  delta\n\nalpha BETA ", "en", "s1"),
    (2, None, "en", None),
    (3, "", None, "s1"),
    (4, "   \n\t", "de", "s2"),
    (5, LONG, "en", "s1"),
    (6, LONG, "en", "s2"),
    (7, LONG + " tail", "fr", "s3"),
    (8, PASSAGE + " one two three", "en", "s1"),
    (9, "intro words here " + PASSAGE, "en", "s1"),
    (10, "été ÉTÉ Ünï code space \U0001f600 \x1c\x1d ctl", "fr", "sé"),
    (11, "a" * 3000, "en", "s1"),
    (12, "x y " * 700, "en", "s4"),
    (13, "same\n" * 12, "en", "s1"),
    (14, "Alpha  beta\nGammadelta\nalphaBETA", "en", "s1"),
    (15, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" mail a.b@c.example.com 10.0.0.1 4111 1111 1111 1111", "en", "s5"),
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Rows with nulls, empty, long, repeated and odd texts, and columns named like the operators' own."""
    rows = [(d, t, la, s, len(t) if t else None, 7, "x", True) for d, t, la, s in DOCS]
    rows += [(20 + i, f"Common  Line\nown {i}\nlicense HERE", "en", "s1", 9, None, None, None) for i in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, digest string, kept boolean"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def pairs(nasty):
    return [(r["doc_id"], r["text"]) for r in nasty.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.limit(0)


def same_rows(frame, expected):
    got = sorted(tuple(r) for r in frame.collect())
    assert got == sorted(expected)

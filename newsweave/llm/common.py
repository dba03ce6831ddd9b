"""Helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The six characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; the slower exact form only where other letters occur."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The runs of characters that aren't spaces."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition under which nulls are equal."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def packed(docs: DataFrame, **derived: Column) -> DataFrame:
    """All columns of a table in one column ``row``, beside derived ones whose names then can't clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in derived.items()])

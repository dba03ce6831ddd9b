"""Helpers for composing Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used.

    Plain Columns are copied wherever they appear; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), lambda bound: use(bound)), F.lit(0))

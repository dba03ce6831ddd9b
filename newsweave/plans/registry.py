"""Query registry: name, Spark plan and, where SQL can say it, the checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsweave.plans.corpus import Corpus
from newsweave.plans.views import VIEWS

PLANS: dict[str, Callable[[Corpus], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    """Register a plan; ``sql`` may use the derived views by name."""

    def add(build: Callable[[Corpus], DataFrame]):
        PLANS[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add


def with_views(sql: str) -> str:
    """Prefix a statement with the definitions of the derived views it uses."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS (\n{VIEWS[name].strip()}\n)" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return PLANS[name](Corpus(spark, sf_dir))

    return run


def checks() -> dict[str, str]:
    """Checking SQL of every plan, complete with the views it needs."""
    return {name: with_views(sql) for name, sql in CHECKS.items()}

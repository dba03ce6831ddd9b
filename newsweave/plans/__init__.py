"""Registered queries over the shared tables, with the SQL each one is checked against."""

from newsweave.plans import (  # noqa: F401
    editorial_plans,
    ingest_plans,
    source_plans,
    streaming_plans,
    text_plans,
    topic_plans,
)
from newsweave.plans.registry import PLANS, checks, runner

__all__ = ["PLANS", "checks", "runner"]

"""Source dimension and editorial rules from JSON configuration files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsweave import schemas as S
from newsweave.operators.lifecycle import upsert


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """One row per configured source, defaults filled in; unknown keys are ignored."""
    raw = spark.read.schema(S.SOURCES_CONFIG).json(path, multiLine=True)
    source = raw.select(F.explode("sources").alias("s")).select("s.*")
    none = F.array().cast("array<string>")
    return source.select(
        "id",
        "name",
        "homepage",
        "angle",
        "enabled",
        F.coalesce("feeds", none).alias("feeds"),
        F.coalesce("newsSitemaps", none).alias("news_sitemaps"),
        "scrape",
        F.coalesce("notes", F.lit("")).alias("notes"),
    )


def read_defaults(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SOURCES_CONFIG).json(path, multiLine=True).select("defaults.*")


def active_sources(sources: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Enabled sources that have any channel to read, optionally limited to some ids."""
    has_channel = (
        (F.size("feeds") > 0) | (F.size("news_sitemaps") > 0) | F.col("scrape").isNotNull()
    )
    active = sources.filter(F.col("enabled") & has_channel)
    return active.filter(F.col("id").isin(*only)) if only else active


def read_editorial(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.EDITORIAL_CONFIG).json(path, multiLine=True)


def duplicate_ids(sources: DataFrame) -> DataFrame:
    return sources.groupBy("id").count().filter("count > 1")


def sync_sources(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """Stored sources with name, angle, homepage and enabled taken from the configuration.

    What the breaker keeps about a source stays as it is.
    """
    return upsert(stored, configured, ["id"], ["name", "angle", "homepage", "enabled"])

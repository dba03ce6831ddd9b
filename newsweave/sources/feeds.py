"""Fetched feed documents (RSS 2.0, RDF, Atom) to feed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsweave.functions import text as X

_ITEM = (
    "ARRAY<STRUCT<title: STRING, link: STRING, "
    "guid: STRUCT<_VALUE: STRING, _isPermaLink: STRING>, pubDate: STRING, "
    "`dc:date`: STRING, description: STRING>>"
)
RSS = f"channel STRUCT<title: STRING, item: {_ITEM}>"
RDF = f"channel STRUCT<title: STRING>, item {_ITEM}"
_TEXT = "STRUCT<_VALUE: STRING, _type: STRING>"
ATOM = (
    f"title {_TEXT}, entry ARRAY<STRUCT<title: {_TEXT}, "
    "link: ARRAY<STRUCT<_rel: STRING, _href: STRING>>, published: STRING, updated: STRING, "
    f"summary: {_TEXT}, content: {_TEXT}>>"
)


def looks_like_feed(body: Column, content_type: Column) -> Column:
    head = F.lower(F.ltrim(F.left(body, F.lit(1000))))
    is_page = head.startswith("<!doctype html") | head.startswith("<html")
    has_root = body.rlike(r"(?i)<(rss|feed|rdf:rdf)[\s>]")
    declared = F.lower(F.coalesce(content_type, F.lit(""))).contains("xml")
    return ~is_page & (has_root | (declared & F.ltrim(body).startswith("<")))


def feed_kind(body: Column) -> Column:
    root = F.lower(F.regexp_extract(body, r"(?i)<(rss|feed|rdf:rdf)[\s>]", 1))
    return (
        F.when(root == "rss", "rss").when(root == "rdf:rdf", "rdf").when(root == "feed", "atom")
    )


def _blank_to_null(value: Column) -> Column:
    text = F.trim(value)
    return F.when(text != "", text)


def _rss_item(item: Column) -> Column:
    # A guid stands in for the link only when it is written with its attribute.
    guid = F.when(item["guid"]["_isPermaLink"].isNotNull(), item["guid"]["_VALUE"])
    return F.struct(
        F.coalesce(_blank_to_null(item["title"]), F.lit("")).alias("title"),
        F.coalesce(_blank_to_null(item["link"]), _blank_to_null(guid)).alias("link"),
        F.coalesce(_blank_to_null(item["pubDate"]), _blank_to_null(item["dc:date"])).alias(
            "published"
        ),
        _blank_to_null(item["description"]).alias("summary"),
    )


def _atom_entry(entry: Column) -> Column:
    links = entry["link"]
    alternate = F.filter(links, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    chosen = F.coalesce(F.get(alternate, F.lit(0)), F.get(links, F.lit(0)))
    return F.struct(
        F.coalesce(_blank_to_null(entry["title"]["_VALUE"]), F.lit("")).alias("title"),
        _blank_to_null(chosen["_href"]).alias("link"),
        F.coalesce(_blank_to_null(entry["published"]), _blank_to_null(entry["updated"])).alias(
            "published"
        ),
        F.coalesce(
            _blank_to_null(entry["summary"]["_VALUE"]), _blank_to_null(entry["content"]["_VALUE"])
        ).alias("summary"),
    )


def parse_feeds(documents: DataFrame) -> DataFrame:
    """Documents(url, body, content_type) plus kind, feed_title and items.

    Documents that are no readable feed are dropped. Every kind is parsed by
    its own expression in one pass over the table.
    """
    feeds = documents.filter(looks_like_feed(F.col("body"), F.col("content_type"))).withColumn(
        "kind", feed_kind(F.col("body"))
    )
    permissive = {"mode": "PERMISSIVE"}
    only = lambda kind: F.when(F.col("kind") == kind, F.col("body"))
    parsed = (
        feeds.withColumn("_rss", F.from_xml(only("rss"), RSS, permissive))
        .withColumn("_rdf", F.from_xml(only("rdf"), RDF, permissive))
        .withColumn("_atom", F.from_xml(only("atom"), ATOM, permissive))
    )
    items = F.coalesce(
        F.transform(F.col("_rss.channel.item"), _rss_item),
        F.transform(F.col("_rdf.item"), _rss_item),
        F.transform(F.col("_atom.entry"), _atom_entry),
    )
    title = F.coalesce(
        F.col("_rss.channel.title"), F.col("_rdf.channel.title"), F.col("_atom.title._VALUE")
    )
    return (
        parsed.withColumn("feed_title", _blank_to_null(title))
        .withColumn("items", items)
        .filter(F.col("items").isNotNull() | F.col("feed_title").isNotNull())
        .drop("_rss", "_rdf", "_atom", "body", "content_type")
    )


def feed_items(documents: DataFrame) -> DataFrame:
    """One row per feed item, ready for the ingest chain."""
    keys = [c for c in documents.columns if c not in ("body", "content_type")]
    return (
        parse_feeds(documents)
        .select(*keys, "kind", F.posexplode("items").alias("position", "item"))
        .select(
            *keys,
            "kind",
            "position",
            X.strip_html(F.col("item.title")).alias("title"),
            F.col("item.link").alias("link"),
            F.col("item.published").alias("published"),
            X.strip_html(F.col("item.summary")).alias("summary"),
        )
    )

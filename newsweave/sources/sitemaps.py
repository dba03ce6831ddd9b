"""Fetched sitemap documents to article addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsweave.functions import text as X

URLSET = (
    "url ARRAY<STRUCT<loc: STRING, lastmod: STRING, "
    "`news:news`: STRUCT<`news:title`: STRING, `news:publication_date`: STRING>>>"
)
INDEX = "sitemap ARRAY<STRUCT<loc: STRING, lastmod: STRING>>"


def looks_like_sitemap(body: Column) -> Column:
    return body.rlike(r"(?i)<(urlset|sitemapindex)[\s>]")


def sitemap_kind(body: Column) -> Column:
    root = F.lower(F.regexp_extract(body, r"(?i)<(urlset|sitemapindex)[\s>]", 1))
    return F.when(root == "urlset", "urlset").when(root == "sitemapindex", "index")


def sitemap_entries(documents: DataFrame) -> DataFrame:
    """Documents(url, body) to entries: kind, position, loc, last_modified, title, published."""
    keys = [c for c in documents.columns if c != "body"]
    known = documents.filter(looks_like_sitemap(F.col("body"))).withColumn(
        "kind", sitemap_kind(F.col("body"))
    )
    news = lambda e: e["news:news"]
    urlset = F.from_xml(F.when(F.col("kind") == "urlset", F.col("body")), URLSET)
    index = F.from_xml(F.when(F.col("kind") == "index", F.col("body")), INDEX)
    parsed = known.withColumn("_urlset", urlset).withColumn("_index", index)
    entries = F.coalesce(
        F.transform(
            F.col("_urlset.url"),
            lambda e: F.struct(
                F.trim(e["loc"]).alias("loc"),
                F.trim(e["lastmod"]).alias("last_modified"),
                F.trim(news(e)["news:title"]).alias("title"),
                F.trim(F.coalesce(news(e)["news:publication_date"], e["lastmod"])).alias(
                    "published"
                ),
            ),
        ),
        F.transform(
            F.col("_index.sitemap"),
            lambda e: F.struct(
                F.trim(e["loc"]).alias("loc"),
                F.trim(e["lastmod"]).alias("last_modified"),
                F.lit(None).cast("string").alias("title"),
                F.trim(e["lastmod"]).alias("published"),
            ),
        ),
    )
    return (
        parsed.select(*keys, "kind", F.posexplode(entries).alias("position", "entry"))
        .select(*keys, "kind", "position", "entry.*")
        .filter(X.first_present([F.col("loc")]).isNotNull())
    )


def expand_indexes(documents: DataFrame, children_per_index: int = 2) -> DataFrame:
    """Entries of the news-like children of sitemap indexes, plus those of plain sitemaps.

    The children are looked up in the same table of fetched documents. A document that an
    index lists is never a plain sitemap, also when it is not among the children to read.
    """
    entries = sitemap_entries(documents)
    urlset = entries.filter("kind = 'urlset'")
    order = Window.partitionBy("url").orderBy("position")
    indexed = entries.filter("kind = 'index'")
    children = (
        indexed
        .filter(F.col("loc").rlike("(?i)news|vesti|latest|stories"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= children_per_index)
        .select(F.col("url").alias("index_url"), F.col("loc").alias("url"))
    )
    listed = indexed.select(F.col("loc").alias("url")).distinct()
    direct = urlset.join(listed, "url", "left_anti").withColumn("index_url", F.lit(None).cast("string"))
    nested = urlset.join(children, "url")
    return direct.unionByName(nested)

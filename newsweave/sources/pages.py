"""Article and listing pages: extraction, link harvest and section statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsweave import params as P
from newsweave.functions import html as H, text as X, urls as U
from newsweave.functions.core import let


def extract_articles(
    pages: DataFrame, now: Column, containers: Sequence[str] = H.CONTAINERS
) -> DataFrame:
    """Pages(url, html, ...) to article fields.

    The main element of the page is tried first, then the linked-data body,
    then the known containers; the first with enough words is the text.
    """
    html, url = F.col("html"), F.col("url")
    staged = pages.withColumn("_meta", H.meta_tags(html)).withColumn("_nodes", H.jsonld_nodes(html))
    metas, nodes = F.col("_meta"), F.col("_nodes")
    meta = lambda *names: H.meta_content(metas, names)
    chosen = H.choose_text(
        [
            (X.clean_body(H.block_text(H.container_block(html, "article"))), "readability"),
            (X.clean_body(H.article_body(nodes)), "jsonld"),
            (X.clean_body(H.container_text(html, containers)), "container"),
        ]
    )
    published = F.coalesce(
        meta(
            "article:published_time", "og:article:published_time", "datePublished", "pubdate"
        ),
        H.linked_date(nodes),
        H.time_element(html),
        F.date_format(H.visible_publish_date(html, now), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    )
    return (
        staged.withColumn("_chosen", chosen)
        .withColumn(
            "title",
            X.clean_title(F.coalesce(meta("og:title", "twitter:title"), H.page_title(html))),
        )
        .withColumn("excerpt", meta("og:description", "description", "twitter:description"))
        .withColumn("author", meta("article:author", "author", "og:article:author"))
        .withColumn("image_url", U.resolve(meta("og:image", "twitter:image"), url))
        .withColumn("language", H.page_language(html))
        .withColumn("published", published)
        .withColumn("canonical_url", H.canonical_link(html, url))
        .withColumn("text", F.col("_chosen.text"))
        .withColumn("method", F.col("_chosen.method"))
        .drop("_meta", "_nodes", "_chosen", "html")
    )


def harvest_links(listings: DataFrame, rules: DataFrame) -> DataFrame:
    """Article links of listing pages within each source's crawl budget: source_id, position, link, title.

    Listings(source_id, listing_id, url, html) are read in order of listing_id. Rules(source_id,
    homepage, link_pattern, link_class, max_links) say which paths are articles, which class
    links must carry (null: any) and how many links of all its listings a source may take. Links
    must stay on the site of the homepage or of the listing. Each listing is cut to the budget
    inside its row, so a source brings at most that many links per listing to its window.

    Links are read out of the markup before the rules are joined, so no markup travels, and once: the
    outer explode keeps Spark from pushing a test for empty lists, with all that makes them, below the
    join. Titles are cleaned for the links that are left.
    """
    linked = F.filter(
        F.transform(
            H.anchor_tags(F.col("html")),
            lambda a: F.struct(U.canonical_url(a["href"], F.col("url")).alias("link"), a["inside"], a["classes"]),
        ),
        lambda a: a["link"].isNotNull(),
    )
    placed = F.transform(
        linked,
        lambda a: F.struct(
            a["link"], a["inside"], a["classes"], U.path(a["link"]).alias("path"), U.root_domain(a["link"]).alias("domain")
        ),
    )
    read = listings.select("source_id", "listing_id", U.root_domain(F.col("url")).alias("_here"), placed.alias("_links"))
    joined = read.join(rules.withColumn("_home", U.root_domain(F.col("homepage"))), "source_id")
    matching = F.filter(
        "_links",
        lambda a: F.rlike(a["path"], F.col("link_pattern"))
        & (F.col("link_class").isNull() | F.array_contains(F.split(a["classes"], r"\s+"), F.col("link_class")))
        & (a["domain"] != "")
        & ((a["domain"] == F.col("_home")) | (a["domain"] == F.col("_here"))),
    )
    # Sorted by link, the first of each run is the link's first place in the page.
    by_link = F.sort_array(F.transform(matching, lambda a, i: F.struct(a["link"], i.alias("i"), a["inside"])))
    first = let(by_link, lambda s: F.filter(s, lambda a, k: (k == 0) | (F.get(s, k - 1)["link"] != a["link"])))
    in_page = F.sort_array(F.transform(first, lambda a: F.struct(a["i"], a["link"], a["inside"])))
    offered = joined.select(
        "source_id", "listing_id", "max_links", F.posexplode_outer(F.slice(in_page, F.lit(1), F.col("max_links"))).alias("_at", "a")
    ).filter(F.col("a").isNotNull())
    order = F.struct("listing_id", "_at")
    links = offered.groupBy("source_id", F.col("a.link").alias("link")).agg(
        F.min_by("a.inside", order).alias("inside"), F.min(order).alias("_order"), F.first("max_links").alias("max_links")
    )
    by_source = Window.partitionBy("source_id").orderBy("_order")
    ranked = links.withColumn("position", F.row_number().over(by_source) - 1)
    return ranked.filter("position < max_links").select("source_id", "position", "link", X.strip_html(F.col("inside")).alias("title"))


def section_statistics(
    links: DataFrame, key: str, limit: int = 6, ignored: Sequence[str] = P.IGNORED_SEGMENTS
) -> DataFrame:
    """Links(key, position, link) to the most frequent first path segments per key."""
    parts = U.path_segments(F.col("link"))
    counted = (
        links.withColumn("segment", F.get(parts, F.lit(0)))
        .filter(F.size(parts) >= 2)
        .filter(~F.lower("segment").isin(*ignored))
        .groupBy(key, "segment")
        .agg(F.count("*").alias("n_links"), F.min_by("link", "position").alias("sample"))
    )
    order = Window.partitionBy(key).orderBy(F.desc("n_links"), "segment")
    return (
        counted.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
    )

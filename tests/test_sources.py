"""Feed, sitemap and configuration documents."""

import json

import pytest
from pyspark.sql import functions as F

from newsweave.sources import config, feeds, pages, sitemaps

HOST = "https://harbour-gazette.example"
RSS = f"""<rss version="2.0"><channel><title>Harbour Gazette</title>
<item><title>Ferry timetable without a link of its own</title><guid>{HOST}/x/77</guid></item>
<item><guid isPermaLink="true">{HOST}/x/78</guid><title>Crane repaired</title></item>
<item><description><![CDATA[<i>Nets</i> &amp; lines]]></description><link> {HOST}/x/79 </link><title>Catch &lt;b&gt;doubles&lt;/b&gt;</title><pubDate>Tue, 03 Mar 2026 06:15:00 GMT</pubDate></item>
</channel></rss>"""
ATOM = f"""<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom">
<entry><link href="{HOST}/e/10"/><title>Tide tables</title><content type="html">Twice a day</content><published>2026-02-11T05:00:00Z</published></entry>
<entry><title>Lighthouse</title><link rel="self" href="{HOST}/e/11.atom"/><link rel="alternate" href="{HOST}/e/11"/><summary>New lamp</summary><updated>2026-02-12T21:30:00Z</updated></entry>
<title type="text">Gazette entries</title></feed>"""
RDF = f"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel><title>Gazette archive</title></channel><item><dc:date>2026-01-20T12:00:00Z</dc:date><link>{HOST}/old/3</link><title>Storm of the year</title></item></rdf:RDF>"""
URLSET = f"""<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9">
<url><lastmod>2026-03-01</lastmod></url><url><loc>{HOST}/s/5</loc><lastmod>2026-03-02</lastmod></url>
<url><news:news><news:title>Pilot strike</news:title><news:publication_date>2026-03-03T10:10:00Z</news:publication_date></news:news><lastmod>2026-03-04</lastmod><loc>{HOST}/s/6</loc></url></urlset>"""
INDEX = f"""<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">
<sitemap><loc>{HOST}/latest-b.xml</loc></sitemap><sitemap><loc>{HOST}/about.xml</loc></sitemap>
<sitemap><loc>{HOST}/stories-2026.xml</loc></sitemap><sitemap><loc>{HOST}/news-archive.xml</loc></sitemap></sitemapindex>"""


def documents(spark, rows):
    return spark.createDataFrame(rows, "url STRING, body STRING, content_type STRING")


def test_feeds_of_all_kinds(spark):
    frame = documents(
        spark,
        [
            ("page", "<!doctype html><html><feed ></feed></html>", "text/html"), ("rdf", RDF, None),
            ("cut", "<rss><channel><title>half", "application/xml"), ("rss", RSS, "text/xml"),
            ("atom", ATOM, "application/atom+xml"), ("late", "<!--" + "x" * 9000 + "-->" + RSS, None),
        ],
    )
    parsed = {r["url"]: r for r in feeds.parse_feeds(frame).collect()}
    assert {u: r["kind"] for u, r in parsed.items() if u != "cut"} == {"rss": "rss", "atom": "atom", "rdf": "rdf", "late": "rss"}
    assert parsed["rss"]["feed_title"] == "Harbour Gazette" and parsed["atom"]["feed_title"] == "Gazette entries"
    rows = feeds.feed_items(frame).filter("url <> 'late'").orderBy("url", "position").collect()
    # A guid counts as link only when written with its attribute.
    assert [(r["url"], (r["link"] or "").removeprefix(HOST)) for r in rows] == [
        ("atom", "/e/10"), ("atom", "/e/11"), ("rdf", "/old/3"), ("rss", ""), ("rss", "/x/78"), ("rss", "/x/79")]
    last = rows[-1]
    assert last["title"] == "Catch doubles" and last["summary"] == "Nets & lines"
    assert [r["published"] for r in rows][:3] == ["2026-02-11T05:00:00Z", "2026-02-12T21:30:00Z", "2026-01-20T12:00:00Z"]


def test_sitemap_entries(spark):
    frame = spark.createDataFrame([("late", "<!--" + "y" * 9000 + "-->" + URLSET), ("u", URLSET), ("x", "<html></html>")], "url STRING, body STRING")
    rows = sitemaps.sitemap_entries(frame).orderBy("url", "position").collect()
    assert [(r["url"], r["loc"].removeprefix(HOST), r["title"], r["published"]) for r in rows] == [
        (u, *e) for u in ("late", "u") for e in (("/s/5", None, "2026-03-02"), ("/s/6", "Pilot strike", "2026-03-03T10:10:00Z"))]


def test_sitemap_index_follows_two_news_children(spark):
    names = ["latest-b", "about", "stories-2026", "news-archive", "unlisted"]
    frame = spark.createDataFrame(
        [(f"{HOST}/root.xml", INDEX)] + [(f"{HOST}/{n}.xml", URLSET.replace("/s/", f"/{n}/")) for n in names],
        "url STRING, body STRING",
    )
    rows = sitemaps.expand_indexes(frame).collect()
    assert {(r["url"].removeprefix(HOST), r["index_url"] is not None) for r in rows} == {
        ("/latest-b.xml", True), ("/stories-2026.xml", True), ("/unlisted.xml", False)}


def test_sources_config(spark, tmp_path):
    path = tmp_path / "sources.json"
    path.write_text(
        json.dumps(
            {
                "version": 1, "_comment": "x",
                "defaults": {"maxConsecutiveFailures": 3, "disableAfterFailuresHours": 6},
                "sources": [
                    {"id": "a", "name": "A", "homepage": "https://a.rs", "angle": "agencija", "enabled": True, "feeds": ["https://a.rs/feed"]},
                    {"id": "b", "name": "B", "homepage": "https://b.rs", "angle": "kriticki", "enabled": True, "feeds": []},
                    {"id": "c", "name": "C", "homepage": "https://c.rs", "angle": "kriticki", "enabled": False, "feeds": ["x"]},
                    {"id": "d", "name": "D", "homepage": "https://d.rs", "angle": "mejnstrim", "enabled": True, "feeds": [],
                     "scrape": {"listingUrls": ["https://d.rs/"], "linkPattern": "^/vest", "maxLinksPerRun": 10}},
                ],
            },
            indent=1,
        )
    )
    sources = config.read_sources(spark, str(path))
    rows = {r["id"]: r for r in sources.collect()}
    assert rows["a"]["news_sitemaps"] == [] and rows["a"]["notes"] == ""
    assert sorted(r["id"] for r in config.active_sources(sources).collect()) == ["a", "d"]
    assert [r["id"] for r in config.active_sources(sources, ["d"]).collect()] == ["d"]
    assert config.duplicate_ids(sources.union(sources)).count() == 4
    assert config.read_defaults(spark, str(path)).first()["maxConsecutiveFailures"] == 3


RULES = "source_id STRING, homepage STRING, link_pattern STRING, link_class STRING, max_links INT"


@pytest.mark.parametrize("cap, expected", [(1, ["/vest/1"]), (2, ["/vest/1", "/vest/2"]), (9, ["/vest/1", "/vest/2", "/vest/3"])])
def test_harvest_links(spark, cap, expected):
    first = "<a href='/vest/1?utm_source=x'>Jedan <b>dva</b></a><a href=\"/o-nama\">b</a><a class=x href=/vest/1>c</a><a href='https://www.d.example/vest/2#k'>d</a>"
    second = "<a href=/vest/2>opet</a><a href=https://tudje.example/vest/9>x</a><a href=/vest/3>tri</a>"
    frame = spark.createDataFrame([("d", 2, "https://d.example/b", second), ("d", 1, "https://d.example/", first)],
                                  "source_id STRING, listing_id INT, url STRING, html STRING")
    rules = spark.createDataFrame([("d", "https://d.example/", "^/vest", None, cap)], RULES)
    rows = pages.harvest_links(frame, rules).orderBy("position").collect()
    assert [r["link"].removeprefix("https://d.example") for r in rows] == expected
    assert rows[0]["title"] == "Jedan dva"


def test_harvest_links_by_class_and_rule(spark):
    html = "<a class='big card' href=/a/1>1</a><a href=/a/2>2</a><a class=card href=/b/3>3</a>"
    frame = spark.createDataFrame([(s, 1, f"https://{s}.example/", html) for s in "pq"], "source_id STRING, listing_id INT, url STRING, html STRING")
    rules = spark.createDataFrame([("p", "https://p.example/", "^/a", "card", 5), ("q", "https://q.example/", "^/b", None, 5)], RULES)
    got = sorted((r["source_id"], r["link"]) for r in pages.harvest_links(frame, rules).collect())
    assert got == [("p", "https://p.example/a/1"), ("q", "https://q.example/b/3")]


def test_links_are_read_out_of_the_markup_once(spark):
    html = "".join(f"<a class=c href=/vest/{i % 40}>Naslov {i} &amp; <b>{i}</b></A>" for i in range(90)) + "<a href=/vest/kraj>kraj"
    frame = spark.createDataFrame([("d", 1, "https://d.example/", html)], "source_id STRING, listing_id INT, url STRING, html STRING")
    rules = spark.createDataFrame([("d", "https://d.example/", "^/vest", None, 50)], RULES)
    links = pages.harvest_links(frame, rules)
    assert links._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    rows = [(r["link"], r["title"]) for r in links.orderBy("position").collect()]
    expected = [(f"https://d.example/vest/{i}", f"Naslov {i} & {i}") for i in range(40)]
    assert rows == [*expected, ("https://d.example/vest/kraj", "kraj")]


def test_section_statistics(spark):
    links = spark.createDataFrame(
        [("s", i, u) for i, u in enumerate(
            ["https://d.rs/sport/1", "https://d.rs/sport/2", "https://d.rs/tag/x", "https://d.rs/kultura/1", "https://d.rs/kontakt"])],
        "source STRING, position INT, link STRING",
    )
    rows = pages.section_statistics(links, "source").orderBy("rank").collect()
    assert [(r["segment"], r["n_links"], r["sample"]) for r in rows] == [
        ("sport", 2, "https://d.rs/sport/1"), ("kultura", 1, "https://d.rs/kultura/1")]


def test_blank_title_and_link_become_empty_and_null(spark):
    body = "<rss><channel><title> </title><item><title> </title><link> </link></item></channel></rss>"
    row = feeds.feed_items(documents(spark, [("u", body, "text/xml")])).select("title", "link").first()
    assert row["title"] == "" and row["link"] is None
    assert F is not None

"""Reading article pages with column expressions: links, meta tags, JSON-LD and body text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsweave import params as P
from newsweave.functions import text as X, times as T, urls as U
from newsweave.functions.core import let

# Known article containers of common publishing systems, in order of trust (fixed values).
CONTAINERS = (
    'itemprop="articleBody"',
    "div.post-content",
    "div.entry-content",
    "div.article-body",
    "div.article__body",
    "div.single-content",
    "div.news-text",
    "div.text-content",
    "article .content",
)
# --- fixed values: article types and date keys of linked data ---
ARTICLE_TYPES = "(?i)((News|Blog|Report|Live)?Article|VideoObject)"
DATE_KEYS = ("datePublished", "dateCreated", "uploadDate", "dateModified")
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _unquote(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, """^["']|["']$""", ""))


def attribute(tag: Column, name: str) -> Column:
    found = _unquote(F.regexp_extract(tag, rf"(?i)[\s\"']{name}{_VALUE}", 1))
    return F.nullif(found, F.lit(""))


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))


def anchor_tags(html: Column) -> Column:
    """Links of the page in page order: struct(href, classes, inside), the last being the markup they enclose."""
    opening = r"<a\b[^>]*>"
    whole = F.regexp_extract_all(html, F.lit(rf"(?is){opening}.*?(?=</a>|<a\b|$)"), F.lit(0))
    found = F.transform(
        F.transform(
            whole,
            lambda x: F.struct(F.regexp_extract(x, rf"(?is)^{opening}", 0).alias("tag"), x.alias("whole")),
        ),
        lambda x: F.struct(
            attribute(x["tag"], "href").alias("href"),
            F.coalesce(attribute(x["tag"], "class"), F.lit("")).alias("classes"),
            F.substring(x["whole"], F.length(x["tag"]) + 1, F.length(x["whole"])).alias("inside"),
        ),
    )
    return F.filter(found, lambda a: a["href"].isNotNull())


def anchors(html: Column) -> Column:
    """Links of the page in page order: struct(href, classes, title)."""
    return F.transform(
        anchor_tags(html), lambda a: F.struct(a["href"], a["classes"], X.strip_html(a["inside"]).alias("title"))
    )


def feed_links(html: Column, base: Column) -> Column:
    """Absolute addresses of the feeds a page announces."""

    def announced(tag: Column) -> Column:
        kind = F.lower(F.coalesce(attribute(tag, "type"), F.lit("")))
        rel = F.lower(F.coalesce(attribute(tag, "rel"), F.lit("")))
        return kind.rlike("rss|atom|rdf") & rel.contains("alternate")

    links = F.transform(
        F.filter(tags(html, "link"), announced),
        lambda t: F.regexp_replace(U.resolve(attribute(t, "href"), base), "#.*$", ""),
    )
    return F.array_distinct(F.filter(links, lambda u: u.isNotNull()))


def meta_tags(html: Column) -> Column:
    return F.transform(
        tags(html, "meta"),
        lambda t: F.struct(
            attribute(t, "property").alias("property"),
            attribute(t, "name").alias("name"),
            attribute(t, "itemprop").alias("itemprop"),
            attribute(t, "content").alias("content"),
        ),
    )


def meta_content(metas: Column, names: Sequence[str]) -> Column:
    """Content of the first name that has one, looked up as property, name and itemprop."""

    def named(kind: str, name: str) -> Column:
        return F.get(F.filter(metas, lambda m: m[kind] == name), F.lit(0))

    def content(name: str) -> Column:
        tag = F.coalesce(*[named(k, name) for k in ("property", "name", "itemprop")])
        return let(tag["content"], lambda v: F.when(F.trim(v) != "", X.strip_html(v)))

    return F.coalesce(*[content(n) for n in names])


def jsonld_scripts(html: Column) -> Column:
    pattern = r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def _as_list(value: Column) -> Column:
    """A JSON array as its elements, any other value as one element."""
    none = F.array().cast("array<variant>")
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(items, F.when(value.isNotNull(), F.array(value)), none)


def _graph_of(node: Column) -> Column:
    return F.flatten(
        F.transform(_as_list(F.try_variant_get(node, '$["@graph"]', "variant")), _as_list)
    )


def jsonld_nodes(html: Column) -> Column:
    """All linked-data nodes of a page: lists flattened, each node followed by the nodes of its graph.

    A page is opened one level a step, as many steps as it spells a graph. The expression is of one
    size, whatever the pages hold, and a deeply nested page costs only its own row.
    """
    nodes = F.flatten(
        F.transform(jsonld_scripts(html), lambda s: _as_list(F.try_parse_json(s)))
    )
    nodes = F.flatten(F.transform(nodes, _as_list))
    entry = lambda node, closed: F.struct(node.alias("node"), F.lit(closed).alias("closed"))

    def opened(s: Column) -> Column:
        inner = F.transform(_graph_of(s["node"]), lambda n: entry(n, False))
        return F.when(s["closed"], F.array(s)).otherwise(F.concat(F.array(entry(s["node"], True)), inner))

    depth = F.regexp_count(html, F.lit('"@graph"'))
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    found = F.aggregate(
        steps,
        F.transform(nodes, lambda n: entry(n, False)),
        lambda acc, _: F.flatten(F.transform(acc, opened)),
    )
    return F.transform(found, lambda s: s["node"])


def _text_of(node: Column, key: str) -> Column:
    value = F.try_variant_get(node, f'$["{key}"]', "string")
    return let(value, lambda v: F.when(F.trim(v) != "", v))


def article_body(nodes: Column) -> Column:
    """Body text of the first article node that carries one."""

    def is_article(node: Column) -> Column:
        kinds = _as_list(F.try_variant_get(node, '$["@type"]', "variant"))
        return F.exists(
            kinds, lambda k: F.coalesce(F.try_variant_get(k, "$", "string"), F.lit("")).rlike(
                ARTICLE_TYPES
            )
        )

    bodies = F.transform(F.filter(nodes, is_article), lambda n: _text_of(n, "articleBody"))
    found = F.get(F.filter(bodies, lambda b: b.isNotNull()), F.lit(0))
    return F.coalesce(X.strip_html(found), F.lit(""))


def linked_date(nodes: Column) -> Column:
    dates = F.transform(
        nodes, lambda n: F.trim(F.coalesce(*[_text_of(n, key) for key in DATE_KEYS]))
    )
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


_BLOCK = "(?:p|h2|h3|li)"


def block_text(block: Column) -> Column:
    """Paragraphs, subheadings and list entries of a block, without captions and side boxes."""
    for tag in ("figure", "figcaption", "aside", "nav", "footer", "script", "style"):
        block = F.regexp_replace(block, rf"(?is)<{tag}[ >].*?</{tag}>", " ")
    block = F.regexp_replace(
        block, r'(?is)<div[^>]*class="(?:[^"]* )?(?:related|banner)(?: [^"]*)?"[^>]*>.*?</div>', " "
    )
    marked = F.regexp_replace(block, rf"(?i)<{_BLOCK}(?: [^>]*)?>", "\u0002")
    marked = F.regexp_replace(marked, rf"(?i)</{_BLOCK}>", "\u0003")
    parts = F.regexp_extract_all(marked, F.lit("\u0002([^\u0002\u0003]*)"), F.lit(1))
    clean = F.transform(parts, X.strip_html)
    return F.array_join(F.filter(clean, lambda p: F.length(p) > 1), " ")


def _opening(selector: str) -> str:
    if selector.startswith("itemprop"):
        return rf"<[^>]*{selector}[^>]*>"
    outer, _, inner = selector.rpartition(" ")
    tag, _, name = inner.partition(".")
    own = rf'<{tag or "[a-z0-9]+"}' + (
        rf'\b[^>]*class="(?:[^"]* )?{name}(?: [^"]*)?"[^>]*>' if name else r"(?: [^>]*)?>"
    )
    return rf"<{outer}[ >].*?{own}" if outer else own


def _until_closed(rest: Column, name: Column) -> Column:
    """Markup up to the tag that closes an element of this name, counting those opened inside it."""
    tag = F.concat(F.lit("(?i)</?"), name, F.lit(r"(?=[\s/>])[^>]*>"))
    marks, gaps = F.regexp_extract_all(rest, tag, F.lit(0)), F.split(rest, tag, -1)
    steps = F.transform(
        marks,
        lambda m, i: F.struct(
            F.length(F.get(gaps, i)).alias("gap"),
            F.length(m).alias("size"),
            F.when(m.startswith("</"), -1).otherwise(1).alias("turn"),
        ),
    )
    end = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end")),
        lambda acc, s: F.struct(
            (acc["depth"] + s["turn"]).alias("depth"),
            (acc["at"] + s["gap"] + s["size"]).alias("at"),
            F.when((acc["end"] < 0) & (acc["depth"] + s["turn"] < 0), acc["at"] + s["gap"])
            .otherwise(acc["end"])
            .alias("end"),
        ),
        lambda acc: acc["end"],
    )
    return let(end, lambda e: F.when(e >= 0, F.left(rest, e)).otherwise(rest))


def container_block(html: Column, selector: str) -> Column:
    """Markup inside the first element that the selector names, up to its own end."""
    opening = rf"(?is)({_opening(selector)})(.*)$"
    # Most pages use none of the known containers: a plain search settles that.
    hint = selector.rpartition(".")[2].rpartition("=")[2].strip('"')
    name = F.regexp_extract(F.regexp_extract(html, opening, 1), r"(?is)<([a-z0-9]+)[^<]*$", 1)
    rest = F.regexp_extract(html, opening, 2)
    inside = F.when(name == "", F.lit("")).otherwise(_until_closed(rest, name))
    return F.when(html.contains(hint), inside).otherwise("")


def container_text(html: Column, containers: Sequence[str] = CONTAINERS) -> Column:
    """Text of the first known container that holds enough words."""
    found = F.lit("")
    for selector in reversed(containers):
        found = _long_enough_or(block_text(container_block(html, selector)), found)
    return found


def _long_enough_or(text: Column, otherwise: Column) -> Column:
    enough = lambda t: X.count_words(t) >= P.MIN_ARTICLE_WORDS
    return let(text, lambda t: F.when(enough(t), t).otherwise(otherwise))


def choose_text(candidates: Sequence[tuple[Column, str]]) -> Column:
    """Struct(text, method): the first candidate with enough words, else the longest, else none."""
    options = F.array(
        *[F.struct(t.alias("text"), F.lit(m).alias("method")) for t, m in candidates]
    )
    nothing = F.struct(F.lit("").alias("text"), F.lit("none").alias("method"))

    def choose(found: Column) -> Column:
        enough = F.filter(found, lambda o: X.count_words(o["text"]) >= P.MIN_ARTICLE_WORDS)
        longest = F.aggregate(
            found,
            nothing,
            lambda best, o: F.when(F.length(o["text"]) > F.length(best["text"]), o).otherwise(best),
        )
        return F.coalesce(F.get(enough, F.lit(0)), longest)

    return let(options, choose)


def page_title(html: Column) -> Column:
    found = X.strip_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.nullif(found, F.lit(""))


def page_language(html: Column) -> Column:
    tag = F.get(tags(html, "html"), F.lit(0))
    return F.left(attribute(tag, "lang"), F.lit(5))


def canonical_link(html: Column, url: Column) -> Column:
    tag = F.get(
        F.filter(
            tags(html, "link"),
            lambda t: F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))) == "canonical",
        ),
        F.lit(0),
    )
    return U.resolve(attribute(tag, "href"), url)


def visible_text(html: Column) -> Column:
    return X.strip_html(html)


def visible_publish_date(html: Column, now: Column) -> Column:
    """Date printed on the page, for sites without machine-readable dates."""
    return T.visible_date(visible_text(html), now)


def time_element(html: Column) -> Column:
    found = F.transform(tags(html, "time"), lambda t: attribute(t, "datetime"))
    return F.get(F.filter(found, lambda d: d.isNotNull()), F.lit(0))

"""URL canonicalisation and site comparison as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsweave.functions.core import let

# Query parameters that only say where the visitor came from (fixed values).
TRACKING = (
    r"(?i)^(utm_|fbclid$|gclid$|gbraid$|wbraid$|yclid$|msclkid$|igshid$|mc_|_ga$|ref$"
    r"|ref_src$|source$|src$)"
)

# scheme, authority, path, query
_PARTS = r"^(?i:(https?):)//([^/?#]*)([^?#]*)(\?[^#]*)?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    """Host and non-default port, lower case, without user info or ``www.``."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, _PARTS, 2), "^.*@", ""))
    default_port = F.when(scheme(url) == "http", F.lit(":80$")).otherwise(F.lit(":443$"))
    return F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), default_port, "")


def host(url: Column) -> Column:
    return F.regexp_replace(authority(url), ":[0-9]*$", "")


def path(url: Column) -> Column:
    raw = F.regexp_extract(url, _PARTS, 3)
    return F.when(raw == "", F.lit("/")).otherwise(raw)


def resolve(link: Column, base: Column) -> Column:
    """Absolute form of ``link`` seen on page ``base``; null unless it is http(s)."""
    protocol = F.regexp_extract(base, r"^((?i:https?):)", 1)
    site = F.regexp_extract(base, r"^((?i:https?)://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^((?i:https?)://[^?#]*)", 1)
    # The page's folder: an address without a path ends in its host.
    folder = F.concat(site, F.regexp_extract(path(base), "^(.*/)", 1))

    def absolute(ref: Column) -> Column:
        return (
            F.when(ref.rlike("^(?i:https?)://"), ref)
            .when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(ref.startswith("//"), F.concat(protocol, ref))
            .when(ref.startswith("/"), F.concat(site, ref))
            .when((ref == "") | ref.rlike("^[?#]"), F.concat(page, ref))
            .otherwise(F.concat(folder, ref))
        )

    return let(let(F.trim(link), absolute), _usable)


def _usable(url: Column) -> Column:
    return F.when(url.rlike("^(?i:https?)://[^/?#]"), _without_dots(url))


def _without_dots(url: Column) -> Column:
    """Resolve ``.`` and ``..`` path segments."""
    raw = F.regexp_extract(url, _PARTS, 3)

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", done)
            .when(segment == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
            .otherwise(F.concat(done, F.array(segment)))
        )

    clean = F.array_join(F.aggregate(F.split(raw, "/"), F.array().cast("array<string>"), step), "/")
    rest = F.regexp_extract(url, r"^(?i:https?)://[^?#]*(.*)$", 1)
    before = F.regexp_extract(url, r"^((?i:https?)://[^/?#]*)", 1)
    return F.when(raw.rlike(r"/[.]{1,2}(/|$)"), F.concat(before, clean, rest)).otherwise(url)


def canonical_query(url: Column) -> Column:
    """Query without tracking parameters, sorted by name; empty when nothing is left."""
    raw = F.regexp_replace(F.regexp_extract(url, _PARTS, 4), "^[?]", "")
    pairs = F.filter(F.split(raw, "&"), lambda p: p != "")
    named = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.regexp_extract(p, "^([^=]*)", 1).alias("name"),
            i.alias("at"),
            F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("pair"),
        ),
    )
    kept = F.array_sort(F.filter(named, lambda s: ~s["name"].rlike(TRACKING)))
    joined = F.array_join(F.transform(kept, lambda s: s["pair"]), "&")
    return F.regexp_replace(joined, "^(?=.)", "?")


def canonical_url(link: Column, base: Column | None = None) -> Column:
    """One spelling per article address; null when the address is unusable."""

    def spell(url: Column) -> Column:
        bare_path = F.regexp_replace(F.regexp_extract(url, _PARTS, 3), "/+$", "")
        canonical = F.concat(
            scheme(url), F.lit("://"), authority(url), F.regexp_replace(bare_path, "^$", "/"),
            canonical_query(url),
        )
        valid = authority(url).rlike(r"^[^ :<>\[\]\\^|%]+(:[0-9]+)?$")
        return F.when(valid, canonical)

    return let(let(F.trim(link), _usable) if base is None else resolve(link, base), spell)


def url_fingerprint(canonical: Column) -> Column:
    return F.sha2(F.lower(canonical), 256)


def root_domain(url: Column) -> Column:
    """Last two labels of the host (also for two-level public suffixes)."""
    return F.substring_index(host(url), ".", -2)


def same_site(link: Column, homepage: Column, channel: Column) -> Column:
    """A link belongs to a source if it shares the homepage's or the channel's domain."""
    mine = root_domain(link)
    return (mine != "") & ((mine == root_domain(homepage)) | (mine == root_domain(channel)))


def path_segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def path_depth(url: Column) -> Column:
    return F.size(path_segments(url))


def is_comment_feed(url: Column) -> Column:
    return url.rlike("(?i)/comments/feed|comments-feed|/feed/comments")

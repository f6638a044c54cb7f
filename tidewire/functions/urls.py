"""URL functions over columns. Invalid URLs keep the value or give null, as each function says."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Query parameters that only track.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src")


def part(url: Column, what: str, key: str | None = None) -> Column:
    return F.try_parse_url(url, F.lit(what), F.lit(key)) if key else F.try_parse_url(url, F.lit(what))


def valid(url: Column) -> Column:
    return F.coalesce(part(url, "PROTOCOL").isNotNull(), F.lit(False))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", "")


def normalize(url: Column) -> Column:
    """The key under which an article is known: no query or fragment, one trailing slash dropped, lower case.

    Video hosts keep their `v` and `t` parameters and their case; one broadcaster's articles and videos get their
    canonical address. Invalid URLs stay as they are.
    """
    host = F.lower(part(url, "HOST"))
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    path = F.when(path == "", F.lit("/")).otherwise(path)
    origin = F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), F.lower(part(url, "AUTHORITY")))
    v, t = F.nullif(part(url, "QUERY", "v"), F.lit("")), F.nullif(part(url, "QUERY", "t"), F.lit(""))
    pairs = F.array_join(F.filter(F.array(F.concat(F.lit("v="), v), F.concat(F.lit("t="), t)), lambda x: x.isNotNull()), "&")
    fragment = part(url, "REF")
    video = F.concat(origin, path, F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise(F.lit("")), F.when(fragment.isNotNull(), F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))
    kind = F.regexp_extract(path, "/(articles|videos)/[^/]+", 1)
    slug = F.regexp_extract(path, "/(?:articles|videos)/([^/]+)", 1)
    plain = F.lower(F.regexp_replace(F.concat(origin, path), "/$", ""))
    return (
        F.when(~valid(url) | host.isNull(), url)
        .when(host.contains("youtube.com") | host.contains("youtu.be"), video)
        .when(host.contains("bbc.com") & (slug != ""), F.concat(F.lit("https://www.bbc.com/news/"), kind, F.lit("/"), slug))
        .otherwise(plain)
    )


def canonicalize(url: Column) -> Column:
    """The key under which a feed is known: bare host, no fragment or tracking parameters, the rest sorted; null
    for anything but http and https."""
    url = F.trim(url)
    scheme = F.lower(part(url, "PROTOCOL"))
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    path = F.when(path == "", F.lit("/")).when(path != "/", F.regexp_replace(path, "/$", "")).otherwise(path)
    query = F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&")
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(query, lambda p: (p != "") & ~name(p).rlike("(?i)^utm_") & ~name(p).isin(*TRACKING))
    named = F.array_sort(F.transform(kept, lambda p, i: F.struct(name(p).alias("name"), i.alias("at"), p.alias("pair"))))
    pairs = F.array_join(F.transform(named, lambda x: x["pair"]), "&")
    authority = F.regexp_replace(F.lower(part(url, "AUTHORITY")), r"^www\.", "")
    out = F.concat(scheme, F.lit("://"), authority, path, F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise(F.lit("")))
    return F.when(scheme.isin("http", "https") & part(url, "HOST").isNotNull(), out)


def video_id(url: Column) -> Column:
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    short = F.nullif(F.substring(path, F.lit(2), F.length(path)), F.lit(""))
    inner = F.nullif(F.regexp_extract(path, r"^/(?:shorts|live|embed)/([A-Za-z0-9_-]+)", 1), F.lit(""))
    return F.when(F.lower(part(url, "HOST")) == "youtu.be", short).otherwise(F.coalesce(F.nullif(part(url, "QUERY", "v"), F.lit("")), inner))


def source_type(declared: Column, url: Column) -> Column:
    """1 news, 2 video, 3 research: the declared name if known, else what the URL says."""
    named = F.when(F.lower(declared) == "news", 1).when(F.lower(declared) == "video", 2).when(F.lower(declared) == "research", 3)
    told = F.when(url.contains("youtube.com/feeds/videos.xml"), 2).when(url.contains("arxiv.org/rss/"), 3).otherwise(1)
    return F.coalesce(named, told).cast("short")


def html_image(html: Column) -> Column:
    """The first picture of a page: an img source, else the og:image."""
    image = F.regexp_extract(html, r"""(?i)<img[^>]+src=["']?([^"'\s>]+)""", 1)
    graph = F.regexp_extract(html, r"""(?i)<meta[^>]+property=["']og:image["'][^>]+content=["']?([^"'\s>]+)""", 1)
    return F.coalesce(F.nullif(image, F.lit("")), F.nullif(graph, F.lit("")))


# Fixed value: paths that are no photographs.
NOT_A_PHOTO = r"(?i)\.(mp4|webm|mov|m3u8|gif|svg)$|(^|[/_-])(icon|logo|avatar|favicon|sprite|pixel)s?([/_.-]|$)"


def picture(url: Column) -> Column:
    """A picture a page may show: http(s) only, no video, vector, icon or logo paths, upgraded to https; else null."""
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    fit = F.lower(part(url, "PROTOCOL")).isin("http", "https") & ~path.rlike(NOT_A_PHOTO)
    return F.when(fit, F.regexp_replace(url, "^(?i)http:", "https:"))


# Fixed value: how addresses of feeds end.
FEED_PATH = r"(?i)/(feed|rss|atom)(/|\.xml|\.atom|\.rss)?$|/(?:feed|atom|rss)\.xml$|\.rss$|\.atom$"


def feed_like(url: Column) -> Column:
    return url.rlike(FEED_PATH)

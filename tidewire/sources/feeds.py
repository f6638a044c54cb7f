"""Feed lists, feed files and HTTP polling: lists and items as DataFrames, polling as a Python data source."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewire.config import DEFAULTS, Settings
from tidewire.functions import text, urls, values
from tidewire.schemas import FEED_ENTRY
from tidewire.storage import materialise


def feed_list(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Feeds of JSON lists whose entries are addresses or objects (one file a row, in `value`).

    A list that is no array, and an entry without an address, is an error.
    """
    entries = F.from_json("value", "array<string>")
    listed = raw.select(F.posexplode(F.when(entries.isNotNull(), entries).otherwise(F.raise_error(F.lit("a feed list must be an array")))).alias("at", "entry"))
    entry = F.from_json("entry", FEED_ENTRY)
    plain = ~F.col("entry").startswith("{")
    url = F.trim(F.when(plain, F.col("entry")).otherwise(entry["url"]))
    url = F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(F.raise_error(F.lit("a feed needs an address")))
    return listed.select(
        "at", url.alias("url"), F.coalesce(entry["enabled"], F.lit(True)).alias("enabled"),
        values.positive(entry["intervalMinutes"], settings.feed_interval_minutes).alias("interval_minutes"),
        values.positive(entry["maxItems"], settings.max_items).cast("int").alias("max_items"),
        urls.source_type(entry["sourceType"], url).alias("source_type"), entry["category"].alias("category"), entry["language"].alias("language"), entry["name"].alias("name"),
    )


def read_feed_list(spark: SparkSession, path: str) -> DataFrame:
    return feed_list(spark.read.text(path, wholetext=True))


_T = "struct<_VALUE:string>"
_U = "struct<_VALUE:string,_url:string,url:string>"
_C = "struct<_VALUE:string,_term:string,_label:string>"
#: The elements of an item that are read, with their attributes (underscored); any may be absent or repeated.
ITEM = (
    f"title array<{_T}>, link array<struct<_VALUE:string,_href:string,_rel:string>>, guid array<{_T}>, id array<{_T}>, description array<{_T}>, summary array<{_T}>, content array<{_T}>, "
    f"pubDate array<{_T}>, published array<{_T}>, updated array<{_T}>, `dc:date` array<{_T}>, author array<struct<_VALUE:string,name:string>>, `dc:creator` array<{_T}>, `content:encoded` array<{_T}>, "
    f"`media:group` array<struct<`media:thumbnail`:array<{_U}>,`media:content`:array<{_U}>,`media:description`:array<{_T}>>>, `media:content` array<{_U}>, `media:description` array<{_T}>, "
    f"`media:thumbnail` array<{_U}>, `media:title` array<{_T}>, enclosure array<{_U}>, image array<{_U}>, `og:image` array<{_U}>, category array<{_C}>, `arxiv:primary_category` array<{_C}>, `arxiv:categories` array<{_C}>"
)


def parse_feed(fetched: DataFrame) -> DataFrame:
    """Items of fetched RSS, RDF or Atom bodies (feed_url, fetched_at, body): a row an item, `seq` within its feed.

    A body is cut into its items, and each item is read as XML of a stated shape; an item that is not well formed is a
    row without values. Entities that XML does not know stay as they are written.
    """
    body = F.regexp_replace("body", r"(?s)<\?xml.*?\?>", "")
    item = F.regexp_extract_all(body, F.lit(r"(?is)<(?:item|entry)[\s>].*?</(?:item|entry)>"), F.lit(0))
    known = F.regexp_replace("item", r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")
    plain = F.transform(F.split("item", r"(?=<!\[CDATA\[)|(?<=\]\]>)"), lambda part: F.when(part.startswith("<![CDATA["), part).otherwise(F.regexp_replace(part, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")))
    rows = fetched.select("feed_url", "fetched_at", _inner(F.regexp_replace(body, r"(?is)<(item|entry)[\s>].*", ""), "title").alias("feed_title"), F.posexplode(item).alias("seq", "item"))
    marked = F.when(F.col("item").contains("<![CDATA["), F.array_join(plain, "")).otherwise(known)
    rows = rows.withColumn("i", F.from_xml(marked, ITEM))
    i = F.col("i")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    first = lambda name: some(F.get(i[name], F.lit(0))["_VALUE"])
    link = F.filter(i["link"], lambda x: F.coalesce(some(x["_VALUE"]), some(x["_href"])).isNotNull())
    href = F.coalesce(F.get(F.filter(link, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"], F.get(link, F.lit(0))["_href"])
    written = F.get(F.filter(F.transform(link, lambda x: some(x["_VALUE"])), lambda v: v.isNotNull()), F.lit(0))
    group = F.get(i["media:group"], F.lit(0))
    named = F.concat(*[F.coalesce(i[c], F.array().cast(f"array<{_C}>")) for c in ("category", "arxiv:categories", "arxiv:primary_category")])
    return rows.select(
        "feed_url", "fetched_at", "feed_title", "seq", first("title").alias("title"), F.coalesce(written, some(href), first("guid"), first("id")).alias("link"),
        F.coalesce(first("description"), first("summary"), first("media:description"), some(F.get(group["media:description"], F.lit(0))["_VALUE"]), first("content:encoded"), first("content")).alias("description"),
        F.coalesce(first("pubDate"), first("dc:date"), first("published"), first("updated")).alias("published"),
        F.coalesce(first("dc:creator"), first("author"), some(F.get(i["author"], F.lit(0))["name"])).alias("author"), picture(i).alias("media"), first("media:title").alias("media_title"),
        F.coalesce(first("content:encoded"), first("content")).alias("content"),
        F.filter(F.transform(named, lambda c: F.coalesce(some(c["_VALUE"]), some(c["_term"]), some(c["_label"]))), lambda t: t.isNotNull()).alias("tags"),
    )


def picture(item: Column) -> Column:
    """The first address among an item's media elements: of each the attribute, then the element within."""
    group = F.get(item["media:group"], F.lit(0))
    held = (item["media:content"], item["media:thumbnail"], group["media:thumbnail"], group["media:content"], item["enclosure"], item["image"], item["og:image"])
    return F.coalesce(*(F.nullif(F.trim(F.get(of, F.lit(0))[c]), F.lit("")) for of in held for c in ("_url", "url")))


def _plain(value: Column) -> Column:
    """Character data of an element: CDATA marks gone, markup entities decoded once."""
    data = F.regexp_replace(value, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    unescaped = F.replace(F.replace(F.replace(data, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.when(value.contains("<![CDATA["), data).otherwise(unescaped)


def _inner(value: Column, tag: str) -> Column:
    return F.nullif(_plain(F.regexp_extract(value, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)), F.lit(""))


def article_rows(items: DataFrame, feeds: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Items as article rows: only valid addresses, at most the feed's number of items, future dates set to now."""
    joined = items.join(feeds.select(F.col("url").alias("feed_url"), "max_items", "source_type"), "feed_url")
    capped = joined.where((F.col("seq") < F.col("max_items")) & urls.valid(F.col("link")))
    url = urls.normalize(F.col("link"))
    published = values.publication_time(values.parse_time(F.col("published")), F.col("fetched_at"), settings.future_hours)
    image = F.when(urls.valid(F.col("media")), F.col("media")).otherwise(F.coalesce(urls.html_image(F.col("content")), urls.html_image(F.col("description"))))
    return capped.select(
        "seq", values.hash64(url).alias("url_hash"), url.alias("url"), "feed_url", text.clean_text(F.col("feed_title")).alias("feed_title"), text.clean_text(F.col("title")).alias("title"),
        F.substring(text.clean_text(F.substring("description", 1, 2000)), 1, 500).alias("summary"), image.alias("image_url"), text.clean_text(F.col("author")).alias("author"),
        published.alias("published_at"), "fetched_at", "source_type", text.tags(F.col("tags")).alias("tags"),
    )


def due(feeds: DataFrame, state: DataFrame, now: str) -> DataFrame:
    """Enabled feeds that have never been polled or whose time has come."""
    at = F.lit(now).cast("timestamp")
    joined = feeds.where("enabled").join(state.select(F.col("feed_url").alias("url"), "next_poll"), "url", "left")
    return joined.where(F.col("next_poll").isNull() | (F.col("next_poll") <= at)).drop("next_poll")


def opml_feeds(files: DataFrame, category: str, language: str, source: str) -> DataFrame:
    """Feeds of OPML files (`value`); a folder's name is the category of the feeds after it, in the file's order."""
    outline = F.regexp_extract_all("value", F.lit(r"(?is)<outline\b([^>]*?)/?>"), F.lit(1))
    rows = files.select(F.xxhash64("value").alias("file"), F.posexplode(outline).alias("at", "attrs"))
    attr = lambda name: F.nullif(text.decode_entities(F.regexp_extract("attrs", rf"""(?is)\b{name}=(["'])(.*?)\1""", 2)), F.lit(""))
    rows = rows.select("file", "at", attr("xmlUrl").alias("url"), F.coalesce(attr("text"), attr("title")).alias("name"), attr("type").alias("type"))
    folder = F.when(F.col("url").isNull() & F.col("name").isNotNull() & ~F.coalesce(F.col("type").startswith("rss"), F.lit(False)), text.slug(F.col("name")))
    order = Window.partitionBy("file").orderBy("at")
    rows = rows.withColumn("category", F.coalesce(F.last(folder, ignorenulls=True).over(order), F.lit(category)))
    return rows.where("url is not null").select("url", "name", "category", F.lit(language).alias("language"), F.lit(source).alias("source"))


def markdown_feeds(files: DataFrame, category: str, language: str, source: str) -> DataFrame:
    """Feed-like addresses in Markdown files (`value`), each once."""
    found = F.regexp_extract_all("value", F.lit(r"""https?://[^\s)<>"'`\]\\]+"""), F.lit(0))
    rows = files.select(F.explode(F.transform(found, lambda u: F.regexp_replace(u, "[.,;!?]+$", ""))).alias("url"))
    return rows.where(urls.feed_like(F.col("url"))).distinct().select("url", F.lit(category).alias("category"), F.lit(language).alias("language"), F.lit(source).alias("source"))


def json_feeds(files: DataFrame, category: str, language: str, source: str) -> DataFrame:
    """Addresses under feed_url or rss_url keys anywhere in JSON files (`value`), as often as they stand there.

    Values are walked level by level; what a level holds below it is written as the next one's input, so there are as
    many rounds as the deepest file has levels. Text that is not JSON has no addresses.
    """
    spark = files.sparkSession
    level = files.select(F.try_parse_json("value").alias("v")).where("v is not null")
    found = []
    while True:
        below = materialise(level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("key", "value"))
        named = F.coalesce(F.col("key").rlike("(?i)^(?:feed_?url|rss_?url)$"), F.lit(False))
        address = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string"))
        hit = named & F.coalesce(address.startswith("http"), F.lit(False))
        found.append(below.where(hit).select(address.alias("url")))
        level = below.where(~hit & F.schema_of_variant("value").rlike("^(?:ARRAY|OBJECT)")).select(F.col("value").alias("v"))
        if level.isEmpty():
            break
    urls_ = reduce(DataFrame.union, found)
    return urls_.select("url", F.lit(category).alias("category"), F.lit(language).alias("language"), F.lit(source).alias("source"))


def charset(head: bytes, content_type: str | None) -> str:
    """The XML prolog's encoding, else the header's, else UTF-8."""
    for pattern, where in ((r"""encoding=["']([\w.:-]+)""", head[:400].decode("latin-1")), (r"charset=([\w.:-]+)", content_type or "")):
        found = re.search(pattern, where, re.IGNORECASE)
        if found:
            return found[1].lower()
    return "utf-8"


def decoded(body: bytes, content_type: str | None = None) -> str:
    try:
        return body.decode(charset(body, content_type))
    except (LookupError, UnicodeDecodeError):
        try:
            return body.decode("windows-1252")
        except UnicodeDecodeError:
            return body.decode("utf-8", "replace")


@dataclass
class Answer:
    """What came back from an address: a body or an error, and what the server said of it."""

    body: str | None = None
    error: str | None = None
    status: int | None = None
    content_type: str | None = None


def fetch(url: str, timeout: float = 5, limit: int = 5 << 20, redirects: int = 5, attempts: int = 2, head: int | None = None) -> Answer:
    """An address's answer: one more attempt after a passing network error, none after an answer.

    With `head` only so many first bytes are read, as is enough to tell a feed; else a body of over `limit` is an error.
    """
    handler = urllib.request.HTTPRedirectHandler()
    handler.max_redirections = redirects
    opener, error = urllib.request.build_opener(handler), None
    for attempt in range(attempts):
        try:
            with opener.open(url, timeout=timeout) as got:
                kind = got.headers.get("Content-Type")
                raw = got.read(limit + 1 if head is None else head)
                if head is None and len(raw) > limit:
                    return Answer(None, "too large", got.status, kind)
                return Answer(decoded(raw, kind) if head is None else raw.decode("utf-8", "replace"), None, got.status, kind)
        except urllib.error.HTTPError as e:
            return Answer(None, f"HTTP {e.code}", e.code, e.headers.get("Content-Type"))
        except (TimeoutError, ConnectionError, urllib.error.URLError) as e:
            cause = getattr(e, "reason", e)
            error = "timeout" if isinstance(cause, TimeoutError) else type(cause).__name__
            if not isinstance(cause, TimeoutError | ConnectionError):
                break
            if attempt + 1 < attempts:
                time.sleep(0.25)
        except (OSError, ValueError) as e:
            return Answer(None, type(e).__name__)
    return Answer(None, error)


def within(seconds: float, work: Callable[[], Answer]) -> Answer:
    """The work's result, or a deadline error once the time is over; what still runs then is left to end by itself."""
    from threading import Thread

    out: list[Answer] = []
    thread = Thread(target=lambda: out.append(work()), daemon=True)
    thread.start()
    thread.join(seconds)
    return out[0] if out else Answer(None, "deadline")


FETCHED = "feed_url string, fetched_at timestamp, body string, error string, duration_ms long, status int, content_type string"


def _host(url: str) -> str:
    try:
        return urllib.parse.urlsplit(url).netloc.lower()
    except ValueError:
        return ""


def _poll(url: str, options: dict) -> tuple:
    """One row of FETCHED; options: timeout (5 s an attempt), deadline (10 s in all), limit and head (bytes)."""
    from datetime import UTC, datetime

    began, head = time.time(), options.get("head")
    got = within(float(options.get("deadline", 10)), lambda: fetch(url, float(options.get("timeout", 5)), int(options.get("limit", 5 << 20)), head=int(head) if head else None))
    return url, datetime.now(UTC), got.body, got.error, int((time.time() - began) * 1000), got.status, got.content_type


def polled(addresses: DataFrame, **options: str | int | float) -> DataFrame:
    """FETCHED rows of a table's addresses (`url`), each once; a host's addresses are polled one after another.

    Hosts are dealt over tasks, so that many hosts are polled side by side and none by two tasks; errors are rows, never
    failures. Options are those of the `feeds` source.
    """
    hosts = addresses.where("url is not null").select("url").distinct().withColumn("host", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)))

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for batch in batches:
            for url in batch["url"]:
                yield pd.DataFrame([_poll(url, options)], columns=[c.split()[0] for c in FETCHED.split(", ")]).astype({"status": "Int32"})

    return hosts.repartition("host").mapInPandas(run, FETCHED)


def listed_files(listings: DataFrame, ending: str = ".opml") -> DataFrame:
    """(name, url) of the files in directory listings: JSON arrays of name, type and download_url, a listing a row (`body`).

    Anything else, as an error's object, lists nothing.
    """
    entry = F.from_json("body", "array<struct<name:string,type:string,download_url:string>>")
    rows = listings.select(F.inline(F.when(F.trim(F.col("body")).startswith("["), entry)))
    return rows.where((F.col("type") == "file") & F.col("name").endswith(ending) & F.col("download_url").isNotNull()).select("name", F.col("download_url").alias("url"))


class FeedSource(DataSource):
    """`spark.read.format("feeds").option("urls", "a b")`, or `readStream`: errors are rows, never failures.

    At most `concurrency` partitions (10) poll one feed after the other, feeds of one host in one partition; each feed
    has `timeout` seconds (5) an attempt and `deadline` seconds (10) in all; `head` asks for that many first bytes.

    As a stream, time goes in ticks of `every` seconds (600), which are the stream's offsets: a restarted stream goes on
    with the tick after its checkpoint's, and ticks that passed meanwhile are not made up for. A tick admits at most
    `per_host` feeds (10) of each host; a host with more takes turns.
    """

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema: object) -> DataSourceReader:
        return _FeedReader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return _FeedStream(self.options)


class _Urls(InputPartition):
    pass


def _dealt(urls_: list[str], concurrency: int) -> list[InputPartition]:
    hosts: dict[str, list[str]] = {}
    for u in urls_:
        hosts.setdefault(_host(u), []).append(u)
    bins: list[list[str]] = [[] for _ in range(max(1, min(concurrency, len(hosts))))]
    for some in sorted(hosts.values(), key=len, reverse=True):
        min(bins, key=len).extend(some)
    return [_Urls(tuple(b)) for b in bins if b]


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.urls, self.concurrency = dict(options), options.get("urls", "").split(), int(options.get("concurrency", 10))

    def partitions(self) -> list[InputPartition]:
        return _dealt(self.urls, self.concurrency)

    def read(self, partition: InputPartition):  # noqa: ANN201
        for url in partition.value:
            yield _poll(url, self.options)


class _FeedStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.urls, self.concurrency = dict(options), options.get("urls", "").split(), int(options.get("concurrency", 10))
        self.every, self.per_host = float(options.get("every", 600)), int(options.get("perhost", options.get("per_host", 10)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tick": int(time.time() // self.every) - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"tick": int(time.time() // self.every)}

    def admitted(self, tick: int) -> list[str]:
        """The feeds whose turn a tick is."""
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(_host(u), []).append(u)
        out = []
        for some in hosts.values():
            turns = -(-len(some) // self.per_host)
            out += some[tick % turns :: turns]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _dealt(self.admitted(end["tick"]), self.concurrency) if end["tick"] > start["tick"] else []

    def read(self, partition: InputPartition):  # noqa: ANN201
        for url in partition.value:
            yield _poll(url, self.options)

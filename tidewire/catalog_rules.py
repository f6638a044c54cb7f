"""Registered queries of the engine's row rules (addresses, feeds, texts, choices, budgets), each with its DuckDB SQL.

Inputs that the tables lack are spelled from their columns, the same way in both languages; every row takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewire.catalog import _A, _DAILY, _POOL, _articles, _pool, _scores, _table, query
from tidewire.config import SECTIONS
from tidewire.functions import text, urls, values
from tidewire.operators import briefing, enrich, expand, followup, selection, store, usage
from tidewire.sources import feeds

_CLEAN = r"""nullif(trim(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<(?:script|style).*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
'[\s\x{{0B}}\x{{A0}}]+', ' ', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')), '')"""


def _pick(items: list[str | None], at) -> object:  # noqa: ANN001
    """Column: the item at a number modulo their count."""
    return F.get(F.array(*[F.lit(i) for i in items]), F.pmod(at, F.lit(len(items))).cast("int"))


def _sql_list(items: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if i is None else "'" + i.replace("'", "''") + "'" for i in items) + "]"


def _sql_pick(items: list[str | None], at: str) -> str:
    return f"({_sql_list(items)})[{at} % {len(items)} + 1]"


# --- texts ----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_A} SELECT seq, replace(coalesce(title, ''), ' ', '&') || chr(CAST(65 + seq % 26 AS INTEGER)) || chr(CAST(97 + seq % 26 AS INTEGER)) || '<x>"' AS plain FROM a WHERE NOT contains(coalesce(title, ''), '&')""")
def decoded_entities(spark, sf_dir):
    a = _articles(spark, sf_dir).where(~F.coalesce("title", F.lit("")).contains("&"))
    code = F.concat(F.lit("&#"), (65 + F.col("seq") % 26).cast("string"), F.lit(";&#x"), F.lower(F.hex(97 + F.col("seq") % 26)), F.lit(";&amp;lt;x&gt;&amp;quot;"))
    return a.select("seq", text.decode_entities(F.concat(F.replace(F.coalesce("title", F.lit("")), F.lit(" "), F.lit("&amp;")), code)).alias("plain"))


@query(f"""WITH {_A}, n AS (SELECT seq, title || ' - ' || feed_url AS title, {_sql_pick(["Google News", "Daily", None], "seq")} AS feed FROM a WHERE title IS NOT NULL)
SELECT seq, CASE WHEN coalesce(feed, '') ILIKE '%google news%' THEN regexp_replace(title, '\\s[-–|]\\s[^-–|]{{2,60}}$', '') ELSE title END AS shown FROM n""")
def clean_titles(spark, sf_dir):
    a = _articles(spark, sf_dir).where("title is not null")
    return a.select("seq", text.clean_title(F.concat("title", F.lit(" - "), "feed_url"), _pick(["Google News", "Daily", None], F.col("seq"))).alias("shown"))


@query(f"""WITH {_A}, n AS (SELECT seq, title, trim(regexp_replace(CASE WHEN seq % 4 = 0 THEN title ELSE summary END, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS flat FROM a)
SELECT seq, CASE WHEN flat <> '' AND flat <> trim(coalesce(title, '')) THEN CASE WHEN length(flat) > 120 THEN rtrim(left(flat, 119)) || '…' ELSE flat END END AS description FROM n""")
def clean_descriptions(spark, sf_dir):
    body = F.when(F.col("seq") % 4 == 0, F.col("title")).otherwise(F.col("summary"))
    return _articles(spark, sf_dir).select("seq", text.clean_description(body, F.col("title"), 120).alias("description"))


@query(f"""WITH {_A} SELECT seq, trim(regexp_replace(regexp_replace(coalesce(title, '') || ' #now' || CASE WHEN seq % 2 = 0 THEN ' | ' || feed_url ELSE ' • Channel' END, '\\s+[|•]\\s+[^|•]{{2,40}}$', ''), '#\\S+', '', 'g')) AS bare FROM a""")
def channel_titles(spark, sf_dir):
    made = F.concat(F.coalesce("title", F.lit("")), F.lit(" #now"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit(" | "), "feed_url")).otherwise(F.lit(" • Channel")))
    return _articles(spark, sf_dir).select("seq", text.strip_channel(made).alias("bare"))


@query(f"""WITH {_A} SELECT seq, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM a""")
def slugs(spark, sf_dir):
    return _articles(spark, sf_dir).select("seq", text.slug(F.col("title")).alias("slug"))


@query(f"""WITH {_A}, w AS (SELECT seq, [lower({_CLEAN.format('x')}) FOR x IN string_split(coalesce(summary, ''), ' ')] AS u FROM a), k AS (SELECT seq, [x FOR x IN u IF x IS NOT NULL AND x <> ''] AS u FROM w)
SELECT seq, array_to_string([x FOR x, i IN u IF list_position(u, x) = i][1:10], ' ') AS tags FROM k""")
def tag_lists(spark, sf_dir):
    return _articles(spark, sf_dir).select("seq", F.array_join(text.tags(F.split(F.coalesce("summary", F.lit("")), " ")), " ").alias("tags"))


@query(f"""WITH {_A} SELECT seq, coalesce(CASE WHEN seq % 4 = 0 THEN nullif(title, '') END, CASE WHEN seq % 4 = 1 THEN nullif(title, '') END, CASE WHEN seq % 4 = 2 THEN upper(left(feed_url, 1)) || substr(feed_url, 2) END, 'Untitled story') AS shown FROM a""")
def story_titles(spark, sf_dir):
    part = lambda k, c: F.when(F.col("seq") % 4 == k, c)
    label = F.when(F.col("seq") % 4 == 2, F.array("feed_url")).otherwise(F.array().cast("array<string>"))
    return _articles(spark, sf_dir).select("seq", text.story_title(part(0, F.col("title")), part(1, F.col("title")), label).alias("shown"))


@query(f"""WITH {_A} SELECT seq, CASE WHEN seq % 3 < 2 THEN title END AS plain FROM a WHERE title <> ''""")
def decoded_headers(spark, sf_dir):
    wrapped = F.concat(F.lit("=?base64?"), F.replace(F.base64(F.col("title").cast("binary")), F.lit("\r\n"), F.lit("")), F.lit("?="))
    value = F.when(F.col("seq") % 3 == 0, F.col("title")).when(F.col("seq") % 3 == 1, wrapped).otherwise(F.lit("=?base64?***?="))
    return _articles(spark, sf_dir).where("title <> ''").select("seq", text.decode_header(value).alias("plain"))


@query(f"""WITH {_A} SELECT seq, CASE WHEN seq % 3 = 0 THEN lang || ',' || feed_url ELSE '' END AS listed FROM a""")
def parsed_lists(spark, sf_dir):
    value = F.when(F.col("seq") % 3 == 0, F.to_json(F.array("lang", "feed_url"))).when(F.col("seq") % 3 == 1, F.lit("{bad"))
    return _articles(spark, sf_dir).select("seq", F.array_join(text.parse_list(value), ",").alias("listed"))


@query(f"""WITH {_A}, w AS (SELECT day, unnest(string_split(lower(title), ' ')) AS word, seq FROM a WHERE title <> ''), c AS (SELECT day, left(word, 4) AS key, word, count(*) AS n, min(seq) AS first FROM w WHERE word <> '' GROUP BY 1, 2, 3)
SELECT CAST(day AS VARCHAR) AS day, key, word AS form, n FROM (SELECT *, row_number() OVER (PARTITION BY day, key ORDER BY n DESC, first, word) AS r FROM c) WHERE r = 1""")
def surface_forms(spark, sf_dir):
    """The most frequent form of each key of a day, the earlier one among equals: the rule of story labels."""
    a = _articles(spark, sf_dir).where("title <> ''")
    words = a.select("day", "seq", F.explode(F.split(F.lower("title"), " ")).alias("word")).where("word <> ''")
    best = store.most_frequent(words.withColumn("key", F.substring("word", 1, 4)), ["day", "key"], "word", "seq")
    return best.select(F.col("day").cast("string").alias("day"), "key", F.col("word").alias("form"), "n")


# --- addresses ------------------------------------------------------------------------------------------------------------

_DECLARED = ["News", "video", "RESEARCH", "blog", None]
_FEED_URLS = ["https://www.youtube.com/feeds/videos.xml?channel_id=", "http://export.arxiv.org/rss/cs", "https://news.example.org/feed/"]


@query(f"""WITH p AS (SELECT page_id, {_sql_pick(_DECLARED, "page_id")} AS declared, {_sql_pick(_FEED_URLS, "page_id // 5")} || page_id AS url FROM pages)
SELECT page_id, CASE WHEN lower(declared) = 'news' THEN 1 WHEN lower(declared) = 'video' THEN 2 WHEN lower(declared) = 'research' THEN 3 WHEN contains(url, 'youtube.com/feeds/videos.xml') THEN 2 WHEN contains(url, 'arxiv.org/rss/') THEN 3 ELSE 1 END AS kind FROM p""")
def source_types(spark, sf_dir):
    p, i = _table(spark, sf_dir, "pages"), F.col("page_id")
    url = F.concat(_pick(_FEED_URLS, F.floor(i / 5)), i.cast("string"))
    return p.select("page_id", urls.source_type(_pick(_DECLARED, i), url).cast("int").alias("kind"))


_VIDEO_URLS = ["https://youtu.be/", "https://www.youtube.com/watch?t=5&v=", "https://www.youtube.com/shorts/", "https://www.youtube.com/live/", "https://www.youtube.com/embed/", "https://vimeo.com/"]


@query(f"""SELECT page_id, CASE WHEN page_id % 6 < 5 THEN 'v' || page_id END AS video, page_id % 7 <> 0 AS ok FROM pages""")
def video_ids(spark, sf_dir):
    p, i = _table(spark, sf_dir, "pages"), F.col("page_id")
    url = F.concat(_pick(_VIDEO_URLS, i), F.lit("v"), i.cast("string"))
    return p.select("page_id", urls.video_id(url).alias("video"), urls.valid(F.when(i % 7 == 0, F.lit("not an address")).otherwise(F.col("url"))).alias("ok"))


_PICTURES = ["/a/photo.jpg", "/a/site-logo.png", "/clip.mp4", "/icons/x.png", "/blogo.png", "/avatar_1.webp", "/vector.SVG", "/img?x=logo.png"]


@query(f"""WITH p AS (SELECT page_id, {_sql_pick(["http", "HTTPS", "ftp"], "page_id")} AS scheme, {_sql_pick(_PICTURES, "page_id // 3")} AS path FROM pages)
SELECT page_id, CASE WHEN scheme <> 'ftp' AND NOT regexp_matches(string_split(path, '?')[1], '(?i)\\.(mp4|webm|mov|m3u8|gif|svg)$|(^|[/_-])(icon|logo|avatar|favicon|sprite|pixel)s?([/_.-]|$)')
THEN CASE WHEN scheme = 'http' THEN 'https' ELSE scheme END || '://i.example.com' || path END AS picture FROM p""")
def pictures(spark, sf_dir):
    i = F.col("page_id")
    url = F.concat(_pick(["http", "HTTPS", "ftp"], i), F.lit("://i.example.com"), _pick(_PICTURES, F.floor(i / 3)))
    return _table(spark, sf_dir, "pages").select("page_id", urls.picture(url).alias("picture"))


_FEED_HOSTS = [
    "www.spiegel.de/schlagzeilen", "www.lemonde.fr/rss", "elpais.com/rss", "www.ansa.it/x", "www.asahi.com/rss", "g1.globo.com/rss", "www.thedailystar.net", "hongkongfp.com/feed", "www.thejournal.ie", "www.smh.com.au",
    "globalnews.ca/feed", "www.republika.co.id", "www.scmp.com/rss", "feeds.bbci.co.uk/news", "rss.cnn.com", "www.politico.com/rss", "rss.dw.com", "techcrunch.com/feed", "openai.com/blog/rss", "krebsonsecurity.com", "www.espn.com",
    "www.nature.com", "www.forbes.com", "www.gamespot.com", "variety.com", "www.space.com", "www.propublica.org", "www.coindesk.com", "www.eater.com", "www.insidehighered.com", "www.thenation.com", "stratechery.com", "own.example.org",
    "www.youtube.com/feeds/videos.xml", "arxiv.org/rss/cs", "trends.google.com/x",
]
_RULES_SQL = " ".join("WHEN regexp_matches(lower(url), '{}') THEN {{'category': '{}', 'language': '{}'}}".format(p.replace("'", "''"), c, lang) for p, c, lang in expand.CATEGORY_RULES)


@query(f"""WITH p AS (SELECT page_id, 'https://' || {_sql_pick(_FEED_HOSTS, "page_id")} AS url FROM pages), c AS (SELECT page_id, CASE {_RULES_SQL} ELSE {{'category': 'general', 'language': 'en'}} END AS c FROM p)
SELECT page_id, c.category AS category, c.language AS language FROM c""")
def inferred_categories(spark, sf_dir):
    url = F.concat(F.lit("https://"), _pick(_FEED_HOSTS, F.col("page_id")))
    return _table(spark, sf_dir, "pages").withColumn("c", expand.infer_category(url)).select("page_id", F.col("c.category").alias("category"), F.col("c.language").alias("language"))


@query(f"""WITH p AS (SELECT 'https://' || {_sql_pick(_FEED_HOSTS, "page_id")} AS url FROM pages), c AS (SELECT CASE {_RULES_SQL} ELSE {{'category': 'general', 'language': 'en'}} END.category AS category FROM p)
SELECT category, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, category LIMIT 12""")
def category_histogram(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select(expand.infer_category(F.concat(F.lit("https://"), _pick(_FEED_HOSTS, F.col("page_id"))))["category"].alias("category"))
    return expand.category_histogram(rows)


_SECTION_SQL = " ".join(f"WHEN category IN ({', '.join(repr(c) for c in cs)}) THEN '{s}'" for s, cs in selection.CATEGORIES.items())
_NAMED = [c for cs in selection.CATEGORIES.values() for c in cs] + ["general", "AI", "world-news", None]


@query(f"""WITH p AS (SELECT page_id, lower({_sql_pick(_NAMED, "page_id")}) AS category FROM pages) SELECT page_id, CASE {_SECTION_SQL} END AS section FROM p""")
def category_sections(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", selection.section_for_category(_pick(_NAMED, F.col("page_id"))).alias("section"))


# --- feed lists and feeds -------------------------------------------------------------------------------------------------


@query("""SELECT unnest([{'url': 'https://a.example/' || doc_id, 'enabled': true, 'every': 10.0, 'most': 50, 'kind': 1, 'category': NULL, 'name': NULL},
{'url': 'https://www.youtube.com/feeds/videos.xml?c=' || doc_id, 'enabled': doc_id % 2 = 0, 'every': 5.0, 'most': 7, 'kind': 2, 'category': source, 'name': 'N' || doc_id}], recursive := true) FROM documents""")
def feed_lists(spark, sf_dir):
    """One list a document: a plain address, and an object with odd values."""
    i = F.col("doc_id").cast("string")
    other = F.to_json(F.struct(
        F.concat(F.lit("  https://www.youtube.com/feeds/videos.xml?c="), i, F.lit(" ")).alias("url"), (F.col("doc_id") % 2 == 0).alias("enabled"), F.lit(5).alias("intervalMinutes"), F.lit(7).alias("maxItems"),
        F.lit("unheard").alias("sourceType"), F.col("source").alias("category"), F.concat(F.lit("N"), i).alias("name"),
    ))
    raw = _table(spark, sf_dir, "documents").select(F.concat(F.lit('["https://a.example/'), i, F.lit('", '), other, F.lit("]")).alias("value"))
    found = feeds.feed_list(raw)
    return found.select("url", "enabled", F.col("interval_minutes").alias("every"), F.col("max_items").alias("most"), F.col("source_type").cast("int").alias("kind"), "category", "name")


@query("""SELECT unnest([{'url': 'https://h.example/' || doc_id || '?a=1&b=2', 'name': 'Before', 'category': 'general'}, {'url': 'https://i.example/' || doc_id, 'name': 'In "folder"', 'category': 'world-news'},
{'url': 'https://j.example/' || doc_id, 'name': NULL, 'category': 'world-news'}], recursive := true) FROM documents""")
def opml_outlines(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    value = F.concat(
        F.lit('<opml><body><outline type="rss" text="Before" xmlUrl="https://h.example/'), i, F.lit('?a=1&amp;b=2"/><outline text="World News!"><outline type="rss" title=\'In &quot;folder&quot;\' xmlUrl="https://i.example/'), i,
        F.lit('"/><outline type="rss" xmlUrl="https://j.example/'), i, F.lit('"/></outline></body></opml>'),
    )
    return feeds.opml_feeds(_table(spark, sf_dir, "documents").select(value.alias("value")), "general", "en", "list").select("url", "name", "category")


_LINK_TEXT = "text || ' see [feed](https://' || source || '.example.com/feed.xml), <http://x.example/' || doc_id || '/rss>; https://x.example/page' || doc_id || '. or https://x.example/a.rss!'"


@query(f"""WITH u AS (SELECT DISTINCT regexp_replace(unnest(regexp_extract_all({_LINK_TEXT}, 'https?://[^\\s)<>"''`\\]\\\\]+')), '[.,;!?]+$', '') AS url FROM documents)
SELECT url FROM u WHERE regexp_matches(url, '(?i)/(feed|rss|atom)(/|\\.xml|\\.atom|\\.rss)?$|/(?:feed|atom|rss)\\.xml$|\\.rss$|\\.atom$')""")
def markdown_links(spark, sf_dir):
    return feeds.markdown_feeds(_table(spark, sf_dir, "documents").select(F.expr(_LINK_TEXT).alias("value")), "general", "en", "list").select("url")


@query("""SELECT unnest(['https://a.example/' || doc_id || '"é', 'https://b.example/' || doc_id, 'https://d.example/' || doc_id, 'https://d.example/' || doc_id]) AS url FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT 'https://deep.example/' || doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 = 0""")
def json_links(spark, sf_dir):
    """Escapes, nesting to any depth, keys whose values are no addresses, and text that is not JSON."""
    i = F.col("doc_id").cast("string")
    deep = F.when(F.col("doc_id") % 5 == 0, F.concat(F.repeat(F.lit('{"k": ['), 7), F.lit('{"RSS_URL": "https://deep.example/'), i, F.lit('"}'), F.repeat(F.lit("]}"), 7))).otherwise("null")
    body = F.concat(
        F.lit(r'{"x": [{"feed_url": "https:\/\/a.example\/'), i, F.lit(r'\"\u00e9", "n": "feed_url"}, {"y": {"rssUrl" : "https://b.example/'), i, F.lit('", "url": "https://c.example"}}, {"feedUrl": 7, "rss_url": null}, {"feedurl": "ftp://no"}, '),
        F.lit('{"feed_url": {"feed_url": ["https://e.example", {"feedurl": "https://d.example/'), i, F.lit('"}]}}, ["https://f.example", {"a": {"rssurl": "https://d.example/'), i, F.lit('"}}]], "z": '), deep, F.lit("}"),
    )
    raw = _table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 != 0, body).otherwise(F.concat(F.lit("{"), body)).alias("value"))
    return feeds.json_feeds(raw, "general", "en", "list").select("url")


# Where an item's picture may stand, in the order in which the places are read.
_PLACES = (
    '<media:content url="{0}"/>', "<media:content><url>{0}</url></media:content>", '<media:thumbnail width="1" url="{0}"/>', "<media:thumbnail><url>{0}</url></media:thumbnail>",
    '<media:group><media:thumbnail url="{0}"/></media:group>', "<media:group><media:thumbnail><url>{0}</url></media:thumbnail></media:group>", '<media:group><media:content url="{0}"/></media:group>',
    "<media:group><media:content><url>{0}</url></media:content></media:group>", '<enclosure url="{0}" type="image/png"/>', "<enclosure><url>{0}</url></enclosure>", '<image url="{0}"/>', "<image><url>{0}</url></image>",
    '<og:image url="{0}"/>', "<og:image><url>{0}</url></og:image>",
)


@query("""SELECT doc_id AS seq, CASE WHEN doc_id % 17 = 16 THEN 'https://x.example/html.png' WHEN doc_id % 17 = 15 THEN NULL WHEN doc_id % 17 = 14 THEN 'https://x.example/html.png' ELSE 'https://x.example/' || (doc_id % 17) || '/' || doc_id END AS image FROM documents""")
def item_pictures(spark, sf_dir):
    """Every place of a picture, an earlier place before later ones, an unusable address, and pictures of the text."""
    i, place = F.col("doc_id").cast("string"), F.col("doc_id") % 17
    spot = F.lit("")
    for k, pattern in enumerate(_PLACES):
        head, tail = pattern.split("{0}")
        later = _PLACES[-1].replace("{0}", "https://x.example/later") if k < 12 else ""
        spot = F.when(place == k, F.concat(F.lit(later + head + f"https://x.example/{k}/"), i, F.lit(tail))).otherwise(spot)
    spot = F.when(place == 14, "<enclosure url=\"no address\"/>").otherwise(spot)
    told = F.when(place == 15, "none &nbsp; here").when(place < 14, "text").otherwise("<![CDATA[<p>a & b <img class=x src='https://x.example/html.png'></p>]]>")
    body = F.concat(F.lit('<?xml version="1.0"?><rss><channel><title>F</title><item><title>t</title><link>https://x.example/a/'), i, F.lit("</link><description>"), told, F.lit("</description>"), spot, F.lit("</item></channel></rss>"))
    fetched = _table(spark, sf_dir, "documents").select(i.alias("feed_url"), F.lit("2024-03-10 00:00:00").cast("timestamp").alias("fetched_at"), body.alias("body"))
    limits = fetched.select(F.col("feed_url").alias("url"), F.lit(2).alias("max_items"), F.lit(1).alias("source_type"))
    return feeds.article_rows(feeds.parse_feed(fetched), limits).select(F.col("feed_url").cast("long").alias("seq"), F.col("image_url").alias("image"))


_ESCAPED = "replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""WITH d AS (SELECT doc_id, source, text, regexp_extract(text, '^[^\\n]*') AS line, TIMESTAMP '2024-03-01 00:00:00' + (doc_id % 500) * INTERVAL 1 HOUR AS moment FROM documents WHERE text IS NOT NULL)
SELECT 'https://f.example/' || doc_id AS feed_url, 'https://x.example/a/' || doc_id AS url, {_CLEAN.format('line')} AS title, left({_CLEAN.format('left(text, 2000)')}, 500) AS summary, {_CLEAN.format('source')} AS author,
strftime(moment, '%Y-%m-%d %H:%M:%S') AS published, 'b,' || source AS tags, 'https://x.example/p.jpg' AS image FROM d WHERE moment <= TIMESTAMP '2024-03-11 00:00:00'
UNION ALL SELECT 'https://f.example/' || doc_id, 'https://x.example/a/' || doc_id, {_CLEAN.format('line')}, left({_CLEAN.format('left(text, 2000)')}, 500), {_CLEAN.format('source')}, '2024-03-10 00:00:00', 'b,' || source, 'https://x.example/p.jpg' FROM d WHERE moment > TIMESTAMP '2024-03-11 00:00:00'""")
def feed_items(spark, sf_dir):
    """A feed a document, with four items: the document, one without an address, and two beyond the feed's limit."""
    d = _table(spark, sf_dir, "documents").where("text is not null")
    i, escaped = F.col("doc_id").cast("string"), lambda c: F.expr(_ESCAPED.format(c))
    at = F.timestamp_seconds(F.lit(1709251200) + F.pmod(F.col("doc_id"), F.lit(500)) * 3600)
    body = F.concat(
        F.lit('<?xml version="1.0"?><rss><channel><title>F</title><item><title>'), escaped(r"regexp_extract(text, '^[^\\n]*', 0)"), F.lit("</title><link>https://x.example/a/"), i, F.lit("?utm_source=f</link><description>"), escaped("text"),
        F.lit("</description><pubDate>"), F.date_format(at, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate><dc:creator>"), F.col("source"), F.lit("</dc:creator><category>B</category><category>"), F.col("source"),
        F.lit("</category><category> b </category><media:thumbnail url=\"https://x.example/p.jpg\"/></item><item><title>none</title><link>nowhere</link></item><item><link>https://x.example/b/"), i, F.lit("</link></item></channel></rss>"),
    )
    fetched = d.select(F.concat(F.lit("https://f.example/"), i).alias("feed_url"), F.lit("2024-03-10 00:00:00").cast("timestamp").alias("fetched_at"), body.alias("body"))
    limits = d.select(F.concat(F.lit("https://f.example/"), i).alias("url"), F.lit(2).alias("max_items"), F.lit(1).alias("source_type"))
    rows = feeds.article_rows(feeds.parse_feed(fetched), limits)
    return rows.select("feed_url", "url", "title", "summary", "author", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), F.array_join("tags", ",").alias("tags"), F.col("image_url").alias("image"))


_TYPES = ["application/rss+xml; charset=utf-8", "text/html", "TEXT/XML", None, "application/json"]
_BODIES = ["<html>", "x<RSS version='2'>", "<feed xmlns='a'>", "<channels>", None]


@query(f"""WITH p AS (SELECT page_id, {_sql_pick(_TYPES, "page_id")} AS t, {_sql_pick(_BODIES, "page_id // 5")} AS b FROM pages)
SELECT page_id, regexp_matches(coalesce(t, ''), '(?i)application/(rss|atom|rdf)\\+xml|application/xml|text/xml') OR regexp_matches(coalesce(b, ''), '(?i)<(rss|feed|rdf:rdf|channel)[\\s>]') AS alive FROM p""")
def alive_feeds(spark, sf_dir):
    i = F.col("page_id")
    return _table(spark, sf_dir, "pages").select("page_id", expand.alive(_pick(_TYPES, i), _pick(_BODIES, F.floor(i / 5))).alias("alive"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') || '/' AS key FROM pages)
SELECT key, min(page_id) AS at FROM u WHERE key NOT IN (SELECT key FROM u WHERE page_id % 11 = 0) GROUP BY 1""")
def new_feeds(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("url"), F.col("page_id").alias("at"), F.lit(None).cast("string").alias("name"))
    return expand.new_feeds(p, p.where("at % 11 = 0")).select("key", "at")


@query("""SELECT seq, CASE WHEN seq % 50 % 5 < 3 THEN 'i' || (seq % 50) END AS image FROM (SELECT doc_id AS seq FROM documents)""")
def picture_check(spark, sf_dir):
    """Pictures that answer with an image for any origin, or for this one without a redirect, stay."""
    a = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.lit("i"), (F.col("doc_id") % 50).cast("string")).alias("image"))
    k = F.col("id") % 5
    probes = spark.range(50).select(
        F.concat(F.lit("i"), F.col("id").cast("string")).alias("image"), F.lit(True).alias("ok"), F.when(k == 3, "text/html").otherwise("image/png").alias("type"),
        F.when(k == 0, "*").otherwise("https://me.example").alias("allow"), (k == 4).alias("redirected"),
    )
    return expand.drop_unloadable(a, probes.union(probes), "https://me.example").select("seq", "image")


# --- hashes, numbers, dates -----------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS client_id FROM customer""")
def client_ids(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", values.fnv1a(F.col("c_name")).alias("client_id"))


_GUARDS = ["5", "0", "-3", "x", None, "2.5", "NaN", "Infinity"]


@query(f"""WITH p AS (SELECT event_id, {_sql_pick(_GUARDS, "event_id")} AS v FROM events) SELECT event_id, CASE WHEN v IN ('5', '2.5') THEN CAST(v AS DOUBLE) ELSE 10.0 END AS guarded,
(0.1 * (event_id % 1000) + 0.4 * (event_id % 77)) / 1e6 AS cost, 2 * (0.1 * (ceil((event_id % 1000) / 3.0) + 500) + 0.4 * 900) / 1e6 AS worst FROM p""")
def guards_and_costs(spark, sf_dir):
    i = F.col("event_id")
    return _table(spark, sf_dir, "events").select(
        "event_id", values.positive(_pick(_GUARDS, i), 10).alias("guarded"), values.model_cost(F.lit(0.1), F.lit(0.4), i % 1000, i % 77).alias("cost"), values.worst_cost(i % 1000, F.lit(0.1), F.lit(0.4), 900).alias("worst")
    )


_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "EEE, d MMM yyyy HH:mm:ss 'GMT'", "d MMM yyyy HH:mm:ss '+0000'", "yyyy-MM-dd HH:mm:ss"]


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS parsed FROM events")
def parsed_times(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    told = F.lit("soon")
    for k, pattern in enumerate(_FORMATS):
        told = F.when(F.col("event_id") % 5 == k, F.date_format(at, pattern)).otherwise(told)
    return _table(spark, sf_dir, "events").select("event_id", F.date_format(values.parse_time(told), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


_DATES = ["2024-02-29", "2023-02-29", "2024-13-01", "24-01-01", "2031-01-01", None, "2024-01-05x"]


@query(f"""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, {_sql_pick(_DATES, "event_id")} AS d FROM events) SELECT event_id, CAST(day + 3 AS VARCHAR) AS shifted, greatest(0, DATE '2024-01-20' - day) AS since,
CASE WHEN DATE '2024-01-20' - day > 2 THEN 86400 ELSE 600 END AS seconds, coalesce(d = '2024-02-29', false) AS valid, {_sql_pick(["lead", "secondary", "secondary", "feature", "feature", "feature", "feature", "brief"], "event_id")} AS tier,
dayname(day) || ' ' || day(day) || ' ' || monthname(day) || ' ' || year(day) AS long_form, left(dayname(day), 3) || ' ' || day(day) || ' ' || left(monthname(day), 3) AS short_form FROM e""")
def day_rules(spark, sf_dir):
    e, day, now = _table(spark, sf_dir, "events"), F.to_date("ts"), F.lit("2024-01-20").cast("date")
    return e.select(
        "event_id", F.date_add(day, 3).cast("string").alias("shifted"), values.days_between(day, now).alias("since"), values.cache_seconds(day, now).alias("seconds"),
        values.valid_date(_pick(_DATES, F.col("event_id")), F.lit("2030-01-01").cast("date")).alias("valid"), values.tier(1 + F.col("event_id") % 8).alias("tier"),
        values.shown_date(day).alias("long_form"), values.shown_date(day, "short").alias("short_form"),
    )


_AGENTS = ["claude-code/1.0", "Claude Desktop", "mcp-inspector", "cursor 0.4", "Windsurf", "vscode", "openai-mcp", "gemini-cli", "intellij", "zed", "cline", "goose", "continue", "mcp-remote", "n8n", "langgraph", "python-httpx", "undici", "curl/8", "lynx", "", None, "claude.ai"]
_VERSIONS = ["1.2.3", "v10.4-beta", "x", "", None, "12345.1"]
_CLIENT_SQL = " ".join("WHEN regexp_matches({{0}}, '(?i){}') THEN '{}'".format(p.replace("'", "''"), c) for c, p in usage.CLIENTS)


@query(f"""WITH e AS (SELECT event_id, nullif({_sql_pick(_AGENTS, "event_id")}, '') AS name, nullif({_sql_pick(_AGENTS, "event_id // 23")}, '') AS agent, {_sql_pick(_VERSIONS, "event_id")} AS v, {_sql_pick([*usage.METHODS, "odd", None], "event_id")} AS m FROM events)
SELECT event_id, coalesce(CASE {_CLIENT_SQL.format('name')} END, CASE {_CLIENT_SQL.format('agent')} END, CASE WHEN coalesce(name, agent) IS NOT NULL THEN 'other' END, '(not set)') AS client,
coalesce(nullif(regexp_extract(coalesce(v, ''), '^v?(\\d{{1,4}}\\.\\d{{1,4}})', 1), ''), '(not set)') AS version, CASE WHEN m <> 'odd' THEN m ELSE '(other)' END AS method, coalesce(left(name, 6), '') AS clipped FROM e""")
def known_clients(spark, sf_dir):
    i = F.col("event_id")
    name, agent = _pick(_AGENTS, i), _pick(_AGENTS, F.floor(i / 23))
    return _table(spark, sf_dir, "events").select(
        "event_id", usage.client(name, agent).alias("client"), usage.version(_pick(_VERSIONS, i)).alias("version"), usage.method(_pick([*usage.METHODS, "odd", None], i)).alias("method"), usage.clip(name, 6).alias("clipped")
    )


# --- storage, stories, budgets --------------------------------------------------------------------------------------------


@query(f"""WITH {_A}, p AS (SELECT 'topic_' || (seq % 90) AS topic_id, CAST(seq AS VARCHAR) AS h FROM a WHERE source_type = 1 UNION ALL SELECT 'topic_' || (seq % 90), CAST(seq AS VARCHAR) FROM a WHERE source_type = 2 OR seq % 4 = 0) SELECT DISTINCT topic_id, h AS url_hash FROM p""")
def topic_links(spark, sf_dir):
    a = _articles(spark, sf_dir).select(F.concat(F.lit("topic_"), (F.col("seq") % 90).cast("string")).alias("id"), F.col("seq").cast("string").alias("h"), "source_type", "seq", F.lit("2024-01-01").cast("date").alias("topic_date"))
    made = a.groupBy("id", "topic_date").agg(F.collect_list(F.when(F.col("source_type") == 1, F.col("h"))).alias("article_hashes"), F.collect_list(F.when((F.col("source_type") == 2) | (F.col("seq") % 4 == 0), F.col("h"))).alias("video_hashes"))
    return store.topic_links(made).select("topic_id", "url_hash")


@query(f"WITH {_DAILY} SELECT CAST(day AS VARCHAR) AS day, id, day_rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 9) DESC, id) AS day_rank FROM s) WHERE day_rank <= 3")
def top_ranked(spark, sf_dir):
    rows = _scores(spark, sf_dir).withColumn("final_score", F.round("score", 9))
    return followup.top_ranked(rows, 3).select(F.col("day").cast("string").alias("day"), "id", F.col("day_rank").cast("long").alias("day_rank"))


@query(f"WITH {_DAILY} SELECT CAST(day AS VARCHAR) AS day, id, round(round(score, 9), 6) AS score FROM s WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' ORDER BY day DESC, round(score, 9) DESC, id")
def topics_between(spark, sf_dir):
    rows = _scores(spark, sf_dir).select(F.col("day").alias("topic_date"), "id", F.round("score", 9).alias("final_score"))
    found = store.topics_between(rows, "2024-01-05", "2024-01-12")
    return found.select(F.col("topic_date").cast("string").alias("day"), "id", F.round("final_score", 6).alias("score"))


_REPAIR = "cold AS (SELECT seq, title, summary FROM a WHERE seq % 3 = 0 OR seq % 2 = 1), hot AS (SELECT seq, title, summary, lang FROM a WHERE seq % 2 = 0 OR seq % 5 = 0)"


@query(f"""WITH {_A}, {_REPAIR} SELECT seq, title, CASE WHEN seq IN (SELECT seq FROM cold) THEN NULL ELSE left(summary, 100) END AS summary, CASE WHEN seq IN (SELECT seq FROM cold) THEN NULL ELSE lang END AS lang FROM hot
UNION ALL SELECT seq, title, NULL, NULL FROM cold WHERE seq NOT IN (SELECT seq FROM hot)""")
def archive_repair(spark, sf_dir):
    a = _articles(spark, sf_dir).select("seq", "title", "summary", "lang")
    return store.repair(a.where("seq % 2 = 0 or seq % 5 = 0"), a.where("seq % 3 = 0 or seq % 2 = 1"), "seq", emptied=("summary", "lang"), most=100)


@query(f"""WITH {_A}, t AS (SELECT 'topic_' || seq AS id, day AS topic_date FROM a), l AS (SELECT 'topic_' || seq AS topic_id, (seq * 7) % 1000 AS url_hash FROM a), old AS (SELECT * FROM l WHERE url_hash % 5 = 0)
SELECT topic_id, url_hash, '2024-01' AS month FROM old WHERE topic_id IN (SELECT id FROM t WHERE strftime(topic_date, '%Y-%m') = '2024-01')
UNION ALL SELECT topic_id, url_hash, strftime(topic_date, '%Y-%m') FROM l JOIN t ON t.id = l.topic_id WHERE topic_id NOT IN (SELECT topic_id FROM old)""")
def archive_links(spark, sf_dir):
    """Links by the month of their topic; topics that the archive has keep their archived links."""
    a = _articles(spark, sf_dir)
    made = a.select(F.concat(F.lit("topic_"), "seq").alias("id"), F.col("day").alias("topic_date"))
    links = a.select(F.concat(F.lit("topic_"), "seq").alias("topic_id"), ((F.col("seq") * 7) % 1000).alias("url_hash"))
    cold = store.links_by_month(links.where("url_hash % 5 = 0"), made)
    return store.archive_links(links, made, cold).select("topic_id", "url_hash", "month")


@query("""WITH RECURSIVE l AS (SELECT CAST(ts AS DATE) AS day, round(sum(event_id % 100) / 1000.0, 9) AS spent FROM events WHERE event_type = 'purchase' GROUP BY 1),
r AS (SELECT event_id AS at, CAST(ts AS DATE) AS day, 2 * (0.1 * (ceil(CASE WHEN event_id % 4 = 0 THEN 100000 ELSE event_id % 5000 END / 3.0) + 500) + 0.4 * 900) / 1000.0 AS worst,
row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS n FROM events WHERE event_type = 'click'),
f AS (SELECT day, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS at, false AS passes, coalesce(spent, 0.0)::DOUBLE AS total FROM (SELECT DISTINCT day FROM r) LEFT JOIN l USING (day)
UNION ALL SELECT r.day, r.n, r.at, round(f.total + r.worst, 9) <= 20.0, CASE WHEN round(f.total + r.worst, 9) <= 20.0 THEN f.total + r.worst ELSE f.total END FROM f JOIN r ON r.day = f.day AND r.n = f.n + 1)
SELECT CAST(day AS VARCHAR) AS day, f.at FROM f WHERE passes""")
def within_budget(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    ledger = e.where("event_type = 'purchase'").select("day", ((F.col("event_id") % 100) / 1000.0).alias("amount"))
    chars = F.when(F.col("event_id") % 4 == 0, 100_000).otherwise(F.col("event_id") % 5000)  # some are refused, and smaller ones after them pass
    asked = e.where("event_type = 'click'").select("day", F.col("event_id").alias("at"), chars.alias("chars"))
    # Prices of 100 and 400 a million tokens: amounts of the size of the day's budget.
    return enrich.within_budget(asked, ledger, 20.0, 100.0, 400.0, 900).select(F.col("day").cast("string").alias("day"), "at")


@query("""WITH u AS (SELECT CAST(ts AS DATE) AS day, (event_id % 100) / 1000.0 AS amount FROM events) SELECT CAST(day AS VARCHAR) AS day, round(sum(amount), 6) AS amount FROM u GROUP BY 1 ORDER BY 1 DESC LIMIT 10""")
def spend_ledger(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), ((F.col("event_id") % 100) / 1000.0).alias("amount"), "event_type")
    out = enrich.record_spend(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type <> 'purchase' or event_type is null").drop("event_type"), 10)
    return out.select(F.col("day").cast("string").alias("day"), F.round("amount", 6).alias("amount"))


@query("""WITH k AS (SELECT o_custkey % 40 AS day, 't' || o_orderkey AS key, 'id' || o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0),
r AS (SELECT o_custkey % 40 AS day, 't' || o_orderkey AS key, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority ELSE '' END AS title, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END AS summary, 't' || (o_orderkey // 2) AS twin FROM orders)
SELECT r.day, k.id, r.title, nullif(r.summary, '') AS summary, CASE WHEN x.id <> k.id THEN x.id END AS duplicate_of FROM r JOIN k ON k.day = r.day AND k.key = r.key LEFT JOIN k x ON x.day = r.day AND x.key = r.twin WHERE r.title <> ''""")
def model_replies(spark, sf_dir):
    o, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    known = o.where(k % 3 != 0).select((F.col("o_custkey") % 40).alias("day"), F.concat(F.lit("t"), k).alias("key"), F.concat(F.lit("id"), k).alias("id"))
    raw = o.select(
        (F.col("o_custkey") % 40).alias("day"), F.concat(F.lit("t"), k).alias("key"), F.when(k % 7 > 0, F.col("o_orderpriority")).otherwise("").alias("title"),
        F.when(k % 2 == 0, "").otherwise(F.col("o_orderstatus")).alias("summary"), F.concat(F.lit("t"), F.floor(k / 2)).alias("duplicate_key"),
    )
    return enrich.replies(raw, known)


@query(f"""WITH k AS (SELECT o_custkey % 40 AS day, 't' || o_orderkey AS key, o_orderkey AS id FROM orders), r AS (SELECT day, key, {_sql_pick([*SECTIONS, "weather", None], "id")} AS section FROM k)
SELECT k.day, k.id, section FROM r JOIN k USING (day, key) WHERE section IS NOT NULL AND section <> 'weather'""")
def model_sections(spark, sf_dir):
    k = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("day"), F.concat(F.lit("t"), "o_orderkey").alias("key"), F.col("o_orderkey").alias("id"))
    return enrich.sections(k.select("day", "key", _pick([*SECTIONS, "weather", None], F.col("id")).alias("section")), k)


@query(f"""WITH e AS (SELECT event_id, {_sql_pick(["a", "b", "c", "d"], "event_id")} AS name FROM events) SELECT event_id, name FROM e WHERE name NOT IN ('b', 'd')""")
def unregistered_names(spark, sf_dir):
    wanted = _table(spark, sf_dir, "events").select("event_id", _pick(["a", "b", "c", "d"], F.col("event_id")).alias("name"))
    return usage.unregistered(wanted, spark.createDataFrame([("b",), ("d",)], "name string")).select("event_id", "name")


# --- briefings ------------------------------------------------------------------------------------------------------------


def _days(spark, sf_dir) -> DataFrame:  # noqa: ANN001
    """A briefing of every order date: its orders as stories, by price."""
    o = _table(spark, sf_dir, "orders")
    n = F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(1 + F.col("o_orderkey") % 3).cast("int")
    article = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.concat(F.lit("a"), i.cast("string")).alias("title")))
    topic = F.struct(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("headline"), F.array().cast("array<string>").alias("label"), F.col("o_orderstatus").alias("summary"),
        _pick([*SECTIONS, None], F.col("o_orderkey")).alias("section"), F.slice(article, F.lit(1), n).alias("articles"), n.alias("article_count"), n.alias("source_count"),
    )
    cell = F.struct((-F.col("o_totalprice")).alias("place"), F.col("o_orderkey").alias("key"), topic.alias("topic"))
    return o.groupBy(F.col("o_orderdate").cast("date").cast("string").alias("date")).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["topic"]).alias("topics"))


_DAYS = f"""o AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderkey AS id, o_orderpriority AS title, {_sql_pick([*SECTIONS, None], "o_orderkey")} AS section, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 + o_orderkey % 3 END AS n,
row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY -o_totalprice, o_orderkey) AS place, count(*) OVER (PARTITION BY CAST(o_orderdate AS DATE)) AS size FROM orders)"""
_SHOWN = f"{_DAYS}, s AS (SELECT date, row_number() OVER (PARTITION BY date ORDER BY place) AS rank, coalesce(section, 'world') AS section, id FROM o WHERE n > 0)"


@query(f"WITH {_SHOWN} SELECT date, rank, CASE WHEN rank = 1 THEN 'lead' WHEN rank <= 3 THEN 'secondary' WHEN rank <= 7 THEN 'feature' ELSE 'brief' END AS tier, id FROM s WHERE section = 'world'")
def shown_stories(spark, sf_dir):
    return briefing.shown_stories(_days(spark, sf_dir), "world").select("date", F.col("rank").cast("long").alias("rank"), "tier", "id")


@query(f"WITH {_SHOWN} SELECT date, section, count(*) AS n FROM s GROUP BY 1, 2")
def section_counts(spark, sf_dir):
    return briefing.section_counts(briefing.shown_stories(_days(spark, sf_dir))).select("date", "section", "n")


@query(f"WITH {_DAYS} SELECT count(DISTINCT date) AS days, count(*) AS stories, CAST(sum(n) AS BIGINT) AS articles FROM o")
def export_totals(spark, sf_dir):
    return briefing.export_totals(_days(spark, sf_dir))


@query(f"""WITH {_DAYS}, p AS (SELECT date, place AS k, list_sort(list_distinct(list_filter([place, place, place + 2, 9999, 0], lambda s: s >= 1 AND s <= size))) AS stories FROM o WHERE id % 2 = 0),
g AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY k) AS r FROM p), c AS (SELECT date, count(*) AS m FROM g WHERE r <= 5 GROUP BY 1)
SELECT date, 'p' || k AS text, array_to_string(stories, ' ') AS stories FROM g JOIN c USING (date) WHERE r <= 5 AND m >= 2""")
def overview_points(spark, sf_dir):
    days = _days(spark, sf_dir)
    rows = days.select("date", F.posexplode("topics").alias("i", "t")).where(F.col("t.id") % 2 == 0).withColumn("at", F.col("i") + 1)
    points = rows.select("date", "at", F.concat(F.lit("p"), F.col("at").cast("string")).alias("text"), F.array("at", "at", F.col("at") + 2, F.lit(9999), F.lit(0)).alias("stories"))
    told = briefing.with_overview(days, points).where("overview is not null").select("date", F.explode("overview.points").alias("p"))
    return told.select("date", F.col("p.text").alias("text"), F.array_join(F.transform("p.stories", lambda s: s.cast("string")), " ").alias("stories"))


@query(f"WITH {_DAYS} SELECT date, place AS rank, CAST(id AS BIGINT) AS id, title FROM o WHERE date = (SELECT max(date) FROM o)")
def daily_news(spark, sf_dir):
    days = _days(spark, sf_dir)
    last = days.agg(F.max("date")).first()[0]
    return briefing.daily_news(days, last or "").select("date", F.col("rank").cast("long").alias("rank"), F.col("id").cast("long").alias("id"), "title")


# --- greedy choices -------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_A}, w AS (SELECT seq % 40 AS id, coalesce(title, '') AS title, coalesce(nullif(feed_title, ''), nullif(feed_url, ''), url) AS src, url, row_number() OVER (PARTITION BY seq % 40 ORDER BY seq) AS r FROM a),
o AS (SELECT *, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS key FROM w),
g AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[]) AS keys, CAST([] AS VARCHAR[]) AS sources, CAST([] AS VARCHAR[]) AS urls FROM o
UNION ALL SELECT id, r, CASE WHEN t THEN list_append(keys, key) ELSE keys END, CASE WHEN t THEN list_append(sources, src) ELSE sources END, CASE WHEN t THEN list_append(urls, url) ELSE urls END
FROM (SELECT g.id, o.r, keys, sources, urls, key, src, url, len(urls) < 5 AND key <> '' AND NOT list_contains(keys, key) AND NOT list_contains(sources, src) AS t FROM g JOIN o ON o.id = g.id AND o.r = g.r + 1))
SELECT id, array_to_string(urls, ' ') AS urls FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r DESC) AS k FROM g) WHERE k = 1""")
def pick_articles(spark, sf_dir):
    rows = _articles(spark, sf_dir).select((F.col("seq") % 40).alias("id"), "seq", F.lit(None).cast("int").alias("rank"), "title", "feed_title", "feed_url", "url")
    return selection.pick_articles(rows).select("id", F.array_join(F.transform("articles", lambda a: a["url"]), " ").alias("urls"))


@query(f"""WITH {_POOL}, q AS (SELECT day, id, place, final_score, {_sql_list(list(SECTIONS))}[s + 1] AS section, max(final_score) OVER (PARTITION BY day) AS top FROM k),
seats AS (SELECT *, row_number() OVER (PARTITION BY day, section ORDER BY place) AS seat FROM q), f AS (SELECT *, seat = 1 AND section NOT IN ('world', 'politics') AND final_score >= 0.5 * top AS forced FROM seats WHERE seat <= 5),
n AS (SELECT *, row_number() OVER (PARTITION BY day, forced ORDER BY place) AS turn, count(*) FILTER (WHERE forced) OVER (PARTITION BY day) AS taken FROM f) SELECT day, id, section FROM n WHERE forced OR turn <= 15 - taken""")
def select_balanced(spark, sf_dir):
    pool = _pool(_table(spark, sf_dir, "orders")).withColumn("section", _pick(list(SECTIONS), F.col("id")))
    return selection.select_balanced(pool.select("day", "place", "id", "final_score", "section")).select("day", "id", "section")

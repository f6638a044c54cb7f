"""Every registered query of the news engine, with its DuckDB counterpart where SQL can express it.

Tables stand in for the engine's relations: documents for articles, events for logs and streams, orders for keyed
batches, pages for fetched HTML, embeddings for dense vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewire.config import DEFAULTS, SECTIONS
from tidewire.functions import text, urls, values
from tidewire.functions.text import STOPWORDS
from tidewire.operators import archive, briefing, expand, followup, scoring, selection, similar, store, terms, topics, usage
from tidewire.plans import daily
from tidewire.sources.articles import articles_of, day_articles
from tidewire.storage import shared_dir
from tidewire.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

# The article view, in DuckDB.
_A = """a AS (SELECT *, CAST(published_at AS DATE) AS day FROM (SELECT doc_id AS seq, 'https://' || source || '.example.com/' || doc_id AS url,
source AS feed_url, source AS feed_title, left(regexp_extract(text, '^[^\\n.]*'), 120) AS title, left(text, 300) AS summary, lang,
TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 720) * INTERVAL 1 HOUR AS published_at, TIMESTAMP '2024-01-01 01:00:00' + (doc_id % 720) * INTERVAL 1 HOUR AS fetched_at,
CASE WHEN doc_id % 10 = 9 THEN 2 ELSE 1 END AS source_type FROM documents))"""
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_STEM = """CASE WHEN length(t) <= 3 THEN t WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%ing' AND length(t) > 5 THEN left(t, length(t) - 3)
WHEN t LIKE '%ed' AND length(t) > 4 THEN left(t, length(t) - 2) WHEN t LIKE '%es' AND length(t) > 4 THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND length(t) > 4 THEN left(t, length(t) - 1) ELSE t END"""
_K = f"""k AS (SELECT *, list_filter(list_transform(list_filter(list_transform(regexp_extract_all(regexp_replace(lower(title), '[''’]s\\b', '', 'g'), '[\\p{{L}}\\p{{N}}]+'), lambda w: strip_accents(w)),
lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w) AND NOT regexp_full_match(w, '[0-9]+')), lambda t: {_STEM}), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t)) AS stems FROM a WHERE source_type = 1)"""
_D = """d AS (SELECT day, seq AS doc_id, headline_key, stems, list_concat(stems, [stems[i] || ' ' || stems[i + 1] FOR i IN range(1, len(stems))]) AS terms, copies, sources FROM (
SELECT *, array_to_string(stems, ' ') AS headline_key, count(*) OVER w AS copies, row_number() OVER (PARTITION BY day, array_to_string(stems, ' ') ORDER BY published_at DESC, feed_url, title, seq) AS r,
len(list_distinct(list(feed_url) OVER w)) AS sources FROM k WHERE len(stems) > 0 WINDOW w AS (PARTITION BY day, array_to_string(stems, ' '))) WHERE r = 1)"""
_TFIDF = """x AS (SELECT day, doc_id, len(terms) AS size, unnest(terms) AS term FROM d), n AS (SELECT day, count(*) AS n FROM d GROUP BY day), df AS (SELECT day, term, count(DISTINCT doc_id) AS df FROM x GROUP BY day, term),
v AS (SELECT x.day, x.doc_id, x.term, count(*) / max(x.size) * (ln((1 + max(n.n)) / (1 + max(df.df))) + 1) AS weight FROM x JOIN n USING (day) JOIN df USING (day, term) GROUP BY x.day, x.doc_id, x.term)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_of(_table(spark, sf_dir, "documents"))


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).where("source_type = 1")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


# --- scans, filters, statistics -------------------------------------------------------------------------------------------


@query(f"WITH {_A} SELECT seq, url, title, feed_url FROM a WHERE source_type = 1 AND title <> '' AND published_at >= TIMESTAMP '2024-01-10' AND published_at < TIMESTAMP '2024-01-11'")
def day_scan(spark, sf_dir):
    return day_articles(_articles(spark, sf_dir), "2024-01-10").select("seq", "url", "title", "feed_url")


@query(f"WITH {_A} SELECT title, feed_url FROM a WHERE source_type = 1 AND title <> '' AND CAST(published_at AS DATE) = DATE '2024-01-10' ORDER BY published_at DESC, feed_url, title LIMIT 7")
def day_scan_topk(spark, sf_dir):
    return day_articles(_articles(spark, sf_dir), "2024-01-10", limit=7).select("title", "feed_url")


@query(f"WITH {_A} SELECT seq, title, summary FROM a WHERE source_type = 2 AND title <> '' AND day = DATE '2024-01-10'")
def video_scan(spark, sf_dir):
    return day_articles(_articles(spark, sf_dir), "2024-01-10", 2).select("seq", "title", "summary")


@query("SELECT count(*) AS n FROM documents")
def article_count(spark, sf_dir):
    return _articles(spark, sf_dir).agg(F.count("*").alias("n"))


@query(f"""WITH {_A} SELECT count(*) AS total, count(*) FILTER (WHERE fetched_at > TIMESTAMP '2024-01-30') AS last_day, count(*) FILTER (WHERE fetched_at > TIMESTAMP '2024-01-24') AS last_week,
count(DISTINCT feed_url) AS feeds FROM a""")
def article_stats(spark, sf_dir):
    return store.statistics(_articles(spark, sf_dir), "2024-01-31 00:00:00")


@query(f"WITH {_A} SELECT seq, title FROM a ORDER BY fetched_at DESC, seq LIMIT 5")
def latest_rows(spark, sf_dir):
    return store.latest(_articles(spark, sf_dir)).select("seq", "title")


@query(f"WITH {_A} SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM a WHERE source_type = 1 GROUP BY 1 HAVING count(*) >= 25")
def active_days(spark, sf_dir):
    return store.active_days(_articles(spark, sf_dir), 25).select(F.col("day").cast("string").alias("day"), "n")


@query(f"WITH {_A} SELECT DISTINCT CAST(day AS VARCHAR) AS day FROM a")
def distinct_days(spark, sf_dir):
    return _articles(spark, sf_dir).select(F.col("day").cast("string").alias("day")).distinct()


@query(f"WITH {_A} SELECT seq, feed_url FROM (SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY seq) AS r FROM a) WHERE r <= 10")
def feed_item_cap(spark, sf_dir):
    order = Window.partitionBy("feed_url").orderBy("seq")
    return _articles(spark, sf_dir).withColumn("r", F.row_number().over(order)).where("r <= 10").select("seq", "feed_url")


# --- keyed storage --------------------------------------------------------------------------------------------------------

_HALVES = """t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS summary FROM orders WHERE o_orderkey % 4 <> 0),
s AS (SELECT o_orderkey AS k, o_orderpriority AS title, 'S' || o_orderstatus AS summary, o_custkey AS seq FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey AS k, 'late' AS title, 'late' AS summary, 1000000000 AS seq FROM orders WHERE o_orderkey % 6 = 0)"""


def _halves(spark, sf_dir):
    o, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    target = o.where(k % 4 != 0).select(k.alias("k"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("summary"))
    first = o.where(k % 2 == 0).select(k.alias("k"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("S"), "o_orderstatus").alias("summary"), F.col("o_custkey").alias("seq"))
    late = o.where(k % 6 == 0).select(k.alias("k"), F.lit("late").alias("title"), F.lit("late").alias("summary"), F.lit(1000000000).cast("long").alias("seq"))
    return target, first.union(late)


@query(f"WITH {_HALVES} SELECT k, title, summary FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS r FROM s) WHERE r = 1 AND k NOT IN (SELECT k FROM t)")
def insert_ignore(spark, sf_dir):
    target, batch = _halves(spark, sf_dir)
    return store.insert_or_ignore(target, batch, "k").select("k", "title", "summary")


@query(f"""WITH {_HALVES}, f AS (SELECT k, arg_min(title, seq) AS title, arg_min(summary, seq) AS summary FROM s GROUP BY k)
SELECT t.k, coalesce(nullif(t.title, ''), f.title, t.title) AS title, coalesce(nullif(t.summary, ''), f.summary) AS summary FROM t LEFT JOIN f USING (k)""")
def enrich_upsert(spark, sf_dir):
    target, batch = _halves(spark, sf_dir)
    return store.enrich(target, batch, "k", ("title", "summary"))


@query(f"""WITH {_HALVES}, f AS (SELECT k, arg_min(title, seq) AS title, arg_min(summary, seq) AS summary FROM s GROUP BY k)
SELECT t.k, coalesce(nullif(t.title, ''), f.title, t.title) AS title, coalesce(nullif(t.summary, ''), f.summary) AS summary FROM t LEFT JOIN f USING (k)
UNION ALL SELECT k, title, summary FROM f WHERE k NOT IN (SELECT k FROM t)""")
def upsert(spark, sf_dir):
    target, batch = _halves(spark, sf_dir)
    return store.upsert(target, batch, "k", ("title", "summary")).select("k", "title", "summary")


# Rows fetched long before or after they are dated, with and without content.
_STORED = """s AS (SELECT seq, url, published_at, TIMESTAMP '2023-11-01 00:00:00' + (seq * 37 % 4000) * INTERVAL 1 HOUR AS fetched_at, CASE WHEN seq % 3 > 0 THEN title END AS title, CASE WHEN seq % 2 > 0 THEN summary END AS summary,
CASE WHEN seq % 5 > 0 THEN 'https://i.example/' || seq END AS image_url, 'w' || seq % 7 AS author, feed_title, lang AS tags, 'f' || seq AS raw_fingerprint FROM a),
m AS (SELECT strftime(fetched_at, '%Y-%m') AS month, count(*) AS n FROM s WHERE fetched_at < TIMESTAMP '2024-01-19' AND (summary IS NOT NULL OR image_url IS NOT NULL OR title IS NOT NULL) GROUP BY 1)"""


def _stored(spark, sf_dir):
    a, seq = _articles(spark, sf_dir), F.col("seq")
    return a.select(
        "seq", "url", "published_at", F.timestamp_seconds(F.lit(1698796800) + seq * 37 % 4000 * 3600).alias("fetched_at"), F.when(seq % 3 > 0, F.col("title")).alias("title"), F.when(seq % 2 > 0, F.col("summary")).alias("summary"),
        F.when(seq % 5 > 0, F.concat(F.lit("https://i.example/"), seq)).alias("image_url"), F.concat(F.lit("w"), seq % 7).alias("author"), "feed_title", F.col("lang").alias("tags"), F.concat(F.lit("f"), seq).alias("raw_fingerprint"),
    )


@query(f"WITH {_A}, {_STORED} SELECT month, n FROM m")
def archive_month_histogram(spark, sf_dir):
    return store.month_histogram(store.archivable(_stored(spark, sf_dir), "2024-01-19"))


@query(f"""WITH {_A}, {_STORED} SELECT seq, title, url, CASE WHEN gone THEN NULL ELSE summary END AS summary, CASE WHEN gone THEN NULL ELSE image_url END AS image_url, CASE WHEN gone THEN NULL ELSE author END AS author,
CASE WHEN gone THEN NULL ELSE feed_title END AS feed_title, CASE WHEN gone THEN NULL ELSE tags END AS tags, CASE WHEN gone THEN NULL ELSE raw_fingerprint END AS raw_fingerprint
FROM (SELECT *, fetched_at < TIMESTAMP '2024-01-19' AND strftime(fetched_at, '%Y-%m') IN (SELECT month FROM m) AS gone FROM s)""")
def archive_stub(spark, sf_dir):
    return store.stub(_stored(spark, sf_dir), "2024-01-19").drop("published_at", "fetched_at")


@query(f"WITH {_A}, {_STORED} SELECT seq FROM s WHERE fetched_at < TIMESTAMP '2024-01-19' AND (summary IS NOT NULL OR image_url IS NOT NULL OR title IS NOT NULL)")
def archivable(spark, sf_dir):
    return store.archivable(_stored(spark, sf_dir), "2024-01-19").select("seq")


@query(f"""WITH {_A}, {_STORED} SELECT seq, strftime(fetched_at, '%Y-%m') AS month, title, summary, author FROM s WHERE fetched_at < TIMESTAMP '2024-01-19' AND (summary IS NOT NULL OR image_url IS NOT NULL OR title IS NOT NULL)""")
def archive_runs(spark, sf_dir):
    """Two runs of the archive, the second over what the first left: rows are archived once, with the columns that they had."""
    table = archive.archive_table(spark, shared_dir(spark), "seq")
    hot, _ = archive.archive_articles(_stored(spark, sf_dir), table, "2023-12-10")
    archive.archive_articles(hot, table, "2024-01-19")
    return table.read().select("seq", "month", "title", "summary", "author")


@query(f"WITH {_A} SELECT seq, title, CAST(NULL AS VARCHAR) AS lang FROM a WHERE seq % 3 = 0 UNION ALL BY NAME SELECT seq, lang, title FROM a WHERE seq % 3 <> 0")
def archive_union_by_name(spark, sf_dir):
    a = _articles(spark, sf_dir)
    cold, fresh = a.where("seq % 3 = 0").select("seq", "title"), a.where("seq % 3 <> 0 or seq % 2 = 0").select("lang", "title", "seq")
    return store.merge_archive(cold, fresh, "seq").select("seq", "title", "lang")


_LINKS = "t AS (SELECT 'topic_' || seq AS id, day AS topic_date, title, seq FROM a), l AS (SELECT 'topic_' || seq AS topic_id, seq AS url_hash FROM a WHERE seq % 2 = 0)"


def _linked(spark, sf_dir):
    a = _articles(spark, sf_dir).select("seq", F.col("seq").alias("url_hash"), "title", "day")
    made = a.select(F.concat(F.lit("topic_"), "seq").alias("id"), F.col("day").alias("topic_date"), F.array("title").alias("sample_headlines"))
    return a, made, a.where("seq % 2 = 0").select(F.concat(F.lit("topic_"), "seq").alias("topic_id"), "url_hash")


@query(f"WITH {_A}, {_LINKS} SELECT CAST(topic_date AS VARCHAR) AS topic_date, count(DISTINCT id) AS broken FROM t LEFT JOIN l ON l.topic_id = t.id WHERE l.topic_id IS NULL GROUP BY 1")
def topic_links_missing(spark, sf_dir):
    _, made, links = _linked(spark, sf_dir)
    return store.missing_links(made, links).select(F.col("topic_date").cast("string").alias("topic_date"), "broken")


@query(f"""WITH {_A}, {_LINKS}, f AS (SELECT lower(title) AS key, arg_min(seq, seq) AS url_hash FROM a GROUP BY 1)
SELECT DISTINCT id AS topic_id, url_hash FROM t JOIN f ON f.key = lower(t.title) WHERE id NOT IN (SELECT topic_id FROM l)""")
def link_repair(spark, sf_dir):
    a, made, links = _linked(spark, sf_dir)
    return store.repair_links(made, links, a)


@query(f"WITH {_A}, {_LINKS} SELECT topic_id, url_hash FROM l WHERE topic_id IN (SELECT id FROM t WHERE topic_date >= DATE '2024-01-21')")
def prune_links(spark, sf_dir):
    _, made, links = _linked(spark, sf_dir)
    return store.prune(made, links, "2024-01-31", 10)[1].select("topic_id", "url_hash")


@query(f"""WITH {_A}, p AS (SELECT 'topic_' || (seq % 50) AS topic_id, source_type, published_at, seq FROM a WHERE title IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY source_type = 2 DESC, published_at DESC, seq) AS position FROM p) SELECT topic_id, seq, position FROM r WHERE position <= 10""")
def topic_articles(spark, sf_dir):
    a = _articles(spark, sf_dir).withColumn("url_hash", F.col("seq")).withColumn("image_url", F.lit(None).cast("string"))
    links = a.select(F.concat(F.lit("topic_"), (F.col("seq") % 50).cast("string")).alias("topic_id"), "url_hash")
    cold = a.where("seq % 9 = 0").select("url_hash", "feed_title", "image_url")
    return store.articles_of_topic(links, a, cold, 10).select("topic_id", "seq", "position")


# --- scalar functions -----------------------------------------------------------------------------------------------------


@query(f"WITH {_A} SELECT seq, CAST(CAST(concat('0x', substr(sha256(url), 1, 16)) AS UBIGINT) AS VARCHAR) AS hash, 'topic_' || ltrim(substr(sha256(url), 1, 16), '0') AS id FROM a")
def hash64(spark, sf_dir):
    return _articles(spark, sf_dir).select("seq", values.hash64(F.col("url")).cast("string").alias("hash"), values.hex_id("topic_", F.col("url")).alias("id"))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')) AS url_key FROM pages")
def normalize_url(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("url_key"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^utm_') AND NOT regexp_matches(p, '^(ref|fbclid|gclid|mc_cid|mc_eid|ref_src)='))) AS q FROM pages)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' WHEN path <> '/' THEN regexp_replace(path, '/$', '') ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM u""")
def canonicalize_url(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.canonicalize(F.col("url")).alias("canonical"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM pages")
def domain_of(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


@query(r"""SELECT page_id, nullif(trim(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style).*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
'[\s\x{0B}\x{A0}]+', ' ', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')), '') AS cleaned FROM pages""")
def clean_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html")).alias("cleaned"))


@query("SELECT page_id, nullif(regexp_extract(html, '<img[^>]+src=[\"'']?([^\"''\\s>]+)', 1, 'i'), '') AS image FROM pages")
def extract_image(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.html_image(F.col("html")).alias("image"))


@query("SELECT doc_id, CASE WHEN length(f) > 80 THEN left(f, 79) || '…' ELSE f END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS f FROM documents)")
def truncated(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 80).alias("short"))


@query(f"WITH {_A} SELECT seq, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS title_key FROM a")
def title_keys(spark, sf_dir):
    return _articles(spark, sf_dir).select("seq", text.title_key(F.col("title")).alias("title_key"))


@query("SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part, CAST(floor(epoch_ms(ts) / 1800000) AS BIGINT) AS bucket, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def time_parts(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    return _table(spark, sf_dir, "events").select("event_id", values.part_of_day(at).alias("part"), values.bucket(at).alias("bucket"), values.iso(at).alias("iso"))


@query("SELECT event_id, least(10.0 * pow(2, least(1 + event_id % 8 - 1, 4)), 1440.0) AS wait, CASE WHEN value IS NULL OR isnan(value) THEN 0.0 ELSE greatest(0.0, least(1.0, value / 100)) END AS clamped FROM events")
def numeric_rules(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", values.backoff_minutes(F.lit(10.0), 1 + F.col("event_id") % 8).alias("wait"), values.clamp01(F.col("value") / 100).alias("clamped"))


@query("SELECT event_id, strftime(CASE WHEN p > f + INTERVAL 24 HOUR THEN f ELSE p END, '%Y-%m-%d %H:%M:%S') AS published FROM (SELECT event_id, ts + (event_id % 5) * INTERVAL 12 HOUR AS p, ts AS f FROM events)")
def future_clamp(spark, sf_dir):
    f = F.col("ts").cast("timestamp")
    p = f + F.make_dt_interval(F.lit(0), ((F.col("event_id") % 5) * 12).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", F.date_format(values.publication_time(p, f), "yyyy-MM-dd HH:mm:ss").alias("published"))


# --- text analytics -------------------------------------------------------------------------------------------------------


@query(f"WITH {_A}, {_K} SELECT seq, array_to_string(stems, ' ') AS stems, CAST(len(stems) + greatest(len(stems) - 1, 0) AS INTEGER) AS n_terms FROM k")
def headline_terms(spark, sf_dir):
    rows = _news(spark, sf_dir).select("seq", F.transform(text.tokens(F.col("title")), lambda t: t["stem"]).alias("stems"))
    return rows.select("seq", F.array_join("stems", " ").alias("stems"), F.size(text.terms(F.col("stems"))).alias("n_terms"))


@query(f"WITH {_A}, {_K}, {_D} SELECT CAST(day AS VARCHAR) AS day, headline_key, doc_id, copies FROM d")
def syndication_collapse(spark, sf_dir):
    found = terms.headline_documents(_titled(_news(spark, sf_dir)))
    return found.select(F.col("day").cast("string").alias("day"), "headline_key", "doc_id", F.size("copies").cast("long").alias("copies"))


def _titled(articles):
    """Only titles count here, as in the SQL; the engine falls back to summaries."""
    return articles.withColumn("summary", F.lit(""))


@query(f"WITH {_A}, {_K}, {_D}, x AS (SELECT DISTINCT day, doc_id, unnest(terms) AS term FROM d) SELECT CAST(day AS VARCHAR) AS day, term, count(*) AS df FROM x GROUP BY 1, 2")
def document_frequency(spark, sf_dir):
    found = terms.document_frequency(terms.headline_documents(_titled(_news(spark, sf_dir))))
    return found.select(F.col("day").cast("string").alias("day"), "term", "df")


@query(f"WITH {_A}, {_K}, {_D}, {_TFIDF} SELECT CAST(day AS VARCHAR) AS day, doc_id, term, round(weight, 6) AS weight FROM v")
def tfidf(spark, sf_dir):
    found = terms.tfidf(terms.headline_documents(_titled(_news(spark, sf_dir))))
    return found.select(F.col("day").cast("string").alias("day"), "doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_A}, {_K}, {_D}, {_TFIDF}, m AS (SELECT day, doc_id, sqrt(sum(weight * weight)) AS norm FROM v GROUP BY day, doc_id),
p AS (SELECT a.day, a.doc_id AS left_id, b.doc_id AS right_id, sum(a.weight * b.weight) AS dot FROM v a JOIN v b ON a.day = b.day AND a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2, 3)
SELECT CAST(p.day AS VARCHAR) AS day, left_id, right_id, round(dot / (x.norm * y.norm), 6) AS similarity FROM p JOIN m x ON x.day = p.day AND x.doc_id = left_id JOIN m y ON y.day = p.day AND y.doc_id = right_id WHERE dot / (x.norm * y.norm) >= 0.3""")
def headline_similarity(spark, sf_dir):
    long = terms.tfidf(terms.headline_documents(_titled(_news(spark, sf_dir))))
    left, right = long.select("day", F.col("doc_id").alias("left_id"), "term", "weight"), long.select("day", F.col("doc_id").alias("right_id"), "term", "weight")
    pairs = similar.similarity_join(left, right, ["day"], 0.3).where("left_id < right_id")
    return pairs.select(F.col("day").cast("string").alias("day"), "left_id", "right_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_A} SELECT seq, array_to_string([e FOR e IN list_distinct_ordered IF true], '|') AS entities FROM (SELECT seq, [x FOR x, i IN u IF list_position(u, x) = i][1:12] AS list_distinct_ordered FROM (
SELECT seq, [e FOR e IN regexp_extract_all(title, '\\b(?:[A-Z][a-zA-Z0-9]+|[A-Z]{{2,}})(?:\\s+(?:[A-Z][a-zA-Z0-9]+|[A-Z]{{2,}})){{0,3}}\\b') IF length(e) > 1 AND NOT list_contains({_STOP}, lower(e))] AS u FROM a))""")
def entities(spark, sf_dir):
    return _articles(spark, sf_dir).select("seq", F.array_join(text.entities(F.col("title")), "|").alias("entities"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id AS probe, b.vec_id AS match, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS similarity
FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.3""")
def cosine_pairs(spark, sf_dir):
    """Probes (ids divisible by 100) against all vectors, as products of matrices."""
    e = _table(spark, sf_dir, "embeddings")
    probes = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("vector"))
    pairs = similar.dense_join(probes, e.select(F.col("vec_id").alias("match"), F.col("embedding").alias("vector")), 0.3, "probe", "match")
    return pairs.where("probe <> match").select("probe", "match", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_A}, {_K}, {_D} SELECT CAST(day AS VARCHAR) AS day, headline_key, copies AS articles, sources, rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY sources DESC, copies DESC, headline_key) AS rank FROM d) WHERE rank <= 20""")
def top_stories(spark, sf_dir):
    """Each day's most widely carried headlines."""
    found = terms.headline_documents(_titled(_news(spark, sf_dir)))
    found = found.select("day", "headline_key", F.size("copies").cast("long").alias("articles"), F.size(F.array_distinct(F.transform("copies", lambda c: c["feed_url"]))).cast("long").alias("sources"))
    order = Window.partitionBy("day").orderBy(F.desc("sources"), F.desc("articles"), "headline_key")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 20")
    return ranked.withColumn("day", F.col("day").cast("string"))


@query()
def story_clusters(spark, sf_dir):
    """Sequential leader clustering: held against golden cases in the tests."""
    made = topics.stories(_news(spark, sf_dir))
    return made.select("day", "id", "headline", "article_count", "unique_source_count", "label_keywords", "entities", "theme_id")


@query()
def scored_stories(spark, sf_dir):
    made = daily.detect_days(_news(spark, sf_dir))
    return made.select("day", "rank", "id", "headline", "status", F.round("final_score", 6).alias("final_score"), "article_count", "unique_source_count")


@query()
def one_day(spark, sf_dir):
    """A day with its history and follow-ups, as the hourly run does it."""
    articles = _articles(spark, sf_dir)
    before = daily.detect_days(articles.where("source_type = 1 and day < date '2024-01-10'"))
    made = daily.detect_day(articles, before, "2024-01-10")
    return made.select("rank", "id", "headline", "status", "final_score", "article_count", "video_hashes")


@query()
def daily_briefings(spark, sf_dir):
    news = _news(spark, sf_dir)
    feeds = spark.createDataFrame([(f"src{i}", SECTIONS[1 + i % 6]) for i in range(12)], "feed_url string, section string")
    return daily.brief(daily.detect_days(news), news, feeds, "2024-02-01T00:00:00.000Z")


# --- scores and choices ---------------------------------------------------------------------------------------------------

_DAILY = """c AS (SELECT CAST(ts AS DATE) AS day, event_type AS id, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2),
h AS (SELECT x.day, x.id, x.n, x.users, count(y.n) AS m, avg(y.n) AS mean, stddev_pop(y.n) AS dev FROM c x LEFT JOIN c y ON x.id = y.id AND y.day < x.day AND y.day >= x.day - 7 GROUP BY 1, 2, 3, 4),
b AS (SELECT *, CASE WHEN m = 0 THEN CASE WHEN n >= 2 THEN 3.0 ELSE 0.0 END WHEN dev > 0 THEN (n - mean) / dev WHEN n > mean THEN 3.0 ELSE 0.0 END AS z, max(users) OVER (PARTITION BY day) AS most FROM h),
g AS (SELECT *, CASE WHEN m = 0 THEN CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, least(1.0, z / 3)) END AS burst, CASE WHEN most > 1 THEN ln(1 + users) / ln(1 + most) ELSE users / n END AS significance FROM b),
s AS (SELECT *, greatest(0.0, least(1.0, 0.45 * significance + 0.25 * burst + 0.2 * novelty + 0.1 * 0.5)) AS score FROM (SELECT *, (length(id) % 10) / 10.0 AS novelty FROM g))"""


def _scores(spark, sf_dir):
    e = _table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    past = Window.partitionBy("id").orderBy(F.unix_date("day")).rangeBetween(-7, -1)
    h = e.withColumn("m", F.count("n").over(past)).withColumn("mean", F.avg("n").over(past)).withColumn("dev", F.stddev_pop("n").over(past))
    z = scoring.burst(F.col("n"), F.col("m"), F.col("mean"), F.col("dev"))
    h = h.withColumn("z", z).withColumn("burst", scoring.normalized_burst(F.col("n"), F.col("m"), F.col("z"))).withColumn("most", F.max("users").over(Window.partitionBy("day")))
    h = h.withColumn("novelty", (F.length("id") % 10) / F.lit(10.0)).withColumn("significance", scoring.significance(F.col("users"), F.col("most"), F.col("n")))
    return h.withColumn("score", scoring.final_score(F.col("significance"), F.col("burst"), F.col("novelty"), F.lit(0.5)))


@query(f"WITH {_DAILY} SELECT CAST(day AS VARCHAR) AS day, id, round(z, 6) AS z, round(burst, 6) AS burst, round(score, 6) AS score FROM s")
def topic_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select(F.col("day").cast("string").alias("day"), "id", F.round("z", 6).alias("z"), F.round("burst", 6).alias("burst"), F.round("score", 6).alias("score"))


@query(f"""WITH {_DAILY} SELECT CAST(day AS VARCHAR) AS day, id, CASE WHEN 1 - novelty >= 0.4 THEN CASE WHEN z >= 2 OR burst >= 0.8 THEN 'trending' ELSE 'ongoing' END WHEN novelty >= 0.7 THEN 'new'
WHEN z >= 2 OR burst >= 0.8 THEN 'trending' ELSE 'monitor' END AS status FROM s""")
def topic_status(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return s.select(F.col("day").cast("string").alias("day"), "id", scoring.status(1 - F.col("novelty"), F.col("novelty"), F.col("z"), F.col("burst")).alias("status"))


@query(f"WITH {_DAILY} SELECT CAST(day AS VARCHAR) AS day, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 9) DESC, n DESC, users DESC, id) AS rank FROM s)")
def topic_rank(spark, sf_dir):
    order = Window.partitionBy("day").orderBy(F.desc(F.round("score", 9)), F.desc("n"), F.desc("users"), "id")
    return _scores(spark, sf_dir).select(F.col("day").cast("string").alias("day"), "id", F.row_number().over(order).cast("long").alias("rank"))


_POOL = """r AS (SELECT o_custkey % 40 AS day, o_orderkey AS id, o_totalprice / 1000 AS final_score, CASE WHEN o_orderkey % 3 = 0 THEN 'theme_' || (o_orderkey % 7) END AS theme_id, o_orderkey % 7 AS s,
row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY day, coalesce(theme_id, 'own:' || id) ORDER BY rank) AS t, max(final_score) OVER (PARTITION BY day) * 0.4 AS floor FROM r),
c AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY rank) AS place FROM t WHERE t = 1), k AS (SELECT * FROM c WHERE (final_score >= floor OR place <= 5) AND place <= 40)"""


def _pool(orders):
    rows = orders.select((F.col("o_custkey") % 40).alias("day"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("final_score"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("theme_"), (F.col("o_orderkey") % 7).cast("string"))).alias("theme_id"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("final_score"), "id")))
    return selection.candidates(ranked)


@query(f"WITH {_POOL} SELECT day, id, place FROM k")
def candidates(spark, sf_dir):
    return _pool(_table(spark, sf_dir, "orders")).select("day", "id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_A}, r AS (SELECT seq % 60 AS id, feed_url, CASE CAST(substr(feed_url, 4) AS INTEGER) % 4 WHEN 1 THEN 'politics' WHEN 2 THEN 'sports' WHEN 3 THEN 'culture' END AS section FROM a),
f AS (SELECT id, count(DISTINCT feed_url) AS feeds FROM r GROUP BY 1), v AS (SELECT id, section, count(DISTINCT feed_url) AS votes FROM r WHERE section IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, list_position(['politics', 'sports', 'culture'], section)) AS r FROM v)
SELECT f.id, CASE WHEN b.votes / f.feeds >= 0.3 THEN b.section ELSE 'world' END AS section FROM f LEFT JOIN b ON b.id = f.id AND b.r = 1""")
def section_vote(spark, sf_dir):
    rows = _articles(spark, sf_dir).select((F.col("seq") % 60).alias("id"), "feed_url")
    feeds = spark.createDataFrame([(f"src{i}", {1: "politics", 2: "sports", 3: "culture"}[i % 4]) for i in range(20) if i % 4], "feed_url string, section string")
    return selection.section_vote(rows, feeds)


@query(f"""WITH {_A}, f AS (SELECT seq % 25 AS id, seq, feed_title, row_number() OVER (PARTITION BY seq % 25, feed_title ORDER BY seq) AS c FROM a WHERE source_type = 2)
SELECT id, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM f WHERE c = 1) WHERE k <= 3""")
def pick_videos(spark, sf_dir):
    rows = _articles(spark, sf_dir).where("source_type = 2").withColumn("id", F.col("seq") % 25)
    return selection.pick_videos(rows).select("id", "seq")


@query(f"WITH {_A}, s AS (SELECT DISTINCT CAST(day AS VARCHAR) AS date FROM a WHERE day(day) % 3 <> 0) SELECT date, lag(date) OVER (ORDER BY date) AS previous, lead(date) OVER (ORDER BY date) AS next FROM s")
def date_neighbours(spark, sf_dir):
    return briefing.neighbours(_articles(spark, sf_dir).where(F.dayofmonth("day") % 3 != 0).select(F.col("day").cast("string").alias("date")))


# --- logs, events, feeds --------------------------------------------------------------------------------------------------

_LOG = "l AS (SELECT 'feed' || (user_id % 50) AS feed_url, ts AS t, event_type <> 'error' AS ok, event_id FROM events)"


def _log(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("feed"), (F.col("user_id") % 50).cast("string")).alias("feed_url"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("ok"), F.lit(10.0).alias("interval_minutes"))


@query(f"""WITH {_LOG}, m AS (SELECT *, max(CASE WHEN ok THEN t END) OVER (PARTITION BY feed_url) AS last_success FROM l),
s AS (SELECT feed_url, count(*) FILTER (WHERE NOT ok AND (last_success IS NULL OR t > last_success)) AS failures, max(t) AS last_at FROM m GROUP BY 1)
SELECT feed_url, CAST(failures AS INTEGER) AS failure_count, CAST(epoch_us(last_at) + CASE WHEN failures > 0 THEN least(10.0 * pow(2, least(failures - 1, 4)), 1440) ELSE 10.0 END * 60000000 AS BIGINT) AS next_poll FROM s""")
def poll_state(spark, sf_dir):
    return ingest.poll_states(_log(spark, sf_dir)).select("feed_url", "failure_count", F.unix_micros("next_poll").alias("next_poll"))


@query(f"""WITH {_LOG}, s AS (SELECT feed_url, max(t) + INTERVAL 10 MINUTE AS next FROM l GROUP BY 1), f AS (SELECT 'feed' || range AS url FROM range(60))
SELECT url FROM f LEFT JOIN s ON s.feed_url = f.url WHERE next IS NULL OR next <= TIMESTAMP '2024-01-30 12:00:00'""")
def due_feeds(spark, sf_dir):
    from tidewire.sources.feeds import due

    state = _log(spark, sf_dir).groupBy("feed_url").agg((F.max("at") + F.expr("interval 10 minutes")).alias("next_poll"))
    feeds = spark.range(60).select(F.concat(F.lit("feed"), F.col("id").cast("string")).alias("url"), F.lit(True).alias("enabled"))
    return due(feeds, state, "2024-01-30 12:00:00").select("url")


@query("SELECT count(*) AS polled, count(*) FILTER (WHERE event_type = 'error') AS transient, count(*) FILTER (WHERE event_type = 'signup') AS hard, CAST(sum(event_id % 1000) AS BIGINT) AS total_ms, max(event_id % 1000) AS slowest_ms FROM events")
def run_metrics(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    error = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "signup", "HTTP 404")
    return ingest.run_metrics(e.select(error.alias("error"), (F.col("event_id") % 1000).alias("duration_ms")))


@query("""SELECT event_id AS request_id, unnest(list_filter(['page_view', CASE WHEN event_type = 'signup' THEN 'connect' WHEN event_type = 'view' THEN 'list_tools' WHEN event_type IN ('click', 'purchase') THEN 'use_tool' END,
CASE WHEN event_type = 'error' THEN 'error' END], lambda x: x IS NOT NULL)) AS event, CAST(floor(epoch_ms(ts) / 1800000) AS BIGINT) AS session, greatest(1, event_id % 300) AS engagement_ms FROM events""")
def usage_events(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type") == "signup", "initialize").when(F.col("event_type") == "view", "tools/list")
        .when(F.col("event_type").isin("click", "purchase", "error"), "tools/call")
    )
    requests = e.select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("method"), F.lit("get_topic").alias("tool"), F.lit("Claude").alias("client_name"), F.lit("x").alias("agent"),
        (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 300).alias("duration_ms"), F.lit(1).alias("result_count"), F.to_date("ts").alias("date"),
    )
    return usage.events(requests).select("request_id", "event", "session", F.col("engagement_ms").cast("long").alias("engagement_ms"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS key, CASE WHEN page_id % 2 = 0 THEN 'n' || page_id END AS name FROM pages)
SELECT key || '/' AS key, min(page_id) AS at, arg_min(name, CASE WHEN name IS NOT NULL THEN page_id END) AS name FROM u GROUP BY 1""")
def merge_feeds(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    root = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit("/?utm_source=x"))
    entries = p.select(root.alias("url"), F.col("page_id").alias("at"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("n"), F.col("page_id").cast("string"))).alias("name"))
    return expand.merge_feeds(entries).select("key", "at", "name")


@query("""WITH t AS (SELECT event_id, [user_id % 9, (user_id + 1) % 9] AS visible, event_id % 40 AS idle FROM events), s AS (SELECT unnest(visible) AS story, 1.0 / len(visible) AS share FROM t WHERE idle <= 30)
SELECT story, round(sum(share), 6) AS seconds FROM s GROUP BY 1 HAVING sum(share) >= 5""")
def reading_time(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    ticks = e.select(F.array(F.col("user_id") % 9, (F.col("user_id") + 1) % 9).alias("visible"), (F.col("event_id") % 40).alias("idle_seconds"))
    return usage.reading_time(ticks).select("story", F.round("seconds", 6).alias("seconds"))


@query(f"""WITH {_A}, l AS (SELECT CAST(day AS VARCHAR) AS date, list_sort(list(DISTINCT seq)) AS ids FROM a GROUP BY 1), r AS (SELECT CAST(day AS VARCHAR) AS date, list(seq) AS seen FROM a WHERE seq % 3 = 0 GROUP BY 1)
SELECT date, array_to_string([i FOR i IN ids IF NOT list_contains(coalesce(seen, []), i)], ' ') AS unread FROM l LEFT JOIN r USING (date)""")
def unread(spark, sf_dir):
    rows = _articles(spark, sf_dir).select(F.col("day").cast("string").alias("date"), F.col("seq").alias("id"))
    days = ingest.unread(rows.select("date", F.lpad(F.col("id").cast("string"), 12, "0").alias("id")), rows.where("id % 3 = 0").select("date", F.lpad(F.col("id").cast("string"), 12, "0").alias("id")))
    return days.select("date", F.array_join(F.transform("unread", lambda i: i.cast("long").cast("string")), " ").alias("unread"))


@query()
def follow_up_anchors(spark, sf_dir):
    """Anchors of one day's leading headlines in the next: held against the reference's own cases in the tests."""
    news = _news(spark, sf_dir)
    docs = terms.headline_documents(news)
    lead = docs.where(F.col("day") == F.lit("2024-01-09").cast("date")).orderBy(F.desc(F.size("copies")), "doc_id").limit(20)
    stories = lead.select(
        F.row_number().over(Window.orderBy("doc_id")).alias("ordinal"), F.col("doc_id").cast("string").alias("id"), F.slice("terms", 1, 8).alias("label_keywords"), F.array("title").alias("sample_headlines"),
        text.entities(F.col("title")).alias("entities"), F.map_from_entries(F.transform(F.array_distinct("terms"), lambda t: F.struct(t, F.lit(1.0)))).alias("centroid_vector"),
    )
    baseline = news.where(F.col("day") == F.lit("2024-01-03").cast("date")).select("title")
    # Days of a few dozen headlines: words of some headlines count as rare, and those new since the earlier day as risen.
    settings = replace(DEFAULTS, follow_up_df_share=0.5, follow_up_lift=1.0)
    return followup.anchors(stories, docs.where(F.col("day") == F.lit("2024-01-10").cast("date")), baseline, settings)


def _registered() -> None:
    from tidewire import catalog_rules  # noqa: F401  it registers its queries here


def queries() -> dict[str, Query]:
    _registered()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _registered()
    return dict(_ORACLES)

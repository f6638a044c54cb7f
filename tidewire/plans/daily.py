"""One day's run, end to end: stories, history, follow-ups, scores, briefing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewire.config import DEFAULTS, Settings
from tidewire.operators import briefing, followup, scoring, selection, topics
from tidewire.operators.cluster import cluster_days
from tidewire.operators.terms import headline_documents, tfidf, vectors
from tidewire.sources.articles import day_articles
from tidewire.storage import materialise


def detect_day(articles: DataFrame, history: DataFrame, day: str, settings: Settings = DEFAULTS, follow_up: bool = True) -> DataFrame:
    """A day's scored stories. `history` holds earlier days' (schema of this result); days must run in order for it."""
    rows = materialise(day_articles(articles, day, 1, settings.max_articles))
    documents = materialise(headline_documents(rows))
    long = materialise(tfidf(documents))
    packed = vectors(long).join(documents.select("day", "doc_id", "at", F.get("copies", F.lit(0))["scan"].alias("scan")), ["day", "doc_id"])
    packed = packed.withColumn("ordinal", F.row_number().over(Window.partitionBy("day").orderBy("at", "scan")))
    members = materialise(cluster_days(packed, ["ordinal"], settings.headline_similarity, settings))
    past = history.where((F.col("day") < F.lit(day).cast("date")) & (F.col("day") >= F.date_sub(F.lit(day).cast("date"), settings.history_days)))
    if follow_up:
        recent = followup.top_ranked(past.where(F.col("day") >= F.date_sub(F.lit(day).cast("date"), settings.follow_up_days)), settings.follow_up_rank)
        recent = recent.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("day"), "day_rank")))
        baseline = day_articles(articles, _shift(day, -settings.follow_up_baseline_days), 1, settings.max_articles)
        found = materialise(followup.anchors(recent, documents, baseline, settings))
        members = materialise(followup.group_follow_ups(members, documents, found, settings))
    built = materialise(topics.build_topics(members, long, documents, settings))
    themed = topics.themes(built, settings)
    videos = topics.attach_videos(built, day_articles(articles, day, 2), documents, settings)
    scored = scoring.score(themed, past.select("day", "id", "centroid_vector", "article_count"), settings)
    return scored.join(videos, ["day", "id"], "left")


def _shift(day: str, days: int) -> str:
    from datetime import date, timedelta

    return str(date.fromisoformat(day) + timedelta(days=days))


def capped(articles: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Each day's newest titled articles, at most `max_articles`: a day's clustering is one task's work."""
    order = Window.partitionBy("day").orderBy(F.desc_nulls_last(F.coalesce("published_at", "fetched_at")), "feed_url", "title", "seq")
    titled = articles.where(F.coalesce("title", F.lit("")) != "")
    return titled.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= settings.max_articles).drop("__r")


def detect_days(articles: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All days at once: days are independent but for history, which is a join.

    Follow-ups need the days in order and are left to `detect_day`; so are a day's videos to `with_videos`.
    """
    found = materialise(topics.stories(capped(articles, settings), settings))
    return scoring.score(found, found.select("day", "id", "centroid_vector", "article_count"), settings)


def with_videos(scored: DataFrame, articles: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Scored days with `video_hashes`: each day's videos attached to its stories."""
    documents = materialise(headline_documents(capped(articles.where("source_type = 1"), settings)))
    videos = capped(articles.where("source_type = 2"), settings)
    return scored.join(topics.attach_videos(scored, videos, documents, settings), ["day", "id"], "left")


def brief(scored: DataFrame, articles: DataFrame, feeds: DataFrame, generated_at: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Briefings of the scored days: candidates, sections by vote, a balanced pick, articles and videos."""
    pool = materialise(selection.candidates(scored, settings))
    if "image_url" not in articles.columns:
        articles = articles.withColumn("image_url", F.lit(None).cast("string"))
    links = pool.select("id", F.posexplode("article_hashes").alias("at", "hash"), "sample_headlines")
    rows = links.join(articles.withColumn("hash", F.col("url_hash").cast("string")), "hash")
    rows = materialise(rows.withColumn("rank", F.nullif(F.array_position("sample_headlines", F.col("title")).cast("int"), F.lit(0))))
    voted = pool.join(selection.section_vote(rows, feeds, settings=settings), "id", "left").withColumn("section", F.coalesce("section", F.lit("world")))
    kept = selection.select_balanced(voted.select("day", "place", "id", "final_score", "section"), settings).select("day", "place", "id", "section")
    picked = selection.pick_articles(rows.withColumn("seq", F.col("at")), settings=settings).select("id", F.posexplode("articles").alias("k", "a"))
    full = picked.join(rows, (picked.id == rows.id) & (picked.a["url"] == rows.url), "inner").drop(rows.id)
    cells = F.transform(F.array_sort(F.collect_list(F.struct("k", F.struct("title", "url", "feed_title", "published_at", F.col("image_url"), "summary").alias("row")))), lambda c: briefing.article(c["row"]))
    shown = full.groupBy("id").agg(cells.alias("picked_articles"))
    stories = kept.join(pool.drop("place"), ["day", "id"]).join(shown, "id", "left")
    if "video_hashes" in pool.columns:
        hashes = pool.select("id", F.posexplode("video_hashes").alias("seq", "hash"))
        found = hashes.join(articles.drop("seq").where("source_type = 2").withColumn("hash", F.col("url_hash").cast("string")), "hash")
        chosen = selection.pick_videos(found, settings=settings)
        cell = briefing.video(F.struct("title", "url", "feed_title", "published_at", "image_url"))
        cells = F.transform(F.array_sort(F.collect_list(F.struct("seq", cell.alias("v")))), lambda c: c["v"])
        stories = stories.join(chosen.groupBy("id").agg(cells.alias("picked_videos")), "id", "left")
    else:
        empty = "array<struct<title:string,url:string,video_id:string,channel:string,published_at:string,thumbnail:string>>"
        stories = stories.withColumn("picked_videos", F.expr(f"cast(array() as {empty})"))
    return briefing.briefings(stories, generated_at)

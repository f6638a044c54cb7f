"""The briefing's choices: candidate stories, a balanced pick, articles and videos; greedy rules are array folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.config import DEFAULTS, SECTIONS, SOFT_MINIMUM_SECTIONS, Settings
from tidewire.functions import text

# Feed categories of each specialist section.
CATEGORIES = {
    "technology": (
        "ai", "tech", "cybersecurity", "websecurity", "pwn", "redteam", "reverse", "mobilesecurity", "iotsecurity", "wirelesssecurity", "programming", "dev", "web-development", "android", "android-development", "ios-development", "apple", "machinelearning", "ui-ux", "tech-video",
    ),
    "business": (
        "business", "business-and-economy", "business-economy", "crypto", "personal-finance", "startups", "business-video", "masters-of-scale-with-reid-hoffman", "how-i-built-this-with-guy-raz",
    ),
    "science-health": (
        "science", "space", "research",
    ),
    "sports": (
        "sports", "football", "tennis", "cricket", "cricket-unfiltered", "the-analyst-inside-cricket",
    ),
    "culture": (
        "movies", "music", "television", "books", "gaming", "culture", "fashion", "beauty", "food", "gastropod", "travel", "photography", "architecture", "interior-design", "lifestyle", "funny", "diy",
    ),
    "politics": (
        "politics",
    ),
}


def section_for_category(category: Column) -> Column:
    name = F.lower(F.coalesce(category, F.lit("")))
    out = F.lit(None).cast("string")
    for section, categories in CATEGORIES.items():
        out = F.when(name.isin(*categories), F.lit(section)).otherwise(out)
    return out


def section_vote(rows: DataFrame, feeds: DataFrame, key: str = "id", settings: Settings = DEFAULTS) -> DataFrame:
    """(key, section): each distinct feed of a topic votes once; a specialist section needs its share of all feeds.

    `feeds` (feed_url, section) is a dimension; Spark broadcasts it while it is small.
    """
    distinct = rows.where(F.coalesce("feed_url", F.lit("")) != "").select(key, "feed_url").distinct()
    totals = rows.select(key).distinct().join(distinct.groupBy(key).agg(F.count("*").alias("feeds")), key, "left")
    votes = distinct.join(feeds, "feed_url").groupBy(key, "section").agg(F.count("*").alias("votes"))
    order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), order))).where("r = 1")
    enough = F.col("votes") / F.col("feeds") >= settings.specialist_share
    return totals.join(best, key, "left").select(key, F.when(enough, F.col("section")).otherwise("world").alias("section"))


def candidates(topics: DataFrame, settings: Settings = DEFAULTS, by: str = "day") -> DataFrame:
    """The best story of each theme above the score floor, at least a few, at most the pool; `place` is their order."""
    theme = F.coalesce(F.nullif("theme_id", F.lit("")), F.concat(F.lit("own:"), F.col("id")))
    first = topics.withColumn("t", F.row_number().over(Window.partitionBy(by, theme).orderBy("rank")))
    floor = F.max("final_score").over(Window.partitionBy(by)) * settings.score_floor
    kept = first.withColumn("floor", floor).where("t = 1")
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("rank")))
    enough = (F.col("final_score") >= F.col("floor")) | (F.col("place") <= settings.min_topics)
    return kept.where(enough & (F.col("place") <= settings.candidate_pool)).drop("t", "floor")


def _chosen(pool: Column, settings: Settings) -> Column:
    """Places picked from a day's candidates, an array of (place, id, score, section) in score order."""
    none = F.array().cast("array<int>")
    least = F.get(pool, F.lit(0))["score"] * settings.soft_minimum_score
    forced = none
    for section in SOFT_MINIMUM_SECTIONS:
        best = F.get(_of_section(pool, section), F.lit(0))
        take = best.isNotNull() & (best["score"] >= least) & (F.size(forced) < settings.max_topics)
        forced = F.when(take, F.array_append(forced, best["place"])).otherwise(forced)
    seats = lambda picked, section: F.size(F.filter(pool, lambda c: (c["section"] == section) & F.array_contains(picked, c["place"])))

    def fill(picked: Column, c: Column) -> Column:
        room = (F.size(picked) < settings.max_topics) & ~F.array_contains(picked, c["place"]) & (seats(picked, c["section"]) < settings.per_section)
        return F.when(room, F.array_append(picked, c["place"])).otherwise(picked)

    def top_up(picked: Column, c: Column) -> Column:
        room = (F.size(picked) < settings.min_topics) & ~F.array_contains(picked, c["place"])
        return F.when(room, F.array_append(picked, c["place"])).otherwise(picked)

    return F.aggregate(pool, F.aggregate(pool, forced, fill), top_up)


def _of_section(pool: Column, section: str) -> Column:
    return F.filter(pool, lambda c: c["section"] == F.lit(section))


def select_balanced(chosen: DataFrame, settings: Settings = DEFAULTS, by: str = "day") -> DataFrame:
    """Candidates (by, place, id, final_score, section) that the balanced rule keeps, in score order.

    Each soft-minimum section gets its best story if that is strong enough, the rest is filled by score with a cap a
    section, and a day with few sections is topped up. A day has at most the pool's few dozen rows in its array.
    """
    pool = F.array_sort(F.collect_list(F.struct("place", "id", F.col("final_score").alias("score"), "section")))
    days = chosen.groupBy(by).agg(pool.alias("pool")).withColumn("picked", _chosen(F.col("pool"), settings))
    return days.select(by, F.explode(F.array_sort("picked")).alias("place")).join(chosen, [by, "place"])


def pick_articles(rows: DataFrame, key: str = "id", settings: Settings = DEFAULTS) -> DataFrame:
    """(key, articles): one article an outlet and a headline, in the order of `rank` (absent last) and seq.

    Outlets and headlines are barred together, so the rule is one fold over each topic's ordered pool.
    """
    shown = text.clean_title(F.col("title"), F.col("feed_title"))
    cell = F.struct(
        F.coalesce("rank", F.lit(1 << 30)).alias("rank"), "seq", text.title_key(shown).alias("title_key"),
        F.coalesce(F.nullif("feed_title", F.lit("")), F.nullif("feed_url", F.lit("")), F.col("url")).alias("source_key"), shown.alias("title"), "url",
    )
    pool = rows.groupBy(key).agg(F.array_sort(F.collect_list(cell)).alias("pool"))

    def step(acc: Column, c: Column) -> Column:
        seen = F.exists(acc, lambda a: (a["title_key"] == c["title_key"]) | (a["source_key"] == c["source_key"]))
        room = (F.size(acc) < settings.articles_per_topic) & (c["title_key"] != "") & ~seen
        return F.when(room, F.array_append(acc, c)).otherwise(acc)

    return pool.select(key, F.aggregate("pool", F.slice("pool", 1, 0), step).alias("articles"))


def pick_videos(rows: DataFrame, key: str = "id", settings: Settings = DEFAULTS) -> DataFrame:
    """The first video of each channel, at most a few a topic."""
    channel = F.coalesce("feed_title", "feed_url")
    first = rows.where(F.coalesce("url", F.lit("")) != "").withColumn("c", F.row_number().over(Window.partitionBy(key, channel).orderBy("seq"))).where("c = 1")
    return first.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where(F.col("k") <= settings.videos_per_topic).drop("c", "k")


def fold_duplicates(stories: DataFrame, replies: DataFrame, settings: Settings = DEFAULTS, by: str = "day") -> DataFrame:
    """Stories with a model's titles and summaries; a duplicate of an earlier kept story gives it its articles and goes."""
    told = stories.join(replies.select(by, "id", F.col("title").alias("new_title"), F.col("summary").alias("new_summary"), "duplicate_of"), [by, "id"], "left")
    places = stories.select(by, F.col("id").alias("duplicate_of"), F.col("place").alias("target_place"))
    targets = replies.where("duplicate_of is not null").select(by, F.col("id").alias("duplicate_of")).distinct()
    told = told.join(places, [by, "duplicate_of"], "left").join(targets.withColumn("target_gone", F.lit(True)), [by, "duplicate_of"], "left")
    gone = F.col("target_place").isNotNull() & (F.col("target_place") < F.col("place")) & F.col("target_gone").isNull()
    told = told.withColumn("goes", F.coalesce(gone, F.lit(False)))
    more = told.where("goes").groupBy(by, F.col("duplicate_of").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "articles"))), lambda s: s["articles"])).alias("more"))
    kept = told.where(~F.col("goes")).join(more, [by, "id"], "left")

    def add(acc: Column, a: Column) -> Column:
        room = (F.size(acc) < settings.articles_per_topic) & ~F.exists(acc, lambda x: x["title"] == a["title"])
        return F.when(room, F.array_append(acc, a)).otherwise(acc)

    articles = F.when(F.col("more").isNotNull(), F.aggregate("more", F.col("articles"), add)).otherwise(F.col("articles"))
    return kept.select(by, "id", "place", F.coalesce("new_title", "title").alias("title"), F.col("new_summary").alias("summary"), articles.alias("articles"))

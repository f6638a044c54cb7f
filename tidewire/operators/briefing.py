"""The daily briefing: nested stories, its files and index, and what the read tools serve from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewire.config import DEFAULTS, SECTIONS, Settings
from tidewire.functions import text, urls, values
from tidewire.schemas import BRIEFING


def article(a: Column) -> Column:
    """The served form of an article row; absent keys stay null and so out of the JSON."""
    return F.struct(
        text.clean_title(a["title"], a["feed_title"]).alias("title"), a["url"].alias("url"), F.nullif(a["feed_title"], F.lit("")).alias("source"),
        values.iso(a["published_at"]).alias("published_at"), F.nullif(a["image_url"], F.lit("")).alias("image"), text.clean_description(a["summary"], a["title"]).alias("description"),
    )


def video(v: Column) -> Column:
    id_ = urls.video_id(v["url"])
    thumb = F.when(id_.isNotNull(), F.concat(F.lit("https://i.ytimg.com/vi/"), id_, F.lit("/hqdefault.jpg"))).otherwise(v["image_url"])
    return F.struct(
        v["title"].alias("title"), v["url"].alias("url"), id_.alias("video_id"), F.nullif(v["feed_title"], F.lit("")).alias("channel"),
        values.iso(v["published_at"]).alias("published_at"), thumb.alias("thumbnail"),
    )


def story(settings: Settings = DEFAULTS) -> Column:
    """A story of a row with the topic's columns, `section`, `picked_articles` and `picked_videos`."""
    titles = F.transform(F.slice("sample_headlines", 1, settings.articles_per_topic), lambda h: F.struct(h.alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("url", "source", "published_at", "image", "description")]))
    return F.struct(
        "id", F.get("sample_headlines", F.lit(0)).alias("title"), F.get("sample_headlines", F.lit(0)).alias("headline"), F.lit(None).cast("string").alias("summary"),
        F.slice("label_keywords", 1, 6).alias("label"), F.coalesce("status", F.lit("new")).alias("category"), "section", F.col("theme_id").alias("theme"),
        F.when(F.size("entities") > 0, F.slice("entities", 1, 5)).alias("entities"), F.coalesce("article_count", F.lit(0)).alias("article_count"),
        F.coalesce("unique_source_count", F.lit(0)).alias("source_count"), F.when(F.size("picked_articles") > 0, F.col("picked_articles")).otherwise(titles).alias("articles"),
        F.when(F.size("picked_videos") > 0, F.col("picked_videos")).alias("videos"),
    )


def briefings(stories: DataFrame, generated_at: str, by: str = "day") -> DataFrame:
    """One nested document a day, stories by place."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("place", story().alias("story")))), lambda s: s["story"])
    return stories.groupBy(F.col(by).cast("string").alias("date")).agg(F.lit(generated_at).alias("generated_at"), cells.alias("topics"))


def write_briefings(days: DataFrame, folder: str) -> None:
    """A folder of JSON a date; dates not in `days` stay."""
    body = days.select("date", F.to_json(F.struct("date", *[c for c in days.columns if c != "date"])).alias("value"))
    body.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").text(folder)


def read_briefings(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.read.text(folder)
    return raw.select(F.from_json("value", BRIEFING).alias("d")).select("d.*")


def missing_days(wanted: DataFrame, exported: DataFrame) -> DataFrame:
    """Dates still without a briefing: a run that failed is made up for by the next one."""
    return wanted.select("date").distinct().join(exported.select("date"), "date", "left_anti")


def exported(spark: SparkSession, folder: str) -> DataFrame:
    """Dates that have a briefing in the folder."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(folder).select(F.col("date").cast("string").alias("date")).distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN.WITH_SUGGESTION"):
            raise
        return spark.createDataFrame([], "date string")


def export(days: DataFrame, folder: str, force: bool = False) -> int:
    """Write the briefings of days that have none there yet, or of all with `force`; returns the articles written."""
    from tidewire.storage import materialise

    there = materialise(exported(days.sparkSession, folder))
    days = materialise(days if force else days.join(missing_days(days, there), "date", "left_semi"))
    write_briefings(days, folder)
    return int(export_totals(days).first().articles)


def without_dead_pictures(days: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Days whose stories lose pictures that do not load (image, fine), with `kept`, `before` and whether the day `changed`.

    Verdicts of a day's own pictures travel with the day, as a map; a picture without a verdict stays.
    """
    shown = days.select("date", F.explode(F.flatten(F.transform("topics", lambda t: F.transform(t["articles"], lambda a: a["image"])))).alias("image")).where("image is not null")
    dead = shown.distinct().join(verdicts.where("not fine").select("image").distinct(), "image").groupBy("date").agg(F.collect_set("image").alias("dead"))
    joined = days.join(dead, "date", "left").withColumn("dead", F.coalesce("dead", F.array().cast("array<string>")))
    gone = lambda a: F.array_contains(F.col("dead"), a["image"])
    mended = F.transform("topics", lambda t: t.withField("articles", F.transform(t["articles"], lambda a: F.when(gone(a), a.withField("image", F.lit(None).cast("string"))).otherwise(a))))
    pictures = lambda c: F.size(F.filter(F.flatten(F.transform(c, lambda t: F.transform(t["articles"], lambda a: a["image"]))), lambda i: i.isNotNull()))
    out = joined.withColumn("before", pictures("topics")).withColumn("topics", mended)
    return out.withColumn("kept", pictures("topics")).withColumn("changed", F.col("kept") < F.col("before")).drop("dead")


def index(days: DataFrame) -> DataFrame:
    return days.select("date").distinct().orderBy("date")


def latest(dates: DataFrame, today: str, listed: bool = True, back: int = 60) -> DataFrame:
    """The date that a reader sees first: the last that the index lists, or, of an unlisted folder's dates, the last of
    today and the days before it, so many in all. No row where there is none."""
    valid = dates.where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    if not listed:
        valid = valid.where((F.col("date") <= today) & (F.col("date").cast("date") > F.date_sub(F.lit(today).cast("date"), back)))
    return valid.agg(F.max("date").alias("date")).where("date is not null")


def neighbours(days: DataFrame) -> DataFrame:
    order = Window.orderBy("date")
    return index(days).select("date", F.lag("date").over(order).alias("previous"), F.lead("date").over(order).alias("next"))


def with_overview(days: DataFrame, points: DataFrame, force: bool = True, summarised: bool = False) -> DataFrame:
    """Days with overview points (date, at, text, stories); references out of range and repeats go; two points are needed.

    A day without usable points keeps the overview it has. Patching stored days: `force` off leaves days that have an
    overview as they are, and `summarised` leaves those of which no story has a summary.
    """
    held = days if "overview" in days.columns else days.withColumn("overview", F.lit(None).cast("struct<points:array<struct<text:string,stories:array<int>>>>"))
    sized = points.join(days.select("date", F.size("topics").alias("n")), "date")
    valid = F.array_sort(F.array_distinct(F.filter("stories", lambda s: (s >= 1) & (s <= F.col("n")))))
    kept = sized.withColumn("stories", valid).where((F.size("stories") > 0) & (F.coalesce("text", F.lit("")) != ""))
    kept = kept.withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy("at"))).where("k <= 5")
    cells = kept.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("k", "text", "stories"))).alias("cells")).where(F.size("cells") >= 2)
    points_ = F.transform("cells", lambda c: F.struct(c["text"].alias("text"), c["stories"].alias("stories")))
    made = cells.select("date", F.struct(points_.alias("points")).alias("made"))
    may = F.lit(True) if force else F.col("overview").isNull()
    if summarised:
        may = may & F.exists("topics", lambda t: F.coalesce(t["summary"], F.lit("")) != "")
    joined = held.join(made, "date", "left")
    return joined.withColumn("overview", F.when(may & F.col("made").isNotNull(), F.col("made")).otherwise(F.col("overview"))).drop("made")


def daily_news(days: DataFrame, date: str) -> DataFrame:
    """A day's stories, short: rank, ids and counts, a missing summary as ''."""
    rows = days.where(F.col("date") == date).select("date", F.posexplode("topics").alias("at", "t"))
    return rows.select(
        "date", (F.col("at") + 1).alias("rank"), F.col("t.id").alias("id"), text.story_title(F.col("t.title"), F.col("t.headline"), F.col("t.label")).alias("title"),
        F.coalesce("t.summary", F.lit("")).alias("summary"), F.col("t.section").alias("section"), "t.article_count", "t.source_count",
    )


def daily_points(days: DataFrame, date: str) -> DataFrame:
    """Overview points with story positions turned to ids; positions without a story go."""
    rows = days.where(F.col("date") == date).select("topics", F.posexplode("overview.points").alias("at", "p"))
    ids = F.filter(F.transform("p.stories", lambda s: F.get(F.col("topics"), s - 1)["id"]), lambda i: i.isNotNull())
    return rows.select("at", F.col("p.text").alias("text"), ids.alias("ids"))


def one_topic(days: DataFrame, date: str, topic_id: str) -> DataFrame:
    rows = days.where(F.col("date") == date).select("date", F.posexplode("topics").alias("at", "t"))
    return rows.where(F.col("t.id") == topic_id).select("date", (F.col("at") + 1).alias("rank"), "t.*")


def shown_stories(days: DataFrame, section: str | None = None) -> DataFrame:
    """Stories with articles, ranked within the whole day and then filtered; an unknown section filters nothing."""
    rows = days.select("date", F.posexplode("topics").alias("at", "t")).where(F.size("t.articles") > 0)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy("at")))
    rows = rows.select("date", "rank", values.tier(F.col("rank")).alias("tier"), F.coalesce("t.section", F.lit("world")).alias("section"), "t.id", "t.title")
    return rows.where(F.col("section") == section) if section in SECTIONS else rows


def export_totals(days: DataFrame) -> DataFrame:
    """Days, stories and articles of an export."""
    articles = F.aggregate("topics", F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.size(t["articles"]), F.lit(0)))
    return days.agg(F.count("*").alias("days"), F.coalesce(F.sum(F.size("topics").cast("long")), F.lit(0)).alias("stories"), F.coalesce(F.sum(articles), F.lit(0)).alias("articles"))


def section_counts(shown: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    return shown.groupBy("date", "section").agg(F.count("*").alias("n")).withColumn("place", order)

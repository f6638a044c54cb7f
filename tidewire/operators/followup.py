"""Follow-up coverage: anchors of recent top stories, and clusters that continue them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewire.config import DEFAULTS, Settings
from tidewire.functions import text


def _stems(column: str) -> object:
    return F.transform(text.tokens(F.col(column)), lambda t: t["stem"])


def top_ranked(topics: DataFrame, limit: int, by: str = "day") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("final_score"), "id")
    return topics.withColumn("day_rank", F.row_number().over(order)).where(F.col("day_rank") <= limit)


def anchors(stories: DataFrame, documents: DataFrame, baseline: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(id, stem, context): one telling word of each recent story, with the story's other words that are specific.

    `stories` has ordinal, id, label_keywords, sample_headlines, entities and centroid_vector; `documents` one day's terms; `baseline`
    the titles of an earlier day, without which there is no anchor. The word is among the first three of the label,
    in most of the story's headlines, rare today, and far more frequent than in the baseline. A word anchors the
    first story only.
    """
    n = documents.count()
    words = documents.select(F.explode(F.array_distinct(F.filter("terms", lambda t: ~t.contains(" ")))).alias("stem"))
    df = words.groupBy("stem").agg(F.count("*").alias("df"))
    n_base = baseline.count()
    if not n or not n_base:
        return stories.select("ordinal", "id", F.lit("").alias("stem"), F.array().cast("array<string>").alias("context")).limit(0)
    base = baseline.select(F.explode(F.array_distinct(_stems("title"))).alias("stem")).groupBy("stem").agg(F.count("*").alias("base_df"))
    most = max(1, int(n * settings.follow_up_df_share))
    lines = F.transform("sample_headlines", lambda h: F.transform(text.tokens(h), lambda t: t["stem"]))
    keyed = stories.select("ordinal", "id", lines.alias("lines"), F.posexplode(F.slice("label_keywords", 1, 3)).alias("at", "word"))
    keyed = keyed.withColumn("stem", F.get(_stems("word"), F.lit(0))).where(F.col("stem").isNotNull() & (F.size("lines") > 0))
    keyed = keyed.groupBy("ordinal", "id", "stem").agg(F.min("at").alias("at"), F.first("lines").alias("lines"))
    # The condition of the filter lambda needs the row's own word beside the array's.
    share = F.size(F.filter(F.transform("lines", lambda w: F.array_contains(w, F.col("stem"))), lambda x: x)) / F.size("lines")
    keyed = keyed.withColumn("share", share).join(df, "stem").join(base, "stem", "left")
    lift = (F.col("df") / n) / ((F.coalesce("base_df", F.lit(0)) + 1) / n_base)
    good = keyed.where((F.col("share") >= settings.follow_up_share) & (F.col("df") <= most) & (lift >= settings.follow_up_lift))
    best = good.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("share"), "at"))).where("r = 1")
    first = best.withColumn("r", F.row_number().over(Window.partitionBy("stem").orderBy("ordinal"))).where("r = 1").select("ordinal", "id", "stem")
    chosen = first.join(stories.drop("ordinal"), "id")
    names = F.transform("entities", lambda e: F.transform(text.tokens(e), lambda t: t["stem"]))
    halves = F.flatten(F.filter(names, lambda s: (F.size(s) == 2) & F.array_contains(s, F.col("stem"))))
    context = chosen.select("ordinal", "id", "stem", halves.alias("halves"), F.explode(F.map_keys("centroid_vector")).alias("word"))
    context = context.where(~F.col("word").contains(" ") & (F.col("word") != F.col("stem")) & ~F.array_contains("halves", F.col("word")))
    common = df.where(F.col("df") > most).select(F.col("stem").alias("word"))
    context = context.join(common, "word", "left_anti").groupBy("id", "stem").agg(F.collect_set("word").alias("context"))
    return first.join(context, ["id", "stem"], "left").select("ordinal", "id", "stem", F.coalesce("context", F.array().cast("array<string>")).alias("context"))


def group_follow_ups(members: DataFrame, documents: DataFrame, found: DataFrame, settings: Settings = DEFAULTS, by: str = "day") -> DataFrame:
    """Members with follow-up clusters merged: a cluster joins the first anchor for which half its documents count.

    A document counts with the anchor's word, a word of its context, and an article of a feed that does not emit the
    anchor in bulk. Merged clusters take numbers after all others; they keep their documents' order.
    """
    singles = documents.select(by, "doc_id", "copies", F.filter("terms", lambda t: ~t.contains(" ")).alias("stems"))
    hits = singles.join(F.broadcast(found), F.array_contains("stems", F.col("stem")))
    feed = lambda a: F.coalesce(F.nullif(a["feed_url"], F.lit("")), F.nullif(a["feed_title"], F.lit("")), F.lit("unknown"))
    spread = hits.select(by, "doc_id", "ordinal", "stem", F.arrays_overlap("stems", "context").alias("shares"), F.explode(F.transform("copies", feed)).alias("feed"))
    bulk = spread.groupBy(by, "stem", "feed").agg(F.count("*").alias("emitted"))
    counted = spread.join(bulk, [by, "stem", "feed"]).where(F.col("shares") & (F.col("emitted") <= settings.follow_up_per_feed)).select(by, "doc_id", "ordinal").distinct()
    sizes = members.groupBy(by, "cluster").agg(F.count("*").alias("size"))
    ratio = members.join(counted, [by, "doc_id"]).groupBy(by, "cluster", "ordinal").agg(F.count("*").alias("n")).join(sizes, [by, "cluster"])
    joined = ratio.where(F.col("n") * 2 >= F.col("size")).groupBy(by, "cluster").agg(F.min("ordinal").alias("ordinal"))
    last = members.groupBy(by).agg((F.max("cluster") + 1).alias("next"))
    moved = members.join(joined, [by, "cluster"], "left").join(last, by)
    fresh = moved.withColumn("target", F.when(F.col("ordinal").isNotNull(), F.col("next") + F.col("ordinal")).otherwise(F.col("cluster")))
    order = Window.partitionBy(by, "target").orderBy("cluster", "position")
    return fresh.select(by, "doc_id", F.col("target").alias("cluster"), (F.row_number().over(order) - 1).cast("long").alias("position"))

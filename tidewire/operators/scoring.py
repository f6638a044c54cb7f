"""Novelty, burst, persistence and breadth of stories; their status and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.config import DEFAULTS, Settings
from tidewire.functions.values import clamp01
from tidewire.operators.similar import similarity_join


def burst(today: Column, n: Column, mean: Column, deviation: Column) -> Column:
    """z against earlier counts (population deviation); without any, two and more count as three deviations."""
    spread = F.when(deviation > 0, (today - mean) / deviation).when(today > mean, F.lit(3.0)).otherwise(F.lit(0.0))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.when(today >= 2, F.lit(3.0)).otherwise(F.lit(0.0))).otherwise(spread)


def normalized_burst(today: Column, n: Column, z: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.when(today >= 2, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(clamp01(z / 3))


def status(similarity: Column, novelty: Column, z: Column, normalized: Column, settings: Settings = DEFAULTS) -> Column:
    rising = (z >= 2) | (normalized >= 0.8)
    return (
        F.when(similarity >= settings.history_similarity, F.when(rising, "trending").otherwise("ongoing"))
        .when(novelty >= 0.70, "new").when(rising, "trending").otherwise("monitor")
    )


def final_score(significance: Column, normalized: Column, novelty: Column, persistence: Column) -> Column:
    return clamp01(0.45 * significance + 0.25 * normalized + 0.20 * novelty + 0.10 * persistence)


def significance(sources: Column, most: Column, articles: Column) -> Column:
    diversity = F.when(articles > 0, sources / articles).otherwise(F.lit(0.0))
    return F.when(most > 1, F.log1p(sources.cast("double")) / F.log1p(most.cast("double"))).otherwise(diversity)


def history_matches(topics: DataFrame, history: DataFrame, settings: Settings = DEFAULTS, by: str = "day", days: int | None = None) -> DataFrame:
    """(by, id, matches): earlier stories of the last days that are similar enough, best first."""
    days = settings.history_days if days is None else days
    now = topics.select(by, F.col("id").alias("left_id"), F.explode("centroid_vector").alias("term", "weight"))
    # Each earlier story is offered to each later day that remembers it.
    past = history.select(F.explode(F.sequence(F.date_add(F.col(by), 1), F.date_add(F.col(by), days))).alias(by), F.col("id").alias("right_id"), F.explode("centroid_vector").alias("term", "weight"))
    pairs = similarity_join(now, past, [by], settings.history_similarity)
    counts = history.select(F.col("id").alias("right_id"), "article_count")
    pairs = pairs.join(counts, "right_id").withColumn("similarity", F.round("similarity", 12))
    return pairs.groupBy(by, F.col("left_id").alias("id")).agg(
        F.max("similarity").alias("max_historical_similarity"), F.count("*").alias("n"), F.avg("article_count").alias("mean"), F.stddev_pop("article_count").alias("deviation"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "right_id"))), 1, 5), lambda m: m["right_id"]).alias("matched_historical_topic_ids"),
    )


def score(topics: DataFrame, history: DataFrame, settings: Settings = DEFAULTS, by: str = "day") -> DataFrame:
    """Topics with every score, status and their day's rank; the day's first `stored_topics` stay."""
    joined = topics.join(history_matches(topics, history, settings, by), [by, "id"], "left")
    most = F.greatest(F.lit(1), F.max("unique_source_count").over(Window.partitionBy(by)))
    similarity = F.coalesce("max_historical_similarity", F.lit(0.0))
    z = burst(F.col("article_count"), F.col("n"), F.col("mean"), F.col("deviation"))
    out = joined.withColumn("max_historical_similarity", similarity).withColumn("novelty_score", clamp01(1 - F.col("max_historical_similarity"))).withColumn("burst_z_score", z)
    out = out.withColumn("burst_score", normalized_burst(F.col("article_count"), F.col("n"), F.col("burst_z_score"))).withColumn("source_diversity", F.col("unique_source_count") / F.col("article_count"))
    out = out.withColumn("persistence_score", F.size("active_windows") / 4).withColumn("entity_importance", clamp01(F.size("entities") / F.lit(4.0)))
    weight = significance(F.col("unique_source_count"), most, F.col("article_count"))
    out = out.withColumn("final_score", final_score(weight, F.col("burst_score"), F.col("novelty_score"), F.col("persistence_score")))
    out = out.withColumn("status", status(F.col("max_historical_similarity"), F.col("novelty_score"), F.col("burst_z_score"), F.col("burst_score"), settings))
    out = out.withColumn("matched_historical_topic_ids", F.coalesce("matched_historical_topic_ids", F.array().cast("array<string>"))).drop("n", "mean", "deviation")
    order = Window.partitionBy(by).orderBy(F.desc("final_score"), F.desc("article_count"), F.desc("unique_source_count"), F.array_join("label_keywords", " "))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.stored_topics)

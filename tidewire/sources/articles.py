"""Article relations: the archive on disk, and an article view over a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire.functions import values
from tidewire.schemas import ARTICLES


def articles_of(documents: DataFrame) -> DataFrame:
    """Documents as articles: sources are outlets, the first line or sentence is the title, a month of hours passes."""
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string"))
    published = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("doc_id"), F.lit(720)) * 3600)
    return documents.select(
        F.col("doc_id").alias("seq"), values.hash64(url).alias("url_hash"), url.alias("url"), F.col("source").alias("feed_url"), F.col("source").alias("feed_title"),
        F.substring(F.regexp_extract("text", "^[^\n.]*", 0), 1, 120).alias("title"), F.substring("text", 1, 300).alias("summary"),
        published.alias("published_at"), (published + F.expr("interval 1 hour")).alias("fetched_at"),
        F.when(F.pmod(F.col("doc_id"), F.lit(10)) == 9, 2).otherwise(1).cast("short").alias("source_type"), F.col("lang"), F.to_date(published).alias("day"),
    )


def day_articles(articles: DataFrame, day: str, source_type: int = 1, limit: int | None = None) -> DataFrame:
    """One day's titled articles, newest first, then by feed and title: narrow columns, a range predicate to push down."""
    rows = articles.where((F.col("source_type") == source_type) & F.col("title").isNotNull() & (F.col("title") != "") & values.in_day(F.col("published_at"), F.col("fetched_at"), F.lit(day).cast("date")))
    ordered = rows.orderBy(F.desc_nulls_last(F.coalesce("published_at", "fetched_at")), "feed_url", "title")
    return ordered.limit(limit) if limit else ordered


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Cold articles of all months, columns by name; an empty relation where there is no archive yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], ARTICLES)

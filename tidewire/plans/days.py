"""Days in order: each day's stories are detected with the days before it, stored, and briefed.

A day reads the stored stories of the days before it (its history and the stories that it may follow up), so days run
one after another; within a day the work is Spark's. A day is one commit of the story table: a run that ends midway
goes on with the next day that is not stored.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire.config import DEFAULTS, Settings
from tidewire.operators import store
from tidewire.operators.tables import Table
from tidewire.plans import daily
from tidewire.schemas import SCORED
from tidewire.storage import emptied, materialise


def story_table(spark: SparkSession, path: str) -> Table:
    """Stored stories by day."""
    return Table(spark, path, "day", "id", buckets=1)


def crawl_days(articles: DataFrame, least: int, start: str | None = None, before: str | None = None) -> list[str]:
    """Days with at least `least` news articles, oldest first, from `start` and before `before`; smaller days are feeds' backlog."""
    found = sorted(str(r.day) for r in store.active_days(articles, least).where("day is not null").select("day").collect())  # a row a day
    return [d for d in found if (start is None or d >= start) and (before is None or d < before)]


def history(table: Table, day: str, settings: Settings = DEFAULTS) -> DataFrame:
    """The stored stories of the days that a day looks back on; only those days' files are read."""
    first = date.fromisoformat(day)
    parts = [str(first - timedelta(days=k)) for k in range(1, settings.history_days + 1)]
    return table.read(parts=parts) if table.version() else table.spark.createDataFrame([], SCORED)


def run_days(articles: DataFrame, table: Table, days: list[str], settings: Settings = DEFAULTS, again: bool = False) -> list[str]:
    """Detect and store the days in order, those that are stored already only with `again`; returns the days that ran.

    Every day sees the newest stories of earlier days, follow-ups are grouped with the stories of the last two days, and
    videos are attached. A day that has no story, and had none, is tried again by the next run.
    """
    done = [] if again else list(table.manifest()["cells"])
    ran = []
    for day in sorted(set(days) - set(done)):
        with emptied(table.spark):
            made = materialise(daily.detect_day(articles, history(table, day, settings), day, settings))
            table.replace(made, parts=[day])
        ran.append(day)
    return ran


def stored(table: Table, days: list[str]) -> DataFrame:
    return table.read(parts=days) if table.version() else table.spark.createDataFrame([], SCORED)


def without_briefing(days: list[str], exported: DataFrame) -> list[str]:
    """Days that have no briefing yet."""
    return sorted(set(days) - {r.date for r in exported.select("date").distinct().collect()})  # a row a day


def with_pictures(articles: DataFrame) -> DataFrame:
    """Articles with the column that briefings show pictures from, where a view lacks it."""
    return articles if "image_url" in articles.columns else articles.withColumn("image_url", F.lit(None).cast("string"))

"""Streaming ingest: keyed de-duplication for ever, enriching upserts and poll state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.config import DEFAULTS, Settings
from tidewire.functions import values
from tidewire.operators.tables import Table

KEYED_BY_DAY = "day"


def article_table(spark: SparkSession, path: str, buckets: int = 16) -> Table:
    """The table of articles: parts are days of publication, keys are address hashes."""
    return Table(spark, path, KEYED_BY_DAY, "url_hash", buckets)


def flush(batch: DataFrame, path: str, stream: str | None = None, batch_id: int | None = None, buckets: int = 16) -> dict[str, int]:
    """Merge one micro-batch into the article table: new keys in, missing columns filled, days that are closed left alone.

    The commit names the batch, so that a batch that a stream brings again after a crash changes nothing; without a
    stream's name a repeated batch finds all its keys known.
    """
    rows = batch.withColumn(KEYED_BY_DAY, F.to_date(values.event_time(F.col("published_at"), F.col("fetched_at"))))
    return article_table(batch.sparkSession, path, buckets).upsert(rows, stream=stream, batch_id=batch_id)


def ingest(rows: DataFrame, path: str, checkpoint: str, once: bool = True, every: str = "60 minutes") -> StreamingQuery:
    """A stream of article rows into the table; `once` takes what is there, else what came in every so often."""
    writer = rows.writeStream.foreachBatch(lambda df, i: flush(df, path, checkpoint, i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def poll_states(log: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Poll state of each feed from its log (feed_url, at, ok, interval_minutes): the batch twin of the keyed state.

    The failure count is the run of failures since the last success; it doubles the wait up to sixteenfold and a day.
    """
    last_ok = F.max(F.when(F.col("ok"), F.col("at"))).over(Window.partitionBy("feed_url"))
    marked = log.withColumn("last_success", last_ok)
    state = marked.groupBy("feed_url").agg(
        F.max("last_success").alias("last_success"), F.max(F.when(~F.col("ok"), F.col("at"))).alias("last_failure"),
        F.count_if(~F.col("ok") & (F.col("last_success").isNull() | (F.col("at") > F.col("last_success")))).cast("int").alias("failure_count"),
        F.max("at").alias("last_at"), F.max_by("interval_minutes", "at").alias("interval"),
    )
    wait = F.when(F.col("failure_count") > 0, values.backoff_minutes(F.col("interval"), F.col("failure_count"), settings.max_backoff_minutes)).otherwise(F.col("interval"))
    next_poll = F.timestamp_micros((F.unix_micros("last_at") + wait * 60_000_000).cast("long"))
    return state.select("feed_url", "last_success", F.when(F.col("failure_count") > 0, F.col("last_failure")).alias("last_failure"), "failure_count", next_poll.alias("next_poll"))


def daily_counts(rows: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Articles a day and feed over a stream; a day closes one day late, and later rows are left to a batch re-run."""
    timed = rows.withColumn("at", values.event_time(F.col("published_at"), F.col("fetched_at")))
    return timed.withWatermark("at", lateness).groupBy(F.window("at", "1 day"), "feed_url").agg(F.count("*").alias("n"))


def run_metrics(log: DataFrame, transient: tuple[str, ...] = ("timeout", "ConnectionResetError", "HTTP 503", "HTTP 429")) -> DataFrame:
    """Polls, hard and passing failures, and time spent of a run."""
    failed = F.col("error").isNotNull()
    return log.agg(
        F.count("*").alias("polled"), F.count_if(failed & F.col("error").isin(*transient)).alias("transient"), F.count_if(failed & ~F.col("error").isin(*transient)).alias("hard"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"), F.coalesce(F.max("duration_ms"), F.lit(0)).alias("slowest_ms"),
    )


def unread(latest: DataFrame, read: DataFrame) -> DataFrame:
    """Stories of a date that a device has not read."""
    seen = read.groupBy("date").agg(F.collect_set("id").alias("seen"))
    days = latest.groupBy("date").agg(F.array_sort(F.collect_set("id")).alias("ids")).join(seen, "date", "left")
    return days.select("date", F.array_except("ids", F.coalesce("seen", F.array().cast("array<string>"))).alias("unread"))


# Errors after which a store is unusable, so that the run has to end and start afresh.
FATAL = r"(?i)Out of Memory|TransactionContext|FATAL|database has been invalidated"


def failure(error: str) -> str:
    """fatal, which ends the run, or passing, which is counted and left to the next run."""
    import re

    return "fatal" if re.search(FATAL, error) else "passing"

"""The monthly archive: cold articles, topics and links in versioned tables by month, of which a run reads and writes the touched months only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire.operators import store
from tidewire.operators.tables import Table
from tidewire.storage import materialise


def archive_table(spark: SparkSession, path: str, key: str = "url_hash") -> Table:
    return Table(spark, path, "month", key, buckets=1)


def _months(rows: DataFrame) -> list[str]:
    """A row a month at most."""
    return sorted(r[0] for r in rows.where("month is not null").select("month").distinct().collect())


def _cold(table: Table, months: list[str], like: DataFrame) -> DataFrame:
    return table.read(parts=months) if table.version() else like.limit(0)


def archive_articles(articles: DataFrame, table: Table, cutoff: str, dry_run: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """Move what was fetched before the cutoff to the archive: the hot table as it is to be kept, and the rows a month.

    A month's archive keeps the copy of a key that it has and takes the other rows; it is written aside, compared with
    what was meant by a checksum, and published whole. Months without rows to archive are neither read nor written.
    """
    rows = materialise(store.archivable(articles, cutoff).withColumn("month", store.month_fetched()))
    counts = {r.month: r.n for r in rows.groupBy("month").agg(F.count("*").alias("n")).orderBy("month").collect()}
    if counts and not dry_run:
        table.replace(materialise(store.merge_archive(_cold(table, list(counts), rows), rows, table.key)))
    return (articles if dry_run else store.stub(articles, cutoff)), counts


def archive_topic_tables(topics: DataFrame, links: DataFrame, months: list[str], topic_table: Table, link_table: Table) -> None:
    """Topics of the months, and the links of those topics, beside what the archive has of them."""
    made = materialise(topics.where(store.month_of(F.col("topic_date")).isin(months)))
    kept = materialise(store.archive_topics(made, _cold(topic_table, months, made.withColumn("month", F.lit("")))))
    bound = store.links_by_month(links, made)
    linked = materialise(store.archive_links(links, made, _cold(link_table, months, bound)))
    for table, rows in ((topic_table, kept), (link_table, linked)):
        if _months(rows):
            table.replace(rows)

"""Operator commands over a table of articles: python -m tidewire COMMAND ARTICLES [options]."""

from __future__ import annotations

import argparse
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire.config import SECTIONS
from tidewire.operators import archive, briefing, store
from tidewire.operators.tables import Table
from tidewire.plans import daily, days
from tidewire.session import session
from tidewire.sources.articles import articles_of


def _articles(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if "url_hash" in rows.columns else articles_of(rows)


def stats(args: argparse.Namespace, articles: DataFrame) -> None:
    """Totals, and the rows fetched last."""
    store.statistics(articles, args.now).show(truncate=False)
    store.latest(articles, args.limit).select("source_type", "title", "url").show(truncate=100)


def _table(args: argparse.Namespace, spark: SparkSession) -> Table:
    return days.story_table(spark, args.stories or f"{args.out.rstrip('/')}-stories")


def topics(args: argparse.Namespace, articles: DataFrame) -> None:
    """Detect the stories of a day, or of all days that have none stored, and show them best first."""
    table = _table(args, articles.sparkSession)
    wanted = [args.date] if args.date else days.crawl_days(articles, args.least, args.start, args.now[:10])
    days.run_days(articles, table, wanted)
    made = days.stored(table, wanted)
    made.orderBy(F.desc("day"), "rank").select("day", "rank", "status", "headline", "article_count", "unique_source_count", F.round("final_score", 3).alias("score")).show(args.limit, truncate=80)


def dry_run(args: argparse.Namespace, articles: DataFrame) -> None:
    """What a run would take in: rows and usable rows a feed, the largest first, and the totals. Nothing is written."""
    usable = F.coalesce("title", F.lit("")) != ""
    feeds = articles.groupBy("feed_url").agg(F.count("*").alias("items"), F.count_if(usable).alias("candidates"))
    feeds.agg(F.count("*").alias("feeds"), F.sum("candidates").alias("candidates"), F.count_if(F.col("candidates") == 0).alias("empty")).show()
    feeds.orderBy(F.desc("items"), "feed_url").show(args.limit, truncate=100)


def _export(args: argparse.Namespace, articles: DataFrame, table: Table, wanted: list[str], force: bool) -> None:
    spark = articles.sparkSession
    missing = wanted if force else days.without_briefing(wanted, briefing.exported(spark, args.out))
    feeds = spark.createDataFrame([], "feed_url string, section string") if args.feeds is None else spark.read.json(args.feeds)
    made = daily.brief(days.stored(table, missing), days.with_pictures(articles), feeds, datetime.now(UTC).isoformat())
    written = briefing.export(made, args.out, force) if missing else 0
    print(f"{written} articles in {args.out}; sections are {', '.join(SECTIONS)}")


def export(args: argparse.Namespace, articles: DataFrame) -> None:
    """Briefing of a day, yesterday's unless --date says otherwise: its stories are detected if none are stored."""
    table = _table(args, articles.sparkSession)
    day = args.date or str(date.fromisoformat(args.now[:10]) - timedelta(days=1))
    days.run_days(articles, table, [day])
    _export(args, articles, table, [day], args.force)


def backfill(args: argparse.Namespace, articles: DataFrame) -> None:
    """Briefings of all stored days that have none yet, or of all stored days with --force."""
    table = _table(args, articles.sparkSession)
    _export(args, articles, table, sorted(table.manifest()["cells"]), args.force)


def recluster(args: argparse.Namespace, articles: DataFrame) -> None:
    """Detect days again, oldest first, so that each sees the newest stories before it, and write their briefings anew.

    A day, or all days before today with --least articles, from --start on.
    """
    table = _table(args, articles.sparkSession)
    wanted = [args.date] if args.date else days.crawl_days(articles, args.least, args.start, args.now[:10])
    days.run_days(articles, table, wanted, again=True)
    _export(args, articles, table, wanted, force=True)


def cold(args: argparse.Namespace, articles: DataFrame) -> None:
    """Archive by month what was fetched more than --keep days ago; with --dry-run only say how much that is."""
    cutoff = f"{date.fromisoformat(args.now[:10]) - timedelta(days=args.keep)} {args.now[11:]}"
    _, counts = archive.archive_articles(articles, archive.archive_table(articles.sparkSession, args.out), cutoff, args.dry_run)
    print(f"{sum(counts.values())} articles of {len(counts)} months {'would go' if args.dry_run else 'are'} in {args.out}: {counts}")


COMMANDS = {"stats": stats, "topics": topics, "dry-run": dry_run, "export": export, "backfill": backfill, "recluster": recluster, "archive": cold}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidewire", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("articles")
    parser.add_argument("--date")
    parser.add_argument("--limit", type=int, default=10)
    parser.add_argument("--now", default=f"{datetime.now(UTC):%Y-%m-%d %H:%M:%S}")
    parser.add_argument("--out", default="news")
    parser.add_argument("--feeds")
    parser.add_argument("--least", type=int, default=2000, help="articles a day needs to be exported")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--start", help="first day of a recluster")
    parser.add_argument("--stories", help="the table of stored stories; beside --out unless given")
    parser.add_argument("--keep", type=int, default=30, help="days that stay out of the archive")
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    COMMANDS[args.command](args, _articles(session(), args.articles))


if __name__ == "__main__":
    main()

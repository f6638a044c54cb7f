"""Days in order: statuses over a week, follow-ups, a run that goes on where it ended, and the commands' briefings."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from tests.test_stories import articles

from tidewire.config import DEFAULTS
from tidewire.operators import briefing, cluster, followup
from tidewire.operators.terms import headline_documents
from tidewire.plans import daily, days
from tidewire.schemas import SCORED

PAIR = ["Ukraine peace talks continue in Paris", "Ukraine peace talks enter second day"]
SMALL = replace(DEFAULTS, min_topic_size=2, min_sources=2)


def day_of(spark, n, titles):
    rows = articles(spark, [(t, f"source-{chr(97 + i)}") for i, t in enumerate(titles)], day=datetime(2026, 4, n, 8))
    return rows.withColumn("url_hash", F.col("url_hash") + 100 * n).withColumn("url", F.concat("url", F.lit(f"?{n}")))


@pytest.fixture(scope="module")
def week(spark):
    big = [*PAIR, "Ukraine peace talks continue as leaders meet"] * 2
    models = ["OpenAI launches reasoning model in Europe", "OpenAI reasoning model launches across Europe", "OpenAI launches Europe reasoning model"]
    rows = day_of(spark, 24, PAIR)
    for n, titles in ((25, PAIR), (27, big + models), (28, PAIR)):
        rows = rows.union(day_of(spark, n, titles))
    return rows.cache()


def told(df):
    return sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in df.collect())


def test_statuses_over_days_and_resumed_runs(spark, week, tmp_path):
    """A story trends, another is new, the first goes on; a run that is broken off and resumed stores the same."""
    wanted = days.crawl_days(week, 1)
    assert wanted == [f"2026-04-{n}" for n in (24, 25, 27, 28)] and days.crawl_days(week, 3, "2026-04-25", "2026-04-28") == ["2026-04-27"]
    table = days.story_table(spark, f"file://{tmp_path}/whole")
    assert days.run_days(week, table, wanted, SMALL) == wanted and days.run_days(week, table, wanted, SMALL) == []
    status = {(str(r.day)[-2:], w): r.status for r in table.read().collect() for w in ("ukraine", "openai") if w in [k.lower() for k in r.label_keywords]}
    assert (status["27", "ukraine"], status["27", "openai"], status["28", "ukraine"]) == ("trending", "new", "ongoing")

    broken = days.story_table(spark, f"file://{tmp_path}/broken")
    days.run_days(week, broken, wanted[:1], SMALL)
    with pytest.raises(Exception, match="stop"):
        days.run_days(week.withColumn("title", F.when(F.col("day") == "2026-04-28", F.raise_error(F.lit("stop"))).otherwise(F.col("title"))), broken, wanted, SMALL)
    assert sorted(broken.manifest()["cells"]) == wanted[:3]
    assert days.run_days(week, broken, wanted, SMALL) == wanted[3:]
    assert told(broken.read()) == told(table.read())
    kept = broken.manifest()["cells"]["2026-04-24"]
    assert days.run_days(week, broken, wanted[3:], SMALL, again=True) == wanted[3:] and broken.manifest()["cells"]["2026-04-24"] == kept
    assert told(broken.read()) == told(table.read())


LINES = [
    ("Japan to simulate cyberattacks as PHP flaws roil internet", "reuters"), ("IT workers on frontline of PHP flaws scramble", "bbc"), ("Foundation patches critical PHP bug again", "zeit"),
    ("Critical PHP issue: what admins must do now", "register"), ("PHP developer conference opens in Berlin", "devnews"),
    *[(f"WordPress {name} theme critical PHP object injection", "cvefeed") for name in ("Astra", "Helion", "Rhodos", "Zen")], ("Storm floods coastal towns", "ap"),
]


def test_follow_ups_join_the_story_of_the_days_before(spark):
    """Without them no story; with them one, of those who cover it and not of who emits the word in bulk."""
    at = datetime(2026, 10, 23, 8)
    rows = articles(spark, LINES, day=at)
    before = articles(spark, [(f"Ordinary headline number {i} about weather and markets", f"s{i}") for i in range(30)], day=datetime(2026, 10, 16, 8))
    story = spark.createDataFrame([("t", ["php", "flaws", "critical"], ["Critical PHP flaws put websites at risk", "PHP flaws exploited by attackers", "Cloudflare sees attacks on PHP flaws"], {"php": 0.6, "flaw": 0.5, "critical": 0.3, "exploit": 0.2, "cloudflare": 0.2}, ["PHP", "Cloudflare"], 0.9)], "id string, label_keywords array<string>, sample_headlines array<string>, centroid_vector map<string,double>, entities array<string>, final_score double")
    for c in spark.createDataFrame([], SCORED).schema:
        if c.name not in story.columns:
            story = story.withColumn(c.name, (F.lit("2026-10-22") if c.name == "day" else F.lit(4) if c.name == "article_count" else F.lit(None)).cast(c.dataType))
    both, settings = rows.unionByName(before), replace(DEFAULTS, follow_up_df_share=1.0)
    assert daily.detect_day(both, story, "2026-10-23", settings, follow_up=False).count() == 0
    (topic,) = daily.detect_day(both, story, "2026-10-23", settings).collect()
    assert (topic.article_count, topic.unique_source_count) == (4, 4) and not any("conference" in t or "WordPress" in t for t in topic.sample_headlines)
    assert daily.detect_day(rows, story, "2026-10-23", settings).count() == 0  # no baseline, no anchor
    found = followup.anchors(story.withColumn("ordinal", F.lit(1)), headline_documents(rows), before, settings).collect()
    assert [(a.id, a.stem) for a in found] == [("t", "php")]


def test_commands_brief_stored_days(spark, week, tmp_path, monkeypatch):
    """Videos come with the stories; only days without a briefing are briefed; a recluster writes them anew."""
    from tidewire import __main__ as commands

    clip = articles(spark, [("Ukraine peace talks continue in Paris | Channel", "tv")], source_type=2, day=datetime(2026, 4, 27, 9))
    rows = week.unionByName(clip.withColumn("url_hash", F.lit(7).cast("long")).withColumn("url", F.lit("https://youtu.be/abc")))
    path, out = str(tmp_path / "articles"), str(tmp_path / "news")
    rows.write.parquet(path)
    monkeypatch.setattr(commands, "session", lambda: spark)
    commands.main(["export", path, "--out", out, "--now", "2026-04-28 01:00:00"])
    (first,) = briefing.read_briefings(spark, out).collect()
    lead = next(t for t in first.topics if "Ukraine" in t.title)
    assert first.date == "2026-04-27" and lead.videos[0].video_id == "abc" and lead.source_count == 6
    commands.main(["recluster", path, "--out", out, "--now", "2026-04-28 01:00:00", "--least", "3"])
    (second,) = briefing.read_briefings(spark, out).collect()
    assert second.generated_at > first.generated_at and second.topics == first.topics
    commands.main(["backfill", path, "--out", out])
    assert briefing.read_briefings(spark, out).first().generated_at == second.generated_at


def test_overviews_of_stored_days(spark):
    story = "struct<title:string,summary:string>"
    rows = spark.createDataFrame([("a", [("x", "s"), ("y", None)]), ("b", [("x", None), ("y", None)])], f"date string, topics array<{story}>")
    points = spark.createDataFrame([(d, i, f"p{i}", [2, 1, 1, 9]) for d in "ab" for i in (1, 2)], "date string, at int, text string, stories array<int>")
    once = briefing.with_overview(rows, points, summarised=True)
    assert {r.date: r.overview and r.overview.points[0].stories for r in once.collect()} == {"a": [1, 2], "b": None}
    other = points.withColumn("text", F.lit("new"))
    assert briefing.with_overview(once, other, force=False).where("date = 'a'").first().overview.points[0].text == "p1"
    assert briefing.with_overview(once, other).where("date = 'a'").first().overview.points[0].text == "new"
    assert briefing.with_overview(once, other.limit(0)).where("date = 'a'").first().overview.points[0].text == "p1"


def test_clusters_do_not_depend_on_the_order_of_terms():
    vectors = [{"a": 1.0, "b": 0.5}, {"b": 0.5, "a": 1.0}, {"c": 1.0}, {"a": 0.9, "b": 0.6}]
    assert cluster.leader_clusters(vectors, 0.5) == cluster.leader_clusters([dict(reversed(v.items())) for v in vectors], 0.5)

"""Briefings, read tools, feeds and ingest on small cases."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewire.operators import briefing, expand, serve, store
from tidewire.schemas import BRIEFING
from tidewire.sources import feeds


@pytest.fixture(scope="module")
def days(spark):
    article = ("A title", "https://x/1", "X", "2026-01-01T00:00:00.000Z", None, None)
    stories = [(f"t{i}", f"Story {i}", f"Story {i}", None, ["a"], "new", "world", None, None, 3, 3, [article], None) for i in (1, 2)]
    return spark.createDataFrame([("2026-01-01", "g", ([("point", [1, 2, 9])],), stories)], BRIEFING)


def test_tools(days):
    news = serve.call_tool("get_daily_news", {}, days, date(2026, 1, 2))
    assert news["structuredContent"]["overview"] == [{"text": "point", "topic_ids": ["t1", "t2"]}] and news["structuredContent"]["date"] == "2026-01-01"
    topic = serve.call_tool("get_topic", {"date": "2026-01-01", "topic_id": "t2"}, days, date(2026, 1, 2))["structuredContent"]["topic"]
    assert (topic["rank"], topic["summary"]) == (2, "")
    for bad in ({"date": "1 Jan"}, {"date": "2027-01-01"}, {"date": "2025-01-01"}):
        assert serve.call_tool("get_daily_news", bad, days, date(2026, 1, 2))["isError"]
    assert [r.ids for r in briefing.daily_points(days, "2026-01-01").collect()] == [["t1", "t2"]]
    assert [r["rank"] for r in briefing.daily_news(days, "2026-01-01").collect()] == [1, 2]


def test_briefing_files(days, tmp_path):
    folder = str(tmp_path / "news")
    briefing.write_briefings(days, folder)
    assert briefing.read_briefings(days.sparkSession, folder).first().topics[1].id == "t2"


def test_publish_message():
    assert serve.publish_message("A\tnews/2026-01-01.json") == "news: add 2026-01-01 daily topics export"
    assert serve.publish_message("A\tnews/2026-01-01.json\nM\tnews/2025-12-31.json") == "news: add 2026-01-01; update 2025-12-31 daily topics exports"
    assert serve.publish_message("M\tnews/index.json") == "news: update index"


def test_feed_parsing_and_rows(spark):
    rss = """<?xml version="1.0"?><rss><channel><title>The Feed</title><item><title>One &amp; two</title><link>https://Example.com/a/?utm_source=x</link>
<description><![CDATA[<p>Text</p><img src="https://i.example.com/p.jpg">]]></description><pubDate>Mon, 27 Apr 2026 08:00:00 +0000</pubDate><category>AI</category><category>ai</category></item>
<item><title>No address</title></item></channel></rss>"""
    fetched = spark.createDataFrame([("https://f/x", datetime(2026, 4, 27, 9), rss)], "feed_url string, fetched_at timestamp, body string")
    listed = feeds.feed_list(spark.createDataFrame([('["https://f/x", {"url": " https://f/y ", "enabled": false, "maxItems": 5, "sourceType": "video"}]',)], "value string"))
    assert [(r.url, r.enabled, r.max_items, r.source_type) for r in listed.orderBy("at").collect()] == [("https://f/x", True, 50, 1), ("https://f/y", False, 5, 2)]
    (row,) = feeds.article_rows(feeds.parse_feed(fetched), listed).collect()
    assert (row.url, row.title, row.summary, row.tags, row.feed_title) == ("https://example.com/a", "One & two", "Text", ["ai"], "The Feed")
    assert row.image_url == "https://i.example.com/p.jpg" and row.published_at == datetime(2026, 4, 27, 8)


def test_opml_carries_folders_forward(spark):
    opml = '<opml><outline text="My News!"><outline text="A &amp; B" xmlUrl="https://a/rss"/></outline><outline text="Tech"/><outline title="C" xmlUrl="https://c/rss"/></opml>'
    rows = feeds.opml_feeds(spark.createDataFrame([(opml,)], "value string"), "general", "en", "s").collect()
    assert sorted((r.url, r.name, r.category) for r in rows) == [("https://a/rss", "A & B", "my-news"), ("https://c/rss", "C", "tech")]


def test_charsets():
    assert feeds.decoded("<?xml version='1.0' encoding='ISO-8859-1'?>é".encode("latin-1")).endswith("é")
    assert feeds.decoded(b"\x93quoted\x94") == "“quoted”"


def test_ingest_flush_is_idempotent(spark, tmp_path):
    from tidewire.streaming.ingest import article_table, flush

    at = datetime(2026, 4, 27, 8)
    schema = "seq long, url_hash long, title string, summary string, image_url string, published_at timestamp, fetched_at timestamp"
    batch = spark.createDataFrame([(1, 1, "a", None, None, at, at), (2, 1, "b", "s", None, at, at), (3, 2, "c", None, None, None, at)], schema)
    path = str(tmp_path / "articles")
    assert flush(batch, path) == {"candidates": 3, "inserted": 2, "late": 0, "cells_read": 0, "cells": 0}
    assert flush(batch, path) == {"candidates": 3, "inserted": 0, "late": 0, "cells_read": 2, "cells": 2}
    rows = {r.url_hash: (r.title, r.summary) for r in article_table(spark, path).read().collect()}
    assert rows == {1: ("a", "s"), 2: ("c", None)}


def test_day_replacement(spark, tmp_path):
    path = str(tmp_path / "topics")
    frame = lambda rows: spark.createDataFrame(rows, "id string, topic_date string")
    store.replace_days(frame([("a", "2026-01-01"), ("b", "2026-01-02")]), path)
    store.replace_days(frame([("c", "2026-01-01")]), path, days=["2026-01-01", "2026-01-02"])
    assert [r.id for r in spark.read.parquet(path).collect()] == ["c"]


def test_picture_verdicts(spark):
    rows = [("u1", True, "image/png", "*", True), ("u2", True, "image/png", "https://me", True), ("u3", True, "text/html", "*", False), ("u4", True, "image/png", "https://me", False)]
    probes = spark.createDataFrame(rows, "image string, ok boolean, type string, allow string, redirected boolean")
    kept = expand.drop_unloadable(probes.select("image", F.lit(1).alias("n")), probes, "https://me").where("image is not null").collect()
    assert sorted(r.image for r in kept) == ["u1", "u4"]
    clash = probes.union(probes.where("image = 'u1'").withColumn("ok", F.lit(False)))
    assert expand.drop_unloadable(probes.select("image"), clash, "https://me").where("image = 'u1'").count() == 0


def test_latest_day_and_registry(spark):
    from tidewire.operators import usage

    dates = spark.createDataFrame([("2026-04-01",), ("2026-05-20",), ("2026-06-30",), ("draft",)], "date string")
    shown = lambda **k: [r.date for r in briefing.latest(dates, "2026-06-01", **k).collect()]
    assert shown() == ["2026-06-30"] and shown(listed=False) == ["2026-05-20"] and shown(listed=False, back=12) == []
    known = spark.createDataFrame([("story_date",), ("latency_ms",), ("other",)], "name string")
    todo = usage.registrations(known)
    assert todo.count() == 16 and usage.registrations(known.union(todo.select("name"))).count() == 0
    assert {(r.name, r.unit) for r in todo.where("kind = 'metric'").collect()} == {("result_count", "STANDARD"), ("story_outlets", "STANDARD")}


def test_vectors_as_json(spark):
    from tidewire.functions import values

    rows = spark.createDataFrame([({"b": 0.5, "a": 1.0},), ({},)], "v map<string,double>").withColumn("j", values.vector_json(F.col("v")))
    assert [(r.j, r.w) for r in rows.withColumn("w", values.vector_of_json(F.col("j"))).collect()] == [('{"a":1.0,"b":0.5}', {"a": 1.0, "b": 0.5}), ("{}", {})]
    odd = spark.createDataFrame([("[1]",), ("x",), (None,), ('{"a": "t", "b": 2}',)], "j string")
    assert [r.w for r in odd.select(values.vector_of_json(F.col("j")).alias("w")).collect()] in ([{}, {}, {}, {"b": 2.0}], [{}, {}, {}, {}])

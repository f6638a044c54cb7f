"""Transport, commands, exports, versioned tables, repair, polling and small states on small cases."""

from __future__ import annotations

import base64
import http.server
import json
import threading
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from tests.test_serving import days  # noqa: F401

from tidewire.operators import briefing, expand, rpc, store, usage
from tidewire.sources import feeds
from tidewire.streaming import ingest

SERVER = rpc.Server(origins=("https://me.example",))
TODAY = date(2026, 1, 2)


def call(days, method, params=None, headers=None, id_=1, server=SERVER):  # noqa: F811
    body = json.dumps({"jsonrpc": "2.0", "id": id_, "method": method} | ({"params": params} if params is not None else {})).encode()
    return rpc.post(body, headers or {}, server, days, TODAY)


def modern(method, name=None):
    meta = {"_meta": {rpc.META + "protocolVersion": "2026-07-28", rpc.META + "clientCapabilities": {}}}
    return meta, {"mcp-protocol-version": "2026-07-28", "mcp-method": method} | ({"mcp-name": name} if name else {})


def test_rpc_negotiates_and_answers(days):  # noqa: F811
    assert call(days, "initialize", {"protocolVersion": "2025-06-18"}).body["result"]["protocolVersion"] == "2025-06-18"
    assert call(days, "initialize", {"protocolVersion": "1999"}).body["result"]["protocolVersion"] == "2025-11-25"
    assert call(days, "ping").body == {"jsonrpc": "2.0", "id": 1, "result": {}}
    meta, headers = modern("tools/list")
    listed = call(days, "tools/list", meta, headers)
    assert listed.headers["Cache-Control"] == "public, max-age=3600" and listed.body["result"]["resultType"] == "complete" and len(listed.body["result"]["tools"]) == 2
    meta, headers = modern("tools/call", f"=?base64?{base64.b64encode(b'get_topic').decode()}?=")
    got = call(days, "tools/call", meta | {"name": "get_topic", "arguments": {"date": "2026-01-01", "topic_id": "t1"}}, headers)
    assert got.body["result"]["structuredContent"]["topic"]["rank"] == 1
    assert call(days, "tools/call", {"name": "get_daily_news", "arguments": {"date": "2026-02-31"}}).body["result"]["isError"]


def test_rpc_refuses(days):  # noqa: F811
    code = lambda r: (r.status, r.body["error"]["code"])
    meta, headers = modern("tools/list")
    assert code(call(days, "tools/list", meta, headers | {"mcp-method": "ping"})) == (400, rpc.HEADER_MISMATCH)
    assert code(call(days, "tools/list", meta)) == (400, rpc.HEADER_MISMATCH)
    assert code(call(days, "ping", None, {"mcp-protocol-version": "1999"})) == (400, rpc.NO_VERSION)
    assert code(call(days, "ping", None, {"mcp-protocol-version": "2026-07-28"})) == (400, rpc.INVALID_PARAMS)
    assert code(call(days, "server/discover")) == (404, rpc.NO_METHOD) and code(call(days, "tools/call", {"name": "x"})) == (200, rpc.INVALID_PARAMS)
    assert code(rpc.post(b"{", {}, SERVER, days, TODAY)) == (400, rpc.PARSE) and code(rpc.post(b"[]", {}, SERVER, days, TODAY)) == (400, rpc.INVALID_REQUEST)
    assert code(rpc.post(b" " * 70_000, {}, SERVER, days, TODAY)) == (413, rpc.INVALID_REQUEST) and code(call(days, "ping", id_=True)) == (400, rpc.INVALID_REQUEST)
    assert rpc.post(b'{"jsonrpc": "2.0", "method": "x"}', {}, SERVER, days, TODAY).status == 202
    seen = []
    limited = rpc.Server(allow=lambda h: False, observe=seen.append)
    assert code(call(days, "tools/call", {"name": "get_topic"}, server=limited)) == (429, rpc.INTERNAL) and seen[0]["status"] == 429
    web = lambda verb, path, **h: rpc.handle(verb, "https://s", path, b'{"jsonrpc": "2.0", "id": 1, "method": "ping"}', h, SERVER, days, TODAY)
    assert web("POST", "/mcp", origin="https://you").status == 403 and web("POST", "/mcp", origin="https://me.example").headers["Vary"] == "Origin"
    assert (web("GET", "/mcp").status, web("OPTIONS", "/mcp").status, web("GET", "/x").status) == (405, 204, 404)
    assert web("GET", "/.well-known/mcp/server-card.json").body["remotes"][0]["url"] == "https://s/mcp" and web("GET", "/").body["mcp_endpoint"] == "https://s/mcp"


def test_export_skips_and_forces(days, tmp_path):  # noqa: F811
    folder = str(tmp_path / "news")
    assert [briefing.export(days, folder), briefing.export(days, folder), briefing.export(days, folder, force=True)] == [2, 0, 2]
    assert briefing.missing_days(days, days.limit(0)).count() == 1


def test_dead_pictures_leave_their_articles(spark, days):  # noqa: F811
    shown = days.withColumn("topics", F.transform("topics", lambda t: t.withField("articles", F.transform(t["articles"], lambda a: a.withField("image", F.concat(F.lit("i"), t["id"]))))))
    verdicts = spark.createDataFrame([("it1", False), ("it2", True)], "image string, fine boolean")
    (row,) = briefing.without_dead_pictures(shown, verdicts).collect()
    assert (row.before, row.kept, row.changed) == (2, 1, True) and [t.articles[0].image for t in row.topics] == [None, "it2"]
    assert not briefing.without_dead_pictures(days, verdicts).first().changed


def test_archive_runs_by_month(spark, tmp_path):
    """Fetched times decide, whatever the date of publication; untouched months keep their files; six columns go."""
    from tidewire.operators import archive

    at = lambda m, d=1: datetime(2024, m, d)
    schema = "url_hash long, title string, summary string, image_url string, author string, feed_title string, tags string, raw_fingerprint string, published_at timestamp, fetched_at timestamp"
    full = ("a", "f", "x", "r")
    hot = spark.createDataFrame(
        [
            (1, "t", "s", None, *full, datetime(2020, 1, 1), at(6)), (2, "t", "s", None, *full, at(5), at(1)), (3, None, None, "i", *full, None, at(1, 9)),
            (4, None, None, None, *full, None, at(1, 10)), (5, None, None, None, *full, None, at(2)), (6, "t", None, None, *full, None, at(2, 20)),
        ], schema,
    )
    table = archive.archive_table(spark, f"file://{tmp_path}/cold")
    assert archive.archive_articles(hot, table, "2024-02-10", dry_run=True)[1] == {"2024-01": 2} and table.version() == 0
    left, counts = archive.archive_articles(hot, table, "2024-02-10")
    assert counts == {"2024-01": 2} and sorted((r.url_hash, r.month, r.author) for r in table.read().collect()) == [(2, "2024-01", "a"), (3, "2024-01", "a")]
    kept = {r.url_hash: (r.summary, r.image_url, r.author, r.feed_title, r.tags, r.raw_fingerprint) for r in left.collect()}
    assert kept[1] == ("s", None, *full) and kept[2] == kept[3] == kept[4] == (None,) * 6
    assert kept[5] == (None, None, *full)  # its month has nothing to archive
    january = table.manifest()["cells"]["2024-01"]
    again, counts = archive.archive_articles(left.where("url_hash > 3"), table, "2024-03-01")
    assert counts == {"2024-02": 1} and table.manifest()["cells"]["2024-01"] == january and table.read().count() == 3

    topics = spark.createDataFrame([("a", date(2024, 1, 5)), ("b", date(2024, 2, 5))], "id string, topic_date date")
    links = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "topic_id string, url_hash long")
    stored = archive.archive_table(spark, f"file://{tmp_path}/topics", "id"), archive.archive_table(spark, f"file://{tmp_path}/links")
    archive.archive_topic_tables(topics, links, ["2024-01"], *stored)
    archive.archive_topic_tables(topics, links.where("url_hash <> 1"), ["2024-01", "2024-02"], *stored)
    assert sorted((r.id, r.month) for r in stored[0].read().collect()) == [("a", "2024-01"), ("b", "2024-02")]
    assert sorted(r.url_hash for r in stored[1].read().collect()) == [1, 2, 3]


def test_refused_requests_spend_nothing(spark):
    from tidewire.operators import enrich

    asked = spark.createDataFrame([("d", 1, 1000, None), ("d", 2, 10_000_000, None), ("d", 3, 1000, None), ("e", 1, 1000, 0.0), ("e", 2, 1000, 0.0)], "day string, at long, chars long, cost double")
    ledger = spark.createDataFrame([("e", 0.01), ("e", 0.009)], "day string, amount double")
    got = lambda budget: sorted((r.day, r.at) for r in enrich.within_budget(asked, ledger, budget, 0.1, 0.4, 900).collect())
    assert got(0.02) == [("d", 1), ("d", 3), ("e", 1), ("e", 2)]  # what is spent counts, not what might have been
    assert got(0.0192) == [("d", 1), ("d", 3)] and got(0.0) == []


def test_topic_archive_and_repair_counts(spark):
    made = spark.createDataFrame([("a", date(2026, 1, 5)), ("b", date(2026, 2, 5))], "id string, topic_date date")
    cold = spark.createDataFrame([("a", date(2026, 1, 5), "2026-01")], "id string, topic_date date, month string")
    assert sorted((r.id, r.month) for r in store.archive_topics(made, cold).collect()) == [("a", "2026-01"), ("b", "2026-02")]
    hot = spark.createDataFrame([(1, "t", None), (2, "t", "s"), (3, None, None)], "url_hash long, title string, summary string")
    assert tuple(store.repair_counts(hot, spark.createDataFrame([(1,), (1,), (3,)], "url_hash long")).first()) == (3, 2, 2)


def test_feed_list_is_sorted_and_backed_up(spark, tmp_path):
    rows = spark.createDataFrame([("https://b", "x"), ("https://a", "x"), ("https://c", "a")], "url string, category string")
    path, backups = str(tmp_path / "list"), str(tmp_path / "old")
    assert expand.write_feed_list(rows, path, backups, "1") == 3 and expand.write_feed_list(rows, path, backups, "2", most=2) == 2
    assert [f["url"] for f in json.loads(spark.read.text(path).first().value)] == ["https://c", "https://a"]
    assert len(json.loads(spark.read.text(f"{backups}/2").first().value)) == 3


def test_prompt_state_and_failures(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    got = spark.range(1).select(usage.snoozed(F.lit(None).cast("int"), now).alias("a"), usage.snoozed(F.lit(1), now).alias("b"), usage.snoozed(F.lit(5), now).alias("c")).first()
    assert [(x.dismissals, str(x.until.date())) for x in (got.a, got.b, got.c)] == [(1, "2026-01-31"), (2, "2026-04-01"), (6, "2026-04-01")]
    may = lambda d, u, reads, back: spark.range(1).select(usage.may_prompt(F.lit(d).cast("int"), F.lit(u).cast("timestamp"), now, F.lit(reads), F.lit(back))).first()[0]
    assert may(None, None, 3, False) and may(2, "2025-12-31", 1, True) and not may(3, None, 9, True) and not may(1, "2026-02-01", 9, True) and not may(0, None, 2, False)
    assert usage.site_events(spark.createDataFrame([("share",), ("x",)], "event string")).count() == 1
    assert ingest.failure("TransactionContext Error") == "fatal" and ingest.failure("HTTP 404") == "passing"


class _Site(http.server.BaseHTTPRequestHandler):
    tries = 0

    def do_GET(self):  # noqa: N802
        if self.path == "/slow":
            time.sleep(3)
        if self.path.startswith("/loop"):
            self.send_response(302)
            self.send_header("Location", f"/loop{len(self.path)}")
            self.end_headers()
            return
        self.send_response(404 if self.path == "/none" else 200)
        self.send_header("Content-Type", "text/xml; charset=iso-8859-1")
        self.end_headers()
        self.wfile.write("<rss>é</rss>".encode("latin-1"))

    def log_message(self, *args):
        pass


def test_polling_is_bounded(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    try:
        kind = "text/xml; charset=iso-8859-1"
        assert feeds.fetch(f"{root}/a") == feeds.Answer("<rss>é</rss>", None, 200, kind) and feeds.fetch(f"{root}/none").error == "HTTP 404"
        assert feeds.fetch(f"{root}/loop").body is None and feeds.fetch(f"{root}/a", limit=3).error == "too large" and feeds.fetch("nowhere").error
        assert feeds.fetch(f"{root}/a", head=5) == feeds.Answer("<rss>", None, 200, kind)
        began = time.time()
        assert feeds.within(0.5, lambda: feeds.fetch(f"{root}/slow")).error == "deadline" and time.time() - began < 1
        spark.dataSource.register(feeds.FeedSource)
        rows = spark.read.format("feeds").option("urls", f"{root}/a {root}/none http://127.0.0.1:9/x").load().collect()
        want = {"a": (True, None, 200), "none": (False, "HTTP 404", 404), "x": (False, "ConnectionRefusedError", None)}
        assert {r.feed_url.rsplit("/", 1)[1]: (r.body is not None, r.error, r.status) for r in rows} == want
        table = spark.createDataFrame([(f"{root}/a",), (f"{root}/none",), ("http://127.0.0.1:9/x",), (f"{root}/a",), (None,)], "url string")
        assert {r.feed_url.rsplit("/", 1)[1]: (r.body is not None, r.error, r.status) for r in feeds.polled(table, head=4096).collect()} == want
    finally:
        server.shutdown()


def test_feeds_stream_by_ticks(spark, tmp_path):
    """A restarted stream polls no tick twice; a host with more feeds than a tick admits takes turns."""
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    urls = " ".join(f"http://127.0.0.1:{server.server_port}/{c}" for c in "abcde")
    spark.dataSource.register(feeds.FeedSource)
    got = []

    def run():
        rows = spark.readStream.format("feeds").option("urls", urls).option("every", "3").option("perHost", "2").load()
        writer = rows.writeStream.foreachBatch(lambda df, _: got.append(sorted(r.feed_url[-1] for r in df.collect()))).option("checkpointLocation", f"{tmp_path}/checkpoint")
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert query.exception() is None

    try:
        turns = feeds._FeedStream({"urls": urls, "perhost": "2"})
        assert sorted("".join(u[-1] for u in turns.admitted(t)) for t in range(3)) == ["ad", "be", "c"] and turns.partitions({"tick": 4}, {"tick": 4}) == []
        for _ in range(4):
            run()
            time.sleep(1.5)
        polls = [p for p in got if p]
        assert polls and all(p in (["a", "d"], ["b", "e"], ["c"]) for p in polls) and all(x != y for x, y in zip(polls, polls[1:], strict=False))
    finally:
        server.shutdown()


def test_directory_listings(spark):
    entries = [{"name": "a.opml", "type": "file", "download_url": "https://x/a"}, {"name": "b.opml", "type": "dir", "download_url": None}, {"name": "c.md", "type": "file", "download_url": "https://x/c"}]
    rows = spark.createDataFrame([(json.dumps(entries),), ('{"message": "limit"}',), ("no json",), (None,)], "body string")
    assert [tuple(r) for r in feeds.listed_files(rows).collect()] == [("a.opml", "https://x/a")]


def test_commands_run(spark, sf_dir, tmp_path, capfd):
    from tidewire.__main__ import main

    path = f"{sf_dir}/documents.parquet"
    for command in ("stats", "dry-run"):
        main([command, path, "--now", "2024-01-31 00:00:00"])
    main(["export", path, "--out", str(tmp_path / "news"), "--now", "2024-01-05 00:00:00"])
    main(["archive", path, "--out", str(tmp_path / "cold"), "--now", "2024-01-31 00:00:00", "--keep", "10", "--dry-run"])
    told = capfd.readouterr().out
    assert "last_week" in told and "candidates" in told and "articles in" in told


def test_one_day_is_capped_and_has_videos(spark):
    from dataclasses import replace

    from tests.test_stories import articles

    from tidewire.config import DEFAULTS
    from tidewire.plans import daily

    news = articles(spark, [(f"Storm floods coastal city harbour {w}", s) for w, s in (("today", "a"), ("again", "b"), ("overnight", "c"), ("badly", "d"))])
    assert daily.capped(news, replace(DEFAULTS, max_articles=2)).count() == 2
    videos = articles(spark, [("Storm floods coastal city harbour | Channel", "tv")], source_type=2).withColumn("url_hash", F.lit(77).cast("long")).withColumn("url", F.lit("https://youtu.be/abc"))
    both = news.unionByName(videos).withColumn("image_url", F.lit("https://i.example/p.jpg"))
    scored = daily.with_videos(daily.detect_days(both.where("source_type = 1")), both)
    (day,) = daily.brief(scored, both, spark.createDataFrame([], "feed_url string, section string"), "now").collect()
    (story,) = day.topics
    assert story.article_count == 4 and story.videos[0].video_id == "abc" and all(a.image == "https://i.example/p.jpg" for a in story.articles)
    assert datetime.fromisoformat(day.date)

"""Requests to a model: what they say, what is asked twice, what it costs, and what is taken from the answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidewire.operators import briefing, enrich


@pytest.fixture(scope="module")
def stories(spark):
    article = "struct<title:string,description:string>"
    rows = [
        ("d1", 1, "a", [(f"Title {i} " + "x" * 300, "what  it is" if i == 0 else None) for i in range(7)], ["h1", "h2 " + "y" * 200, "h3", "h4"], "First", "told"),
        ("d1", 2, "b", [("Other", "")], ["only"], "Second", None), ("d1", 3, "c", [], [], "Third", ""), ("d2", 1, "e", [("Alone", "d")], ["alone"], "Fourth", "s"),
    ]
    return spark.createDataFrame(rows, f"day string, place int, id string, articles array<{article}>, sample_headlines array<string>, title string, summary string")


def test_requests_are_short(stories):
    got = {r.day: r for r in enrich.summary_requests(stories, "Do it.").collect()}
    first, second, third = got["d1"].input.split("\n\n")
    lines = first.split("\n")
    assert lines[0] == "[t1]" and len(lines) == 6 and lines[1].endswith("… — what it is") and len(lines[2]) == 202
    assert (second, third) == ("[t2]\n- Other", "[t3]\n") and got["d1"].chars == len(got["d1"].input) + 6
    sections = {r.day: r.input for r in enrich.section_requests(stories, "").collect()}
    assert sections["d2"] == "[t1]\n- alone" and sections["d1"].split("\n\n")[0].count("\n") == 3 and "h4" not in sections["d1"]
    overview = enrich.overview_requests(stories, "").collect()
    assert [r.day for r in overview] == ["d1"] and overview[0].input == "[1] First — told\n[2] Second\n[3] Third"


def model(instructions, body, reason):
    if "refuse" in instructions and reason:
        return {"status": 400, "body": "Unsupported parameter: reasoning.effort"}
    if "break" in instructions:
        raise OSError("gone")
    if "limit" in instructions:
        return {"status": 429, "body": "reasoning is busy"}
    if "wrong" in instructions:
        return {"status": 200, "body": "no json"}
    topics = [{"key": "t1", "title": " New ", "summary": "s", "duplicate_of": "t1"}, {"key": "t2", "title": "Dup", "summary": "", "duplicate_of": "t1"}, {"key": "t9", "title": "x"}, {"key": "t3", "title": ""}]
    return {"status": 200, "body": json.dumps({"topics": topics}), "tokens_in": 1000, "tokens_out": 500}


def test_one_resend_and_failures(stories):
    asked = {kind: enrich.ask(enrich.summary_requests(stories.where("day = 'd1'"), kind), model).first().answer for kind in ("fine", "refuse", "break", "limit", "wrong")}
    assert {k: a and (a.status, a.resent) for k, a in asked.items()} == {"fine": (200, False), "refuse": (200, True), "break": None, "limit": (429, False), "wrong": (200, False)}
    assert enrich.ask(enrich.summary_requests(stories, ""), None).where("answer is not null").count() == 0


def test_replies_and_spend(spark, stories):
    requests = enrich.summary_requests(stories, "fine").withColumn("at", F.lit(1))
    allowed = enrich.within_budget(requests, spark.createDataFrame([("d2", 0.0199)], "day string, amount double"), 0.02, 0.1, 0.5, 2000)
    assert [r.day for r in allowed.collect()] == ["d1"]
    asked = enrich.ask(allowed, model)
    (spend,) = enrich.spends(asked, 0.1, 0.5).collect()
    assert spend.day == "d1" and spend.amount == pytest.approx((1000 * 0.1 + 500 * 0.5) / 1e6)
    known = enrich.keyed(stories)
    got = sorted((r.id, r.title, r.summary, r.duplicate_of) for r in enrich.replies(enrich.topic_replies(asked), known).collect())
    assert got == [("a", "New", "s", None), ("b", "Dup", None, "a")]
    wrong = enrich.ask(enrich.summary_requests(stories, "wrong").withColumn("worst", F.lit(0.5)), model)
    assert enrich.topic_replies(wrong).count() == 0 and {r.amount for r in enrich.spends(wrong, 0.1, 0.5).collect()} == {0.5}


def test_overview_points(spark, stories):
    points = {"points": [{"text": " One\n two ", "stories": [2, 1, 9]}, {"text": "Three", "stories": [3]}, {"text": "", "stories": [1]}]}
    asked = enrich.ask(enrich.overview_requests(stories, ""), lambda i, b, r: {"status": 200, "body": json.dumps(points)})
    days = stories.groupBy(F.col("day").alias("date")).agg(F.collect_list(F.struct("title", "summary")).alias("topics"))
    got = {r.date: r.overview for r in briefing.with_overview(days, enrich.overview_replies(asked)).collect()}
    assert got["d2"] is None and [(p.text, p.stories) for p in got["d1"].points] == [("One two", [1, 2]), ("Three", [3])]

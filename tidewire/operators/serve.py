"""The read tools over stored briefings: arguments checked, days found, results as plain structures."""

from __future__ import annotations

import json
import re
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, functions as F


class ToolInputError(ValueError):
    """Wrong arguments: told to the caller as a tool error."""


def _day(days: DataFrame, wanted: str | None, today: date) -> tuple[str, dict]:
    """The asked day, or today's or else yesterday's; only that day's row is read."""
    if wanted is not None:
        if not isinstance(wanted, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", wanted):
            raise ToolInputError("a date is written YYYY-MM-DD")
        try:
            datetime.strptime(wanted, "%Y-%m-%d")
        except ValueError:
            raise ToolInputError(f"{wanted} is no day of the calendar") from None
        if wanted > str(today):
            raise ToolInputError(f"{wanted} lies ahead of {today}")
    asked = [wanted] if wanted is not None else [str(today), str(today - timedelta(days=1))]
    found = {r["date"]: r.asDict(recursive=True) for r in days.where(F.col("date").isin(asked)).collect()}
    for d in asked:
        if d in found:
            return d, found[d]
    raise ToolInputError(f"there is no briefing for {' or '.join(asked)}")


def _summary(story: dict) -> dict:
    keep = lambda rows, keys: [{k: r.get(k) for k in keys} for r in rows or []]
    out = {k: story.get(k) for k in ("id", "title", "category", "source_count", "article_count")} | {"summary": story.get("summary") or ""}
    out |= {"section": story["section"]} if story.get("section") else {}
    return out | {"articles": keep(story.get("articles"), ("title", "source", "url", "published_at")), "videos": keep(story.get("videos"), ("title", "channel", "url", "published_at"))}


def get_daily_news(days: DataFrame, today: date, date: str | None = None) -> dict:
    """A day's stories and its overview, whose story positions become ids; positions without a story go."""
    day, found = _day(days, date, today)
    stories = found.get("topics") or []
    points = ((found.get("overview") or {}).get("points")) or []
    named = [{"text": p["text"], "topic_ids": [stories[n - 1]["id"] for n in p["stories"] or [] if 1 <= n <= len(stories)]} for p in points]
    return {"date": day, "generated_at": found.get("generated_at"), "overview": named, "topics": [_summary(s) for s in stories]}


def get_topic(days: DataFrame, today: date, date: str | None = None, topic_id: str | None = None) -> dict:
    """One story of a day in full, with its rank."""
    if not isinstance(date, str) or not isinstance(topic_id, str) or not topic_id:
        raise ToolInputError("a date and a topic_id are needed")
    day, found = _day(days, date, today)
    for rank, story in enumerate(found.get("topics") or [], 1):
        if story["id"] == topic_id:
            told = [{k: a.get(k) for k in ("title", "source", "url", "published_at")} | {"description": a.get("description") or ""} for a in story.get("articles") or []]
            extra = {"rank": rank, "headline": story.get("headline"), "entities": story.get("entities") or [], "keywords": story.get("label") or [], "articles": told}
            return {"date": day, "topic": _summary(story) | extra}
    raise ToolInputError(f"{day} has no topic {topic_id}")


TOOLS = {"get_daily_news": get_daily_news, "get_topic": get_topic}


def call_tool(name: str, arguments: dict | None, days: DataFrame, today: date) -> dict:
    """A tool's result as text and structure; input and loading errors are results too, an unknown tool is not."""
    tool = TOOLS[name]
    try:
        result = tool(days, today, **(arguments or {}))
    except (ToolInputError, TypeError) as e:
        return {"content": [{"type": "text", "text": str(e)}], "isError": True}
    return {"content": [{"type": "text", "text": json.dumps(result)}], "structuredContent": result, "isError": False}


def publish_message(changes: str) -> str:
    """A commit message from lines of status and file: which days were added and which updated."""
    days = [(s, m[1]) for s, f in (line.split("\t")[:2] for line in changes.splitlines() if "\t" in line) if (m := re.search(r"(\d{4}-\d{2}-\d{2})\.json$", f))]
    added, updated = [d for s, d in days if s == "A"], [d for s, d in days if s != "A"]
    if len(added) == 1 and not updated:
        return f"news: add {added[0]} daily topics export"
    parts = [f"{verb} {', '.join(ds)}" for verb, ds in (("add", added), ("update", updated)) if ds]
    return f"news: {'; '.join(parts)} daily topics exports" if parts else "news: update index"

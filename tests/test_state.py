"""Stateful streams with restarts from their checkpoint, against the batch functions over the whole log."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.streaming import ingest, state

START = datetime(2026, 4, 1)


@pytest.fixture(scope="module")
def store(spark):
    for k, v in state.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in state.STATE_STORE:
        spark.conf.unset(k)


def run(spark, tmp_path, parts, schema, stream):
    """Each part of a log is a file that a fresh query takes in from where the last one ended; all rows that came out, by part."""
    out = []
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        got = []
        query = (
            stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/log")).writeStream.outputMode("update")
            .foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()  # noqa: B023
        )
        query.awaitTermination(120)
        assert query.exception() is None, i
        out.append(got)
    return out


def test_poll_state_over_restarts(store, tmp_path):
    rng = random.Random(2)
    log = [(f"f{rng.randint(0, 5)}", START + timedelta(minutes=7 * i), rng.random() < 0.4, 10 * rng.randint(1, 9)) for i in range(90)]
    parts = [log[:30], log[30:60], log[60:]]
    schema = "feed_url string, at timestamp, ok boolean, interval_minutes int"
    out = run(store, tmp_path, parts, schema, state.poll_stream)
    last = {}
    for r in (r for part in out for r in part if not r.due):
        last[r.feed_url] = tuple(r)[:5]
    twin = {r.feed_url: (r.feed_url, r.last_success, r.last_failure, r.failure_count, r.next_poll) for r in ingest.poll_states(store.createDataFrame(log, schema)).collect()}
    assert last == twin
    due = [r for part in out for r in part if r.due]
    assert due and all(r.next_poll <= log[-1][1] for r in due)


def test_read_state_is_forgotten(store, tmp_path):
    marks = [("a", "2026-04-01", "x", START), ("a", "2026-04-01", "y", START), ("b", "2026-04-02", "x", START + timedelta(days=1))]
    later = [("a", "2026-04-01", "x", START + timedelta(days=3)), ("a", "2026-04-04", "z", START + timedelta(days=3))]
    last = [("c", "2026-04-16", "q", START + timedelta(days=15, hours=2))]
    schema = "device string, date string, id string, at timestamp"
    first, second, third = run(store, tmp_path, [marks, later, last], schema, state.read_stream)
    shown = lambda rows: sorted((r.device, r.date, r.ids) for r in rows)
    assert shown(first) == [("a", "2026-04-01", ["x", "y"]), ("b", "2026-04-02", ["x"])]
    assert shown(second) == [("a", "2026-04-01", ["x", "y"]), ("a", "2026-04-04", ["z"])]
    assert shown(third) == [("a", "2026-04-01", []), ("c", "2026-04-16", ["q"])]
    held = {}
    for r in (r for part in (first, second, third) for r in part):
        held[r.device, r.date] = r.ids
    twin = state.read_states(store.createDataFrame(marks + later + last, schema), date(2026, 4, 16))
    assert {k: v for k, v in held.items() if v} == {(r.device, r.date): r.ids for r in twin.collect()}


def test_snooze_state_over_restarts(store, tmp_path):
    rows = [("a", START), ("b", START + timedelta(hours=1))]
    later = [("a", START + timedelta(days=40)), ("c", START + timedelta(days=41))]
    schema = "device string, at timestamp"
    first, second, third = run(store, tmp_path, [rows, later, [("d", START + timedelta(days=200))]], schema, state.snooze_stream)
    last = {}
    for r in (r for part in (first, second, third) for r in part if not r.over):
        last[r.device] = (r.dismissals, r.until)
    twin = state.snooze_states(store.createDataFrame([*rows, *later, ("d", START + timedelta(days=200))], schema))
    assert last == {r.device: (r.dismissals, r.until) for r in twin.collect()} and last["a"] == (2, START + timedelta(days=130))
    assert {r.device for part in (second, third) for r in part if r.over} == {"a", "b", "c"}

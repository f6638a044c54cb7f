"""Keyed state of streams: when feeds are polled again, what devices have read, and when a prompt may show again.

Each is a stateful processor with event-time timers; state lives in the RocksDB store (`STATE_STORE`) and outlives
restarts by the query's checkpoint. The batch functions beside them give the same state from a whole log.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewire.config import DEFAULTS, Settings
from tidewire.operators.usage import SNOOZE_DAYS, snoozed

#: The store that stateful processors need; a session has to have it.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _ms(at: datetime) -> int:
    return int(at.replace(tzinfo=at.tzinfo or UTC).timestamp() * 1000)


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


class _Timed(StatefulProcessor):
    """One value of state a key, and one timer, which moves when the state does."""

    state = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state)

    def close(self) -> None:
        pass

    def wake(self, at_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at_ms)


class PollState(_Timed):
    """A feed's failures since its last success and when it is due: a failure doubles the wait up to sixteenfold and a day.

    A row a feed and micro-batch, and a row with `due` when its time has come (in the log's event time).
    """

    state = "last_success timestamp, last_failure timestamp, failure_count int, next_poll timestamp"

    def __init__(self, most_minutes: int):
        self.most = most_minutes

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        success, failure, failures = self.value.get()[:3] if self.value.exists() else (None, None, 0)
        for row in sorted(rows, key=lambda r: r.at):
            success, failures, failure = (row.at, 0, None) if row.ok else (success, failures + 1, row.at)
            wait = min(row.interval_minutes * 2 ** min(failures - 1, 4), self.most) if failures else row.interval_minutes
            after = row.at + timedelta(minutes=wait)
        self.value.update((success, failure, failures, after))
        self.wake(_ms(after))
        yield Row(feed_url=key[0], last_success=success, last_failure=failure, failure_count=failures, next_poll=after, due=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        success, failure, failures, after = self.value.get()
        yield Row(feed_url=key[0], last_success=success, last_failure=failure, failure_count=failures, next_poll=after, due=True)


def poll_stream(log: DataFrame, settings: Settings = DEFAULTS, lateness: str = "1 minute") -> DataFrame:
    """Poll state of a stream of (feed_url, at, ok, interval_minutes); `ingest.poll_states` is its batch twin."""
    out = "feed_url string, last_success timestamp, last_failure timestamp, failure_count int, next_poll timestamp, due boolean"
    return log.withWatermark("at", lateness).groupBy("feed_url").transformWithState(PollState(settings.max_backoff_minutes), out, "Update", "EventTime")


class ReadState(StatefulProcessor):
    """What a device has read, by date of the briefing; dates of more than `keep` days ago are forgotten when their time is over."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.read = handle.getMapState("read", "date string", "ids array<string>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        touched = {}
        for row in rows:
            held = touched.get(row.date) or set(self.read.getValue((row.date,))[0] if self.read.containsKey((row.date,)) else ())
            touched[row.date] = held | {row.id}
        for day, ids in sorted(touched.items()):
            self.read.updateValue((day,), (sorted(ids),))
            self.handle.registerTimer(_ms(datetime.fromisoformat(day)) + (self.keep + 1) * 86_400_000)
            yield Row(device=key[0], date=day, ids=sorted(ids))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        last = str(_time(expiredTimerInfo.getExpiryTimeInMs()).date() - timedelta(days=self.keep + 1))
        for (day,) in list(self.read.keys()):
            if day <= last:
                self.read.removeKey((day,))
                yield Row(device=key[0], date=day, ids=[])


def read_stream(marks: DataFrame, keep: int = 14, lateness: str = "1 hour") -> DataFrame:
    """(device, date, ids) of a stream of marks (device, date, id, at): the ids read of a date, or none once it is forgotten."""
    return marks.withWatermark("at", lateness).groupBy("device").transformWithState(ReadState(keep), "device string, date string, ids array<string>", "Update", "EventTime")


def read_states(marks: DataFrame, today: date, keep: int = 14) -> DataFrame:
    """The batch twin: the ids that each device has read, of dates that are not forgotten on a day."""
    kept = marks.where(F.col("date") >= str(today - timedelta(days=keep)))
    return kept.groupBy("device", "date").agg(F.array_sort(F.collect_set("id")).alias("ids"))


class SnoozeState(_Timed):
    """A device's dismissals of the prompt and until when it sleeps: 30 days, then 90. A row with `over` when that ends."""

    state = "dismissals int, until timestamp"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        n = self.value.get()[0] if self.value.exists() else 0
        for row in sorted(rows, key=lambda r: r.at):
            n += 1
            until = row.at + timedelta(days=SNOOZE_DAYS[min(n, len(SNOOZE_DAYS)) - 1])
        self.value.update((n, until))
        self.wake(_ms(until))
        yield Row(device=key[0], dismissals=n, until=until, over=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        n, until = self.value.get()
        yield Row(device=key[0], dismissals=n, until=until, over=True)


def snooze_stream(dismissals: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(device, dismissals, until, over) of a stream of dismissals (device, at)."""
    return dismissals.withWatermark("at", lateness).groupBy("device").transformWithState(SnoozeState(), "device string, dismissals int, until timestamp, over boolean", "Update", "EventTime")


def snooze_states(dismissals: DataFrame) -> DataFrame:
    """The batch twin."""
    counted = dismissals.groupBy("device").agg(F.count("*").cast("int").alias("n"), F.max("at").alias("last"))
    return counted.select("device", snoozed(F.col("n") - 1, F.col("last")).alias("s")).select("device", "s.dismissals", "s.until")

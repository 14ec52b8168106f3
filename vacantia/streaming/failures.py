"""The failure counter as keyed state of a stream of probe results, with an event-time timer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.replay import SILENCE_HOURS
from ..operators.sync import FAILURE_LIMIT
from .jobs import run_to_files

#: One row a source and batch that has events of it, and one when it expires.
CHANGES = "source_id long, seq long, at_ms long, ats_failure_count long, ats_status string"
_STATE = "count long, known boolean, last_ms long, seq long"


def _status(count: int, known: bool) -> str | None:
    if count:
        return "needs_manual_review" if count >= FAILURE_LIMIT else "dead"
    return "ok" if known else None


class FailureCounter(StatefulProcessor):
    """Counts failures in a row; a success resets, ``hours`` without an event end the state.

    Events of a batch go by time, then id. An event older than the source's last one (a later batch, within
    the watermark) counts when it comes and moves no timer back.
    """

    def __init__(self, hours: int = SILENCE_HOURS):
        self.silence = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counter", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        count, known, last, seq = self.state.get() if self.state.exists() else (0, False, None, 0)
        old = last
        for ms, _, failed in sorted(((r.ms, r.event_id, r.failed) for r in rows), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
            if last is not None and ms >= last + self.silence:
                count, known = 0, False
            if failed is not None:
                count, known = (count + 1 if failed else 0), True
            last = ms if last is None else max(ms, last)
        self.state.update((count, known, last, seq + 1))
        if last != old:
            if old is not None:
                self.handle.deleteTimer(old + self.silence)
            self.handle.registerTimer(last + self.silence)
        yield self._change(key, seq, last, count, _status(count, known))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        count, known, last, seq = self.state.get()
        self.state.update((0, False, None, seq + 1))  # the number goes on, so that later changes stay the latest
        yield self._change(key, seq, expiredTimerInfo.getExpiryTimeInMs(), 0, "expired")

    @staticmethod
    def _change(key, seq: int, ms: int, count: int, status: str | None) -> Row:
        return Row(source_id=key[0], seq=seq, at_ms=ms, ats_failure_count=count, ats_status=status)

    def close(self) -> None:
        pass


def failure_changes(probes: DataFrame, late: str = "1 hour", hours: int = SILENCE_HOURS) -> DataFrame:
    """Changes of the counters of a stream (source_id long, ts, event_id, failed); rows without time are dropped, as a watermark needs one."""
    timed = probes.filter("ts IS NOT NULL").select("source_id", "ts", F.unix_millis("ts").alias("ms"), "event_id", "failed").withWatermark("ts", late)
    return timed.groupBy("source_id").transformWithState(FailureCounter(hours), CHANGES, "Append", "EventTime")


def run(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Append the changes of all that is there as files (the processor's timers need the RocksDB state store)."""
    run_to_files(changes, path, checkpoint)


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each source."""
    return changes.groupBy("source_id").agg(F.max_by(F.struct("at_ms", "ats_failure_count", "ats_status"), "seq").alias("c")).select("source_id", "c.*")

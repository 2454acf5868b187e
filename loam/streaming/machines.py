"""State that outlives a batch: a status machine with retries, claims that lapse, and a cache whose answers expire."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_store(spark: SparkSession):
    """Stateful processors keep their state in RocksDB, which the session is set to while their queries start and run."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


_EPOCH, _US, _NEVER = datetime(1970, 1, 1, tzinfo=UTC), timedelta(microseconds=1), -(1 << 63)


def _in_order(rows: Iterator[Row]) -> list[tuple]:
    """A batch's events of one key (key, event_id, at, what the processor reads) by time and id: microseconds (those without a time first), id, and what it reads."""
    return sorted((_NEVER if at is None else (at - _EPOCH) // _US, number, *rest) for _, number, at, *rest in rows)


class StatusMachine(StatefulProcessor):
    """Statuses that a key asks for, applied where ``legal`` (from -> statuses; '' is the start) allows it.

    ``failed`` names the status of a failed run: it is legal from anywhere, and a key that has failed may start again, but only ``retries``
    times; after that it is stalled and nothing is applied any more. An event older than the newest one of its key is late and is not
    applied. A row per key and batch tells how it stands.
    """

    READS = ("status",)
    OUTPUT = "key long, status string, n_applied long, n_refused long, n_late long, n_failures int, stalled boolean"

    def __init__(self, legal: dict[str, tuple[str, ...]], failed: str, retries: int):
        self.legal, self.failed, self.retries = legal, failed, retries

    def init(self, handle) -> None:
        self.state = handle.getValueState("run", "status string, n_applied long, n_refused long, n_late long, n_failures int, newest long, newest_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, applied, refused, late, failures, newest, newest_id = self.state.get() or ("", 0, 0, 0, 0, -(1 << 62), -(1 << 62))
        for at, number, asked in _in_order(rows):
            if (at, number) <= (newest, newest_id):
                late += 1
                continue
            newest, newest_id = at, number
            stalled = status == self.failed and failures > self.retries
            fits = asked == self.failed and status != self.failed or asked in self.legal.get("" if status == self.failed else status, ())
            if stalled or not fits:
                refused += 1
            else:
                status, applied = asked, applied + 1
                failures += asked == self.failed
        self.state.update((status, applied, refused, late, failures, newest, newest_id))
        stalled = status == self.failed and failures > self.retries
        yield Row(key=key[0], status=status, n_applied=applied, n_refused=refused, n_late=late, n_failures=failures, stalled=stalled)

    def close(self) -> None:
        pass


class Claims(StatefulProcessor):
    """Claims that lapse ``idle_us`` microseconds after the last event of their key: a row per lapse (key, since_us, lapsed_us, n_events).

    A gap between two events of a batch lapses where it lies; after the last one a timer waits for the watermark to pass the time. An
    event that is older than the newest of its open claim still counts as one of its events; one of a claim that has lapsed opens a new one.
    """

    READS = ()
    OUTPUT = "key long, since_us long, lapsed_us long, n_events long"

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claim", "since long, newest long, n long")

    def _row(self, key, since: int, newest: int, n: int) -> Row:
        return Row(key=key[0], since_us=since, lapsed_us=newest + self.idle, n_events=n)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        lapsed, now = [], self.state.get()
        if now is not None:
            self.handle.deleteTimer(self._due(now[1]))
        for at, _ in _in_order(rows):
            if now is not None and at - now[1] <= self.idle:
                now = (min(now[0], at), max(now[1], at), now[2] + 1)
            else:
                if now is not None:
                    lapsed.append(self._row(key, *now))
                now = (at, at, 1)
        self.state.update(now)
        self.handle.registerTimer(self._due(now[1]))
        yield from lapsed

    def _due(self, newest: int) -> int:
        """The first whole millisecond by which the claim has lapsed."""
        return -(-(newest + self.idle) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self.state.get()
        self.state.clear()
        if now is not None:
            yield self._row(key, *now)

    def close(self) -> None:
        pass


class ExpiringCache(StatefulProcessor):
    """Questions answered from a cache: the first one of a key is a miss, and so is any that comes ``ttl_us`` microseconds or more after the last miss.

    A row per key and batch: misses, hits, and when and by which event the cached answer was made. The answer leaves the state when the
    watermark passes its time, which a timer waits for; the counts stay. A late question is answered by what is cached now.
    """

    READS = ()
    OUTPUT = "key long, n_misses long, n_hits long, made_us long, made_by long"

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "misses long, hits long")
        self.answer = handle.getValueState("answer", "made long, event long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        counts = self.counts.get()
        misses, hits = counts or (0, 0)
        before = answer = self.answer.get() if counts is not None else None
        for at, number in _in_order(rows):
            if answer is not None and at - answer[0] < self.ttl:
                hits += 1
            else:
                misses, answer = misses + 1, (at, number)
        if answer != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before[0]))
            self.answer.update(answer)
            self.handle.registerTimer(self._due(answer[0]))
        self.counts.update((misses, hits))
        yield Row(key=key[0], n_misses=misses, n_hits=hits, made_us=answer[0], made_by=answer[1])

    def _due(self, made: int) -> int:
        return -(-(made + self.ttl) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.answer.clear()
        return iter(())

    def close(self) -> None:
        pass


def kept(events: DataFrame, processor: StatefulProcessor, lateness: str = "2 hours") -> DataFrame:
    """A processor over events (key, event_id, at, and what it reads), in event time; run it inside keyed_store().

    A batch's events of a key are sorted by its task, so a source's trigger limits (files per batch) bound what a task holds. Only what the
    processor reads is shuffled and handed to Python.
    """
    return events.select("key", "event_id", "at", *processor.READS).withWatermark("at", lateness).groupBy("key").transformWithState(statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode="Update", timeMode="EventTime")

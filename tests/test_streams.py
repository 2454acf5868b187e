"""Stateful processors over several runs: what is kept, what is late, what lapses."""

import datetime

import pytest

from loam.streaming import ledgers as L, machines as M

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def at(minutes):
    return DAY + datetime.timedelta(minutes=minutes)


def us(minutes):
    return int((at(minutes) - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


@pytest.fixture()
def runs(spark, tmp_path):
    """Writes each batch of events and runs the processor on it, going on from the checkpoint; gives all rows written."""

    def run(processor, *batches):
        source, out, found = tmp_path / "in" / "events.parquet", str(tmp_path / "out"), []
        for rows in batches:
            spark.createDataFrame([(k, at(m), u, s) for k, m, u, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
            frame = spark.readStream.schema(SCHEMA).parquet(str(source)).selectExpr("user_id AS key", "event_id", "ts AS at", "event_type AS status")
            with M.keyed_store(spark):
                kept = M.kept(frame, processor, "10 minutes")
                L.run_once(kept, out, "update")
        for r in spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows/*").orderBy("batch").collect():
            found.append(tuple(r)[:-1])
        return found

    return run


def test_a_run_fails_retries_stalls_and_ignores_late_events(runs):
    machine = M.StatusMachine({"": ("queued",), "queued": ("running",), "running": ("done",)}, "failed", 1)
    found = runs(
        machine,
        [(1, 0, 1, "queued"), (2, 1, 1, "done"), (3, 2, 1, "running"), (4, 0, 2, "running")],
        [(5, 1, 1, "done"), (6, 3, 1, "failed"), (7, 4, 1, "failed"), (8, 5, 1, "queued"), (9, 6, 1, "failed"), (10, 7, 1, "queued"), (11, 7, 2, "queued"), (11, 7, 2, "queued")],
    )
    assert sorted(found[:2]) == [(1, "running", 2, 1, 0, 0, False), (2, "", 0, 1, 0, 0, False)]
    assert sorted(found[2:]) == [(1, "failed", 5, 3, 1, 2, True), (2, "queued", 1, 1, 1, 0, False)]


def test_claims_lapse_by_gap_and_by_timer_over_a_restart(runs):
    found = runs(
        M.Claims(30 * 60 * 1_000_000),
        [(1, 0, 1, "x"), (2, 20, 1, "x"), (3, 60, 1, "x"), (4, 55, 2, "x")],
        [(5, 80, 1, "x"), (6, 300, 3, "x")],
        [(7, 320, 3, "x")],
    )
    # the first gap lies in a batch, user 2 and the second claim of user 1 lapse when event 6 moves the watermark
    assert sorted(found) == [(1, us(0), us(50), 2), (1, us(60), us(110), 2), (2, us(55), us(85), 1)]


def test_answers_expire(runs):
    found = runs(M.ExpiringCache(60 * 60 * 1_000_000), [(1, 0, 1, "x"), (2, 59, 1, "x"), (3, 60, 1, "x"), (4, 0, 2, "x")], [(5, 119, 1, "x"), (6, 500, 2, "x")], [(7, 501, 1, "x")])
    assert found[-1] == (1, 3, 2, us(501), 7)
    assert (1, 2, 1, us(60), 3) in found and (1, 2, 2, us(60), 3) in found and (2, 2, 0, us(500), 6) in found


class Held:
    """A handle whose states are kept in a dictionary and that notes which ones are asked for."""

    def __init__(self):
        self.values, self.asked = {}, []

    def getValueState(self, name, schema):
        held = self

        class State:
            def get(self):
                held.asked.append(name)
                return held.values.get(name)

            def update(self, value):
                held.values[name] = value

            def clear(self):
                held.values.pop(name, None)

        return State()

    def registerTimer(self, at):
        self.due = at


def test_a_cache_takes_narrow_rows_and_an_expiry_tells_no_empty_frame(spark):
    cache, held = M.ExpiringCache(60_000_000), Held()
    cache.init(held)
    rows = [(1, k, at(m).replace(tzinfo=datetime.UTC)) for k, m in ((9, 1), (8, 0), (7, 0.5))]
    assert [tuple(r) for r in cache.handleInputRows((1,), iter(rows), None)] == [(1, 2, 1, us(1), 9)]
    assert held.asked == ["counts"] and held.due == us(2) // 1000
    assert list(cache.handleExpiredTimer((1,), None, None)) == [] and held.values == {"counts": (2, 1)}
    events = spark.readStream.format("rate").load().selectExpr("value AS key", "value AS event_id", "timestamp AS at", "'x' AS status")
    handed = lambda p: "status" in M.kept(events, p)._jdf.queryExecution().analyzed().toString().split("EventTimeWatermark")[0]
    assert handed(M.StatusMachine({}, "", 0)) and not handed(M.ExpiringCache(1)) and not handed(M.Claims(1))

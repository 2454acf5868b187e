"""Queries that run the streaming operators over the event files and read what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.sources.shared import new_path
from loam.streaming import ledgers as L, machines as M


def _run(spark: SparkSession, frame: DataFrame, keys: list[str]) -> DataFrame:
    path = new_path(spark, "stream")
    L.run_once(frame, path, "update")
    return L.newest_rows(spark, path, frame.schema, keys)


def status_stream(spark: SparkSession, d: str) -> DataFrame:
    events = L.event_stream(spark, d)
    latest = L.latest_status(events, "user_id", F.col("event_type"), F.struct("at", "event_id"))
    return _run(spark, latest, ["user_id"]).select("user_id", "status", F.unix_micros("at").alias("at_us"), "n")


STATUS_STREAM = """
SELECT user_id, event_type AS status, epoch_us(ts) AS at_us, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k = 1
"""


def receipt_stream(spark: SparkSession, d: str) -> DataFrame:
    events = L.event_stream(spark, d).withColumn("at", F.date_trunc("hour", "at"))
    once = L.receipts(events.select("user_id", "event_type", "at"), ["user_id", "event_type"])
    found = _run(spark, once, ["user_id", "event_type", "at"])
    return found.select("user_id", "event_type", F.unix_micros("at").alias("at_us"))


RECEIPT_STREAM = "SELECT DISTINCT user_id, event_type, epoch_us(date_trunc('hour', ts)) AS at_us FROM events"


def daily_stream(spark: SparkSession, d: str) -> DataFrame:
    counted = L.windowed(L.event_stream(spark, d), "event_type", "1 day")
    return _run(spark, counted, ["start", "event_type"]).select(F.unix_micros("start").alias("start_us"), "event_type", "n")


DAILY_STREAM = "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2"

#: What may follow what in a visit: nothing yet, looking, clicking, buying.
VISIT = {"": ("view", "click"), "view": ("click", "view"), "click": ("view", "purchase"), "purchase": ("view",)}
CLAIM_US, CACHE_US = 30 * 60 * 1_000_000, 60 * 60 * 1_000_000


def _stateful(spark: SparkSession, d: str, processor, keys: list[str]) -> DataFrame:
    events = L.event_stream(spark, d).select(F.col("user_id").alias("key"), "event_id", "at", F.col("event_type").alias("status"))
    with M.keyed_store(spark):
        return _run(spark, M.kept(events, processor), keys)


def run_states(spark: SparkSession, d: str) -> DataFrame:
    """Users as runs: event types are the statuses they ask for, errors are failures, and two retries are allowed."""
    return _stateful(spark, d, M.StatusMachine(VISIT, "error", 2), ["key"])


RUN_STATES = """
WITH RECURSIVE e AS (SELECT user_id, event_type AS asked, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
m(user_id, n, status, n_applied, n_refused, n_failures) AS (
SELECT DISTINCT user_id, 0::BIGINT, '', 0::BIGINT, 0::BIGINT, 0 FROM events
UNION ALL
SELECT user_id, n, CASE WHEN ok THEN asked ELSE status END, n_applied + ok::INT, n_refused + (NOT ok)::INT, n_failures + (ok AND asked = 'error')::INT
FROM (SELECT e.user_id, e.n, asked, status, n_applied, n_refused, n_failures,
  NOT (status = 'error' AND n_failures > 2) AND (asked = 'error' AND status <> 'error' OR CASE status WHEN 'view' THEN asked IN ('click', 'view') WHEN 'click' THEN asked IN ('view', 'purchase') WHEN 'purchase' THEN asked = 'view' ELSE asked IN ('view', 'click') END) AS ok
  FROM m JOIN e ON e.user_id = m.user_id AND e.n = m.n + 1))
SELECT user_id AS key, status, n_applied, n_refused, 0::BIGINT AS n_late, n_failures, status = 'error' AND n_failures > 2 AS stalled FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1
"""


def lapsed_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims on users that lapse half an hour after the user's last event, as far as the watermark has come."""
    return _stateful(spark, d, M.Claims(CLAIM_US), ["key", "since_us"])


LAPSED_CLAIMS = """
WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
g AS (SELECT user_id, t, sum(CASE WHEN before IS NULL OR t - before > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS claim FROM e),
c AS (SELECT user_id, claim, min(t) AS since, max(t) + 1800000000 AS lapsed, count(*) AS n FROM g GROUP BY 1, 2)
SELECT user_id AS key, since AS since_us, lapsed AS lapsed_us, n AS n_events FROM c
WHERE (lapsed + 999) // 1000 <= (SELECT (max(epoch_us(ts)) // 1000) - 7200000 FROM events) OR EXISTS (SELECT 1 FROM c d WHERE d.user_id = c.user_id AND d.claim > c.claim)
"""


def cache_answers(spark: SparkSession, d: str) -> DataFrame:
    """Hits and misses of a cache by user whose answers expire after an hour."""
    return _stateful(spark, d, M.ExpiringCache(CACHE_US), ["key"])


CACHE_ANSWERS = """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
m(user_id, n, misses, hits, made, made_by) AS (
SELECT user_id, n, 1::BIGINT, 0::BIGINT, t, event_id FROM e WHERE n = 1
UNION ALL
SELECT m.user_id, e.n, misses + (t - made >= 3600000000)::INT, hits + (t - made < 3600000000)::INT, CASE WHEN t - made >= 3600000000 THEN t ELSE made END, CASE WHEN t - made >= 3600000000 THEN e.event_id ELSE made_by END
FROM m JOIN e ON e.user_id = m.user_id AND e.n = m.n + 1)
SELECT user_id AS key, misses AS n_misses, hits AS n_hits, made AS made_us, made_by FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1
"""

QUERIES = {
    "status_stream": (status_stream, STATUS_STREAM), "receipt_stream": (receipt_stream, RECEIPT_STREAM), "daily_stream": (daily_stream, DAILY_STREAM),
    "run_states": (run_states, RUN_STATES), "lapsed_claims": (lapsed_claims, LAPSED_CLAIMS), "cache_answers": (cache_answers, CACHE_ANSWERS),
}

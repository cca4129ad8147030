"""Streaming queries, run to the end of their source and compared with batch SQL."""

from __future__ import annotations

from tidewright.streaming import streams as S

from .registry import add
from .shaping import r


def stream_tumbling(spark, d):
    return S.drained(S.tumbling(S.event_stream(spark, d), "15 minutes", "1 hour"), "complete")


add("stream_tumbling", stream_tumbling, f"SELECT event_type, time_bucket(INTERVAL '15 minutes', ts) AS t, count(*) AS n, {r('sum(value)')} AS total FROM events GROUP BY 1, 2")


def stream_sliding(spark, d):
    return S.drained(S.sliding(S.event_stream(spark, d), "15 minutes", "5 minutes", "1 hour"), "complete")


add(
    "stream_sliding",
    stream_sliding,
    "SELECT event_type, time_bucket(INTERVAL '5 minutes', ts) - INTERVAL 5 MINUTES * j AS t, count(*) AS n, max(value) AS top FROM events, range(3) g(j) GROUP BY 1, 2",
)


def stream_sessions(spark, d):
    return S.drained(S.sessions(S.event_stream(spark, d), "2 hours", "1 day"), "complete")


add(
    "stream_sessions",
    stream_sessions,
    "WITH f AS (SELECT user_id, ts, (coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS, true))::INTEGER AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, min(ts) AS a, count(*) AS n FROM s GROUP BY user_id, s",
)


def stream_once(spark, d):
    """Every event arrives twice."""
    again = S.event_stream(spark, d).unionByName(S.event_stream(spark, d)).select("event_id", "ts", "value")
    return S.drained(S.once(again, "event_id", "1 day"), "append")


add("stream_once", stream_once, "SELECT event_id, ts, value FROM events")


def stream_settlement(spark, d):
    e = S.event_stream(spark, d).select("event_id", "ts", "user_id", "event_type", "value")
    other = S.event_stream(spark, d).select("event_id", "ts", "user_id", "event_type", "value")
    return S.drained(S.settled(e.where("event_type = 'purchase'"), other.where("event_type = 'view'"), "6 hours", "1 day"), "append")


add(
    "stream_settlement",
    stream_settlement,
    "WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), q AS (SELECT * FROM events WHERE event_type = 'view'), m AS (SELECT least((SELECT max(ts) FROM p), (SELECT max(ts) FROM q)) - INTERVAL 1 DAY AS seen) "
    "SELECT p.event_id AS position, q.event_id AS price, q.value AS value FROM p LEFT JOIN q ON p.user_id = q.user_id AND q.ts BETWEEN p.ts AND p.ts + INTERVAL 6 HOURS, m WHERE q.event_id IS NOT NULL OR p.ts + INTERVAL 6 HOURS < seen",
)


def stream_accounts(spark, d):
    return S.drained(S.running_accounts(S.event_stream(spark, d).select("event_id", "ts", "user_id", "value"), 500.0), "update")


add(
    "stream_accounts",
    stream_accounts,
    "WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT user_id, 0::BIGINT AS n, 0.0::DOUBLE AS held, 0::BIGINT AS payouts FROM (SELECT DISTINCT user_id FROM s) UNION ALL SELECT s.user_id, s.i, CASE WHEN f.held + s.value >= 500 THEN 0 ELSE f.held + s.value END, f.payouts + (f.held + s.value >= 500)::BIGINT FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.n + 1) "
    "SELECT user_id, n, payouts FROM f QUALIFY n = max(n) OVER (PARTITION BY user_id)",
)

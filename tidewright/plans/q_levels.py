"""Queries of zones, votes with the price of now, and the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import levels as L
from tidewright.operators import windows as W
from tidewright.sources import tables as T
from tidewright.streaming.streams import shared_path

from .q_bars import SWINGS
from .registry import add
from .shaping import r, rounded


def support_and_resistance(spark, d):
    return rounded(L.zones(W.swings(T.hourly(spark, d))), 5)


def _fold(name, flag, price):
    fits = "abs(s.p - f.total / f.n) / (f.total / f.n) <= 0.002"
    return (
        f"s{name} AS (SELECT k, {price} AS p, row_number() OVER (PARTITION BY k ORDER BY {price}) AS i FROM swung WHERE {flag}), f{name} AS (SELECT k, i, p, 1 AS z, p AS total, 1 AS n FROM s{name} WHERE i = 1 UNION ALL "
        f"SELECT s.k, s.i, s.p, CASE WHEN {fits} THEN f.z ELSE f.z + 1 END, CASE WHEN {fits} THEN f.total + s.p ELSE s.p END, CASE WHEN {fits} THEN f.n + 1 ELSE 1 END FROM f{name} f JOIN s{name} s ON s.k = f.k AND s.i = f.i + 1), "
        f"z{name} AS (SELECT k, '{name}' AS side, min(p) * 0.999 AS low, max(p) * 1.001 AS high, (min(p) * 0.999 + max(p) * 1.001) / 2 AS mid, count(*) AS n FROM f{name} GROUP BY k, z)"
    )


add(
    "support_and_resistance",
    support_and_resistance,
    f"WITH RECURSIVE {SWINGS}, {_fold('resistance', 'swing_high', 'h')}, {_fold('support', 'swing_low', 'l')}, w AS (SELECT k, h, l, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY t) - 1 >= count(*) OVER (PARTITION BY k) // 2 THEN 1.1 ELSE 1.0 END AS weight FROM bars), "
    "z AS (SELECT * FROM zresistance UNION ALL SELECT * FROM zsupport), t AS (SELECT z.*, coalesce((SELECT sum(weight) FROM w WHERE w.k = z.k AND (abs(w.h - z.mid) <= 0.002 * z.mid OR abs(w.l - z.mid) <= 0.002 * z.mid)), 0)::DOUBLE AS touched FROM z) "
    f"SELECT k, side, {r('low', 5)} AS low, {r('high', 5)} AS high, {r('mid', 5)} AS mid, n, {r('least(touched / 5, 1.0)', 5)} AS strength, row_number() OVER (PARTITION BY k, side ORDER BY CASE WHEN side = 'resistance' THEN low ELSE -high END) AS place FROM t",
)


def votes_with_price(spark, d):
    """Kinds of event as arms that vote on the price of each quarter; `view` is the control."""
    w = T.windows(spark, d)
    v = w.select(F.col("k").alias("arm"), F.lit(15).alias("horizon"), "t", F.floor(F.col("strike") + 10 * (F.col("p") - 0.5)).alias("pred"), F.col("strike").alias("price_now"), F.when(F.col("n") % 5 != 0, F.round(F.abs(F.col("final") - F.col("strike")), 4)).alias("abs_err"))
    return L.voted(v, "view", 12, 5)


add(
    "votes_with_price",
    votes_with_price,
    f"WITH {T.WINDOWS}, v AS (SELECT k AS arm, t, floor(strike + 10 * (p - 0.5))::BIGINT AS pred, strike, CASE WHEN n % 5 <> 0 THEN round(abs(final - strike), 4) END AS e FROM windows), "
    "l AS (SELECT *, list(e) FILTER (e IS NOT NULL) OVER (PARTITION BY arm ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS es FROM v), m AS (SELECT *, CASE WHEN len(es) >= 5 THEN list_avg(es[greatest(len(es) - 11, 1):]) END AS trail FROM l), "
    "s AS (SELECT t, count(*) AS every, max(trunc(strike)::BIGINT) FILTER (arm = 'view') AS now_, CASE WHEN count(trail) >= 3 THEN max(trail) END AS worst FROM m GROUP BY t HAVING count(*) > 1 AND max(trunc(strike)) FILTER (arm = 'view') IS NOT NULL), "
    "d AS (SELECT s.t, now_, min(arm) FILTER (trail = worst) AS dropped, list(m) AS x FROM s JOIN m ON m.t = s.t GROUP BY s.t, now_), p AS (SELECT t, dropped, list_sort(list_append(list_transform(list_filter(x, lambda z: z.arm IS DISTINCT FROM dropped), lambda z: z.pred), now_)) AS q FROM d) "
    "SELECT 15 AS horizon, t, len(q) AS voters, dropped, CASE WHEN len(q) % 2 = 1 THEN q[len(q) // 2 + 1] ELSE floor((q[len(q) // 2] + q[len(q) // 2 + 1]) / 2)::BIGINT END AS pred FROM p",
)


def inventory_records(spark, d):
    """Coverage of orders by priority, updated twice; the second update has all of them."""
    at = L.Inventory(spark, f"{shared_path(spark)}/inventory")
    o = T.table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.lit("1d").alias("timeframe"), F.col("o_orderdate").cast("timestamp_ntz").alias("t"))
    for year, rows in ((2020, o.where(F.year("t") < 1997)), (2021, o)):
        now = F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz")
        at.update(rows.groupBy("k", "timeframe").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n")).withColumn("fetched_at", now).withColumn("updated_at", now))
    return at.all().drop("fetched_at")


add("inventory_records", inventory_records, "SELECT o_orderpriority AS k, '1d' AS timeframe, min(o_orderdate)::TIMESTAMP AS first_t, max(o_orderdate)::TIMESTAMP AS last_t, count(*) AS n, TIMESTAMP '2021-01-01' AS updated_at FROM orders GROUP BY 1")

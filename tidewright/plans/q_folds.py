"""Queries of ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import folds as X
from tidewright.operators import windows as W
from tidewright.sources import tables as T

from .q_bars import SWINGS, _last
from .registry import add
from .shaping import r, rounded

_TR = "list(CASE WHEN prev IS NULL THEN h - l ELSE greatest(h - l, abs(h - prev), abs(l - prev)) END)"
ATR = (
    f"p AS (SELECT *, lag(c) OVER (PARTITION BY k ORDER BY t) AS prev FROM bars), s AS (SELECT k, t, {_TR} {_last(100)} AS x, list(h - l) {_last(100)} AS f FROM p), y AS (SELECT k, t, list_concat([f[1]], x[2:]) AS x FROM s), "
    "atrs AS (SELECT k, t, CASE WHEN len(x) >= 14 THEN list_reduce(x[15:], lambda a, v: (a * 13 + v) / 14, list_sum(x[1:14]) / 14) END AS atr FROM y)"
)


def atr_14(spark, d):
    return rounded(X.wilder_atr(T.hourly(spark, d)).select("k", "t", "atr"))


add("atr_14", atr_14, f"WITH {T.BARS}, {ATR} SELECT k, t, {r('atr')} AS atr FROM atrs")


def volatility_regime(spark, d):
    x = X.atr_regime(X.wilder_atr(T.hourly(spark, d)))
    return x.groupBy("k", "regime").agg(F.count("*").alias("n"))


add(
    "volatility_regime",
    volatility_regime,
    f"WITH {T.BARS}, {ATR}, q AS (SELECT k, t, atr, list(atr) FILTER (atr IS NOT NULL) {_last(50)} AS x FROM atrs) SELECT k, CASE WHEN x IS NULL OR len(x) < 50 OR atr IS NULL THEN 'normal' WHEN atr >= list_aggregate(x, 'quantile_cont', 0.9) THEN 'extreme' WHEN atr >= list_aggregate(x, 'quantile_cont', 0.75) THEN 'high' WHEN atr <= list_aggregate(x, 'quantile_cont', 0.25) THEN 'low' ELSE 'normal' END AS regime, count(*) AS n FROM q GROUP BY 1, 2",
)


def atr_expanding(spark, d):
    x = W.expanding(X.wilder_atr(T.hourly(spark, d)), "atr")
    return x.select("k", "t", "expanding")


add("atr_expanding", atr_expanding, f"WITH {T.BARS}, {ATR} SELECT k, t, coalesce(atr > lag(atr, 5) OVER (PARTITION BY k ORDER BY t), false) AS expanding FROM atrs")


def _ema(x: str, n: str, period: int) -> str:
    a = 2 / (period + 1)
    return f"list_sum(list_transform({x}, lambda v, i: v * CASE WHEN i = 1 THEN power({1 - a!r}, {n} - 1) ELSE {a!r} * power({1 - a!r}, {n} - i) END))"


def ema_20(spark, d):
    return rounded(X.ema(T.hourly(spark, d), 20, 60).select("k", "t", "ema"))


add("ema_20", ema_20, f"WITH {T.BARS}, s AS (SELECT k, t, list(c) {_last(60)} AS x FROM bars) SELECT k, t, {r(_ema('x', 'len(x)', 20))} AS ema FROM s")


def macd_12_26_9(spark, d):
    return rounded(X.macd(T.hourly(spark, d)).select("k", "t", "macd", "signal"))


add(
    "macd_12_26_9",
    macd_12_26_9,
    f"WITH {T.BARS}, s AS (SELECT k, t, list(c) {_last(45)} AS x FROM bars), m AS (SELECT k, t, list_transform(range(1, len(x) + 1), lambda j: {_ema('x[1:j]', 'j', 12)} - {_ema('x[1:j]', 'j', 26)}) AS m FROM s) SELECT k, t, {r('m[len(m)]')} AS macd, {r(_ema('m', 'len(m)', 9))} AS signal FROM m",
)


def statistical_forecast(spark, d):
    return rounded(X.statistical_forecast(T.hourly(spark, d)).select("k", "t", "ewm", "slope", "expected"))


add(
    "statistical_forecast",
    statistical_forecast,
    f"WITH {T.BARS}, s AS (SELECT k, t, c, list(c) {_last(32)} AS x FROM bars), y AS (SELECT *, list_transform(range(2, len(x) + 1), lambda i: ln(x[i] / x[i - 1])) AS rt, list_transform(x, lambda v, i: (i - 1 - 15.5) * v) AS xc FROM s), "
    f"z AS (SELECT k, t, CASE WHEN len(x) >= 32 THEN {_ema('rt', 'len(rt)', 12)} * 5 ELSE 0 END AS e, CASE WHEN len(x) >= 32 THEN list_sum(xc) / 2728.0 * 5 / c ELSE 0 END AS s FROM y) SELECT k, t, {r('e')} AS ewm, {r('s')} AS slope, {r('(e + s) / 2')} AS expected FROM z",
)


def price_zones(spark, d):
    b = W.swings(T.hourly(spark, d))
    return rounded(X.price_zones(b.where("swing_high"), "h"))


add(
    "price_zones",
    price_zones,
    f"WITH RECURSIVE {SWINGS}, s AS (SELECT k, h AS p, row_number() OVER (PARTITION BY k ORDER BY h) AS i FROM swung WHERE swing_high), f AS (SELECT k, i, p, 1 AS z, p AS total, 1 AS n FROM s WHERE i = 1 UNION ALL SELECT s.k, s.i, s.p, CASE WHEN abs(s.p - f.total / f.n) / (f.total / f.n) <= 0.002 THEN f.z ELSE f.z + 1 END, "
    "CASE WHEN abs(s.p - f.total / f.n) / (f.total / f.n) <= 0.002 THEN f.total + s.p ELSE s.p END, CASE WHEN abs(s.p - f.total / f.n) / (f.total / f.n) <= 0.002 THEN f.n + 1 ELSE 1 END FROM f JOIN s ON s.k = f.k AND s.i = f.i + 1) "
    f"SELECT k, {r('sum(p) / count(*)')} AS mid, count(*) AS n, {r('min(p)')} AS low, {r('max(p)')} AS high FROM f GROUP BY k, z",
)


def sequential_test(spark, d):
    x = T.windows(spark, d).withColumn("d", F.pow(F.col("market") - F.col("y"), F.lit(2.0)) - F.pow(F.col("p") - F.col("y"), F.lit(2.0)))
    return rounded(X.sprt(x, "d", 0.01))


add(
    "sequential_test",
    sequential_test,
    f"WITH {T.WINDOWS}, d AS (SELECT k, t, (market - y) ** 2 - (p - y) ** 2 AS v, row_number() OVER (PARTITION BY k ORDER BY t) AS n FROM windows), s AS (SELECT k, n, v, var_samp(v) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS var FROM d), q AS (SELECT k, count(*) AS n, avg(v) AS mean, sum(CASE WHEN n > 12 THEN (0.01 * v - 0.00005) / greatest(0.01, var) ELSE 0 END) AS llr FROM s GROUP BY k) "
    f"SELECT k, n, {r('mean')} AS mean, {r('llr')} AS llr, CASE WHEN n < 40 THEN 'CONTINUE' WHEN llr >= ln(16.0) THEN 'ACCEPT' WHEN llr <= ln(0.2 / 0.95) THEN 'REJECT' ELSE 'CONTINUE' END AS verdict FROM q",
)


def expert_weights(spark, d):
    x = T.windows(spark, d).withColumn("a", F.pow(F.col("p") - F.col("y"), F.lit(2.0))).withColumn("b", F.pow(F.col("market") - F.col("y"), F.lit(2.0)))
    return rounded(X.fixed_share(x, ["a", "b"]))


add(
    "expert_weights",
    expert_weights,
    f"WITH RECURSIVE {T.WINDOWS}, s AS (SELECT k, exp(-0.5 * (p - y) ** 2) AS a, exp(-0.5 * (market - y) ** 2) AS b, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM windows), f AS (SELECT k, 0::BIGINT AS i, 0.5::DOUBLE AS wa, 0.5::DOUBLE AS wb FROM (SELECT DISTINCT k FROM s) UNION ALL SELECT s.k, s.i, 0.95 * f.wa * s.a / (f.wa * s.a + f.wb * s.b) + 0.025, 0.95 * f.wb * s.b / (f.wa * s.a + f.wb * s.b) + 0.025 FROM f JOIN s ON s.k = f.k AND s.i = f.i + 1) "
    f"SELECT k, {r('wa')} AS w_a, {r('wb')} AS w_b FROM f QUALIFY i = max(i) OVER (PARTITION BY k)",
)


def adaptive_threshold(spark, d):
    x = T.windows(spark, d).groupBy("k", F.date_trunc("day", "t").cast("timestamp_ntz").alias("t")).agg(F.avg("y").alias("rate"))
    return rounded(X.adaptive_state(x, "rate"))


add(
    "adaptive_threshold",
    adaptive_threshold,
    f"WITH RECURSIVE {T.WINDOWS}, dd AS (SELECT k, t::DATE AS t, avg(y) AS x FROM windows GROUP BY 1, 2), s AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM dd), f AS (SELECT k, 0::BIGINT AS i, 0.5::DOUBLE AS e, 0.5::DOUBLE AS th FROM (SELECT DISTINCT k FROM s) UNION ALL SELECT s.k, s.i, f.e * 0.7 + s.x * 0.3, greatest(0.3, least(0.9, f.th + greatest(-0.05, least(0.05, f.e * 0.7 + s.x * 0.3 - f.th)))) FROM f JOIN s ON s.k = f.k AND s.i = f.i + 1) "
    f"SELECT k, {r('e')} AS ema, {r('th')} AS threshold FROM f QUALIFY i = max(i) OVER (PARTITION BY k)",
)


def bankroll_walk(spark, d):
    return X.bankroll(T.trades(spark, d), "1000000", "id", "line", "part", "supp")


add(
    "bankroll_walk",
    bankroll_walk,
    f"WITH {T.TRADES}, c AS (SELECT k, t, id, line, part, supp, 1000000 + sum(pnl::DECIMAL(20, 4)) OVER (PARTITION BY k ORDER BY t, id, line, part, supp ROWS UNBOUNDED PRECEDING) AS cash FROM trades) SELECT k, count(*) AS n, last(cash ORDER BY t, id, line, part, supp)::DOUBLE AS last, min(cash)::DOUBLE AS lowest FROM c GROUP BY k",
)


def portfolio_simulation(spark, d):
    return rounded(X.simulate_portfolio(T.hourly(spark, d)), 4)


add(
    "portfolio_simulation",
    portfolio_simulation,
    f"WITH RECURSIVE {T.BARS}, s AS (SELECT k, o, c, row_number() OVER (PARTITION BY k ORDER BY t) AS i, count(*) OVER (PARTITION BY k) AS m FROM bars), "
    "f AS (SELECT k, 0::BIGINT AS i, 10000.0::DOUBLE AS cash, 0.0::DOUBLE AS qty, 0.0::DOUBLE AS entry, 0::BIGINT AS trades, 0::BIGINT AS stops FROM (SELECT DISTINCT k FROM s) UNION ALL "
    "SELECT k, i, CASE WHEN buys THEN money - want * c ELSE money END, CASE WHEN buys THEN want WHEN closed THEN 0 ELSE qty END, CASE WHEN buys THEN c WHEN closed THEN 0 ELSE entry END, trades + closed::BIGINT, stops + stopped::BIGINT FROM "
    "(SELECT *, qty <= 0 AND c > o AND want >= 1 AS buys FROM (SELECT *, floor(least(money * 0.1 / (c * 0.2), money / c)) AS want FROM (SELECT *, stopped OR hit AS closed, CASE WHEN stopped THEN cash + qty * entry * (1 - 0.2) WHEN hit THEN cash + qty * entry * (1 + 0.3) ELSE cash END AS money FROM "
    "(SELECT s.k, s.i, s.o, s.c, f.cash, f.qty, f.entry, f.trades, f.stops, f.qty > 0 AND s.c <= f.entry * (1 - 0.2) AS stopped, f.qty > 0 AND s.c >= f.entry * (1 + 0.3) AS hit FROM f JOIN s ON s.k = f.k AND s.i = f.i + 1))))) "
    f"SELECT f.k, trades, stops, {r('cash + qty * s.c', 4)} AS equity FROM f JOIN s ON s.k = f.k AND s.i = f.i WHERE s.i = s.m",
)

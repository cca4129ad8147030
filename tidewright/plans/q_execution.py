"""Queries of execution: ledgers with quotes and marks, splits, sensitivity, the one bet, noise floors, grid verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import bars as B
from tidewright.operators import execution as X
from tidewright.sources import tables as T

from .registry import add
from .shaping import r, rounded

_MARKS, _PRICES = {"15m": 900, "45m": 2700}, {"15m": 900}


def _path(spark, d):
    """Quarters as quotes; a key's day is a ticker."""
    w = T.windows(spark, d)
    return w.select(F.concat_ws("-", "k", F.date_format("t", "MMdd")).alias("ticker"), "t", "p", F.col("final").alias("base"))


def _orders(spark, d):
    x = T.ticks(spark, d).where("id % 3 = 0")
    ask = (1 + F.col("id") * 7 % 98).cast("double")
    x = x.select(F.concat_ws("-", "k", F.date_format("t", "MMdd")).alias("ticker"), "t", "id", F.when(F.col("id") % 2 == 0, "yes").otherwise("no").alias("side"), ask.alias("ask_c"), (F.col("id") % 100 / 100).alias("p"), F.when(F.col("id") % 7 != 0, F.col("id") % 15).cast("double").alias("mins_left"), F.when(F.col("id") % 11 != 0, F.floor(F.col("id") / 3) % 2).cast("int").alias("win"), (F.col("id") % 13 == 0).alias("skipped"))
    return x.withColumn("stake_c", 10 * F.col("ask_c")).withColumn("pnl_c", F.when(F.col("win") == 1, 1000 - 10 * F.col("ask_c")).otherwise(-10 * F.col("ask_c")))


def _ledger(spark, d):
    return X.execution_ledger(_orders(spark, d), _path(spark, d), _MARKS, _PRICES, 1800, 600)


def execution_rows(spark, d):
    return rounded(_ledger(spark, d).select("id", "quote_age_s", "market", "modelled_ask", "slippage", "mark_15m", "mark_45m", "price_15m", "ev", "missing"))


_O = (
    f"{T.WINDOWS}, path AS (SELECT concat(k, '-', strftime(t, '%m%d')) AS ticker, t, p, final AS base FROM windows), "
    "ord AS (SELECT concat(k, '-', strftime(t, '%m%d')) AS ticker, t, id, id % 2 = 0 AS yes, (1 + id * 7 % 98)::DOUBLE AS ask, id % 100 / 100 AS p, CASE WHEN id % 7 <> 0 THEN id % 15 END AS ml, CASE WHEN id % 11 <> 0 THEN (id // 3) % 2 END AS win FROM ticks WHERE id % 3 = 0), "
    "done AS (SELECT *, id % 13 = 0 AS skipped FROM ord), "
    "q0 AS (SELECT o.*, q.t AS qt, q.p AS qp, q.base AS qb FROM done o ASOF LEFT JOIN path q ON q.ticker = o.ticker AND q.t <= o.t), "
    "q AS (SELECT * REPLACE (CASE WHEN qt >= t - INTERVAL 1800 SECONDS THEN qt END AS qt, CASE WHEN qt >= t - INTERVAL 1800 SECONDS THEN qp END AS qp, CASE WHEN qt >= t - INTERVAL 1800 SECONDS THEN qb END AS qb) FROM q0)"
)
_MK = lambda s: f"m{s} AS (SELECT q.id, arg_min(x.p, (abs(epoch_us(x.t) - epoch_us(qt) - {s * 1_000_000}::BIGINT), x.t)) AS p, arg_min(x.base, (abs(epoch_us(x.t) - epoch_us(qt) - {s * 1_000_000}::BIGINT), x.t)) AS b FROM q JOIN path x ON x.ticker = q.ticker AND abs(epoch_us(x.t) - epoch_us(qt) - {s * 1_000_000}::BIGINT) <= 600000000 GROUP BY 1)"
_LEDGER = (
    f"{_O}, {_MK(900)}, {_MK(2700)}, led AS (SELECT q.*, CASE WHEN yes THEN 1 ELSE -1 END AS sg, date_diff('microsecond', qt, q.t) / 1e6 AS age, 100 * CASE WHEN yes THEN qp ELSE 1 - qp END + 2.5 AS model, m900.p AS p900, m900.b AS b900, m2700.p AS p2700, CASE WHEN win = 1 THEN 1000 - 10 * ask ELSE -10 * ask END / (10 * ask) AS ev, "
    "CASE WHEN q.ticker NOT IN (SELECT ticker FROM path) THEN 'no_path' WHEN qt IS NULL THEN 'no_recent_quote' END AS missing FROM q LEFT JOIN m900 ON m900.id = q.id LEFT JOIN m2700 ON m2700.id = q.id WHERE NOT skipped AND win IS NOT NULL)"
)
add("execution_rows", execution_rows, f"WITH {_LEDGER} SELECT id, {r('age')} AS quote_age_s, {r('qp')} AS market, {r('model')} AS modelled_ask, {r('ask - model')} AS slippage, {r('sg * (p900 - qp) * 100')} AS mark_15m, {r('sg * (p2700 - qp) * 100')} AS mark_45m, {r('sg * (b900 - qb)')} AS price_15m, {r('ev')} AS ev, missing FROM led")


def execution_splits(spark, d):
    """Marks and gains over all orders, and by side, confidence, price and time left."""
    return rounded(X.split_stats(X.bands(_ledger(spark, d)), ["side", "conf_band", "price_band", "mins_band"], ["mark_15m", "ev"]), 5)


_BANDED = (
    f"{_LEDGER}, b AS (SELECT *, sg * (p900 - qp) * 100 AS mark, CASE WHEN yes THEN 'yes' ELSE 'no' END AS side, CASE WHEN p < 0.7 THEN '<0.7' WHEN p <= 0.8 THEN '0.7-0.8' WHEN p > 0.8 THEN '>0.8' ELSE 'unknown' END AS conf_band, CASE WHEN ask < 40 THEN '<40c' WHEN ask <= 60 THEN '40-60c' WHEN ask > 60 THEN '>60c' ELSE 'unknown' END AS price_band, "
    "CASE WHEN ml < 8 THEN '<8m' WHEN ml < 11 THEN '8-11m' WHEN ml >= 11 THEN '>=11m' ELSE 'unknown' END AS mins_band FROM led)"
)
_ST = "count(*) AS orders, " + ", ".join(f"count({c}) AS {n}_n, {r(f'avg({c})', 5)} AS {n}_mean, {r(f'quantile_cont({c}, 0.5)', 5)} AS {n}_median, {r(f'quantile_cont({c}, 0.1)', 5)} AS {n}_p10, {r(f'quantile_cont({c}, 0.9)', 5)} AS {n}_p90" for n, c in (("mark_15m", "mark"), ("ev", "ev")))
add("execution_splits", execution_splits, f"WITH {_BANDED} SELECT 'all' AS split, 'all' AS part, {_ST} FROM b " + " ".join(f"UNION ALL SELECT '{k}', {k}, {_ST} FROM b GROUP BY {k}" for k in ("side", "conf_band", "price_band", "mins_band")))


def quote_sensitivity(spark, d):
    """Gains at earlier and later quotes, and at dearer fills; none is left unfilled, as SQL has another hash."""
    o = _orders(spark, d).where("win is not null")
    return rounded(X.sensitivity(o, _path(spark, d), [0, 1, 2, 3], 2.0, 900, 1800, unfilled=0.0))


_EV = lambda p, more: f"(100 * win - {_A(p, more)} - 7 * ({_A(p, more)} / 100) * (1 - {_A(p, more)} / 100)) / {_A(p, more)}"
_A = lambda p, more: f"greatest(1, least(99, greatest(1, least(99, 100 * CASE WHEN yes THEN {p} ELSE 1 - {p} END + 2.5)) + {more}))"
_CASES = [("stale", d, -900 * d, 0.0) for d in range(4)] + [("delay", d, 900 * d, 0.0) for d in range(4)] + [("plain", 0, 0, 0.0), ("slipped", 0, 0, 2.0), ("stressed", 0, 0, 2.5), ("mid", 0, 0, -2.5)]
add(
    "quote_sensitivity",
    quote_sensitivity,
    f"WITH {_O}, cases AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{m}{chr(39)}, {d}, {s}, {x}::DOUBLE)' for m, d, s, x in _CASES)}) v(model, delta, shift, more)), "
    f"j AS (SELECT model, delta, q.id, q.win, x.p IS NULL AS none, CASE WHEN x.p IS NOT NULL THEN {_EV('x.p', 'more')} END AS ev FROM q CROSS JOIN cases LEFT JOIN path x ON x.ticker = q.ticker AND x.t = qt + INTERVAL 1 SECOND * shift WHERE win IS NOT NULL AND qt IS NOT NULL), "
    "s AS (SELECT model, delta, avg(ev) AS ev, count(ev) AS n, count(*) FILTER (none) AS excluded FROM j GROUP BY 1, 2), l AS (SELECT *, delta > 0 AND model IN ('stale', 'delay') AND ev < (SELECT ev FROM s WHERE model = 'plain') - 0.01 AS low FROM s) "
    f"SELECT model, delta, {r('ev')} AS ev, n, excluded, coalesce(low AND delta = min(delta) FILTER (low) OVER (PARTITION BY model), false) AS crossing FROM l",
)


def single_bets(spark, d):
    """One bet for each hour of a key, from its quarters."""
    w = T.windows(spark, d).withColumn("hour", F.date_trunc("hour", "t").cast("timestamp_ntz"))
    m = w.select(F.concat_ws("-", "k", F.date_format("hour", "MMddHH")).alias("k"), "t", F.lit(0).alias("id"), (F.lit(900.0) - 15 * F.minute("t")).alias("seconds_left"), F.when(F.col("n") % 6 != 0, F.lit(0.5) + (F.col("p") - 0.5) * 10).alias("p"), F.round(F.lit(50) + (F.col("market") - 0.5) * 1000, 3).alias("mid"))
    m = m.withColumn("yes_bid", F.col("mid") - 2).withColumn("yes_ask", F.col("mid") + 2).drop("mid")
    return rounded(X.one_bet(m, last_s=200.0, forced_s=500.0).select("k", "t", "side", "price_c", "edge_c", "forced"))


add(
    "single_bets",
    single_bets,
    f"WITH {T.WINDOWS}, m AS (SELECT concat(k, '-', strftime(t, '%m%d%H')) AS k, t, 900.0 - 15 * minute(t) AS left_, CASE WHEN n % 6 <> 0 THEN 0.5 + (p - 0.5) * 10 END AS p, round(50 + (market - 0.5) * 1000, 3) - 2 AS bid, round(50 + (market - 0.5) * 1000, 3) + 2 AS ask FROM windows), "
    "s AS (SELECT *, p >= 0.5 AS call, left_ <= 500 AS near, CASE WHEN p >= 0.5 THEN ask ELSE 100 - bid END AS cp, CASE WHEN p >= 0.5 THEN 100 * p - ask ELSE 100 * (1 - p) - (100 - bid) END AS ce, CASE WHEN p >= 0.5 THEN 100 - bid ELSE ask END AS op, CASE WHEN p >= 0.5 THEN 100 * (1 - p) - (100 - bid) ELSE 100 * p - ask END AS oe FROM m WHERE left_ >= 200 AND p IS NOT NULL AND bid > 0 AND ask > 0), "
    "b AS (SELECT *, cp < 80 AND (ce >= 3 OR near OR cp >= 75) AS mine, near AND op < 80 AS other FROM s), f AS (SELECT * FROM b WHERE mine OR other QUALIFY row_number() OVER (PARTITION BY k ORDER BY t) = 1) "
    f"SELECT k, t, CASE WHEN mine = call THEN 'yes' ELSE 'no' END AS side, {r('CASE WHEN mine THEN cp ELSE op END')} AS price_c, {r('CASE WHEN mine THEN ce ELSE oe END')} AS edge_c, near AND CASE WHEN mine THEN ce ELSE oe END < 3 AS forced FROM f",
)


def noise_floors(spark, d):
    return rounded(X.noise_floor(B.resample(T.ticks(spark, d), "15 minutes"), {"15m": "15 minutes", "1h": "1 hour"}, 10))


add(
    "noise_floors",
    noise_floors,
    f"WITH {T.TICKS}, {T.bars_sql('quarters', '15 minutes')}, m AS (SELECT a.k, h.n AS horizon, b.c - a.c AS m FROM quarters a, (VALUES ('15m', INTERVAL 15 MINUTES), ('1h', INTERVAL 1 HOUR)) h(n, w) JOIN quarters b ON b.k = a.k AND b.t = a.t + h.w) "
    f"SELECT k, horizon, count(*) AS n, {r('avg(abs(m))')} AS floor, {r('stddev_pop(m)')} AS sigma, {r('avg((m > 0)::INTEGER)')} AS up, {r('stddev_pop(m) * sqrt(2 / pi())')} AS normal_floor FROM m GROUP BY 1, 2 HAVING count(*) >= 10",
)


def grid_recommendations(spark, d):
    """Line items as trades under thresholds on their discount; orders of the account stand for bars."""
    t = T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_discount").alias("x"), F.round(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")), 4).alias("pnl"))
    many = t.select("k", "pnl", F.explode(F.array(*(F.struct(F.lit(s).alias("setting"), (F.col("x") >= s).alias("in_")) for s in (0.02, 0.05, 0.08, 0.095, 0.2)))).alias("c")).select("k", "pnl", "c.*")
    pnl = F.when(F.col("in_"), F.col("pnl"))
    each = many.groupBy("k", "setting").agg((4 * F.count("*")).alias("n_bars"), F.count(pnl).alias("n_trades"), F.avg((pnl > 0).cast("double")).alias("win_rate"), F.avg(F.when(pnl > 0, pnl)).alias("avg_gain"), F.avg(F.when(pnl <= 0, pnl)).alias("avg_loss"))
    return rounded(X.grid_verdicts(each), 4)


add(
    "grid_recommendations",
    grid_recommendations,
    "WITH t AS (SELECT l_returnflag AS k, l_discount AS x, round(l_extendedprice * (l_discount - l_tax), 4) AS pnl FROM lineitem), s AS (SELECT unnest([0.02, 0.05, 0.08, 0.095, 0.2])::DOUBLE AS setting), "
    "g AS (SELECT k, setting, 4 * count(*) AS n_bars, count(pnl) FILTER (x >= setting) AS n_trades, avg((pnl > 0)::INTEGER) FILTER (x >= setting) AS win_rate, avg(pnl) FILTER (x >= setting AND pnl > 0) AS avg_gain, avg(pnl) FILTER (x >= setting AND pnl <= 0) AS avg_loss FROM t, s GROUP BY 1, 2), "
    "v AS (SELECT *, 100 * n_trades / n_bars AS per_100, CASE WHEN per_100 < 2 THEN 'too_few' WHEN per_100 > 20 THEN 'too_many' ELSE 'good' END AS verdict, coalesce(avg_gain, 0) * coalesce(win_rate, 0) + coalesce(avg_loss, 0) * (1 - coalesce(win_rate, 0)) AS expectancy FROM g), "
    "b AS (SELECT k, arg_min(setting, (-expectancy, setting)) FILTER (verdict = 'good') AS g, min(setting) FILTER (n_trades > 0) AS l FROM v GROUP BY k) "
    f"SELECT v.k, setting, n_bars, n_trades, {r('win_rate', 4)} AS win_rate, {r('avg_gain', 4)} AS avg_gain, {r('avg_loss', 4)} AS avg_loss, {r('per_100', 4)} AS per_100, verdict, {r('expectancy', 4)} AS expectancy, coalesce(setting = coalesce(g, l), false) AS recommended, CASE WHEN g IS NOT NULL THEN 'good_verdict_best_expectancy' WHEN l IS NOT NULL THEN 'no_good_verdict_least_restrictive' ELSE 'no_trades_all_thresholds' END AS reason FROM v JOIN b ON b.k = v.k",
)

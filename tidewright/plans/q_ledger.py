"""Queries of trades, ledgers, coverage and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import ledger as L
from tidewright.operators import windows as W
from tidewright.sources import tables as T

from .registry import add
from .shaping import r, rounded

_T = f"WITH {T.TRADES}"


def trade_metrics(spark, d):
    return rounded(L.trade_metrics(T.trades(spark, d)))


add(
    "trade_metrics",
    trade_metrics,
    f"{_T} SELECT k, count(*) AS n, sum((pnl > 0)::BIGINT)::BIGINT AS winners, {r('avg((pnl > 0)::INTEGER)')} AS win_rate, {r('avg(CASE WHEN pnl > 0 THEN pnl END)')} AS avg_gain, {r('avg(CASE WHEN pnl <= 0 THEN pnl END)')} AS avg_loss, {r('sum(pnl)')} AS total, {r('sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(abs(sum(CASE WHEN pnl > 0 THEN 0 ELSE pnl END)), 0)')} AS profit_factor FROM trades GROUP BY k",
)


def sharpe_ratio(spark, d):
    return rounded(L.sharpe(T.hourly(spark, d), "c", 252.0 * 24))


add("sharpe_ratio", sharpe_ratio, f"WITH {T.BARS}, x AS (SELECT k, c / lag(c) OVER (PARTITION BY k ORDER BY t) - 1 AS x FROM bars) SELECT k, {r('greatest(-10.0, least(10.0, avg(x) / nullif(stddev_samp(x), 0) * sqrt(252 * 24)))')} AS sharpe FROM x GROUP BY k")


def peak_drawdown(spark, d):
    return rounded(L.max_drawdown(T.hourly(spark, d), "c"))


add("peak_drawdown", peak_drawdown, f"WITH {T.BARS}, p AS (SELECT k, c, max(c) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS p FROM bars) SELECT k, {r('max((p - c) / p * 100)')} AS percent, {r('max(p - c)')} AS units FROM p GROUP BY k")


def pnl_totals(spark, d):
    return rounded(L.totals(T.trades(spark, d)))


add(
    "pnl_totals",
    pnl_totals,
    f"{_T} SELECT k, reason, year(t)::INTEGER AS year, (grouping(k) * 4 + grouping(reason) * 2 + grouping(year(t)))::INTEGER AS level, count(*) AS n, {r('sum(pnl)')} AS pnl FROM trades GROUP BY GROUPING SETS ((k), (reason), (year(t)), ())",
)


def trade_diagnostics(spark, d):
    return rounded(L.diagnostics(T.trades(spark, d)).groupBy("k", "reason", "outcome").agg(F.count("*").alias("n"), F.avg("pct").alias("pct"), F.stddev_samp("pct").alias("spread")))


add("trade_diagnostics", trade_diagnostics, f"{_T}, o AS (SELECT k, reason, CASE WHEN pnl > 1e-8 THEN 'win' WHEN pnl < -1e-8 THEN 'loss' ELSE 'breakeven' END AS outcome, pnl / entry * 100 AS pct FROM trades) SELECT k, reason, outcome, count(*) AS n, {r('avg(pct)')} AS pct, {r('stddev_samp(pct)')} AS spread FROM o GROUP BY 1, 2, 3")


def worst_trades(spark, d):
    return L.top_losses(T.trades(spark, d).select("k", "t", "id", "line", "part", "supp", "pnl"), 20, "id", "line", "part", "supp")


add("worst_trades", worst_trades, f"{_T} SELECT k, t, id, line, part, supp, pnl FROM trades ORDER BY pnl, id, line, part, supp LIMIT 20")


def gain_concentration(spark, d):
    return rounded(L.concentration(T.trades(spark, d).withColumn("pnl", F.round("pnl", 4)), "supp"))


add(
    "gain_concentration",
    gain_concentration,
    f"{_T}, g AS (SELECT k, supp, sum(pnl) AS pnl FROM trades GROUP BY 1, 2 HAVING sum(pnl) > 0), q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pnl DESC, supp) AS i FROM g) SELECT k, {r('sum(CASE WHEN i <= 3 THEN pnl ELSE 0 END) / sum(pnl)')} AS share FROM q GROUP BY k",
)


def cost_stress(spark, d):
    return rounded(L.stress(T.trades(spark, d), [0.0, 0.002, 0.005, 0.02]))


add("cost_stress", cost_stress, f"{_T}, s AS (SELECT k, rate, sum(pnl) AS base, sum(pnl - entry * rate) AS net FROM trades, (VALUES (0.0::DOUBLE), (0.002), (0.005), (0.02)) v(rate) GROUP BY 1, 2) SELECT k, rate, {r('base')} AS base, {r('net')} AS net, base <= 0 OR net >= 0.5 * base AS passes FROM s")


def bars_upsert(spark, d):
    """Old bars under newer ones of the later half of each day."""
    old = T.hourly(spark, d).select("k", "t", "c").withColumn("seq", F.lit(1))
    new = old.where(F.hour("t") >= 12).withColumn("c", F.col("c") + 1).withColumn("seq", F.lit(2))
    return rounded(L.upsert(old, new.unionByName(new.withColumn("c", F.col("c") + 1).withColumn("seq", F.lit(3))), ["k", "t"], "seq"))


add("bars_upsert", bars_upsert, f"WITH {T.BARS} SELECT k, t, {r('CASE WHEN hour(t) >= 12 THEN c + 2 ELSE c END')} AS c, CASE WHEN hour(t) >= 12 THEN 3 ELSE 1 END AS seq FROM bars")


def order_coverage(spark, d):
    x = T.table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("t"))
    return L.coverage(x, "k")


add("order_coverage", order_coverage, "SELECT o_orderpriority AS k, min(o_orderdate) AS first_t, max(o_orderdate) AS last_t, count(*) AS n FROM orders GROUP BY 1")


def order_edge_gaps(spark, d):
    return L.edge_gaps(order_coverage(spark, d), F.lit("1994-12-20").cast("date"), F.lit("2001-08-20").cast("date")).select("k", "side", F.col("a").cast("string").alias("a"), F.col("z").cast("string").alias("z"), "missing_days")


add(
    "order_edge_gaps",
    order_edge_gaps,
    "WITH c AS (SELECT o_orderpriority AS k, min(o_orderdate)::DATE AS f, max(o_orderdate)::DATE AS l FROM orders GROUP BY 1), g AS (SELECT k, 'head' AS side, DATE '1994-12-20' AS a, f - 1 AS z FROM c UNION ALL SELECT k, 'tail', l + 1, DATE '2001-08-20' FROM c) "
    "SELECT k, side, a::VARCHAR AS a, z::VARCHAR AS z, (SELECT count(*) FROM generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 day) s(x) WHERE isodow(x) <= 5)::BIGINT AS missing_days FROM g WHERE a <= z",
)


def silences(spark, d):
    return L.outages(T.ticks(spark, d), "75 minutes")


add("silences", silences, f"WITH {T.TICKS}, n AS (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY t) AS z FROM (SELECT DISTINCT k, t FROM ticks)) SELECT k, t AS a, z FROM n WHERE z > t + INTERVAL 75 MINUTES")


def silences_merged(spark, d):
    return L.merged(silences(spark, d), "30 minutes")


add(
    "silences_merged",
    silences_merged,
    f"WITH {T.TICKS}, n AS (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY t) AS z FROM (SELECT DISTINCT k, t FROM ticks)), s AS (SELECT k, t AS a, z FROM n WHERE z > t + INTERVAL 75 MINUTES), f AS (SELECT *, coalesce(a >= lag(z) OVER (PARTITION BY k ORDER BY a) + INTERVAL 30 MINUTES, true)::INTEGER AS f FROM s), g AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT k, min(a) AS a, max(z) AS z, count(*) AS n FROM g GROUP BY k, g",
)


def grid_clear_of_silences(spark, d):
    from tidewright.operators import bars as B

    grid = T.hourly(spark, d).select("k", "t")
    return B.grid_clear_of(grid, silences(spark, d), "60 minutes", "30 minutes")


add(
    "grid_clear_of_silences",
    grid_clear_of_silences,
    f"WITH {T.BARS}, n AS (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY t) AS z FROM (SELECT DISTINCT k, t FROM ticks)), s AS (SELECT k, t AS a, z FROM n WHERE z > t + INTERVAL 75 MINUTES) SELECT k, t FROM bars b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = b.k AND s.a < b.t + INTERVAL 30 MINUTES AND s.z > b.t - INTERVAL 60 MINUTES)",
)


def repeated_decisions(spark, d):
    return L.duplicates(T.ticks(spark, d).select("k", "user_id", F.date_trunc("day", "t").cast("timestamp_ntz").alias("day")), "k", "user_id", "day")


add("repeated_decisions", repeated_decisions, f"WITH {T.TICKS} SELECT k, user_id, date_trunc('day', t)::TIMESTAMP AS day, count(*) AS n FROM ticks GROUP BY 1, 2, 3 HAVING count(*) > 1")


def disordered_lines(spark, d):
    x = T.trades(spark, d).withColumn("seq", F.struct("id", "line", "part", "supp"))
    return L.out_of_order(x, "seq", F.floor(F.col("id") / 10_000)).groupBy("k").agg(F.count("*").alias("n"))


add("disordered_lines", disordered_lines, f"{_T}, p AS (SELECT k, t, lag(t) OVER (PARTITION BY k ORDER BY id, line, part, supp) AS p FROM trades) SELECT k, count(*) AS n FROM p WHERE t < p GROUP BY k")


def position_sizes(spark, d):
    b = T.hourly(spark, d)
    size = L.position_size(F.col("c"), F.col("c") * 0.97, F.lit(100_000.0), F.col("v") * 100, 0.01, 0.2)
    return b.select("k", "t", size.alias("size"))


add("position_sizes", position_sizes, f"WITH {T.BARS} SELECT k, t, greatest(1, floor(least(100000.0 * 0.01 / abs(c - c * 0.97), 100000.0 * 0.2 / c, v * 100 / c)))::BIGINT AS size FROM bars")


def _gates():
    return (F.col("n") < 2, "THIN"), (F.col("v") < 60, "VOLUME"), ((F.col("h") - F.col("l")) > F.col("c"), "RANGE"), (F.col("c") < F.col("o"), "DOWN")


def gate_cascade(spark, d):
    b = T.hourly(spark, d)
    return b.withColumn("reason", L.first_failing(*_gates())).groupBy("k", "reason").agg(F.count("*").alias("n"))


add("gate_cascade", gate_cascade, f"WITH {T.BARS} SELECT k, CASE WHEN n < 2 THEN 'THIN' WHEN v < 60 THEN 'VOLUME' WHEN h - l > c THEN 'RANGE' WHEN c < o THEN 'DOWN' ELSE 'ok' END AS reason, count(*) AS n FROM bars GROUP BY 1, 2")


def gate_reasons(spark, d):
    b = T.hourly(spark, d)
    return b.withColumn("reasons", F.concat_ws("|", L.all_failing(*_gates()))).groupBy("reasons").agg(F.count("*").alias("n"))


add("gate_reasons", gate_reasons, f"WITH {T.BARS} SELECT concat_ws('|', CASE WHEN n < 2 THEN 'THIN' END, CASE WHEN v < 60 THEN 'VOLUME' END, CASE WHEN h - l > c THEN 'RANGE' END, CASE WHEN c < o THEN 'DOWN' END) AS reasons, count(*) AS n FROM bars GROUP BY 1")


def first_bets(spark, d):
    """Exactly one bet a day and user: the first cheap enough."""
    x = T.ticks(spark, d).withColumn("k", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("t", "yyyy-MM-dd")))
    return L.first_qualifying(x.select("k", "t", "id", "px"), F.col("px") < 25, "t", "id")


add("first_bets", first_bets, f"WITH {T.TICKS} SELECT user_id::VARCHAR || '/' || strftime(t, '%Y-%m-%d') AS k, t, id, px FROM ticks WHERE px < 25 QUALIFY row_number() OVER (PARTITION BY user_id, t::DATE ORDER BY t, id) = 1")


def leakage_canary(spark, d):
    x = T.windows(spark, d).select(F.col("y").cast("double").alias("y"), "p", "market", (F.col("y") * 2.0 + 1).alias("leak"), F.lit(3.0).alias("flat"))
    return rounded(L.future_label_canary(x, ["p", "market", "leak", "flat"], "y"))


add(
    "leakage_canary",
    leakage_canary,
    f"WITH {T.WINDOWS} SELECT 'p' AS field, {r('abs(corr(p, y))')} AS r, abs(corr(p, y)) > 0.95 AS leaks FROM windows UNION ALL SELECT 'market', {r('abs(corr(market, y))')}, abs(corr(market, y)) > 0.95 FROM windows UNION ALL SELECT 'leak', 1.0::DOUBLE, true UNION ALL SELECT 'flat', NULL, false",
)


def replay_parity(spark, d):
    live = T.hourly(spark, d)
    replay = live.where(F.hour("t") != 5).withColumn("c", F.when(F.hour("t") == 7, F.col("c") + 0.01).otherwise(F.col("c") + 0.00001))
    return rounded(L.parity(live, replay, ["k", "t"], "c"))


add("replay_parity", replay_parity, f"WITH {T.BARS} SELECT k, t, {r('c')} AS live, {r('CASE WHEN hour(t) = 7 THEN c + 0.01 END')} AS replay FROM bars WHERE hour(t) IN (5, 7)")


def range_position_spread(spark, d):
    """How far the last volatility features of each key lie apart: a roll-up over a window feature."""
    x = W.volatility(T.hourly(spark, d))
    return rounded(x.groupBy("k").agg(F.max("range_position").alias("top"), F.min("range_position").alias("bottom"), F.avg("volume_ratio").alias("volume_ratio")))


add(
    "range_position_spread",
    range_position_spread,
    f"WITH {T.BARS}, f AS (SELECT k, coalesce((c - min(l) OVER w60) / nullif(max(h) OVER w60 - min(l) OVER w60, 0), 0.5) AS pos, coalesce(avg(v) OVER w5 / nullif(avg(v) OVER w60, 0), 1) AS vr FROM bars WINDOW w60 AS (PARTITION BY k ORDER BY t ROWS 59 PRECEDING), w5 AS (PARTITION BY k ORDER BY t ROWS 4 PRECEDING)) SELECT k, {r('max(pos)')} AS top, {r('min(pos)')} AS bottom, {r('avg(vr)')} AS volume_ratio FROM f GROUP BY k",
)

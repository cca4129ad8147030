"""Queries of journals and of the forecast with its paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import forecast as P
from tidewright.operators import journal as J
from tidewright.sources import tables as T

from .q_bars import _last
from .q_folds import _ema
from .registry import add
from .shaping import r, rounded


def forecast_paths(spark, d):
    """Expected return, confidence and the ends of the three paths, for each hour."""
    x = P.forecast_paths(T.hourly(spark, d).select("k", "t", "c"))
    return rounded(x.select("k", "t", "ewm", "trend", "expected", "confidence", *(F.col(q)[i].alias(f"{q}_{i + 1}") for q in ("q10", "q50", "q90") for i in (0, 4))), 5)


_AT = lambda z, i: f"c * exp({i} * CASE WHEN len(x) >= 32 THEN e + {z} ELSE 0 END)"
_CAP = lambda x: f"greatest(0.1, least(0.85, {x}))"
add(
    "forecast_paths",
    forecast_paths,
    f"WITH {T.BARS}, s AS (SELECT k, t, c, list(c) {_last(32)} AS x FROM bars), l AS (SELECT *, list_transform(x, lambda v: ln(v)) AS lg, list_transform(range(2, len(x) + 1), lambda i: ln(x[i]) - ln(x[i - 1])) AS rt FROM s), "
    f"m AS (SELECT *, CASE WHEN len(rt) > 0 THEN {_ema('rt', 'len(rt)', 12)} END AS e, coalesce(list_stddev_pop(rt), 0) AS sd, list_sum(list_transform(lg, lambda v, i: (i - 1 - (len(lg) - 1) / 2) * v)) / nullif(len(lg) * (len(lg) * len(lg) - 1) / 12, 0) AS sl FROM l), "
    "f AS (SELECT *, CASE WHEN len(x) >= 32 THEN e * 5 ELSE 0 END AS ewm, CASE WHEN len(x) >= 32 THEN sl * 5 ELSE 0 END AS trend FROM m), g AS (SELECT *, (ewm + trend) / 2 AS expected FROM f) "
    f"SELECT k, t, {r('ewm', 5)} AS ewm, {r('trend', 5)} AS trend, {r('expected', 5)} AS expected, CASE WHEN len(x) >= 32 THEN {r(_CAP(_CAP('abs(expected) / CASE WHEN sd > 1e-8 THEN sd ELSE 0.01 END') + ' * CASE WHEN ewm * trend < 0 THEN 0.6 ELSE 1 END'), 5)} ELSE 0.1 END AS confidence, "
    + ", ".join(f"{r(_AT(z, i), 5)} AS {q}_{i}" for q, z in (("q10", "(-sd)"), ("q50", "0"), ("q90", "sd")) for i in (1, 5))
    + " FROM g",
)


def _journal(spark, d):
    """Line items as trades; a tenth is open, and features are missing in part."""
    x = T.trades(spark, d)
    i = F.col("id") + F.col("line")
    held = F.create_map(F.lit("fta_reward_risk"), (i % 4).cast("string"), F.lit("reward_risk"), F.when(i % 3 != 0, "1.5"), F.lit("forecast_direction_up"), F.when(i % 5 != 0, (i % 2).cast("string")).otherwise("no"), F.lit("forecast_confidence"), (i % 7 / 10).cast("string"))
    t = F.col("t").cast("timestamp_ntz")
    return x.select(
        F.concat_ws("-", "id", "line").alias("id"), "k", F.when(i % 2 == 0, "long").otherwise("short").alias("side"), t.alias("entry_t"), F.when(i % 6 != 0, F.timestamp_add("MINUTE", i % 500 - 20, t)).alias("exit_t"), F.col("entry").cast("double").alias("entry_price"),
        F.when(i % 10 != 0, F.col("entry") + F.col("pnl")).cast("double").alias("exit_price"), F.when(i % 8 != 0, F.col("entry") - 50).cast("double").alias("stop_price"), (F.col("entry") + 25).cast("double").alias("target_price"), F.when(i % 9 != 0, F.col("pnl")).cast("double").alias("pnl"), F.when(i % 11 != 0, F.col("reason")).alias("reason"),
        F.when(i % 3 == 1, F.create_map().cast("map<string,string>")).otherwise(held).alias("features"),
    )


def journal_diagnostics(spark, d):
    return rounded(J.diagnostics(_journal(spark, d)).select("id", "outcome", "holding_hours", "reward_risk", "direction", "confidence", "reason"))


_J = (
    f"{T.TRADES}, j AS (SELECT *, id + line AS i FROM trades), c AS (SELECT concat(id, '-', line) AS id, k, i, CASE WHEN i % 9 <> 0 THEN pnl ELSE 0 END AS pnl, CASE WHEN i % 6 <> 0 THEN greatest(0, (i % 500 - 20) / 60) ELSE 0 END AS hours, i % 3 <> 1 AS has, entry, CASE WHEN i % 8 <> 0 THEN 50 ELSE entry END AS risk, coalesce(CASE WHEN i % 11 <> 0 THEN reason END, 'unknown') AS reason FROM j WHERE i % 10 <> 0), "
    "dg AS (SELECT *, coalesce(CASE WHEN has AND i % 4 <> 0 THEN (i % 4)::DOUBLE END, CASE WHEN has AND i % 3 <> 0 THEN 1.5 END, CASE WHEN risk = 0 THEN 0 ELSE 25 / risk END) AS rr, CASE WHEN has AND i % 5 <> 0 THEN CASE WHEN i % 2 = 1 THEN 'up' ELSE 'down' END END AS direction, CASE WHEN has THEN (i % 7 / 10)::DOUBLE END AS conf FROM c)"
)
add("journal_diagnostics", journal_diagnostics, f"WITH {_J} SELECT id, CASE WHEN pnl > 1e-8 THEN 'win' WHEN pnl < -1e-8 THEN 'loss' ELSE 'breakeven' END AS outcome, {r('hours')} AS holding_hours, {r('rr')} AS reward_risk, direction, {r('conf')} AS confidence, reason FROM dg")


def decision_reports(spark, d):
    """The funnel of each key; line items with a large discount stand for what a gate refused."""
    refused = T.table(spark, d, "lineitem").where("l_discount >= 0.09").select(F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("gate"))
    x = J.decision_report(_journal(spark, d), refused)
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e.key, e.value)), ",")
    return rounded(x.withColumn("gates", flat("gates")).withColumn("exits", flat("exits")), 5)


add(
    "decision_reports",
    decision_reports,
    f"WITH {_J}, a AS (SELECT k, count(*) AS accepted FROM trades GROUP BY k), e AS (SELECT k, string_agg(concat(reason, '=', n), ',' ORDER BY reason) AS exits FROM (SELECT k, reason, count(*) AS n FROM dg GROUP BY 1, 2) GROUP BY k), g AS (SELECT k, sum(n)::BIGINT AS refused, string_agg(concat(gate, '=', n), ',' ORDER BY gate) AS gates FROM (SELECT l_returnflag AS k, l_linestatus AS gate, count(*) AS n FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1, 2) GROUP BY k), "
    f"m AS (SELECT k, avg(conf) AS cm, stddev_samp(conf) AS cs FROM dg GROUP BY k) SELECT k, accepted + coalesce(refused, 0) AS candidates, accepted, {r('accepted / (accepted + coalesce(refused, 0))', 5)} AS acceptance, gates, {r('coalesce(cm, 0)', 5)} AS confidence_mean, {r('coalesce(cs, 0)', 5)} AS confidence_std, exits FROM a LEFT JOIN g USING (k) LEFT JOIN e USING (k) LEFT JOIN m USING (k)",
)


def holding_comparison(spark, d):
    """Holding each key's hours at three costs, by return; of the era from a day on."""
    b = J.of_era(T.hourly(spark, d), F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))
    out = None
    for name, cost in (("free", 0.0), ("cheap", 0.001), ("dear", 0.05)):
        one = J.buy_and_hold(b, 100_000.0, 20, cost, cost).withColumn("config", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(J.comparison(out), 5)


add(
    "holding_comparison",
    holding_comparison,
    f"WITH {T.BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM bars WHERE t >= TIMESTAMP '2024-01-03'), e AS (SELECT k, count(*) AS n_bars, max(c) FILTER (i = 21) AS en, arg_max(c, t) AS ex FROM n GROUP BY k HAVING max(c) FILTER (i = 21) IS NOT NULL), "
    "q AS (SELECT *, floor(100000.0 / en)::BIGINT AS quantity FROM e), p AS (SELECT q.*, config, (ex - en) * quantity - en * quantity * 2 * cost AS pnl FROM q, (VALUES ('free', 0.0::DOUBLE), ('cheap', 0.001), ('dear', 0.05)) v(config, cost)) "
    f"SELECT k, config, n_bars, 1::BIGINT AS n_trades, quantity, {r('pnl', 5)} AS pnl, {r('pnl / 100000 * 100', 5)} AS return_pct, (pnl > 0)::INTEGER::DOUBLE AS win_rate, {r('greatest(pnl, 0) / greatest(-pnl, 1e-9)', 5)} AS profit_factor, row_number() OVER (PARTITION BY k ORDER BY pnl DESC, config) AS place FROM p",
)

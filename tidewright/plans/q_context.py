"""Queries of context vectors, inputs of stacked models and the bundle of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.scalar import horizon_sigma
from tidewright.operators import bars as B
from tidewright.operators import context as C
from tidewright.sources import tables as T

from .q_bars import _last
from .q_folds import ATR, _ema
from .q_structure import BREAKS, _Q
from .registry import add
from .shaping import r, rounded


def _snapped(spark, d):
    """Features of quarters, with a snapshot of numbers of the bar's own, missing on every third bar."""
    x = C.bar_features(B.resample(T.ticks(spark, d), "15 minutes"))
    there = F.col("n") % 3 != 0
    value = {"fng": F.col("n") % 100, "funding": F.col("n") / 1e5, "imb": F.col("n") / 10, "spread_bp": F.col("n"), "sent": F.col("n") / 20, "news_n": 9 * F.col("n"), "ofi_1m": F.col("n") / 8, "ofi_5m": -F.col("n") / 9, "k_pup": F.col("n") / 7, "k_dist_bp": F.col("n"), "k_spread": F.col("n") / 50}
    return x.withColumns({c: F.when(there, value[c]).cast("double") if c in value else F.lit(None).cast("double") for c in C.SNAPSHOT})


def context_vectors(spark, d):
    x = _snapped(spark, d).withColumn("x", C.context_vector())
    return rounded(x.select("k", "t", *(F.col("x")[i].alias(f"x{i}") for i in range(39))), 5)


_O = "OVER (PARTITION BY k ORDER BY t)"
_RET = lambda n: f"coalesce(c / nullif(lag(c, {n}) {_O}, 0) - 1, 0)"
FEATURES = (
    f"{T.TICKS}, {T.bars_sql('quarters', '15 minutes')}, f1 AS (SELECT *, {_RET(1)} AS ret_1, {_RET(5)} AS ret_5, {_RET(15)} AS ret_15, {_RET(60)} AS ret_60, {_RET(240)} AS ret_240, c / nullif(lag(c) {_O}, 0) - 1 AS raw, c - lag(c) {_O} AS d, list(c) {_last(60)} AS x, avg(v) {_last(60)} AS v60, avg(v) {_last(5)} AS v5, avg(c) {_last(20)} AS m20, stddev_pop(c) {_last(20)} AS s20 FROM quarters), "
    f"f2 AS (SELECT *, coalesce(stddev_pop(raw) {_last(30)}, 0) AS vol_30, count(d) {_last(14)} AS dn, sum(greatest(d, 0)) {_last(14)} AS gain, sum(greatest(-d, 0)) {_last(14)} AS loss, x[greatest(len(x) - 44, 1):] AS s FROM f1), "
    f"f3 AS (SELECT *, list_transform(range(2, len(s) + 1), lambda j: {_ema('s[1:j]', 'j', 12)} - {_ema('s[1:j]', 'j', 26)}) AS ml FROM f2), f4 AS (SELECT *, ml[greatest(len(ml) - 8, 1):] AS m FROM f3), "
    "f5 AS (SELECT *, CASE WHEN dn < 14 THEN 50.0 WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END AS rsi, "
    f"c / nullif({_ema('x', 'len(x)', 30)}, 0) - 1 AS ema_dist, coalesce(v5 / nullif(v60, 0), 1) AS vol_ratio, coalesce(v / nullif(v60, 0), 1) AS vol_1_ratio, CASE WHEN list_max(x) > list_min(x) THEN (c - list_min(x)) / (list_max(x) - list_min(x)) - 0.5 ELSE 0 END AS range_pos, (sign(ret_5) + sign(ret_15) + sign(ret_60)) / 3.0 AS trend_align, "
    f"CASE WHEN len(m) > 0 THEN m[len(m)] ELSE 0 END AS macd, CASE WHEN len(m) > 0 THEN {_ema('m', 'len(m)', 9)} ELSE 0 END AS sig, n % 3 <> 0 AS snap FROM f4), "
    "feat AS (SELECT *, macd / c * 1e4 AS macd_bp, (macd - sig) / c * 1e4 AS macd_hist_bp, (c - m20) / c * 1e4 AS gap_bp20, CASE WHEN s20 > 1e-9 THEN (c - m20) / (2 * s20) ELSE 0 END AS bb_z, 4 * s20 / c * 1e4 AS bb_width_bp FROM f5)"
)
_lg = lambda c: f"ln(greatest({c}, 1e-6)) / 2"
_cl = lambda x, m: f"greatest(-{m}, least({m}, {x}))"
_TECH = ["(rsi - 50) / 50", _cl("ema_dist * 1e4 / 10", 3), _cl("macd_bp / 5", 3), _cl("macd_hist_bp / 3", 3), _cl("gap_bp20 / 10", 3), _cl("bb_z", 2), "least(bb_width_bp / 20, 3)", _lg("vol_1_ratio")]
_S = lambda x, other="0": f"CASE WHEN snap THEN {x} ELSE {other} END"
_VECTOR = [
    "1.0", "ret_1 * 1e4 / 10", "ret_5 * 1e4 / 20", "ret_15 * 1e4 / 30", "ret_60 * 1e4 / 60", "vol_30 * 1e4 / 10", "(rsi - 50) / 50", "ema_dist * 1e4 / 30", _lg("vol_ratio"), _S("(n % 100 - 50) / 50"), *_TECH, "ret_240 * 1e4 / 120", "trend_align", "range_pos * 2",
    _S("n / 1e5 * 1e4"), "0", "0", "0", "0", _S("n / 10"), _S("n / 5"), _S("n / 20"), "0", _S("least(9 * n / 20, 1.5)"), _S("n / 8"), _S("-n / 9"), "0", "0", _S("(n / 7 - 0.5) * 2"), _S("n / 5"), "0", _S("n / 50 * 5"),
]
add("context_vectors", context_vectors, f"WITH {FEATURES} SELECT k, t, " + ", ".join(f"round(({x})::DOUBLE, 5) AS x{i}" for i, x in enumerate(_VECTOR)) + " FROM feat")


def _decided(spark, d):
    """Three decisions in each hour on its close against its open, by quarters of it, with the path so far."""
    x = _snapped(spark, d).withColumn("window_t", F.date_trunc("hour", "t").cast("timestamp_ntz"))
    strike = x.groupBy("k", "window_t").agg(F.min_by("o", "t").alias("strike"))
    later = x.join(strike, ["k", "window_t"]).withColumn("mins_left", 60 - F.minute("t").cast("double")).withColumn("base", F.col("c"))
    later = later.withColumn("t", F.col("t") + F.expr("interval 1 minute")).withColumn("sigma_3", horizon_sigma(F.col("vol_30"), F.lit(3.0), F.col("c"))).withColumn("quote", F.col("k_pup"))
    bars = B.resample(T.ticks(spark, d), "15 minutes").select("k", "t", "c")
    return C.path_features(later, bars, 60).withColumn("p2", F.col("n") % 10 / 10).withColumn("p3", F.col("n") % 7 / 7).withColumn("p4", F.col("n") % 5 / 5)


def stacked_inputs(spark, d):
    """Inputs of four stacked models at each decision."""
    x = _decided(spark, d)
    parts = {"b": (C.binary_vector(), 24), "s": (C.stacked_vector(), 12), "e": (C.entry_vector(F.col("n") % 2 == 0, (F.lit(10) + F.col("n")).cast("double"), F.hour("t") == 13), 14), "l": (C.pool_vector(F.col("p3"), F.col("k_pup")), 3)}
    out = x.select("k", "t", *(v.alias(n) for n, (v, _) in parts.items()))
    return rounded(out.select("k", "t", *(F.col(n)[i].alias(f"{n}{i}") for n, (_, size) in parts.items() for i in range(size))), 5)


_KP = "CASE WHEN snap THEN n / 7 END"
_PATH = (
    f"{FEATURES}, w AS (SELECT *, date_trunc('hour', t) AS wt, {_KP} AS kp, n % 10 / 10 AS p2, n % 7 / 7 AS p3, n % 5 / 5 AS p4 FROM feat), st AS (SELECT k AS k_, wt AS wt_, arg_min(o, t) AS strike FROM w GROUP BY 1, 2), "
    "dc AS (SELECT w.*, strike, t + INTERVAL 1 MINUTE AS at_, 60 - minute(t) AS ml_ FROM w JOIN st ON k = k_ AND wt = wt_), "
    "pb AS (SELECT d.k, d.at_, list(q.c ORDER BY q.t) AS cs, list({'t': q.t + INTERVAL 1 MINUTE, 'q': q.kp} ORDER BY q.t) FILTER (q.kp IS NOT NULL) AS qs FROM dc d JOIN w q ON q.k = d.k AND q.wt = d.wt AND q.t < d.at_ GROUP BY 1, 2), "
    "pd AS (SELECT d.*, cs, qs, list_transform(cs, lambda c: (c >= strike)::INTEGER) AS ab FROM dc d JOIN pb USING (k, at_)), "
    "pt AS (SELECT *, round(list_sum(ab) / len(ab) - 0.5, 5) AS q0, round(least(4, coalesce(list_sum(list_transform(range(2, len(ab) + 1), lambda i: (ab[i] <> ab[i - 1])::INTEGER)), 0)) / 4, 5) AS q1, "
    "round(CASE WHEN len(cs) >= 4 THEN greatest(-4, least(4, (cs[-1] - cs[-4]) / greatest(vol_30 * sqrt(3) * c, 5))) ELSE 0 END, 5) AS q2, round(coalesce(qs[-1].q - list_filter(qs, lambda z: z.t <= qs[-1].t - INTERVAL 170 SECONDS)[-1].q, 0), 5) AS q3, "
    "greatest(-4, least(4, (c - strike) / greatest(vol_30 * sqrt(greatest(ml_, 1)) * c, 5))) AS z, n % 2 = 0 AS yes, CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END AS sg FROM pd)"
)
_MK = "coalesce((kp - 0.5) * 2, 0)"
_od = lambda p: f"greatest(-3, least(3, ln(least(0.98, greatest(0.02, {p})) / (1 - least(0.98, greatest(0.02, {p}))))))"
_IN = {
    "b": ["1", _MK, "(kp IS NOT NULL)::INTEGER", "z", "ml_ / 15", "z * ml_ / 15", _S("n / 8"), _S("-n / 9"), _S("n / 10"), "ret_5 * 1e4 / 30", "ret_15 * 1e4 / 60", _lg("vol_ratio"), "q0", "q1", "q2", "q3", *_TECH],
    "s": ["1", "(p2 - 0.5) * 2", "(p3 - 0.5) * 2", "(p2 - 0.5) * 2 * (p3 - 0.5) * 2 * 2", _MK, "(kp IS NOT NULL)::INTEGER", "z", "ml_ / 15", "q0", "q1", "q2", "q3"],
    "e": ["1", "(p2 - 0.5) * 2 * sg", "(p3 - 0.5) * 2 * sg", "(p4 - 0.5) * 2 * sg", f"{_MK} * sg", f"(p2 - 0.5) * 2 * sg - {_MK} * sg", "(10 + n) / 100", "(100 * CASE WHEN yes THEN p2 ELSE 1 - p2 END - (10 + n)) / 100", "z * sg", "ml_ / 15", "(hour(at_) = 13)::INTEGER", "q0 * sg", "q1", "q3 * sg * 5"],
    "l": ["1", _od("p3"), f"CASE WHEN kp IS NOT NULL THEN {_od('kp')} ELSE 0 END"],
}
add("stacked_inputs", stacked_inputs, f"WITH {_PATH} SELECT k, at_ AS t, " + ", ".join(f"round(({x})::DOUBLE, 5) AS {n}{i}" for n, xs in _IN.items() for i, x in enumerate(xs)) + " FROM pt")


def feature_bundle(spark, d):
    """Structure, levels, volatility and liquidity of each key's last hour."""
    return rounded(C.bundle(T.hourly(spark, d)))


add(
    "feature_bundle",
    feature_bundle,
    f"WITH {BREAKS}, {ATR}, rg AS (SELECT k, t, atr, atr > lag(atr, 5) OVER (PARTITION BY k ORDER BY t) AS expanding, list(atr) FILTER (atr IS NOT NULL) {_last(50)} AS rx FROM atrs), "
    f"rgs AS (SELECT k, t, atr, expanding, CASE WHEN rx IS NULL OR len(rx) < 50 OR atr IS NULL THEN 'normal' WHEN atr >= {_Q(0.9)} THEN 'extreme' WHEN atr >= {_Q(0.75)} THEN 'high' WHEN atr <= {_Q(0.25)} THEN 'low' ELSE 'normal' END AS regime FROM rg), "
    f"lq AS (SELECT k, t, h, l, v, avg(v) {_last(20)} AS av FROM bars), ab AS (SELECT k, t, c, list(CASE WHEN swing_high THEN h END) OVER w AS hs, list(CASE WHEN swing_low THEN l END) OVER w AS ls FROM swung WINDOW w AS (PARTITION BY k ORDER BY t ROWS BETWEEN 200 PRECEDING AND 5 PRECEDING)), "
    "tr AS (SELECT ts.k, trend, CASE trend WHEN 'uptrend' THEN (hh + hl) / 2 WHEN 'downtrend' THEN 1 - (hh + hl) / 2 WHEN 'ranging' THEN greatest((hh + hl) / 2, 1 - (hh + hl) / 2) ELSE 0 END AS strength FROM ts JOIN trends USING (k)), "
    "sc AS (SELECT k, count(*) FILTER (swing_high) AS swing_highs, count(*) FILTER (swing_low) AS swing_lows FROM swung GROUP BY k) "
    f"SELECT k, t, {r('c')} AS c, trend, {r('strength')} AS strength, swing_highs, swing_lows, {r('list_min(list_filter(hs, lambda x: x > c))')} AS above, {r('list_max(list_filter(ls, lambda x: x < c))')} AS below, {r('coalesce(atr, 0)')} AS atr, {r('coalesce(atr / nullif(c, 0), 0)')} AS atr_pct, regime, coalesce(expanding, false) AS expanding, "
    f"{r('av')} AS avg_volume, {r('coalesce(v / nullif(av, 0), 0)')} AS relative_volume, {r('CASE WHEN v = 0 THEN 0 ELSE 0.1 * (h - l) END')} AS spread_estimate FROM ab JOIN rgs USING (k, t) JOIN lq USING (k, t) JOIN tr USING (k) JOIN sc USING (k) QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC) = 1",
)

"""Queries of reviews: trailing scores, scaled bands, weights by phase, the frontier with money, failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import reviews as V
from tidewright.sources import tables as T

from .registry import add
from .shaping import r, rounded

_NOW = "2024-01-25 00:00:00"
_W = f"{T.WINDOWS}, w AS (SELECT *, date_diff('minute', TIMESTAMP '2024-01-01', t) AS m FROM windows)"


def _windows(spark, d):
    minute = F.timestamp_diff("MINUTE", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("t"))
    return T.windows(spark, d).withColumn("m", minute)


def trailing_scores(spark, d):
    """Forecasts of a window's end from its start, by kind and by a horizon that the window's time gives."""
    w = _windows(spark, d).withColumn("arm", F.col("k")).withColumn("horizon", F.floor(F.col("m") / 15) % 2)
    w = w.withColumn("price_now", F.col("strike")).withColumn("pred", F.when(F.col("n") % 4 == 0, F.col("strike")).otherwise(F.col("strike") + 20 * (F.col("p") - 0.5))).withColumn("actual", F.when(F.col("m") % 7 != 0, F.col("final")))
    w = w.withColumn("lo", F.when(F.col("n") % 3 != 0, F.col("pred") - 10)).withColumn("hi", F.when(F.col("n") % 3 != 0, F.col("pred") + 12))
    return rounded(V.trailing_scores(w, F.lit(_NOW).cast("timestamp_ntz"), 240))


add(
    "trailing_scores",
    trailing_scores,
    f"WITH {_W}, x AS (SELECT k AS arm, (m // 15) % 2 AS horizon, strike AS now_, CASE WHEN n % 4 = 0 THEN strike ELSE strike + 20 * (p - 0.5) END AS pred, final AS actual, n % 3 <> 0 AS banded FROM w WHERE m % 7 <> 0 AND t >= TIMESTAMP '{_NOW}' - INTERVAL 240 HOURS) "
    f"SELECT arm, horizon, count(*) AS n, {r('avg((pred - actual) * (pred - actual))')} AS mse, {r('avg(abs(pred - actual))')} AS mae, {r('avg(((pred > now_) = (actual > now_))::INTEGER) FILTER (pred <> now_)')} AS dir, {r('avg((actual BETWEEN pred - 10 AND pred + 12)::INTEGER) FILTER (banded)')} AS cov, {r('avg(pred + 12 - (pred - 10)) FILTER (banded)')} AS sharp, "
    f"{r('sqrt(avg((pred - actual) * (pred - actual)))')} AS rmse, {r('avg((pred - actual) * (pred - actual)) / nullif(avg((actual - now_) * (actual - now_)), 0)')} AS msse, {r('avg(abs(pred - actual)) / nullif(avg(abs(actual - now_)), 0)')} AS mase FROM x GROUP BY 1, 2 HAVING count(*) >= 10",
)


def trailing_binary(spark, d):
    return rounded(V.trailing_binary(T.windows(spark, d), F.lit(_NOW).cast("timestamp_ntz"), 240))


add(
    "trailing_binary",
    trailing_binary,
    f"WITH {T.WINDOWS}, x AS (SELECT k, count(*) AS n, avg(((p >= 0.5)::INTEGER = y)::INTEGER) AS acc, avg((p - y) * (p - y)) AS b, avg((market - y) * (market - y)) AS mb FROM windows WHERE t >= TIMESTAMP '{_NOW}' - INTERVAL 240 HOURS GROUP BY k) SELECT k, n, {r('acc')} AS acc, {r('b')} AS brier, {r('mb')} AS market_brier, {r('1 - b / nullif(mb, 0)')} AS skill_market, {r('1 - b / 0.25')} AS skill_coin FROM x",
)


def scaled_bands(spark, d):
    w = _windows(spark, d).select("k", "t", F.col("strike").alias("pred"), F.when(F.col("m") % 11 != 0, F.col("final")).alias("actual"), F.when(F.col("n") % 7 != 0, 1 + F.col("m") % 5).cast("double").alias("sigma"))
    return rounded(V.scaled_band(w, 60))


add(
    "scaled_bands",
    scaled_bands,
    f"WITH {_W}, x AS (SELECT k, t, strike AS pred, CASE WHEN m % 11 <> 0 THEN final END AS actual, CASE WHEN n % 7 <> 0 THEN (1 + m % 5)::DOUBLE END AS sigma FROM w), u AS (SELECT *, actual IS NOT NULL AND coalesce(sigma > 0, false) AS u, (actual - pred) / sigma AS z FROM x), "
    "c AS (SELECT *, list({'z': z, 's': sigma}) FILTER (u) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM u), b AS (SELECT *, a[greatest(len(a) - 59, 1):] AS a2 FROM c), "
    "e AS (SELECT *, list_sort(list_transform(a2, lambda x: x.z)) AS zs, list_sort(list_transform(a2, lambda x: x.s)) AS ss, len(a2) AS q FROM b), f AS (SELECT *, greatest(coalesce(sigma, ss[q // 2 + 1]), 0.6 * ss[q // 2 + 1]) AS sc FROM e) "
    "SELECT k, t, round(pred, 6) AS pred, round(actual, 6) AS actual, sigma, CASE WHEN q >= 20 THEN floor(zs[floor(0.1::DOUBLE * q)::INTEGER + 1] * sc)::BIGINT END AS lo, CASE WHEN q >= 20 THEN ceil(zs[least(q - 1, floor(0.9::DOUBLE * q)::INTEGER) + 1] * sc)::BIGINT END AS hi FROM f",
)


def _calls(spark, d):
    w = _windows(spark, d)
    return w.select("k", "t", F.lit(0).alias("id"), (F.floor(F.col("m") / 15) * 7 % 15).cast("double").alias("mins_left"), "p", "market", F.when(F.col("m") % 7 != 0, F.col("y")).alias("y"))


def phase_weights(spark, d):
    """Weights of calls against the market, and of their distance from a half, by phase."""
    c = _calls(spark, d)
    blend, shrink = V.phase_weights(c, "market", 100, 30, 1.0, 0.5), V.phase_weights(c, None, 80, 20, 1.2, 1.0)
    return rounded(blend.withColumn("kind", F.lit("blend")).unionByName(shrink.withColumn("kind", F.lit("shrink"))))


_PHASES = f"{_W}, c AS (SELECT k, t, (m // 15) * 7 % 15 AS ml, CASE WHEN ml >= 10 THEN 'early' WHEN ml >= 5 THEN 'mid' ELSE 'late' END AS phase, p, market, CASE WHEN m % 7 <> 0 THEN y END AS y FROM w), every AS (SELECT DISTINCT k, phase FROM (SELECT DISTINCT k FROM c), (VALUES ('early'), ('mid'), ('late')) v(phase))"
_FIT = lambda kind, c, last, least, most, default: f"SELECT '{kind}' AS kind, e.k, e.phase, round((CASE WHEN n >= {least} AND b > 1e-9 THEN greatest(0, least({most}, a / b)) ELSE {default} END)::DOUBLE, 6) AS weight, coalesce(n, 0) AS n FROM every e LEFT JOIN (SELECT k, phase, count(*) AS n, sum((p - {c}) * (y - {c})) AS a, sum((p - {c}) * (p - {c})) AS b FROM (SELECT * FROM c WHERE y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, phase ORDER BY t DESC) <= {last}) GROUP BY 1, 2) s ON s.k = e.k AND s.phase = e.phase"
add("phase_weights", phase_weights, f"WITH {_PHASES} {_FIT('blend', 'market', 100, 30, 1.0, 0.5)} UNION ALL {_FIT('shrink', '0.5', 80, 20, 1.2, 1.0)}")

_STEPS = [x / 2 for x in range(-4, 13)]


def economic_frontier(spark, d):
    return rounded(V.economic_frontier(V.entry_economics(T.windows(spark, d)), _STEPS, 0.5))


_ENTRY = f"{T.WINDOWS}, e1 AS (SELECT k, p >= 0.5 AS yes, y, p, greatest(1.0, least(99.0, 100 * CASE WHEN p >= 0.5 THEN market ELSE 1 - market END)) AS price FROM windows), e2 AS (SELECT *, price + 7 * (price / 100) * (1 - price / 100) AS cost, 100 * CASE WHEN yes THEN p ELSE 1 - p END - price AS edge FROM e1), e AS (SELECT *, CASE WHEN (y = 1) = yes THEN 100 - cost ELSE -cost END AS g FROM e2)"
add(
    "economic_frontier",
    economic_frontier,
    f"WITH {_ENTRY}, th AS (SELECT unnest({_STEPS})::DOUBLE AS threshold), a AS (SELECT k, count(*) AS an, count(*) FILTER (g > 0) AS ag, sum(g) FILTER (g > 0) AS aw FROM e GROUP BY k), "
    "f AS (SELECT e.k, threshold, count(*) AS n, count(*) FILTER (g > 0) AS good, coalesce(sum(g) FILTER (g > 0), 0) AS won, coalesce(sum(g) FILTER (g <= 0), 0) AS lost, sum(g / cost) AS ratio FROM e JOIN th ON edge >= threshold GROUP BY 1, 2), "
    "x AS (SELECT f.k, threshold, n, n / an AS coverage, good / greatest(ag, 1) AS recall, 1 - good / n AS bad, won, lost, coalesce(aw, 0) - won AS missed, 100 * ratio / n AS gain, 1 - good / n <= 0.5 AND 100 * ratio / n > 0 AS feasible FROM f JOIN a ON a.k = f.k) "
    f"SELECT k, threshold, n, {r('coverage')} AS coverage, {r('recall')} AS recall, {r('bad')} AS bad, {r('won')} AS captured_c, {r('lost')} AS dicey_c, {r('missed')} AS missed_c, {r('gain')} AS gain_per_100, feasible, feasible AND row_number() OVER (PARTITION BY k ORDER BY feasible DESC, recall DESC, threshold) = 1 AS operating FROM x",
)


def failure_clusters(spark, d):
    """Why the last hundred lost bets of each key were lost."""
    w = _windows(spark, d).withColumn("id", F.lit(0)).withColumn("side", F.when(F.col("m") % 2 == 0, "yes").otherwise("no")).withColumn("price_c", (F.col("m") / 15 * 7 % 100).cast("double"))
    w = w.withColumn("mins_left", (F.floor(F.col("m") / 15) % 15).cast("double")).withColumn("edge_c", F.col("n") % 5 - 2.0).withColumn("forced", F.col("n") % 6 == 0).withColumn("p", F.when(F.col("n") % 9 != 0, F.lit(0.5) + (F.col("p") - 0.5) * 8))
    w = w.withColumn("market", F.when(F.col("n") % 4 != 0, F.col("p") / 2 + 0.2)).withColumn("pnl_c", F.when((F.col("y") == 1) == (F.col("side") == "yes"), 100 - F.col("price_c")).otherwise(-F.col("price_c")))
    return rounded(V.failure_clusters(w, 100))


_TAGGED = [("tk < 0.5 AND edge < 0 AND NOT forced", 0), ("coalesce(oth >= 0.62, false)", 1), ("tk >= 0.65", 2), ("price >= 70", 3), ("ml < 3", 4), ("tk >= 0.5 AND tk < 0.65", 5)]
add(
    "failure_clusters",
    failure_clusters,
    f"WITH {_W}, b AS (SELECT k, t, y, CASE WHEN n % 9 <> 0 THEN 0.5 + (p - 0.5) * 8 END AS p, m % 2 = 0 AS yes, (m / 15 * 7 % 100)::DOUBLE AS price, (m // 15) % 15 AS ml, n % 5 - 2.0 AS edge, n % 6 = 0 AS forced, n FROM w), "
    "c AS (SELECT *, CASE WHEN n % 4 <> 0 THEN p / 2 + 0.2 END AS market, CASE WHEN (y = 1) = yes THEN 100 - price ELSE -price END AS pnl, CASE WHEN yes THEN coalesce(p, 0.5) ELSE 1 - coalesce(p, 0.5) END AS tk FROM b), l AS (SELECT *, CASE WHEN yes THEN 1 - market ELSE market END AS oth FROM c WHERE pnl < 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC) <= 100) "
    f"SELECT k, CASE {' '.join(f'WHEN {c} THEN {chr(39)}{V.FAILURES[i]}{chr(39)}' for c, i in _TAGGED)} ELSE 'UNCLASSIFIED' END AS reason, count(*) AS n, {r('sum(pnl)')} AS pnl_c, count(*) FILTER (NOT forced AND tk < 0.5 AND edge < 0) AS invalid FROM l GROUP BY 1, 2",
)

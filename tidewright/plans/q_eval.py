"""Queries of forecast evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import evaluation as E
from tidewright.sources import tables as T

from .registry import add
from .shaping import r, rounded

_W = f"WITH {T.WINDOWS}"
TAUS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.8, 0.9]
_TAUS = ", ".join(f"({t}::DOUBLE)" for t in TAUS)


def forecast_scores(spark, d):
    return rounded(E.scores(T.windows(spark, d)))


add(
    "forecast_scores",
    forecast_scores,
    f"{_W}, s AS (SELECT k, count(*) AS n, avg((p - y) ** 2) AS b, avg((market - y) ** 2) AS m, -avg(y * ln(greatest(1e-6, least(1 - 1e-6, p))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, p)))) AS ll FROM windows GROUP BY k) "
    f"SELECT k, n, {r('b')} AS brier, {r('m')} AS market_brier, {r('ll')} AS log_loss, {r('1 - b / nullif(m, 0)')} AS skill FROM s",
)


def forecast_auc(spark, d):
    return rounded(E.rank_auc(T.windows(spark, d)))


add(
    "forecast_auc",
    forecast_auc,
    f"{_W}, rk AS (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0 AS rk FROM windows), s AS (SELECT k, sum(CASE WHEN y = 1 THEN rk END)::DOUBLE AS rs, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM rk GROUP BY k) SELECT k, {r('(rs - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0)')} AS auc FROM s",
)


def calibration_error(spark, d):
    return rounded(E.equal_count_bins(T.windows(spark, d)))


add(
    "calibration_error",
    calibration_error,
    f"{_W}, i AS (SELECT k, p, y, row_number() OVER (PARTITION BY k ORDER BY p, t) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM windows), b AS (SELECT k, ((i + 1) * 10 - 1) // n AS b, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM i GROUP BY 1, 2) SELECT k, {r('sum(n * gap) / sum(n)')} AS ece FROM b GROUP BY k",
)


def reliability_bins(spark, d):
    return rounded(E.reliability(T.windows(spark, d)))


add("reliability_bins", reliability_bins, f"{_W} SELECT k, least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, {r('avg(p)')} AS forecast, {r('avg(y)')} AS outcome FROM windows GROUP BY 1, 2")


def confusion_matrix(spark, d):
    return rounded(E.confusion(T.windows(spark, d)))


_CONF = "c AS (SELECT k, sum((p >= 0.5 AND y = 1)::BIGINT)::BIGINT AS tp, sum((p >= 0.5 AND y = 0)::BIGINT)::BIGINT AS fp, sum((p < 0.5 AND y = 1)::BIGINT)::BIGINT AS fn, sum((p < 0.5 AND y = 0)::BIGINT)::BIGINT AS tn FROM windows GROUP BY k)"
add(
    "confusion_matrix",
    confusion_matrix,
    f"{_W}, {_CONF}, m AS (SELECT *, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS acc, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS pr, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS re FROM c) SELECT k, tp, fp, fn, tn, {r('acc')} AS accuracy, {r('pr')} AS precision, {r('re')} AS recall, {r('coalesce(2 * pr * re / nullif(pr + re, 0), 0)')} AS f1 FROM m",
)


def precision_by_class(spark, d):
    return rounded(E.by_class(T.windows(spark, d)))


add(
    "precision_by_class",
    precision_by_class,
    f"{_W}, {_CONF} SELECT k, {r('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)')} AS precision_up, {r('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)')} AS recall_up, {r('coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0)')} AS precision_down, {r('coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)')} AS recall_down FROM c",
)

_AT = f"a AS (SELECT k, tau, greatest(p, 1 - p) >= tau AS keep, ((p >= 0.5)::INTEGER = y)::INTEGER AS ok FROM windows, (VALUES {_TAUS}) v(tau))"


def selective_accuracy(spark, d):
    return rounded(E.selective_accuracy(T.windows(spark, d), TAUS))


add("selective_accuracy", selective_accuracy, f"{_W}, {_AT} SELECT k, tau, {r('avg(keep::INTEGER)')} AS coverage, {r('avg(CASE WHEN keep THEN ok END)')} AS accuracy FROM a GROUP BY 1, 2")


def precision_target_tau(spark, d):
    return rounded(E.precision_tau(T.windows(spark, d), TAUS, 0.55))


add(
    "precision_target_tau",
    precision_target_tau,
    f"{_W}, {_AT}, e AS (SELECT k, tau, sum(keep::INTEGER) AS n, avg(CASE WHEN keep THEN ok END) AS pr FROM a GROUP BY 1, 2), l AS (SELECT *, min((n >= 25)::INTEGER) OVER (PARTITION BY k ORDER BY tau) AS alive FROM e) SELECT k, min(CASE WHEN alive = 1 AND pr >= 0.55 THEN tau END) AS tau FROM l GROUP BY k",
)

_POINT = f"WITH {T.BARS}, f AS (SELECT k, t, c AS actual, lag(c) OVER (PARTITION BY k ORDER BY t) AS naive, avg(c) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS forecast FROM bars)"


def _points(spark, d):
    from tidewright.operators.bars import in_time, trailing

    b = T.hourly(spark, d)
    return b.select("k", "t", F.col("c").alias("actual"), F.lag("c").over(in_time()).alias("naive"), F.avg("c").over(trailing(5, 1)).alias("forecast"))


def point_forecast_scores(spark, d):
    return rounded(E.regression_scores(_points(spark, d), "forecast", "actual", "naive"))


add(
    "point_forecast_scores",
    point_forecast_scores,
    f"{_POINT}, e AS (SELECT k, forecast - actual AS e, naive - actual AS b FROM f WHERE forecast IS NOT NULL AND naive IS NOT NULL) SELECT k, count(*) AS n, {r('avg(abs(e))')} AS mae, {r('sqrt(avg(e * e))')} AS rmse, {r('avg(abs(e)) / nullif(avg(abs(b)), 0)')} AS mase, {r('avg(e * e) / nullif(avg(b * b), 0)')} AS msse FROM e GROUP BY k",
)


def interval_forecast_scores(spark, d):
    x = _points(spark, d).withColumn("low", F.col("forecast") * 0.5).withColumn("high", F.col("forecast") * 1.7)
    return rounded(E.interval_scores(x, "actual", "low", "high"))


add(
    "interval_forecast_scores",
    interval_forecast_scores,
    f"{_POINT}, i AS (SELECT k, actual AS x, forecast * 0.5 AS lo, forecast * 1.7 AS hi FROM f WHERE forecast IS NOT NULL) SELECT k, {r('avg(CASE WHEN x >= lo THEN 0.1 * (x - lo) ELSE 0.9 * (lo - x) END)')} AS pinball_low, {r('avg(CASE WHEN x >= hi THEN 0.9 * (x - hi) ELSE (1 - 0.9) * (hi - x) END)')} AS pinball_high, {r('avg(hi - lo)')} AS sharpness, {r('avg((x BETWEEN lo AND hi)::INTEGER)')} AS coverage FROM i GROUP BY k",
)


def directional_test(spark, d):
    return rounded(E.pesaran_timmermann(T.windows(spark, d)))


add(
    "directional_test",
    directional_test,
    f"{_W}, a AS (SELECT k, count(*)::DOUBLE AS n, avg(((p >= 0.5)::INTEGER = y)::INTEGER) AS hit, avg((p >= 0.5)::INTEGER) AS px, avg(y) AS py FROM windows GROUP BY k), b AS (SELECT *, py * px + (1 - py) * (1 - px) AS s FROM a), "
    "v AS (SELECT *, s * (1 - s) / n AS v, ((2 * py - 1) ** 2 * px * (1 - px) + (2 * px - 1) ** 2 * py * (1 - py)) / n + 4 * py * px * (1 - py) * (1 - px) / (n * n) AS w FROM b) "
    f"SELECT k, {r('CASE WHEN n >= 20 AND v - w > 0 THEN (hit - s) / sqrt(greatest(v - w, 1e-300)) END')} AS z FROM v",
)


def loss_difference_test(spark, d):
    x = T.windows(spark, d).withColumn("la", F.pow(F.col("p") - F.col("y"), F.lit(2.0))).withColumn("lb", F.pow(F.col("market") - F.col("y"), F.lit(2.0)))
    return rounded(E.diebold_mariano(x, "la", "lb", 3))


add(
    "loss_difference_test",
    loss_difference_test,
    f"{_W}, d AS (SELECT k, t, (p - y) ** 2 - (market - y) ** 2 AS d FROM windows), e AS (SELECT k, t, d, d - avg(d) OVER (PARTITION BY k) AS e FROM d), l AS (SELECT *, e * lag(e, 1) OVER w AS p1, e * lag(e, 2) OVER w AS p2, e * lag(e, 3) OVER w AS p3 FROM e WINDOW w AS (PARTITION BY k ORDER BY t)), "
    "s AS (SELECT k, count(*) AS n, avg(d) AS mean, sum(e * e) / count(*) + 2 * 0.75 * coalesce(sum(p1), 0) / count(*) + 2 * 0.5 * coalesce(sum(p2), 0) / count(*) + 2 * 0.25 * coalesce(sum(p3), 0) / count(*) AS v FROM l GROUP BY k) "
    f"SELECT k, n, {r('mean')} AS mean, {r('CASE WHEN v > 0 THEN mean / sqrt(greatest(v, 1e-300) / n) END')} AS dm FROM s",
)


def win_rate_interval(spark, d):
    x = T.windows(spark, d).groupBy("k").agg(F.sum("y").alias("hits"), F.count("*").alias("n"))
    low, high = E.wilson(F.col("hits"), F.col("n"))
    return rounded(x.select("k", "hits", "n", low.alias("low"), high.alias("high")))


add(
    "win_rate_interval",
    win_rate_interval,
    f"{_W}, a AS (SELECT k, sum(y)::BIGINT AS hits, count(*) AS n, avg(y) AS s FROM windows GROUP BY k) SELECT k, hits, n, {r('(s + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((s * (1 - s) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n)')} AS low, {r('(s + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((s * (1 - s) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n)')} AS high FROM a",
)


def paired_difference(spark, d):
    x = T.windows(spark, d).withColumn("d", F.col("p") - F.col("market"))
    return rounded(E.mean_with_error(x, "d").drop("p_positive"))


add("paired_difference", paired_difference, f"{_W}, a AS (SELECT k, count(*) AS n, avg(p - market) AS m, stddev_samp(p - market) / sqrt(count(*)) AS se FROM windows GROUP BY k) SELECT k, n, {r('m')} AS mean, {r('se')} AS se, {r('2.8 * se')} AS mde FROM a")


def bootstrap_spread(spark, d):
    """Percentiles of resampled means; a hash draws, which SQL elsewhere can't repeat."""
    x = T.trades(spark, d).withColumn("id", F.xxhash64("id", "line", "part", "supp"))
    return E.bootstrap_means(x, "pnl", 200).groupBy("k").agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), F.avg((F.col("mean") > 0).cast("double")).alias("p_positive"))


add("bootstrap_spread", bootstrap_spread)


def tick_distribution(spark, d):
    return rounded(E.distribution(T.ticks(spark, d), "px", "k"))


add("tick_distribution", tick_distribution, f"WITH {T.TICKS} SELECT k, count(px) AS n, {r('avg(px)')} AS mean, {r('quantile_cont(px, 0.5)')} AS median, {r('quantile_cont(px, 0.1)')} AS p10, {r('quantile_cont(px, 0.9)')} AS p90 FROM ticks GROUP BY k")


def blend_weight(spark, d):
    return rounded(E.shrink_weight(T.windows(spark, d)))


add(
    "blend_weight",
    blend_weight,
    f"{_W}, l AS (SELECT * FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC) <= 100), s AS (SELECT k, count(*) AS n, sum((p - market) * (y - market)) / nullif(sum((p - market) * (p - market)), 0) AS w FROM l GROUP BY k) SELECT k, n, {r('CASE WHEN n < 20 OR w IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, w)) END')} AS weight FROM s",
)

THRESHOLDS = [0.0, 20_000.0, 40_000.0, 60_000.0, 80_000.0]
_SWEEP = (
    f"WITH {T.TRADES}, s AS (SELECT k, threshold, t, id, line, part, supp, pnl FROM trades, (VALUES (0.0::DOUBLE), (20000.0), (40000.0), (60000.0), (80000.0)) v(threshold) WHERE threshold <= 0 OR entry >= threshold), "
    "c AS (SELECT *, sum(pnl) OVER (PARTITION BY k, threshold ORDER BY t, id, line, part, supp ROWS UNBOUNDED PRECEDING) AS c FROM s), q AS (SELECT *, greatest(0.0, max(c) OVER (PARTITION BY k, threshold ORDER BY t, id, line, part, supp ROWS UNBOUNDED PRECEDING)) AS pk FROM c), "
    "sw AS (SELECT k, threshold, count(*) AS n, avg((pnl > 0)::INTEGER) AS win_rate, sum(pnl) AS total, max(pk - c) AS drawdown FROM q GROUP BY 1, 2)"
)


def threshold_sweep(spark, d):
    return rounded(E.threshold_sweep(T.trades(spark, d), "entry", THRESHOLDS, "id", "line", "part", "supp"))


add("threshold_sweep", threshold_sweep, f"{_SWEEP} SELECT k, threshold, n, {r('win_rate')} AS win_rate, {r('total')} AS total, {r('drawdown')} AS drawdown FROM sw")


def best_threshold(spark, d):
    return E.best_threshold(E.threshold_sweep(T.trades(spark, d), "entry", THRESHOLDS, "id", "line", "part", "supp"), 40_000.0)


add(
    "best_threshold",
    best_threshold,
    f"{_SWEEP}, n AS (SELECT k, drawdown AS d0 FROM sw WHERE threshold = 40000) SELECT sw.k, first(threshold ORDER BY total DESC, threshold) AS best FROM sw JOIN n ON sw.k = n.k WHERE drawdown <= 1.5 * d0 GROUP BY sw.k",
)


def decision_frontier(spark, d):
    return rounded(E.frontier(T.windows(spark, d), TAUS, 0.45))


add(
    "decision_frontier",
    decision_frontier,
    f"{_W}, f AS (SELECT k, theta, sum((p >= theta AND y = 1)::INTEGER)::DOUBLE / nullif(sum((y = 1)::INTEGER), 0) AS re, sum((p >= theta AND y = 0)::INTEGER)::DOUBLE / nullif(sum((p >= theta)::INTEGER), 0) AS bad FROM windows, (VALUES {_TAUS}) v(theta) GROUP BY 1, 2) SELECT k, theta, {r('re')} AS recall, {r('bad')} AS bad, coalesce(bad <= 0.45, false) AS feasible FROM f",
)


def edge_monotonicity(spark, d):
    return rounded(E.monotone_buckets(T.windows(spark, d), F.round(F.col("p") - F.col("market"), 6)))


add(
    "edge_monotonicity",
    edge_monotonicity,
    f"{_W}, e AS (SELECT k, t, y, round(p - market, 6) + 0.0 AS edge FROM windows), i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY edge, t) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM e) SELECT k, ((i + 1) * 5 - 1) // n AS slice, count(*) AS n, {r('avg(edge)')} AS edge, {r('avg(y)')} AS outcome FROM i GROUP BY 1, 2",
)


def model_trend(spark, d):
    x = T.windows(spark, d).withColumn("loss", F.pow(F.col("p") - F.col("y"), F.lit(2.0)))
    return rounded(E.trend_state(x, "loss"))


add(
    "model_trend",
    model_trend,
    f"{_W}, a AS (SELECT k, (p - y) ** 2 AS loss, row_number() OVER (PARTITION BY k ORDER BY t DESC) AS i FROM windows), s AS (SELECT k, count(*) AS n, avg(CASE WHEN i <= 25 THEN loss END) AS recent, avg(CASE WHEN i > 25 AND i <= 100 THEN loss END) AS prior FROM a GROUP BY k) "
    f"SELECT k, n, {r('recent')} AS recent, {r('prior')} AS prior, CASE WHEN n < 50 THEN 'UNKNOWN' WHEN recent - prior < -0.01 THEN 'IMPROVING' WHEN recent - prior > 0.01 THEN 'WORSENING' ELSE 'FLAT' END AS state FROM s",
)


def effective_sample(spark, d):
    return rounded(E.autocorrelation(T.hourly(spark, d), "v", 10))


_RHO = ", ".join(f"coalesce(sum(p{j}) / nullif(sum(e * e), 0), 0) AS r{j}" for j in range(1, 11))
_RUNS = " + ".join("CASE WHEN " + " AND ".join(f"r{i} > 0" for i in range(1, j + 1)) + f" THEN r{j} ELSE 0 END" for j in range(1, 11))
add(
    "effective_sample",
    effective_sample,
    f"WITH {T.BARS}, e AS (SELECT k, t, v - avg(v) OVER (PARTITION BY k) AS e FROM bars), l AS (SELECT k, e, " + ", ".join(f"e * lag(e, {j}) OVER (PARTITION BY k ORDER BY t) AS p{j}" for j in range(1, 11)) + f" FROM e), s AS (SELECT k, count(*) AS n, {_RHO} FROM l GROUP BY k) SELECT k, n, {r('r1')} AS rho_1, {r(f'n / (1 + 2 * ({_RUNS}))')} AS effective_n FROM s",
)


def robust_slope(spark, d):
    x = T.hourly(spark, d).groupBy("k", F.to_date("t").alias("day")).agg(F.max("h").alias("h")).withColumn("x", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("double"))
    return rounded(E.theil_sen(x, "x", "h"))


add(
    "robust_slope",
    robust_slope,
    f"WITH {T.BARS}, x AS (SELECT k, date_diff('day', DATE '2024-01-01', t::DATE)::DOUBLE AS x, max(h) AS h FROM bars GROUP BY 1, 2) SELECT a.k, {r('median((b.h - a.h) / (b.x - a.x))')} AS slope FROM x a JOIN x b ON a.k = b.k AND a.x < b.x GROUP BY a.k",
)


def partial_correlations(spark, d):
    return rounded(E.partial_correlation(T.hourly(spark, d), "c", "v", "n"))


add(
    "partial_correlations",
    partial_correlations,
    f"WITH {T.BARS}, c AS (SELECT k, count(*) AS n, corr(c, v) AS xy, corr(c, n) AS xc, corr(v, n) AS yc FROM bars GROUP BY k), q AS (SELECT k, n, (xy - xc * yc) / sqrt((1 - xc * xc) * (1 - yc * yc)) AS r FROM c) SELECT k, n, {r('r')} AS r, {r('tanh(atanh(r) - 1.96 / sqrt(n - 4))')} AS low, {r('tanh(atanh(r) + 1.96 / sqrt(n - 4))')} AS high FROM q",
)


def feature_importance(spark, d):
    x = T.windows(spark, d).withColumn("n", F.col("n").cast("double")).withColumn("flat", F.lit(1.0)).withColumn("win", F.col("y").cast("double"))
    return rounded(E.importance(x, ["p", "market", "n", "flat"], "win"))


add(
    "feature_importance",
    feature_importance,
    f"{_W} SELECT 'p' AS feature, {r('corr(p, y)')} AS importance FROM windows UNION ALL SELECT 'market', {r('corr(market, y)')} FROM windows UNION ALL SELECT 'n', {r('corr(n, y)')} FROM windows UNION ALL SELECT 'flat', 0.0::DOUBLE",
)


def arm_agreement(spark, d):
    x = T.windows(spark, d).withColumn("call", (F.col("p") >= 0.5).cast("int"))
    return rounded(E.agreement(x, "k", ["t"], "call"))


add("arm_agreement", arm_agreement, f"{_W} SELECT a.k AS a, b.k AS b, count(*) AS n, {r('avg(((a.p >= 0.5) = (b.p >= 0.5))::INTEGER)')} AS same FROM windows a JOIN windows b ON a.t = b.t AND a.k < b.k GROUP BY 1, 2")


def shuffled_scores(spark, d):
    """Scores of forecasts dealt anew: what chance gives."""
    x = E.permutation_rows(T.windows(spark, d).select("k", "t", "y", "market", "p"), "p", 7)
    return rounded(E.scores(x))


add(
    "shuffled_scores",
    shuffled_scores,
    f"{_W}, a AS (SELECT k, t, y, market, p, row_number() OVER (PARTITION BY k ORDER BY t) AS i, row_number() OVER (PARTITION BY k ORDER BY md5('7' || strftime(t, '%Y-%m-%d %H:%M:%S')), t) AS j FROM windows), s AS (SELECT x.k, count(*) AS n, avg((z.p - x.y) ** 2) AS b, avg((x.market - x.y) ** 2) AS m, -avg(x.y * ln(greatest(1e-6, least(1 - 1e-6, z.p))) + (1 - x.y) * ln(1 - greatest(1e-6, least(1 - 1e-6, z.p)))) AS ll FROM a x JOIN a z ON x.k = z.k AND x.i = z.j GROUP BY x.k) "
    f"SELECT k, n, {r('b')} AS brier, {r('m')} AS market_brier, {r('ll')} AS log_loss, {r('1 - b / nullif(m, 0)')} AS skill FROM s",
)

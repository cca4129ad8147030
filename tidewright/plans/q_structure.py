"""Queries of market structure, decisions, news and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import asof as J
from tidewright.operators import bars as B
from tidewright.operators import folds as X
from tidewright.operators import structure as Z
from tidewright.operators import windows as W
from tidewright.sources import tables as T

from .q_bars import SWINGS, _last, _share
from .q_folds import ATR
from .registry import add
from .shaping import r, rounded

TRENDS = (
    f"ts AS (SELECT b.k, a.s AS hh, z.s AS hl FROM (SELECT DISTINCT k FROM bars) b LEFT JOIN {_share('swing_high', 'h')} a ON a.k = b.k LEFT JOIN {_share('swing_low', 'l')} z ON z.k = b.k), "
    "trends AS (SELECT k, CASE WHEN hh + hl IS NULL THEN 'unknown' WHEN (hh + hl) / 2 >= 0.75 THEN 'uptrend' WHEN (hh + hl) / 2 <= 0.25 THEN 'downtrend' ELSE 'ranging' END AS trend FROM ts)"
)
BREAKS = (
    f"{SWINGS}, {TRENDS}, lv AS (SELECT DISTINCT k, h AS level, 'bullish' AS direction FROM swung WHERE swing_high UNION SELECT DISTINCT k, l, 'bearish' FROM swung WHERE swing_low), lt AS (SELECT lv.*, trend FROM lv JOIN trends USING (k) WHERE CASE trend WHEN 'uptrend' THEN direction = 'bearish' WHEN 'downtrend' THEN direction = 'bullish' ELSE trend = 'ranging' END), "
    "bi AS (SELECT k, t, c FROM bars QUALIFY row_number() OVER (PARTITION BY k ORDER BY t) > 1), broken AS (SELECT lt.k, direction, level, min(t) AS t FROM lt JOIN bi ON bi.k = lt.k AND CASE WHEN direction = 'bullish' THEN c > level ELSE c < level END GROUP BY 1, 2, 3)"
)


def _structure(spark, d):
    swung = W.swings(T.hourly(spark, d))
    trends = W.trend(swung)
    return swung, trends, Z.breaks(swung, trends)


def structure_breaks(spark, d):
    return _structure(spark, d)[2]


add("structure_breaks", structure_breaks, f"WITH {BREAKS} SELECT k, direction, level, t FROM broken")


def character_changes(spark, d):
    _, trends, broken = _structure(spark, d)
    return Z.change_of_character(broken, trends)


add(
    "character_changes",
    character_changes,
    f"WITH {BREAKS}, f AS (SELECT b.*, trend, first_value(direction) OVER (PARTITION BY b.k ORDER BY t, direction, level) AS f FROM broken b JOIN trends USING (k)) SELECT k, t, direction, level FROM f WHERE CASE trend WHEN 'uptrend' THEN direction = 'bearish' WHEN 'downtrend' THEN direction = 'bullish' ELSE direction <> f END QUALIFY row_number() OVER (PARTITION BY k ORDER BY t, direction, level) = 1",
)


def _scored(spark, d):
    b = Z.nearest_below(Z.nearest_above(W.liquidity(W.swings(T.hourly(spark, d)))))
    b = X.statistical_forecast(X.atr_regime(X.wilder_atr(b)))
    swung, trends, broken = _structure(spark, d)
    c = Z.sided_candidates(b).withColumn("spread_estimate", F.when(F.col("v") == 0, 0.0).otherwise(0.1 * (F.col("h") - F.col("l"))))
    c = c.join(trends.withColumn("strength", Z.trend_strength()).select("k", "trend", "strength"), "k")
    up = F.col("direction") == "bullish"
    c = J.as_of(c, broken.select("k", "t", up.cast("long").alias("id"), up.cast("double").alias("up")), "up", prefix="break")
    return Z.trouble_score(c.withColumn("last_break", F.when(F.col("break_value") == 1, "bullish").when(F.col("break_value") == 0, "bearish")))


def trade_candidates(spark, d):
    b = X.statistical_forecast(X.wilder_atr(T.hourly(spark, d)))
    return rounded(Z.candidates(b).select("k", "t", "entry", "stop", "target", "rr"))


_FORECAST = (
    f"fs AS (SELECT k, t, c, list(c) {_last(32)} AS x FROM bars), fy AS (SELECT *, list_transform(range(2, len(x) + 1), lambda i: ln(x[i] / x[i - 1])) AS rt, list_transform(x, lambda v, i: (i - 1 - 15.5) * v) AS xc FROM fs), "
    "fz AS (SELECT k, t, c, CASE WHEN len(x) >= 32 THEN list_sum(list_transform(rt, lambda v, i: v * CASE WHEN i = 1 THEN power(11.0 / 13, len(rt) - 1) ELSE 2.0 / 13 * power(11.0 / 13, len(rt) - i) END)) * 5 ELSE 0 END AS e, CASE WHEN len(x) >= 32 THEN list_sum(xc) / 2728.0 * 5 / c ELSE 0 END AS s FROM fy)"
)
add(
    "trade_candidates",
    trade_candidates,
    f"WITH {T.BARS}, {ATR}, {_FORECAST} SELECT z.k, z.t, {r('c')} AS entry, {r('c - 1.5 * atr')} AS stop, {r('c + 3 * atr')} AS target, {r('(3 * atr) / (1.5 * atr)')} AS rr FROM fz z JOIN atrs a ON a.k = z.k AND a.t = z.t WHERE atr > 0 AND (e + s) / 2 > 0 AND c - 1.5 * atr > 0",
)


def candidate_scores(spark, d):
    """The whole chain from bars to an accepted or refused candidate on either side."""
    x = _scored(spark, d)
    p = Z.probability(F.col("confidence"), F.col("reward_risk"), F.col("strength"), F.col("relative_volume"), F.col("regime"))
    return rounded(x.select("k", "t", "side", "trouble", "distance", "reward_risk", "structure_score", "liquidity_score", "volatility_ok", "cleared", "score", F.concat_ws("|", "reasons").alias("reasons"), "accepted", p.alias("p")))


_Q = lambda q: f"list_aggregate(rx, 'quantile_cont', {q})"
_CHAIN = (
    f"{BREAKS}, {ATR}, {_FORECAST}, rg AS (SELECT k, t, atr, list(atr) FILTER (atr IS NOT NULL) {_last(50)} AS rx FROM atrs), "
    f"rgs AS (SELECT k, t, atr, CASE WHEN rx IS NULL OR len(rx) < 50 OR atr IS NULL THEN 'normal' WHEN atr >= {_Q(0.9)} THEN 'extreme' WHEN atr >= {_Q(0.75)} THEN 'high' WHEN atr <= {_Q(0.25)} THEN 'low' ELSE 'normal' END AS regime FROM rg), "
    f"lq AS (SELECT k, t, h, l, v, v / nullif(avg(v) {_last(20)}, 0) AS rv FROM bars), "
    "ab AS (SELECT k, t, c, list(CASE WHEN swing_high THEN h END) OVER w AS hs, list(CASE WHEN swing_low THEN l END) OVER w AS ls FROM swung WINDOW w AS (PARTITION BY k ORDER BY t ROWS BETWEEN 200 PRECEDING AND 5 PRECEDING)), "
    "fc AS (SELECT z.*, list_sum(list_transform(y.rt, lambda v: v * v)) / len(y.rt) AS m2, list_sum(y.rt) / len(y.rt) AS m1 FROM fz z JOIN fy y ON y.k = z.k AND y.t = z.t WHERE len(y.x) >= 32), "
    "cf AS (SELECT k, t, c, (e + s) / 2 AS expected, greatest(0.05, least(0.95, coalesce(abs((e + s) / 2) / nullif(sqrt(greatest(m2 - m1 * m1, 0)) * sqrt(5), 0), 0))) * CASE WHEN sign(e) * sign(s) < 0 THEN 0.6 ELSE 1 END AS confidence FROM fc), "
    "cd AS (SELECT cf.*, atr, regime, rv, CASE WHEN v = 0 THEN 0 ELSE 0.1 * (h - l) END AS spread, CASE WHEN expected > 0 THEN 1.0 ELSE -1.0 END AS sg, list_min(list_filter(hs, lambda x: x > cf.c)) AS above, list_max(list_filter(ls, lambda x: x < cf.c)) AS below FROM cf JOIN rgs USING (k, t) JOIN lq USING (k, t) JOIN ab ON ab.k = cf.k AND ab.t = cf.t WHERE atr > 0 AND expected <> 0 AND cf.c - CASE WHEN expected > 0 THEN 1.5 ELSE -1.5 END * atr > 0), "
    "tr AS (SELECT ts.k, trend, CASE trend WHEN 'uptrend' THEN (hh + hl) / 2 WHEN 'downtrend' THEN 1 - (hh + hl) / 2 WHEN 'ranging' THEN greatest((hh + hl) / 2, 1 - (hh + hl) / 2) ELSE 0 END AS strength FROM ts JOIN trends USING (k)), "
    "lb AS (SELECT cd.k, cd.t, arg_max(direction, (b.t, direction)) AS last FROM cd JOIN broken b ON b.k = cd.k AND b.t <= cd.t GROUP BY 1, 2), "
    "c1 AS (SELECT cd.*, trend, strength, last, CASE WHEN sg > 0 THEN coalesce(above, c * 1.1) ELSE coalesce(below, c * 0.9) END AS trouble FROM cd JOIN tr USING (k) LEFT JOIN lb ON lb.k = cd.k AND lb.t = cd.t), "
    "c2 AS (SELECT *, sg * (trouble - c) / c AS distance, greatest(c * abs(expected), 0.8 * sg * (trouble - c)) / (1.5 * atr) AS rr, greatest(0, least(1, 0.5 * CASE WHEN trend = CASE WHEN sg > 0 THEN 'uptrend' ELSE 'downtrend' END THEN 1.0 WHEN trend = 'ranging' THEN 0.4 WHEN trend = 'unknown' THEN 0.2 ELSE 0.1 END + 0.3 * strength + 0.2 * CASE WHEN last IS NULL THEN 0 WHEN (last = 'bullish') = (sg > 0) THEN 0.2 ELSE -0.2 END)) AS structure, "
    "least(coalesce(rv, 0) / 2, 1) * CASE WHEN spread > 0 AND spread > 0.05 * atr THEN 0.7 ELSE 1 END AS liquid, regime IN ('low', 'normal') AND atr / c <= 0.05 AS calm, sg * (c * (1 + expected) - trouble) / c > 0.005 AS cleared FROM c1)"
)
_WHY = [f"CASE WHEN {c} THEN '{n}' END" for c, n in zip(("rr < 2", "NOT cleared", "structure < 0.35", "liquid < 0.25", "NOT calm", "distance < 0.005"), Z.REFUSALS, strict=True)]
add(
    "candidate_scores",
    candidate_scores,
    f"WITH {_CHAIN} SELECT k, t, CASE WHEN sg > 0 THEN 'long' ELSE 'short' END AS side, {r('trouble')} AS trouble, {r('distance')} AS distance, {r('rr')} AS reward_risk, {r('structure')} AS structure_score, {r('liquid')} AS liquidity_score, calm AS volatility_ok, cleared, "
    f"{r('0.35 * least(rr / 4, 1) + 0.25 * cleared::INTEGER + 0.2 * structure + 0.15 * liquid + 0.05 * calm::INTEGER')} AS score, concat_ws('|', {', '.join(_WHY)}) AS reasons, NOT (rr < 2 OR NOT cleared OR structure < 0.35 OR liquid < 0.25 OR NOT calm OR distance < 0.005) AS accepted, "
    f"{r(chr(10).join(['greatest(0, least(1, 0.35 * confidence + 0.25 * least(rr / 4, 1) + 0.2 * strength + 0.1 * least(rv / 2, 1) + 0.1 * (1 - CASE regime', *[f'WHEN {chr(39)}{n}{chr(39)} THEN {v}' for n, v in (('low', '0.0'), ('high', '2.0'), ('extreme', '3.0'))], 'ELSE 1.0 END / 3)))']))} AS p FROM c2",
)


def document_events(spark, d):
    x = T.table(spark, d, "documents")
    return x.groupBy("source", Z.event_type(F.col("text")).alias("event")).agg(F.count("*").alias("n"))


_CASE = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in Z.EVENT_WORDS)
add("document_events", document_events, f"SELECT source, CASE {_CASE} ELSE 'none' END AS event, count(*) AS n FROM documents GROUP BY 1, 2")


def news_feature_rollup(spark, d):
    """Ticks as articles, their price as sentiment, as of a fixed time."""
    x = T.ticks(spark, d).withColumn("sentiment", F.round(F.col("px") / 100 - 0.5, 6))
    return rounded(Z.news_features(x, F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")))


_AGE = "date_diff('second', date_trunc('second', t), TIMESTAMP '2024-01-20 12:00:00')"
add(
    "news_feature_rollup",
    news_feature_rollup,
    f"WITH {T.TICKS}, a AS (SELECT k, round(px / 100 - 0.5, 6) AS s, {_AGE} AS age FROM ticks), g AS (SELECT k, sum((age <= 3600)::INTEGER)::BIGINT AS n_1h, sum((age <= 86400)::INTEGER)::BIGINT AS n_24h, avg(s) FILTER (age <= 86400) AS m, stddev_pop(s) FILTER (age <= 86400) AS sd, max(s) FILTER (age <= 86400) AS hi, min(s) FILTER (age <= 86400) AS lo, min(age) AS la FROM a WHERE age >= 0 GROUP BY k) "
    f"SELECT k, n_1h, n_24h, {r('m')} AS mean, {r('sd')} AS spread, {r('greatest(hi - m, m - lo)')} AS surprise, {r('coalesce(la / 60, 9999.0)')} AS minutes_since FROM g",
)


def time_splits(spark, d):
    x = Z.splits(T.hourly(spark, d))
    return x.groupBy("k", "part").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


add(
    "time_splits",
    time_splits,
    f"WITH {T.BARS}, i AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM bars) SELECT k, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validate' ELSE 'test' END AS part, count(*) AS n, min(t) AS first_t FROM i GROUP BY 1, 2",
)


def walk_forward_folds(spark, d):
    return Z.walk_forward(T.hourly(spark, d), 4).groupBy("k", "fold", "part").agg(F.count("*").alias("n"), F.max("t").alias("last_t"))


add(
    "walk_forward_folds",
    walk_forward_folds,
    f"WITH {T.BARS}, i AS (SELECT k, t, ((row_number() OVER (PARTITION BY k ORDER BY t) - 1) * 5) // count(*) OVER (PARTITION BY k) AS s FROM bars) SELECT k, fold::INTEGER AS fold, CASE WHEN s < fold THEN 'train' ELSE 'test' END AS part, count(*) AS n, max(t) AS last_t FROM i, range(1, 5) g(fold) WHERE s <= fold GROUP BY 1, 2, 3",
)


def _predictions(spark, d):
    b = T.hourly(spark, d)
    return Z.settle(b.select("k", "t", F.col("o").alias("pred"), (F.col("h") - F.col("l") + 5).alias("band")), b, "2 hours")


def settled_predictions(spark, d):
    return rounded(_predictions(spark, d))


_SETTLED = "st AS (SELECT a.k, a.t, a.o AS pred, a.h - a.l + 5 AS band, b.c AS actual, a.o - b.c AS err FROM bars a LEFT JOIN bars b ON a.k = b.k AND b.t = a.t + INTERVAL 2 HOURS)"
add("settled_predictions", settled_predictions, f"WITH {T.BARS}, {_SETTLED} SELECT k, t, {r('pred')} AS pred, {r('band')} AS band, {r('actual')} AS actual, {r('err')} AS err, {r('abs(err)')} AS abs_err, (abs(err) <= band)::INTEGER AS hit FROM st")


def conformal_bands(spark, d):
    x = _predictions(spark, d).where("err is not null")
    return rounded(Z.conformal_band(x).select("k", "t", "lo", "hi"))


add(
    "conformal_bands",
    conformal_bands,
    f"WITH {T.BARS}, {_SETTLED}, x AS (SELECT k, t, list_sort(list(err) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)) AS x FROM st WHERE err IS NOT NULL) SELECT k, t, {r('CASE WHEN len(x) >= 20 THEN x[(floor(0.1::DOUBLE * len(x)) + 1)::INTEGER] END')} AS lo, {r('CASE WHEN len(x) >= 20 THEN x[(floor(0.9::DOUBLE * len(x)) + 1)::INTEGER] END')} AS hi FROM x",
)


def leaders(spark, d):
    """The event type that leads each weekday: an arm by the wins of its last windows."""
    x = T.windows(spark, d).withColumn("arm", F.col("k")).withColumn("k", F.weekday("t").cast("string")).withColumn("loss", F.round(F.pow(F.col("p") - F.col("y"), F.lit(2.0)), 8))
    return Z.leader(x, "arm", "y", "loss")


add(
    "leaders",
    leaders,
    f"WITH {T.WINDOWS}, x AS (SELECT k AS arm, (isodow(t) - 1)::VARCHAR AS k, t, y, round((p - y) ** 2, 8) AS loss FROM windows), l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY k, arm ORDER BY t DESC) <= 10), g AS (SELECT k, arm, avg(y) AS rate, avg(loss) AS loss FROM l GROUP BY 1, 2 HAVING count(*) >= 5) SELECT k, arm AS leader FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY rate DESC, loss, arm DESC) = 1",
)

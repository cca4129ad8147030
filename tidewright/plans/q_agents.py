"""Queries of calibration, episodes, action values and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import agents as A
from tidewright.operators import bars as B
from tidewright.operators import calibrate as C
from tidewright.operators import supervised as S
from tidewright.sources import tables as T

from .registry import add
from .shaping import r, rounded


def calibration_coefficients(spark, d):
    """Do the forecasts of each key lean, and are they too timid or too bold?"""
    return rounded(C.calibration_fit(T.windows(spark, d).select("k", "p", "y")), 5)


_POINTS = "pts AS (SELECT k, ln(p / (1 - p)) AS x, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM windows GROUP BY 1, 2)"
_MU = "(1 / (1 + exp(-greatest(-30, least(30, f.a + f.b * x)))))"
add(
    "calibration_coefficients",
    calibration_coefficients,
    f"WITH RECURSIVE {T.WINDOWS}, {_POINTS}, fit AS (SELECT k, 0 AS i, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, false AS done, 0 AS steps FROM (SELECT DISTINCT k FROM pts) UNION ALL "
    "SELECT k, i + 1, a + CASE WHEN ok THEN (ga * hbb - gb * hab) / det ELSE 0 END, b + CASE WHEN ok THEN (gb * haa - ga * hab) / det ELSE 0 END, NOT ok OR abs((ga * hbb - gb * hab) / det) + abs((gb * haa - ga * hab) / det) < 1e-8, steps + ok::INTEGER FROM ("
    f"SELECT f.k, f.i, f.a, f.b, f.steps, sum(s - n * {_MU}) AS ga, sum((s - n * {_MU}) * x) AS gb, sum(n * greatest({_MU} * (1 - {_MU}), 1e-9)) AS haa, sum(n * greatest({_MU} * (1 - {_MU}), 1e-9) * x) AS hab, sum(n * greatest({_MU} * (1 - {_MU}), 1e-9) * x * x) AS hbb, haa * hbb - hab * hab AS det, abs(haa * hbb - hab * hab) >= 1e-12 AS ok "
    "FROM fit f JOIN pts ON pts.k = f.k WHERE NOT f.done AND f.i < 25 GROUP BY 1, 2, 3, 4, 5)) "
    f"SELECT k, {r('a', 5)} AS intercept, {r('b', 5)} AS slope, (SELECT sum(n)::BIGINT FROM pts WHERE pts.k = fit.k) AS n, steps FROM fit QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1",
)

_HORIZONS = {"15m": "15 minutes", "1h": "1 hour"}


def _episodes(spark, d):
    return A.episodes(B.resample(T.ticks(spark, d), "15 minutes"), _HORIZONS, 4, ("18:00", "19:15"), "America/Los_Angeles")


def episode_rows(spark, d):
    return _episodes(spark, d).withColumn("day", F.col("day").cast("string"))


_O, _L = "OVER (PARTITION BY k, t::DATE ORDER BY t)", lambda n: f"OVER (PARTITION BY k, t::DATE ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_EP = (
    f"{T.TICKS}, {T.bars_sql('quarters', '15 minutes')}, s AS (SELECT *, row_number() {_O} AS i, coalesce(c / nullif(lag(c) {_O}, 0) - 1, 0) AS ret, coalesce(c / nullif(lag(c, 5) {_O}, 0) - 1, 0) AS ret5 FROM quarters), "
    f"f AS (SELECT k, t, c, i, ret5, coalesce((c - min(l) {_L(60)}) / nullif(max(h) {_L(60)} - min(l) {_L(60)}, 0), 0.5) AS pos, coalesce(stddev_pop(ret) {_L(30)}, 0) AS vol, coalesce(avg(v) {_L(5)} / nullif(avg(v) {_L(60)}, 0), 1) AS vr FROM s), "
    "g AS (SELECT k, t, c, concat(CASE WHEN ret5 < -0.05 THEN 0 WHEN ret5 > 0.05 THEN 2 ELSE 1 END, CASE WHEN pos < 0.33 THEN 0 WHEN pos > 0.67 THEN 2 ELSE 1 END, CASE WHEN vol < 0.5 THEN 0 WHEN vol > 1.5 THEN 2 ELSE 1 END, CASE WHEN vr < 0.8 THEN 0 WHEN vr > 1.2 THEN 2 ELSE 1 END) AS state FROM f WHERE i > 4), "
    "e AS (SELECT g.k, g.t::DATE AS day, g.t, h.n AS horizon, state, g.c AS price_now, q.c AS price_future, strftime(timezone('America/Los_Angeles', timezone('UTC', q.t)), '%H:%M') IN ('18:00', '19:15') AS target_slot FROM g, (VALUES ('15m', INTERVAL 15 MINUTES), ('1h', INTERVAL 1 HOUR)) h(n, w) JOIN quarters q ON q.k = g.k AND q.t = g.t + h.w AND q.t::DATE = g.t::DATE)"
)
add("episode_rows", episode_rows, f"WITH {_EP} SELECT * REPLACE (day::VARCHAR AS day) FROM e")


def _logged(spark, d):
    """Episodes with an action by rule and its reward: a guess 8 lower, at, or 8 above the price."""
    e = _episodes(spark, d)
    minute = F.timestamp_diff("MINUTE", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("t"))
    e = e.withColumn("id", minute).withColumn("action", (F.floor(minute / 15) * 7 % 3).cast("int"))
    return e.withColumn("r", A.prediction_reward(F.col("price_now") + 8 * (F.col("action") - 1), F.col("price_future"), F.lit(5.0)))


_LOG = f"{_EP}, a AS (SELECT *, date_diff('minute', TIMESTAMP '2024-01-01', t) AS id, ((date_diff('minute', TIMESTAMP '2024-01-01', t) // 15) * 7 % 3)::INTEGER AS action FROM e), lg AS (SELECT *, abs(price_now + 8 * (action - 1) - price_future) / 5.0 AS u, CASE WHEN u <= 1 THEN 1.0 ELSE greatest(-1.0, 2 - u) END AS r FROM a)"


def tabular_q_values(spark, d):
    return rounded(A.tabular_q(_logged(spark, d).where("horizon = '1h'"), by="week"))


add("tabular_q_values", tabular_q_values, f"WITH {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY k, state, action ORDER BY t DESC, id DESC) - 1 AS after FROM lg WHERE horizon = '1h') SELECT k, state, action, {r('sum(0.1 * power(0.9, after) * r)')} AS q, count(*) AS n FROM o GROUP BY 1, 2, 3")


def linear_q_weights(spark, d):
    x = _logged(spark, d).where("horizon = '15m'").withColumn("one", F.lit(1.0)).withColumn("level", F.col("price_now") / 100)
    return rounded(A.linear_q(x.withColumnRenamed("action", "arm"), ["one", "level"], 0.05, "week").select("k", "arm", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"), "pulls"))


add(
    "linear_q_weights",
    linear_q_weights,
    f"WITH RECURSIVE {_LOG}, o AS (SELECT k, action AS arm, price_now / 100 AS x, r, row_number() OVER (PARTITION BY k, action ORDER BY t, id) AS i FROM lg WHERE horizon = '15m'), lq AS (SELECT k, arm, 0::BIGINT AS i, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1 FROM (SELECT DISTINCT k, arm FROM o) UNION ALL "
    f"SELECT o.k, o.arm, o.i, w0 + 0.05 * (r - w0 - w1 * x), w1 + 0.05 * (r - w0 - w1 * x) * x FROM lq JOIN o ON o.k = lq.k AND o.arm = lq.arm AND o.i = lq.i + 1) SELECT k, arm, {r('w0')} AS w0, {r('w1')} AS w1, i AS pulls FROM lq QUALIFY i = max(i) OVER (PARTITION BY k, arm)",
)


def binary_logit_chances(spark, d):
    x = T.windows(spark, d).withColumn("id", F.lit(0).cast("long")).withColumn("one", F.lit(1.0)).withColumn("edge", F.col("p") - F.col("market"))
    return rounded(A.binary_logit(x, ["one", "edge"]).select("k", "t", "y", "p"))


add(
    "binary_logit_chances",
    binary_logit_chances,
    f"WITH RECURSIVE {T.WINDOWS}, o AS (SELECT k, t, y, p - market AS x, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM windows), f AS (SELECT k, 0::BIGINT AS i, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, NULL::TIMESTAMP AS t, NULL::INTEGER AS y, NULL::DOUBLE AS p FROM (SELECT DISTINCT k FROM o) UNION ALL "
    "SELECT k, i, w0 - rate * ((p - y) + 1e-4 * w0), w1 - rate * ((p - y) * x + 1e-4 * w1), t, y, p FROM (SELECT o.*, w0, w1, 1 / (1 + exp(-greatest(-30, least(30, w0 + w1 * x)))) AS p, 0.05 / (1 + f.i / 400.0) AS rate FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)) "
    f"SELECT k, t, y, {r('p')} AS p FROM f WHERE i > 0",
)


def _decisions(spark, d):
    """Windows as bets, as calls and as third forecasts."""
    w = T.windows(spark, d).withColumn("ticker", F.concat_ws("-", "k", F.date_format("t", "yyyyMMddHHmm"))).withColumn("close_t", F.col("t") + F.expr("interval 15 minutes"))
    w = w.withColumn("mins_left", F.col("n") % 15 + 0.5).withColumn("path", F.when(F.col("n") > 1, F.array(F.col("p") - 0.5, F.lit(0.25), F.col("market"), F.lit(0.1))))
    side = F.when(F.col("p") >= 0.5, "yes").otherwise("no")
    bets = w.where("n % 2 = 0").select("ticker", "t", "close_t", side.alias("side"), (100 * F.col("market")).alias("price"), "p", "mins_left", (F.col("n") % 4 == 0).alias("forced"), (F.col("y") == (F.col("p") >= 0.5).cast("int")).alias("win"), "path")
    call = (F.col("p") >= 0.5).cast("int")
    calls = w.select("ticker", "t", "close_t", "p", call.alias("call"), (call == F.col("y")).cast("int").alias("hit"), F.when(F.col("n") % 5 != 0, F.col("market")).alias("market"), "mins_left", "path")
    thirds = w.where("n % 3 <> 0").select("ticker", "t", (F.col("mins_left") + 0.25).alias("mins_left"), (1 - F.col("market")).alias("p"))
    return bets, calls, thirds


def supervised_rows(spark, d):
    """Bets and what might have been bet, parted by a cut with an embargo of two hours."""
    out = S.embargoed(S.supervised_set(*_decisions(spark, d)), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), "2 hours")
    return rounded(out.select("ticker", "t", "label_t", *(F.col("x")[i].alias(f"x{i}") for i in range(15)), "y", "weight", "price", "real", "part"), 8)


_W = f"{T.WINDOWS}, w AS (SELECT *, concat_ws('-', k, strftime(t, '%Y%m%d%H%M')) AS ticker, t + INTERVAL 15 MINUTES AS close_t, n % 15 + 0.5 AS m, p >= 0.5 AS up FROM windows)"
_ROWS = (
    f"{_W}, u AS (SELECT ticker, t, close_t, up, 100 * market AS price, p, m, n % 4 = 0 AS forced, (y = up::INTEGER)::INTEGER AS y, 3.0 AS weight, true AS real, n, market FROM w WHERE n % 2 = 0 UNION ALL SELECT * FROM (SELECT ticker, t, close_t, up, 100 * CASE WHEN up THEN market ELSE 1 - market END + 2.5 AS price, p, m, false, (y = up::INTEGER)::INTEGER, 1.0, false, n, market FROM w WHERE n % 5 <> 0) WHERE price BETWEEN 1 AND 99), "
    "h AS (SELECT ticker, round_even(m + 0.25, 0) AS m, 1 - market AS p FROM w WHERE n % 3 <> 0), j AS (SELECT u.*, CASE WHEN up THEN u.p ELSE 1 - u.p END AS ps, CASE WHEN up THEN h.p ELSE 1 - h.p END - 0.5 AS o, CASE WHEN up THEN 1.0 ELSE -1.0 END AS sg FROM u LEFT JOIN h ON h.ticker = u.ticker AND h.m = round_even(u.m, 0))"
)
_XS = ["1.0", "ps", "price / 100", "(100 * ps - price) / 100", "least(greatest(m, 0), 15) / 15", "forced::INTEGER::DOUBLE", "up::INTEGER::DOUBLE", "coalesce(o, 0)", "coalesce(2 * abs(o), 0)", "(o IS NOT NULL)::INTEGER::DOUBLE", "CASE WHEN n > 1 THEN sg * (p - 0.5) ELSE 0 END", "CASE WHEN n > 1 THEN 0.25 ELSE 0 END", "CASE WHEN n > 1 THEN sg * market / 4 ELSE 0 END", "CASE WHEN n > 1 THEN sg * 0.5 ELSE 0 END", "(n > 1)::INTEGER::DOUBLE"]
add(
    "supervised_rows",
    supervised_rows,
    f"WITH {_ROWS} SELECT ticker, t, close_t AS label_t, " + ", ".join(f"round(({x})::DOUBLE, 8) AS x{i}" for i, x in enumerate(_XS)) + f", y, weight::DOUBLE AS weight, {r('price', 8)} AS price, real, CASE WHEN t >= TIMESTAMP '2024-01-20' THEN 'test' WHEN close_t <= TIMESTAMP '2024-01-20' - INTERVAL 2 HOURS THEN 'train' END AS part FROM j",
)


def journal_rows(spark, d):
    """Trades with features in a map, some without."""
    x = T.trades(spark, d).withColumn("features", F.when(F.col("line") == 1, F.create_map().cast("map<string,double>")).when(F.col("line") != 2, F.create_map(F.lit("qty"), F.col("qty").cast("double"), F.lit("part"), F.col("part").cast("double"))))
    out = S.journal_set(x, ["qty", "missing", "part"])
    return out.select("id", "line", *(F.col("x")[i].alias(f"x{i}") for i in range(3)), "y")


add("journal_rows", journal_rows, f"WITH {T.TRADES} SELECT id, line, qty::DOUBLE AS x0, 0.0::DOUBLE AS x1, part::DOUBLE AS x2, (pnl > 0)::INTEGER AS y FROM trades WHERE line > 2")

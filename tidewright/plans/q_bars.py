"""Queries on bars, windows and joins in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import scalar as S
from tidewright.operators import asof as J
from tidewright.operators import bars as B
from tidewright.operators import windows as W
from tidewright.sources import tables as T

from .registry import add
from .shaping import r, rounded

_OVER = "OVER (PARTITION BY k ORDER BY t)"


def _last(n: int, skip: int = 0) -> str:
    return f"OVER (PARTITION BY k ORDER BY t ROWS BETWEEN {n - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"


def bars_hourly(spark, d):
    return rounded(T.hourly(spark, d))


add("bars_hourly", bars_hourly, f"WITH {T.BARS} SELECT k, t, {r('o')} AS o, {r('h')} AS h, {r('l')} AS l, {r('c')} AS c, {r('v')} AS v, n FROM bars")


def bars_4h_from_1h(spark, d):
    return rounded(B.coarser(T.hourly(spark, d), "4 hours"))


add(
    "bars_4h_from_1h",
    bars_4h_from_1h,
    f"WITH {T.BARS}, b AS (SELECT k, time_bucket(INTERVAL '4 hours', ts) AS t, first(o ORDER BY ts) AS o, max(h) AS h, min(l) AS l, last(c ORDER BY ts) AS c, sum(v) AS v, count(*) AS n FROM (SELECT k, t AS ts, o, h, l, c, v FROM bars) GROUP BY 1, 2) "
    "SELECT k, t, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, round(v, 6) AS v, n FROM b QUALIFY t < max(t) OVER (PARTITION BY k)",
)


def bars_4h_native_or_derived(spark, d):
    """Keys before 'f' have native 4-hour bars; others get theirs from hourly ones."""
    native = B.resample(T.ticks(spark, d).where("k < 'f'"), "4 hours")
    return rounded(B.native_or(native, B.coarser(T.hourly(spark, d), "4 hours")).select("k", "t", "o", "c"))


add(
    "bars_4h_native_or_derived",
    bars_4h_native_or_derived,
    f"WITH {T.BARS}, {T.bars_sql('native', '4 hours')}, b AS (SELECT k, time_bucket(INTERVAL '4 hours', ts) AS t, first(o ORDER BY ts) AS o, last(c ORDER BY ts) AS c FROM (SELECT k, t AS ts, o, c FROM bars) GROUP BY 1, 2), "
    "derived AS (SELECT * FROM b QUALIFY t < max(t) OVER (PARTITION BY k)) SELECT k, t, o, c FROM native WHERE k < 'f' UNION ALL SELECT k, t, o, c FROM derived WHERE k >= 'f'",
)


def bars_valid_clamped(spark, d):
    """Bars with open and close knocked out of range, clamped back; those of odd volume below 0 go."""
    knocked = T.hourly(spark, d).withColumn("o", F.col("o") * 1.5).withColumn("c", F.col("c") * 0.5).withColumn("v", F.when(F.hour("t") == 3, -F.col("v")).otherwise(F.col("v")))
    return rounded(B.clamped(knocked))


add("bars_valid_clamped", bars_valid_clamped, f"WITH {T.BARS} SELECT k, t, {r('greatest(l, least(h, o * 1.5))')} AS o, {r('h')} AS h, {r('l')} AS l, {r('greatest(l, least(h, c * 0.5))')} AS c, {r('v')} AS v, n FROM bars WHERE hour(t) <> 3 OR v = 0")


def price_per_minute(spark, d):
    return B.last_per(T.ticks(spark, d), "1 minute")


add("price_per_minute", price_per_minute, f"WITH {T.TICKS} SELECT k, date_trunc('minute', ts) AS t, last(px ORDER BY ts, id) AS px, count(*) AS n FROM (SELECT k, t AS ts, id, px FROM ticks) GROUP BY 1, 2")


def price_filled_hourly(spark, d):
    return B.filled(B.last_per(T.ticks(spark, d), "1 hour"), "1 hour")


add(
    "price_filled_hourly",
    price_filled_hourly,
    f"WITH {T.TICKS}, p AS (SELECT k, date_trunc('hour', ts) AS t, last(px ORDER BY ts, id) AS px FROM (SELECT k, t AS ts, id, px FROM ticks) GROUP BY 1, 2), g AS (SELECT k, unnest(generate_series(min(t), max(t), INTERVAL 1 hour)) AS t FROM p GROUP BY k) "
    f"SELECT g.k, g.t, last_value(p.px IGNORE NULLS) OVER (PARTITION BY g.k ORDER BY g.t) AS px, p.px IS NULL AS synthetic FROM g LEFT JOIN p ON g.k = p.k AND g.t = p.t",
)

TRUE_RANGE = f"greatest(h - l, abs(h - lag(c) {_OVER}), abs(l - lag(c) {_OVER}))"


def true_range(spark, d):
    return rounded(W.true_range(T.hourly(spark, d)).select("k", "t", "tr"))


add("true_range", true_range, f"WITH {T.BARS} SELECT k, t, {r(TRUE_RANGE)} AS tr FROM bars")


def _swing_sql(side: int = 5) -> str:
    b, a = f"OVER (PARTITION BY k ORDER BY t ROWS BETWEEN {side} PRECEDING AND 1 PRECEDING)", f"OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {side} FOLLOWING)"
    full = f"count(*) {b} = {side} AND count(*) {a} = {side}"
    return f"swung AS (SELECT *, coalesce({full} AND h > max(h) {b} AND h > max(h) {a}, false) AS swing_high, coalesce({full} AND l < min(l) {b} AND l < min(l) {a}, false) AS swing_low, lead(t, {side}) {_OVER} AS later FROM bars)"


SWINGS = f"{T.BARS}, {_swing_sql()}"


def swings(spark, d):
    return W.swings(T.hourly(spark, d)).where("swing_high or swing_low").select("k", "t", "h", "l", "swing_high", "swing_low", "known_at")


add("swings", swings, f"WITH {SWINGS} SELECT k, t, h, l, swing_high, swing_low, later AS known_at FROM swung WHERE swing_high OR swing_low")


def trend_by_swings(spark, d):
    return rounded(W.trend(W.swings(T.hourly(spark, d))))


def _share(flag: str, value: str) -> str:
    return f"(SELECT k, avg(CASE WHEN x > p THEN 1.0 WHEN x <= p THEN 0.0 END) AS s FROM (SELECT k, {value} AS x, lag({value}) OVER (PARTITION BY k ORDER BY t) AS p FROM (SELECT * FROM swung WHERE {flag} QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC) <= 4)) GROUP BY k)"


add(
    "trend_by_swings",
    trend_by_swings,
    f"WITH {SWINGS}, s AS (SELECT b.k, a.s AS hh, z.s AS hl FROM (SELECT DISTINCT k FROM bars) b LEFT JOIN {_share('swing_high', 'h')} a ON a.k = b.k LEFT JOIN {_share('swing_low', 'l')} z ON z.k = b.k) "
    f"SELECT k, {r('hh')} AS higher_highs, {r('hl')} AS higher_lows, CASE WHEN hh + hl IS NULL THEN 'unknown' WHEN (hh + hl) / 2 >= 0.75 THEN 'uptrend' WHEN (hh + hl) / 2 <= 0.25 THEN 'downtrend' ELSE 'ranging' END AS trend FROM s",
)


def liquidity(spark, d):
    return rounded(W.liquidity(T.hourly(spark, d)).select("k", "t", "avg_volume", "relative_volume", "spread"))


add("liquidity", liquidity, f"WITH {T.BARS} SELECT k, t, {r(f'avg(v) {_last(20)}')} AS avg_volume, {r(f'v / nullif(avg(v) {_last(20)}, 0)')} AS relative_volume, {r('(h - l) / nullif(c, 0)')} AS spread FROM bars")


def simple_returns(spark, d):
    return rounded(W.returns(T.hourly(spark, d)).select("k", "t", "ret_1", "ret_5", "ret_15"))


add("simple_returns", simple_returns, f"WITH {T.BARS} SELECT k, t, " + ", ".join(r(f"coalesce(c / nullif(lag(c, {k}) {_OVER}, 0) - 1, 0)") + f" AS ret_{k}" for k in (1, 5, 15)) + " FROM bars")


def rsi_14(spark, d):
    return rounded(W.rsi(T.hourly(spark, d)).select("k", "t", "rsi"))


add(
    "rsi_14",
    rsi_14,
    f"WITH {T.BARS}, s AS (SELECT k, t, c - lag(c) {_OVER} AS d FROM bars), g AS (SELECT k, t, count(d) {_last(14)} AS n, sum(greatest(d, 0)) {_last(14)} AS gain, sum(greatest(-d, 0)) {_last(14)} AS loss FROM s) "
    f"SELECT k, t, {r('CASE WHEN n < 14 THEN 50.0 WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END')} AS rsi FROM g",
)


def bollinger_20(spark, d):
    return rounded(W.bollinger(T.hourly(spark, d)).select("k", "t", "sma", "boll_z", "boll_width"))


add(
    "bollinger_20",
    bollinger_20,
    f"WITH {T.BARS}, s AS (SELECT k, t, c, count(*) {_last(20)} AS n, avg(c) {_last(20)} AS m, stddev_pop(c) {_last(20)} AS sd FROM bars) "
    f"SELECT k, t, {r('CASE WHEN n = 20 THEN m END')} AS sma, {r('CASE WHEN n = 20 THEN coalesce((c - m) / nullif(sd, 0), 0) ELSE 0 END')} AS boll_z, {r('CASE WHEN n = 20 THEN coalesce(4 * sd / nullif(m, 0), 0) ELSE 0 END')} AS boll_width FROM s",
)


def volatility_features(spark, d):
    return rounded(W.volatility(T.hourly(spark, d)).select("k", "t", "realised_vol", "volume_ratio", "range_position", "trend_alignment"))


add(
    "volatility_features",
    volatility_features,
    f"WITH {T.BARS}, s AS (SELECT *, coalesce(c / nullif(lag(c) {_OVER}, 0) - 1, 0) AS ret FROM bars) SELECT k, t, {r(f'coalesce(stddev_pop(ret) {_last(30)}, 0)')} AS realised_vol, {r(f'coalesce(avg(v) {_last(5)} / nullif(avg(v) {_last(60)}, 0), 1)')} AS volume_ratio, "
    f"{r(f'coalesce((c - min(l) {_last(60)}) / nullif(max(h) {_last(60)} - min(l) {_last(60)}, 0), 0.5)')} AS range_position, CAST(sign(c - first_value(c) {_last(60)}) * sign(c - first_value(c) {_last(5)}) AS DOUBLE) AS trend_alignment FROM s",
)


def return_sequence_60(spark, d):
    """The padded sequence, as its sum, its weighted sum and its length."""
    seq = W.return_sequence(T.hourly(spark, d))
    add_up = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return rounded(seq.select("k", "t", F.size("seq").cast("long").alias("n"), add_up(F.col("seq")).alias("total"), add_up(F.transform("seq", lambda v, i: v * i)).alias("weighted")))


add(
    "return_sequence_60",
    return_sequence_60,
    f"WITH {T.BARS}, s AS (SELECT k, t, coalesce(c / nullif(lag(c) {_OVER}, 0) - 1, 0) AS ret FROM bars), q AS (SELECT k, t, list(ret) {_last(60)} AS x FROM s) "
    f"SELECT k, t, CAST(60 AS BIGINT) AS n, {r('list_sum(x)')} AS total, {r('list_sum(list_transform(x, lambda v, i: v * (60 - len(x) + i - 1)))')} AS weighted FROM q",
)


def trailing_regime(spark, d):
    return rounded(W.trailing_accuracy(T.windows(spark, d)).select("k", "t", "regime_acc"))


add("trailing_regime", trailing_regime, f"WITH {T.WINDOWS} SELECT k, t, {r(f'CASE WHEN count(y) {_last(20, 1)} = 20 THEN avg(y) {_last(20, 1)} END')} AS regime_acc FROM windows")


def losing_streaks(spark, d):
    return W.losing_streak(T.trades(spark, d), "id", "line", "part", "supp")


add(
    "losing_streaks",
    losing_streaks,
    f"WITH {T.TRADES}, g AS (SELECT k, sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t DESC, id DESC, line DESC, part DESC, supp DESC ROWS UNBOUNDED PRECEDING) AS g FROM trades) SELECT k, CAST(sum(CASE WHEN g = 0 THEN 1 ELSE 0 END) AS BIGINT) AS streak FROM g GROUP BY k",
)


def daily_pnl_drawdown(spark, d):
    daily = T.trades(spark, d).groupBy("k", "t").agg(F.round(F.sum("pnl"), 6).alias("pnl"))
    return rounded(W.drawdown(daily, "pnl", floor=0.0))


add(
    "daily_pnl_drawdown",
    daily_pnl_drawdown,
    f"WITH {T.TRADES}, p AS (SELECT k, t, round(sum(pnl), 6) AS pnl FROM trades GROUP BY 1, 2), c AS (SELECT *, sum(pnl) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS running FROM p), q AS (SELECT *, greatest(0.0, max(running) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING)) AS peak FROM c) "
    "SELECT k, t, round(pnl, 6) + 0.0 AS pnl, round(running, 6) + 0.0 AS running, round(peak, 6) + 0.0 AS peak, round(peak - running, 6) + 0.0 AS down FROM q",
)


def path_crossings(spark, d):
    path = T.ticks(spark, d).withColumn("strike", F.lit(30.0))
    return rounded(W.crossings(path, "strike"))


add(
    "path_crossings",
    path_crossings,
    f"WITH {T.TICKS}, s AS (SELECT k, t, id, sign(px - 30.0) AS s, lag(sign(px - 30.0)) OVER w AS p, px - lag(px, 3) OVER w AS d FROM ticks WINDOW w AS (PARTITION BY k ORDER BY t, id)) "
    f"SELECT k, {r('avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END)')} AS above, CAST(coalesce(sum(CASE WHEN s * p < 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS crossings, {r('last(d ORDER BY t, id)')} AS drift FROM s GROUP BY k",
)


def order_flow_imbalance(spark, d):
    return rounded(W.order_flow(T.ticks(spark, d)).drop("user_id"))


def _flow(s: int) -> str:
    w = f"OVER (PARTITION BY k ORDER BY t RANGE BETWEEN INTERVAL {s} SECONDS PRECEDING AND CURRENT ROW)"
    return f"{r(f'coalesce((2 * sum(CASE WHEN taker_buy THEN size ELSE 0.0 END) {w} - sum(size) {w}) / nullif(sum(size) {w}, 0), 0)')} AS imbalance_{s}, count(*) {w} AS trades_{s}, CAST(sum(CASE WHEN size >= 90 THEN 1 ELSE 0 END) {w} AS BIGINT) AS whales_{s}"


add("order_flow_imbalance", order_flow_imbalance, f"WITH {T.TICKS} SELECT k, t, id, px, size, taker_buy, {_flow(60)}, {_flow(300)}, {_flow(900)} FROM ticks")


def recency_weights(spark, d):
    return W.recency_weight(T.hourly(spark, d)).select("k", "t", "weight")


add("recency_weights", recency_weights, f"WITH {T.BARS} SELECT k, t, CASE WHEN row_number() {_OVER} - 1 >= count(*) OVER (PARTITION BY k) // 2 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM bars")


def first_tick_in_quarter(spark, d):
    return W.first_in_bucket(T.ticks(spark, d), B.bucket("15 minutes"), "id").select("k", "bucket", "t", "id", "px")


add("first_tick_in_quarter", first_tick_in_quarter, f"WITH {T.TICKS} SELECT k, time_bucket(INTERVAL '15 minutes', t) AS bucket, t, id, px FROM ticks QUALIFY row_number() OVER (PARTITION BY k, time_bucket(INTERVAL '15 minutes', t) ORDER BY t, id) = 1")


def discrete_state(spark, d):
    x = W.discretised(T.hourly(spark, d))
    return x.select("k", "t", *(F.col("state")[i].alias(f"s{i}") for i in range(4)))


add(
    "discrete_state",
    discrete_state,
    f"WITH {T.BARS}, s AS (SELECT *, coalesce(c / nullif(lag(c) {_OVER}, 0) - 1, 0) AS ret, coalesce(c / nullif(lag(c, 5) {_OVER}, 0) - 1, 0) AS ret5 FROM bars), f AS (SELECT k, t, ret5, coalesce((c - min(l) {_last(60)}) / nullif(max(h) {_last(60)} - min(l) {_last(60)}, 0), 0.5) AS pos, "
    f"coalesce(stddev_pop(ret) {_last(30)}, 0) AS vol, coalesce(avg(v) {_last(5)} / nullif(avg(v) {_last(60)}, 0), 1) AS vr FROM s) SELECT k, t, CASE WHEN ret5 < -0.05 THEN 0 WHEN ret5 > 0.05 THEN 2 ELSE 1 END AS s0, CASE WHEN pos < 0.33 THEN 0 WHEN pos > 0.67 THEN 2 ELSE 1 END AS s1, "
    "CASE WHEN vol < 0.5 THEN 0 WHEN vol > 1.5 THEN 2 ELSE 1 END AS s2, CASE WHEN vr < 0.8 THEN 0 WHEN vr > 1.2 THEN 2 ELSE 1 END AS s3 FROM f",
)


def _sides(spark, d):
    x = T.ticks(spark, d)
    of = lambda k: x.where(F.col("k") == k).select(F.col("user_id").alias("k"), "t", "id", "px")
    return of("purchase"), of("view")


_SIDES = f"{T.TICKS}, l AS (SELECT user_id AS k, t, id, px FROM ticks WHERE k = 'purchase'), q AS (SELECT user_id AS k, t, id, px FROM ticks WHERE k = 'view'), q1 AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY id DESC) = 1)"


def asof_backward(spark, d):
    left, right = _sides(spark, d)
    return J.as_of(left, right, "px", "12 hours")


add(
    "asof_backward",
    asof_backward,
    f"WITH {_SIDES} SELECT l.k, l.t, l.id, l.px, CASE WHEN q1.t >= l.t - INTERVAL 12 HOURS THEN q1.t END AS q_t, CASE WHEN q1.t >= l.t - INTERVAL 12 HOURS THEN q1.px END AS q_value FROM l ASOF LEFT JOIN q1 ON l.k = q1.k AND l.t >= q1.t",
)


def asof_forward(spark, d):
    left, right = _sides(spark, d)
    return J.as_of_forward(left, right, "px", "6 hours")


add(
    "asof_forward",
    asof_forward,
    f"WITH {_SIDES}, q2 AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY id) = 1) SELECT l.k, l.t, l.id, l.px, CASE WHEN q2.t <= l.t + INTERVAL 6 HOURS THEN q2.t END AS n_t, CASE WHEN q2.t <= l.t + INTERVAL 6 HOURS THEN q2.px END AS n_value FROM l ASOF LEFT JOIN q2 ON l.k = q2.k AND l.t <= q2.t",
)


def asof_nearest(spark, d):
    left, right = _sides(spark, d)
    return J.nearest(left, right, "px", "3 hours")


add(
    "asof_nearest",
    asof_nearest,
    f"WITH {_SIDES}, m AS (SELECT l.id, q.t AS m_t, q.px AS m_value FROM l JOIN q ON l.k = q.k AND q.t BETWEEN l.t - INTERVAL 3 HOURS AND l.t + INTERVAL 3 HOURS QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY abs(epoch_us(q.t) - epoch_us(l.t)), q.t, CASE WHEN q.t <= l.t THEN -q.id ELSE q.id END) = 1) "
    "SELECT l.k, l.t, l.id, l.px, m_t, m_value FROM l LEFT JOIN m ON l.id = m.id",
)


def bar_at_offset(spark, d):
    return J.at_offset(T.hourly(spark, d).select("k", "t", "c"), "4 hours")


add("bar_at_offset", bar_at_offset, f"WITH {T.BARS} SELECT a.k, a.t, a.c, b.c AS later FROM bars a JOIN bars b ON a.k = b.k AND b.t = a.t + INTERVAL 4 HOURS")


def paired_arms(spark, d):
    return J.paired(T.hourly(spark, d), "k", "click", "view", ["t"], "c")


add("paired_arms", paired_arms, f"WITH {T.BARS} SELECT a.t, a.c AS a, b.c AS b FROM bars a JOIN bars b ON a.t = b.t WHERE a.k = 'click' AND b.k = 'view'")


def delivered_bars(spark, d):
    x = T.ticks(spark, d)
    return J.delivered(x.select("k", "t", "id", "px"), T.hourly(spark, d), "10 minutes", "1 hour")


add(
    "delivered_bars",
    delivered_bars,
    f"WITH {T.BARS}, l AS (SELECT k, t, id, px FROM ticks), b AS (SELECT k, t + INTERVAL 70 MINUTES AS t, c FROM bars) SELECT l.k, l.t, l.id, l.px, b.t AS bar_t, b.c AS bar_value FROM l ASOF LEFT JOIN b ON l.k = b.k AND l.t >= b.t",
)


def first_break_below(spark, d):
    """The first bar that closes below each swing low."""
    b = W.swings(T.hourly(spark, d))
    return J.first_touch(b.where("swing_low").select("k", F.col("l").alias("level")).distinct(), b, F.col("c") < F.col("level"))


add("first_break_below", first_break_below, f"WITH {SWINGS}, v AS (SELECT DISTINCT k, l AS level FROM swung WHERE swing_low) SELECT v.k, v.level, min(b.t) AS touched_at FROM v LEFT JOIN bars b ON b.k = v.k AND b.c < v.level GROUP BY 1, 2")


def zone_touches(spark, d):
    b = W.recency_weight(W.swings(T.hourly(spark, d)))
    zones = b.where("swing_high").select("k", F.col("h").alias("mid")).distinct()
    return rounded(J.touching(zones, b, 0.002, "weight"))


add(
    "zone_touches",
    zone_touches,
    f"WITH {SWINGS}, z AS (SELECT DISTINCT k, h AS mid FROM swung WHERE swing_high), w AS (SELECT k, h, l, CASE WHEN row_number() {_OVER} - 1 >= count(*) OVER (PARTITION BY k) // 2 THEN 1.1 ELSE 1.0 END AS weight FROM bars) "
    f"SELECT z.k, z.mid, count(w.k) AS touches, {r('coalesce(sum(w.weight), 0)::DOUBLE')} AS strength FROM z LEFT JOIN w ON w.k = z.k AND (abs(w.h - z.mid) <= 0.002 * z.mid OR abs(w.l - z.mid) <= 0.002 * z.mid) GROUP BY 1, 2",
)


def nearest_levels(spark, d):
    b = W.swings(T.hourly(spark, d))
    last = b.groupBy("k").agg(F.max_by("c", "t").alias("price"))
    return J.nearest_level(last, b.where("swing_high").select("k", F.col("h").alias("mid")).distinct(), "price")


add("nearest_levels", nearest_levels, f"WITH {SWINGS}, p AS (SELECT k, last(c ORDER BY t) AS price FROM bars GROUP BY k) SELECT p.k, p.price, min(CASE WHEN h > price THEN h END) AS above, max(CASE WHEN h < price THEN h END) AS below FROM p LEFT JOIN (SELECT k, h FROM swung WHERE swing_high) s ON s.k = p.k GROUP BY 1, 2")


def sessions(spark, d):
    return T.ticks(spark, d).select("id", S.session_label(F.col("t")).alias("session")).groupBy("session").agg(F.count("*").alias("n"))


add(
    "sessions",
    sessions,
    f"WITH {T.TICKS}, s AS (SELECT t + CASE WHEN month(t) BETWEEN 4 AND 10 THEN INTERVAL '-4 hours' ELSE INTERVAL '-5 hours' END AS lt FROM ticks), m AS (SELECT hour(lt) * 60 + minute(lt) AS m, isodow(lt) <= 5 AS wd FROM s) "
    "SELECT CASE WHEN wd AND m BETWEEN 570 AND 959 THEN 'open' WHEN wd AND m BETWEEN 240 AND 569 THEN 'pre' WHEN wd AND m BETWEEN 960 AND 1199 THEN 'post' ELSE 'closed' END AS session, count(*) AS n FROM m GROUP BY 1",
)


def price_bands(spark, d):
    return T.ticks(spark, d).groupBy("k", S.band(F.col("px"), [10.0, 30.0, 90.0], ["low", "mid", "high", "top"]).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("px"), 6).alias("mean"))


add("price_bands", price_bands, f"WITH {T.TICKS} SELECT k, CASE WHEN px < 10 THEN 'low' WHEN px < 30 THEN 'mid' WHEN px < 90 THEN 'high' ELSE 'top' END AS band, count(*) AS n, {r('avg(px)')} AS mean FROM ticks GROUP BY 1, 2")


def fees(spark, d):
    """All conventions on distinct prices in cents."""
    cents = F.round(F.least(F.col("px"), F.lit(99.0)), 0)
    x = T.ticks(spark, d).select(cents.alias("c")).distinct().where("c > 0")
    return rounded(x.select("c", S.fee_continuous(F.col("c")).alias("continuous"), S.fee_per_contract(F.col("c")).alias("per_contract"), S.fee_per_order(F.col("c"), F.lit(13)).alias("per_order"), S.kelly(F.lit(0.6), F.col("c") / 100).alias("kelly"), S.logit(F.col("c") / 100).alias("logit"), S.sigmoid(F.col("c") / 10 - 5).alias("sigmoid")))


add(
    "fees",
    fees,
    f"WITH {T.TICKS}, x AS (SELECT DISTINCT round(least(px, 99.0), 0) AS c FROM ticks), f AS (SELECT c, 7 * (c / 100) * (1 - c / 100) AS f, c / 100 AS p FROM x WHERE c > 0) SELECT c, {r('f')} AS continuous, ceil(round(f, 9))::DOUBLE AS per_contract, ceil(round(f * 13, 9))::DOUBLE AS per_order, {r('greatest(0.0, (0.6 - p) / (1 - p))')} AS kelly, {r('ln(p / (1 - p))')} AS logit, {r('1 / (1 + exp(-(c / 10 - 5)))')} AS sigmoid FROM f",
)


def unseen_ids(spark, d):
    x = T.ticks(spark, d)
    return J.not_seen(x.select("k", "t", "id"), x.where("taker_buy"), ["id"])


add("unseen_ids", unseen_ids, f"WITH {T.TICKS} SELECT k, t, id FROM ticks WHERE NOT taker_buy")


def shared_slots(spark, d):
    x = T.hourly(spark, d)
    return x.where("k = 'click'").select("t").intersect(x.where("k = 'view'").select("t"))


add("shared_slots", shared_slots, f"WITH {T.BARS} SELECT t FROM bars WHERE k = 'click' INTERSECT SELECT t FROM bars WHERE k = 'view'")


def config_sweep(spark, d):
    """Hits of a grid of ratio and distance settings."""
    grid = spark.createDataFrame([(rr, dist) for rr in (1.2, 1.5, 2.0) for dist in (0.5, 1.0)], "rr double, dist double")
    b = W.true_range(T.hourly(spark, d))
    return J.sweep(b, grid).groupBy("k", "rr", "dist").agg(F.sum(((F.col("h") - F.col("o")) >= F.col("rr") * F.col("dist") * (F.col("o") - F.col("l"))).cast("long")).alias("hits"))


add("config_sweep", config_sweep, f"WITH {T.BARS}, g AS (SELECT * FROM (VALUES (1.2::DOUBLE), (1.5), (2.0)) a(rr), (VALUES (0.5::DOUBLE), (1.0)) b(dist)) SELECT k, rr, dist, CAST(sum(CASE WHEN h - o >= rr * dist * (o - l) THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM bars, g GROUP BY 1, 2, 3")

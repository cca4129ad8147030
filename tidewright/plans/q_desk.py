"""Queries of gates, policy, portfolio and robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import scalar as S
from tidewright.operators import desk as D
from tidewright.operators import structure as Z
from tidewright.operators import windows as W
from tidewright.sources import tables as T

from .q_bars import SWINGS
from .registry import add
from .shaping import r, rounded

_W = f"WITH {T.WINDOWS}"
_ACCOUNT = (
    "s AS (SELECT o_orderkey AS id, (o_orderkey % 7)::INTEGER AS today, (o_orderkey % 5)::INTEGER AS open_, 100000.0 AS equity, 100000.0 + (o_custkey % 8) * 1000 AS day_equity, (o_custkey % 10) * 1000.0 AS in_k, (o_orderkey % 11) * 9000.0 AS in_all, 30000.0 - (o_custkey % 6) * 5000 AS cash, o_totalprice / 20 AS required FROM orders)"
)


def risk_checks(spark, d):
    """Orders as wishes to open a trade, in states of an account that hang on their keys."""
    o, key, cust = T.table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    x = o.select(
        key.alias("id"), (key % 7).alias("trades_today"), (key % 5).alias("open_positions"), F.lit(100_000.0).alias("equity"), (F.lit(100_000.0) + (cust % 8) * 1000).alias("day_equity"),
        ((cust % 10) * 1000.0).alias("in_ticker"), ((key % 11) * 9000.0).alias("in_all"), (F.lit(30_000.0) - (cust % 6) * 5000).alias("cash"), (F.col("o_totalprice") / 20).alias("required"),
    )
    return D.opening_check(x, D.Limits(positions=4, day_loss=0.05)).select("id", "reason")


add(
    "risk_checks",
    risk_checks,
    f"WITH {_ACCOUNT} SELECT id, CASE WHEN today >= 5 THEN 'max_trades_per_day reached' WHEN open_ >= 4 THEN 'max_concurrent_positions reached' WHEN greatest((day_equity - equity) / day_equity, 0) >= 0.05 THEN 'daily_drawdown_limit_breached' "
    "WHEN (in_k + required) / equity > 0.1 THEN 'max_ticker_exposure exceeded' WHEN in_all + required > 0.9 * equity THEN 'max_portfolio_exposure exceeded' WHEN cash < required THEN 'insufficient_cash' ELSE 'ok' END AS reason FROM s",
)


def recommendations(spark, d):
    """Orders as setups, with numbers that hang on their keys."""
    o, key, cust = T.table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    entry = F.col("o_totalprice") / 1000
    x = o.select(
        key.alias("id"), F.element_at(F.array(*(F.lit(p[0]) for p in D.PROFILES)), (cust % 3 + 1).cast("int")).alias("profile"), (key % 6).alias("trades_today"), (key % 9 > 0).alias("accepted"),
        F.when(key % 10 > 0, 0.45 + (key % 53) / 100).alias("score"), (F.lit(1.0) + (cust % 29) / 10).alias("rr"), (0.45 + (cust % 51) / 100).alias("chance"), (0.4 + (key % 57) / 100).alias("confidence"),
        ((key % 4 - 1) / 100).alias("expected"), F.when(cust % 5 == 0, "earnings").alias("event"), (cust % 12).alias("losing_streak"), F.when(key % 2 == 0, "intraday_1h").otherwise("daily").alias("timeframe"),
        F.lit(100_000.0).alias("equity"), entry.alias("entry"), F.when(cust % 13 > 0, entry * 0.97).alias("stop"),
    )
    return D.recommend(x, spark.createDataFrame(D.PROFILES, D.PROFILE_COLUMNS)).select("id", "profile", "gate", "action", F.round("size", 1).alias("size"))


_PROFILES = "profiles(profile, risk, intraday_size, swing_size, day_trades, least_chance, least_score, least_rr, least_confidence, on_event, event_size, streak_step) AS (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in p) + ")" for p in D.PROFILES) + ")"
add(
    "recommendations",
    recommendations,
    f"WITH {_PROFILES}, s AS (SELECT o_orderkey AS id, ['conservative', 'moderate', 'aggressive'][o_custkey % 3 + 1] AS profile, o_orderkey % 6 AS today, o_orderkey % 9 > 0 AS accepted, CASE WHEN o_orderkey % 10 > 0 THEN 0.45::DOUBLE + (o_orderkey % 53)::DOUBLE / 100 ELSE 0 END AS score, 1.0::DOUBLE + (o_custkey % 29)::DOUBLE / 10 AS rr, "
    "0.45::DOUBLE + (o_custkey % 51)::DOUBLE / 100 AS chance, 0.4::DOUBLE + (o_orderkey % 57)::DOUBLE / 100 AS confidence, o_orderkey % 4 - 1 AS expected, o_custkey % 5 = 0 AS event, (o_custkey % 12)::DOUBLE AS streak, o_orderkey % 2 = 0 AS intraday, o_totalprice / 1000 AS entry, CASE WHEN o_custkey % 13 > 0 THEN o_totalprice / 1000 * 0.97::DOUBLE END AS stop FROM orders), "
    "g AS (SELECT *, CASE WHEN today >= day_trades THEN 'max_trades_per_day' WHEN NOT accepted THEN 'fta_rejected' WHEN score < least_score THEN 'fta_score_below_threshold' WHEN rr < least_rr THEN 'reward_risk_below_threshold' WHEN chance < least_chance THEN 'meta_model_probability_below_threshold' "
    "WHEN confidence < least_confidence THEN 'forecast_confidence_below_threshold' WHEN event AND on_event = 'skip' THEN 'event_risk_skip' END AS gate FROM s JOIN profiles USING (profile)) "
    "SELECT id, profile, gate, CASE WHEN gate IS NOT NULL THEN 'HOLD' WHEN expected > 0 THEN 'BUY' ELSE 'SELL' END AS action, CASE WHEN gate IS NULL THEN round(greatest(1, round(100000 * risk / CASE WHEN stop IS NULL THEN entry * 0.01 ELSE abs(entry - stop) END * CASE WHEN intraday THEN intraday_size ELSE swing_size END * CASE WHEN event AND on_event = 'reduce' THEN event_size ELSE 1 END * greatest(1 - streak_step * streak, 0.1), 2)), 1) END AS size FROM g",
)


def timeframe_policies(spark, d):
    c = F.col("c_custkey")
    policies = F.array(*map(F.lit, (*D.POLICIES, "unheard_of")))
    x = T.table(spark, d, "customer").select(c.alias("id"), F.element_at(policies, (c % 4 + 1).cast("int")).alias("policy"), F.when(c % 5 > 0, c % 3 > 0).alias("has_intraday"), (c % 97).alias("intraday_trades"))
    return D.timeframe_policy(x, finetune=False).select("id", "mode", "timeframe", "why", "fell_back")


add(
    "timeframe_policies",
    timeframe_policies,
    "WITH s AS (SELECT c_custkey AS id, ['daily_only', 'daily_plus_intraday_calibration', 'intraday_experimental_finetune', 'daily_only'][c_custkey % 4 + 1] AS p, c_custkey % 5 > 0 AND c_custkey % 3 > 0 AS has, c_custkey % 97 AS n FROM customer), "
    "w AS (SELECT *, CASE WHEN p = 'daily_only' THEN 'daily_only' WHEN NOT has THEN 'no_real_intraday_data' WHEN n < 50 THEN 'insufficient_intraday_trades' ELSE 'daily_with_intraday_calibration' END AS why FROM s) "
    "SELECT id, CASE WHEN why = 'daily_with_intraday_calibration' THEN 'daily_plus_intraday_calibration' ELSE 'daily_only' END AS mode, '1d' AS timeframe, why, why LIKE '%no\\_real%' ESCAPE '\\' OR why LIKE 'insufficient%' AS fell_back FROM w",
)


def portfolio_risk_checks(spark, d):
    """An account that trades all keys, and one for each key, under the same limits."""
    b = T.hourly(spark, d).select(F.explode(F.array(F.lit("all"), F.col("k"))).alias("account"), "k", "t", "o", "c")
    return rounded(D.run_portfolio(b, D.Limits(risk=0.05, day_trades=8, positions=6, day_loss=0.05, ticker=0.12, portfolio=0.55), 0.3, 0.4), 4)


_EQUITY = "cash + list_sum(list_transform(pos, lambda p: p.q * p.last) || [0.0])"
_LEFT = "list_filter(marked, lambda p: NOT (p.k = k AND (c <= p.e * 0.7 OR c >= p.e * 1.4)))"
add(
    "portfolio_risk_checks",
    portfolio_risk_checks,
    f"WITH RECURSIVE {T.BARS}, b AS (SELECT unnest(['all', k]) AS account, k, t, o::DOUBLE AS o, c::DOUBLE AS c FROM bars), s AS (SELECT *, t::DATE AS d, row_number() OVER (PARTITION BY account ORDER BY t, k) AS i FROM b), "
    "f AS (SELECT DISTINCT account, 0::BIGINT AS i, 100000::DOUBLE AS cash, []::STRUCT(k VARCHAR, q DOUBLE, e DOUBLE, last DOUBLE)[] AS pos, NULL::DATE AS day, 0::BIGINT AS today, 100000::DOUBLE AS day_equity, 0::BIGINT AS opened, 0::BIGINT AS stopped, 0::BIGINT AS reached, 0::BIGINT AS r1, 0::BIGINT AS r2, 0::BIGINT AS r3, 0::BIGINT AS r4, 0::BIGINT AS r5, 0::BIGINT AS r6, 100000::DOUBLE AS equity, 100000::DOUBLE AS peak, 0::DOUBLE AS worst FROM s "
    "UNION ALL SELECT account, i, cash, pos, day, today, day_equity, opened, stopped, reached, r1, r2, r3, r4, r5, r6, eq, greatest(peak, eq), greatest(worst, (greatest(peak, eq) - eq) / greatest(peak, eq)) FROM (SELECT *, " + _EQUITY + " AS eq FROM ("
    "SELECT account, i, d AS day, day_equity, CASE WHEN why = 0 THEN cash - need ELSE cash END AS cash, CASE WHEN why = 0 THEN pos || [{'k': k, 'q': want, 'e': c, 'last': c}] ELSE pos END AS pos, today + (why = 0)::BIGINT AS today, opened + (why = 0)::BIGINT AS opened, stopped, reached, "
    + ", ".join(f"r{j} + (why = {j})::BIGINT AS r{j}" for j in range(1, 7))
    + ", peak, worst FROM (SELECT *, CASE WHEN c <= o THEN -1 WHEN today >= 8 THEN 1 WHEN len(pos) >= 6 THEN 2 WHEN day_equity > 0 AND (day_equity - now_) / day_equity >= 0.05 THEN 3 WHEN now_ > 0 AND (list_sum(list_transform(list_filter(pos, lambda p: p.k = k), lambda p: p.q * p.last) || [0.0]) + need) / now_ > 0.12 THEN 4 "
    "WHEN now_ - cash + need > 0.55 * now_ THEN 5 WHEN cash < need THEN 6 ELSE 0 END AS why FROM (SELECT *, want * c AS need FROM (SELECT *, greatest(1.0, floor(least(now_ * 0.05 / (c * 0.3), now_ * 0.12 / c, cash / c))) AS want FROM (SELECT *, " + _EQUITY + " AS now_ FROM ("
    "SELECT account, i, k, d, o, c, today, day_equity, cash + list_sum(list_transform(list_filter(marked, lambda p: p.k = k), lambda p: CASE WHEN c <= p.e * 0.7 THEN p.q * p.e * 0.7 WHEN c >= p.e * 1.4 THEN p.q * p.e * 1.4 ELSE 0.0 END) || [0.0]) AS cash, " + _LEFT + " AS pos, "
    "opened, stopped + len(list_filter(marked, lambda p: p.k = k AND c <= p.e * 0.7)) AS stopped, reached + len(list_filter(marked, lambda p: p.k = k AND c > p.e * 0.7 AND c >= p.e * 1.4)) AS reached, r1, r2, r3, r4, r5, r6, peak, worst FROM ("
    "SELECT s.account, s.i, s.k, s.d, s.o, s.c, CASE WHEN f.day IS NULL OR s.d > f.day THEN 0 ELSE f.today END AS today, CASE WHEN f.day IS NULL OR s.d > f.day THEN f.equity ELSE f.day_equity END AS day_equity, f.cash, list_transform(f.pos, lambda p: {'k': p.k, 'q': p.q, 'e': p.e, 'last': CASE WHEN p.k = s.k THEN s.c ELSE p.last END}) AS marked, "
    "f.opened, f.stopped, f.reached, f.r1, f.r2, f.r3, f.r4, f.r5, f.r6, f.peak, f.worst FROM f JOIN s ON s.account = f.account AND s.i = f.i + 1))))))))) "
    f"SELECT account, opened, stopped, reached, r1 AS refused_1, r2 AS refused_2, r3 AS refused_3, r4 AS refused_4, r5 AS refused_5, r6 AS refused_6, {r('equity', 4)} AS equity, {r('worst', 4)} AS drawdown FROM f QUALIFY i = max(i) OVER (PARTITION BY account)",
)


def threshold_sensitivity(spark, d):
    x = T.trades(spark, d).withColumn("confidence", (F.col("part") % 100) / 100)
    return rounded(D.threshold_sensitivity(x, "confidence", [0.3, 0.5, 0.6, 0.7, 0.8]), 2)


add(
    "threshold_sensitivity",
    threshold_sensitivity,
    f"WITH {T.TRADES}, x AS (SELECT k, pnl, (part % 100)::DOUBLE / 100 AS confidence FROM trades), s AS (SELECT k, threshold, sum(pnl) AS base, count(*) FILTER (confidence >= threshold) AS n, coalesce(sum(pnl) FILTER (confidence >= threshold), 0) AS p FROM x, (VALUES (0.3::DOUBLE), (0.5), (0.6), (0.7), (0.8)) v(threshold) GROUP BY 1, 2) "
    f"SELECT k, {r('base', 2)} AS base, threshold, n, {r('p', 2)} AS pnl, n >= 3 AND (base <= 0 OR p >= 0.5 * base) AS passes FROM s",
)


def regime_split(spark, d):
    return rounded(D.regime_split(T.trades(spark, d), F.when(F.col("part") % 10 > 0, F.col("reason")), "F", 1_000_000.0), 4)


add(
    "regime_split",
    regime_split,
    f"WITH {T.TRADES}, s AS (SELECT k, CASE WHEN part % 10 > 0 THEN reason ELSE 'unknown' END AS regime, count(*) AS n, avg((pnl > 0)::INTEGER) AS w, avg(pnl) AS m, sum(pnl) / 10000 AS p FROM trades GROUP BY 1, 2) "
    f"SELECT k, regime, n, {r('w', 4)} AS win_rate, {r('m', 4)} AS mean_pnl, {r('p', 4)} AS percent, {r('''coalesce(max(p) FILTER (regime = 'F') OVER (PARTITION BY k), 0)''', 4)} AS baseline, p >= -5 AS passes FROM s",
)


def sample_size_stress(spark, d):
    return D.sample_size_stress(T.trades(spark, d).select(F.col("part").alias("k")), 30)


add("sample_size_stress", sample_size_stress, f"WITH {T.TRADES} SELECT part AS k, count(*) AS n, count(*) < 30 AS suppressed FROM trades GROUP BY 1")


def filter_acceptance(spark, d):
    return rounded(D.filter_acceptance(T.windows(spark, d), F.col("p") >= 0.5))


add("filter_acceptance", filter_acceptance, f"{_W} SELECT k, count(*) AS before, count(*) FILTER (p >= 0.5) AS after, count(*) FILTER (p < 0.5) AS filtered, {r('100.0 * count(*) FILTER (p < 0.5) / count(*)')} AS filtered_percent, bool_or(p < 0.5) AS is_filtering FROM windows GROUP BY 1")


def prediction_distribution(spark, d):
    return rounded(D.prediction_distribution(T.windows(spark, d), "p"))


add("prediction_distribution", prediction_distribution, f"{_W} SELECT k, {r('avg(p)')} AS mean, {r('stddev_pop(p)')} AS std, {r('min(p)')} AS least, {r('max(p)')} AS largest, {r('avg((p > 0.6)::INTEGER)')} AS share_above FROM windows GROUP BY 1")


def validation_summary(spark, d):
    """Five criteria of each key's trades; that of an average loss is null where nothing was lost."""
    x = T.trades(spark, d).groupBy("k").agg(F.count("*").alias("n"), F.sum("pnl").alias("total"), F.avg((F.col("pnl") > 0).cast("int")).alias("w"), F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("gain"), F.avg(F.when(F.col("pnl") < 0, -F.col("pnl"))).alias("loss"))
    tests = {"trades": F.col("n") >= 10, "profit": F.col("total") > 0, "win rate": F.col("w") >= 0.4, "expectancy": F.col("gain") * F.col("w") > F.col("loss") * (1 - F.col("w")), "payoff": F.col("gain") > F.col("loss")}
    return D.validation_summary(x.select("k", F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), t.alias("passed")) for c, t in tests.items()))).alias("c")).select("k", "c.*"))


add(
    "validation_summary",
    validation_summary,
    f"WITH {T.TRADES}, s AS (SELECT k, count(*) AS n, sum(pnl) AS total, avg((pnl > 0)::INTEGER) AS w, avg(pnl) FILTER (pnl > 0) AS gain, -avg(pnl) FILTER (pnl < 0) AS loss FROM trades GROUP BY 1), c AS (SELECT k, unnest([n >= 10, total > 0, w >= 0.4, coalesce(gain * w > loss * (1 - w), false), coalesce(gain > loss, false)]) AS ok FROM s) SELECT k, count(*) AS criteria, count(*) FILTER (ok) AS passed, bool_and(ok) AS accepted FROM c GROUP BY 1",
)


def sample_ratio(spark, d):
    x = T.table(spark, d, "orders").select(F.col("o_orderstatus").alias("k"), (F.col("o_orderkey") % 3).alias("arm"), F.col("o_custkey").alias("unit"))
    return rounded(D.sample_ratio(x, 3))


add(
    "sample_ratio",
    sample_ratio,
    f"WITH e AS (SELECT o_orderstatus AS k, o_orderkey % 3 AS arm, count(*) AS n, count(DISTINCT o_custkey) AS u FROM orders GROUP BY 1, 2) SELECT k, sum(n)::BIGINT AS n, sum(n - u)::BIGINT AS repeated, {r('sum(n) / 3.0')} AS expected, {r('sum(n * n) / (sum(n) / 3.0) - sum(n)')} AS chi_squared FROM e GROUP BY 1",
)


def tail_summary(spark, d):
    return rounded(D.tail_summary(T.windows(spark, d)))


add(
    "tail_summary",
    tail_summary,
    f"{_W}, t AS (SELECT * FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC) <= 100) SELECT k, count(*) AS n, {r('avg(((p >= 0.5)::INTEGER = y)::INTEGER)')} AS accuracy, {r('avg((p - y) ** 2)')} AS brier, {r('avg((market - y) ** 2)')} AS market_brier FROM t GROUP BY 1",
)


def tail_winner(spark, d):
    x = T.windows(spark, d).withColumn("loss", F.round(F.pow(F.col("p") - F.col("y"), F.lit(2.0)), 6))
    return rounded(D.winner_by_tail(x, "k", "loss"))


add(
    "tail_winner",
    tail_winner,
    f"{_W}, t AS (SELECT k, round((p - y) ** 2, 6) AS l FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC) <= 50), m AS (SELECT k, avg(l) AS loss FROM t GROUP BY 1 HAVING count(*) >= 20) SELECT k AS arm, {r('loss')} AS loss FROM m ORDER BY loss, k LIMIT 1",
)


def bands_and_bets(spark, d):
    """Windows with a band about their start, capped, and whether a selector keeps the bet."""
    x = T.windows(spark, d)
    minutes = F.lit(1) + (F.hour("t") % 12)
    sigma = S.horizon_sigma(F.lit(0.004), minutes, F.col("strike"))
    band = S.capped_band(F.col("strike"), F.col("strike") - 100 * F.col("p") * minutes, F.col("strike") + 150 * minutes, minutes, F.when(F.col("y") == 1, sigma))
    return rounded(x.select("k", "t", sigma.alias("sigma"), band["lo"].alias("lo"), band["hi"].alias("hi"), S.selector_keeps(F.col("p"), F.round(F.col("market") * 100)).alias("keep")), 4)


add(
    "bands_and_bets",
    bands_and_bets,
    f"{_W}, s AS (SELECT *, 1 + hour(t) % 12 AS m, greatest(0.004::DOUBLE * sqrt(1 + hour(t) % 12) * strike, 5.0) AS sigma, round(market * 100) AS c FROM windows), b AS (SELECT *, strike - 100 * p * m AS lo, strike + 150 * m AS hi, greatest(CASE WHEN m <= 5 THEN 200 ELSE 400 END, CASE WHEN y = 1 THEN 3.2::DOUBLE * sigma ELSE 0 END) AS cap FROM s) "
    f"SELECT k, t, {r('sigma', 4)} AS sigma, trunc(CASE WHEN hi - lo > cap THEN strike + (lo - strike) * (cap / (hi - lo)) ELSE lo END)::BIGINT AS lo, trunc(CASE WHEN hi - lo > cap THEN strike + (hi - strike) * (cap / (hi - lo)) ELSE hi END)::BIGINT AS hi, p >= greatest(0.5, (c + ceil(round(7 * (c / 100) * (1 - c / 100), 9))) / 100) AS keep FROM b",
)


def trouble_ahead(spark, d):
    """The nearest swing high above each close, of those known by then."""
    return rounded(Z.nearest_above(W.swings(T.hourly(spark, d)), 200).select("k", "t", "c", "above"))


add(
    "trouble_ahead",
    trouble_ahead,
    f"WITH {SWINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM swung) SELECT a.k, a.t, {r('a.c')} AS c, {r('min(b.h)')} AS above FROM n a LEFT JOIN n b ON b.k = a.k AND b.swing_high AND b.i BETWEEN a.i - 200 AND a.i - 5 AND b.h > a.c GROUP BY a.k, a.t, a.c",
)

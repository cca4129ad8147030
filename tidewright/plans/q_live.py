"""Queries of live orders in windows of eight hours, and of audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import scalar as S
from tidewright.operators import bars as B
from tidewright.operators import live as V
from tidewright.sources import tables as T

from .registry import add
from .shaping import r, rounded

_HOURS = 8


def path(spark, d):
    """Ticks as rows of windows of eight hours: the price gives the quotes, the size the forecast."""
    x = T.ticks(spark, d).withColumn("w", B.bucket(f"{_HOURS} hours"))
    ends = x.groupBy("k", "w").agg(F.min_by("px", F.struct("t", "id")).alias("a"), F.max_by("px", F.struct("t", "id")).alias("z"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ask = S.clamp(F.round("px"), 2, 98)
    return x.join(ends, ["k", "w"]).select(
        "k", "w", "t", "id", (_HOURS * 60 - (micros("t") - micros("w")) / 60_000_000).alias("left"), S.clamp(F.col("size") / 100, 0.01, 0.99).alias("p"), (ask / 100).alias("market"), (ask - 1).alias("bid"), ask.alias("ask"),
        (F.col("z") >= F.col("a")).cast("int").alias("y"), (F.col("w") + F.expr(f"interval {_HOURS} hours")).alias("closes"),
    )


PATH = (
    f"{T.TICKS}, seen AS (SELECT *, time_bucket(INTERVAL '8 hours', t) AS w, greatest(2.0, least(98.0, round(px))) AS ask FROM ticks), "
    "path AS (SELECT k, w, t, id, 480 - date_diff('microsecond', w, t)::DOUBLE / 60000000 AS lft, greatest(0.01::DOUBLE, least(0.99::DOUBLE, size / 100)) AS p, ask / 100 AS market, ask - 1 AS bid, ask, "
    "(last_value(px) OVER z >= first_value(px) OVER z)::INTEGER AS y, w + INTERVAL '8 hours' AS closes FROM seen WINDOW z AS (PARTITION BY k, w ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
)
_PHASES = ([120.0, 300.0], ["late", "mid", "early"])


def minute_calls(spark, d):
    return V.minute_calls(path(spark, d), _PHASES, {"late": 1.2, "mid": 0.8, "early": 0.5}, {"late": 0.9, "mid": 0.6}, 0.7)


add(
    "minute_calls",
    minute_calls,
    f"WITH {PATH}, f AS (SELECT *, date_trunc('minute', t) AS slot FROM path WHERE lft >= 1 QUALIFY row_number() OVER (PARTITION BY k, w, date_trunc('minute', t) ORDER BY t, id) = 1), "
    "g AS (SELECT *, CASE WHEN lft < 120 THEN 'late' WHEN lft < 300 THEN 'mid' ELSE 'early' END AS phase FROM f), h AS (SELECT *, CASE phase WHEN 'late' THEN 1.2 WHEN 'mid' THEN 0.8 ELSE 0.5 END::DOUBLE AS c, CASE phase WHEN 'late' THEN 0.9 WHEN 'mid' THEN 0.6 ELSE 1 END::DOUBLE AS b FROM g), "
    "i AS (SELECT *, round(greatest(0.01, least(0.99, 0.5::DOUBLE + c * (p - 0.5::DOUBLE))), 4) AS calibrated FROM h), j AS (SELECT k, w, slot, phase, 'calibrated' AS variant, calibrated AS p FROM i UNION ALL SELECT k, w, slot, phase, 'blended', round(greatest(0.01, least(0.99, b * calibrated + (1 - b) * market)), 4) FROM i) "
    "SELECT *, (p >= 0.5)::INTEGER AS call, (greatest(p, 1 - p) >= 0.7)::INTEGER AS sure FROM j",
)


def orders(spark, d):
    """Sure calls rest six cents under their ask."""
    x = path(spark, d).where(V.confidence(F.col("p")) >= 0.8).withColumn("up", F.col("p") >= 0.5)
    return x.select("k", "w", "t", "id", "up", (V.side_ask(F.col("up")) - 6).alias("limit"))


_SIDE = "CASE WHEN {0} THEN {1}ask ELSE 100 - {1}bid END"


def _fills_sql(guard: str) -> str:
    """Pairs of each order and later quotes, and the first of those that fill it."""
    ask, chance = _SIDE.format("o.up", "q."), "CASE WHEN o.up THEN q.p ELSE 1 - q.p END"
    return (
        f"{PATH}, o AS (SELECT *, p >= 0.5 AS up, {_SIDE.format('p >= 0.5', '')} - 6 AS lim FROM path WHERE greatest(p, 1 - p) >= 0.8 QUALIFY row_number() OVER (PARTITION BY k, w ORDER BY t, id) = 1), "
        f"hits AS (SELECT o.k, o.w, q.t AS ft, {ask} AS fa FROM o JOIN path q ON q.k = o.k AND q.w = o.w AND q.t > o.t AND {ask} BETWEEN 5 AND o.lim {guard.format(ask=ask, chance=chance)} QUALIFY row_number() OVER (PARTITION BY o.k, o.w ORDER BY q.t, q.id) = 1), "
        "fills AS (SELECT o.*, ft, fa FROM o LEFT JOIN hits USING (k, w))"
    )


_GUARD = "AND ({chance}) * 100 >= ({ask}) + 7::DOUBLE * (({ask}) / 100) * (1 - ({ask}) / 100) + 4"


def resting_limits(spark, d):
    return V.resting_limits(orders(spark, d), path(spark, d))


add("resting_limits", resting_limits, f'WITH {_fills_sql("")} SELECT k, w, t, id, up, lim AS "limit", ft AS filled_t, fa AS ask, ft IS NULL AS skipped FROM fills')


def guarded_limits(spark, d):
    return V.resting_limits(orders(spark, d), path(spark, d), margin=4.0)


add("guarded_limits", guarded_limits, f'WITH {_fills_sql(_GUARD)} SELECT k, w, t, id, up, lim AS "limit", ft AS filled_t, fa AS ask, ft IS NULL AS skipped FROM fills')


def settled_limits(spark, d):
    """Orders of windows, of which every seventh day's results are not in."""
    x = path(spark, d)
    results = x.where(F.dayofmonth("w") % 7 > 0).groupBy("k", "w").agg(F.max("closes").alias("closes"), F.max("y").alias("y"))
    return rounded(V.settle_limits(V.resting_limits(orders(spark, d), x), results, 2000.0, 100_000.0), 4)


add(
    "settled_limits",
    settled_limits,
    f"WITH {_fills_sql('')}, s AS (SELECT k, w, up, ft, fa, CASE WHEN day(w) % 7 > 0 THEN closes END AS due, CASE WHEN day(w) % 7 > 0 THEN y END AS res, CASE WHEN ft IS NULL THEN 0.0 ELSE floor(2000 / (fa + 7::DOUBLE * (fa / 100) * (1 - fa / 100))) END::DOUBLE AS n FROM fills), "
    "u AS (SELECT *, CASE WHEN n > 0 THEN floor(n * fa) + ceil(round(7::DOUBLE * (fa / 100) * (1 - fa / 100) * n, 9)) ELSE 0 END::DOUBLE AS stake, CASE WHEN ft IS NULL THEN -1 ELSE res END AS outcome, CASE WHEN ft IS NOT NULL THEN (up = (res = 1))::INTEGER END AS win FROM s), "
    "v AS (SELECT *, CASE WHEN ft IS NULL THEN 0.0 ELSE 100 * n * win END AS paid FROM u), spent AS (SELECT k, coalesce(ft, due) AS moment, -stake AS cents FROM v), back AS (SELECT k, due AS moment, coalesce(paid, 0) AS cents FROM v) "
    "SELECT k, w, n AS contracts, stake, outcome, win, paid - stake AS pnl, CASE WHEN outcome IS NOT NULL AND due IS NOT NULL THEN 100000.0 + (SELECT sum(cents) FROM spent WHERE spent.k = v.k AND moment <= v.due) + (SELECT sum(cents) FROM back WHERE back.k = v.k AND moment <= v.due) END::DOUBLE AS purse FROM v",
)


def dip_entries(spark, d):
    return V.dip_entries(path(spark, d), (120.0, 420.0), 0.75, 0.2, 10.0, 60.0)


_EVENT = "CASE WHEN CASE WHEN c.up THEN p.p ELSE 1 - p.p END < 0.2 THEN 'INVALIDATED' WHEN c.call_ask - (" + _SIDE.format("c.up", "p.") + ") >= 10 THEN 'TRIGGERED' END"
add(
    "dip_entries",
    dip_entries,
    f"WITH {PATH}, c AS (SELECT *, p >= 0.5 AS up, {_SIDE.format('p >= 0.5', '')} AS call_ask FROM path WHERE lft BETWEEN 120 AND 420 AND greatest(p, 1 - p) >= 0.75 QUALIFY row_number() OVER (PARTITION BY k, w ORDER BY t, id) = 1), "
    f"e AS (SELECT c.k, c.w, {_EVENT} AS event, {_SIDE.format('c.up', 'p.')} AS a FROM c JOIN path p ON p.k = c.k AND p.w = c.w AND (p.t, p.id) > (c.t, c.id) AND p.lft >= 60 WHERE {_EVENT} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c.k, c.w ORDER BY p.t, p.id) = 1), a AS (SELECT DISTINCT k, w FROM path) "
    "SELECT k, w, CASE WHEN up IS NULL THEN 'NO_THESIS' ELSE coalesce(event, 'MISSED') END AS state, up, call_ask, CASE WHEN event = 'TRIGGERED' THEN a END AS entry_ask, CASE WHEN event = 'TRIGGERED' THEN call_ask - a END AS improvement FROM a LEFT JOIN c USING (k, w) LEFT JOIN e USING (k, w)",
)


def excursions(spark, d):
    return rounded(V.excursions(path(spark, d), (120.0, 420.0), ([0.75, 0.85, 0.95], ["low", "75", "85", "95"])), 4)


add(
    "excursions",
    excursions,
    f"WITH {PATH}, x AS (SELECT *, p >= 0.5 AS up, CASE WHEN greatest(p, 1 - p) < 0.75 THEN 'low' WHEN greatest(p, 1 - p) < 0.85 THEN '75' WHEN greatest(p, 1 - p) < 0.95 THEN '85' ELSE '95' END AS band FROM path), "
    "c AS (SELECT * FROM x WHERE lft BETWEEN 120 AND 420 QUALIFY row_number() OVER (PARTITION BY k, w, band ORDER BY t, id) = 1), "
    f"s AS (SELECT c.band, any_value(c.up = (c.y = 1)) AS won, any_value({_SIDE.format('c.up', 'c.')}) AS a, min({_SIDE.format('c.up', 'q.')}) AS later FROM c JOIN path q ON q.k = c.k AND q.w = c.w AND (q.t, q.id) > (c.t, c.id) GROUP BY c.k, c.w, c.band) "
    f"SELECT band, count(*) AS n, {r('avg(won::INTEGER)', 4)} AS win_rate, {r('avg(a)', 4)} AS entry_ask, {r('avg(later)', 4)} AS least_later_ask, {r('avg((a - later >= 10)::INTEGER)', 4)} AS fell_10, {r('avg((a - later >= 20)::INTEGER)', 4)} AS fell_20 FROM s GROUP BY 1",
)


def divergence_residual(spark, d):
    phases = {"early": (360.0, 480.0), "mid": (180.0, 300.0), "late": (10.0, 120.0)}
    return rounded(V.divergence(path(spark, d), phases, {"10-20": (0.1, 0.2), "over 20": (0.2, 1.0)}), 4)


add(
    "divergence_residual",
    divergence_residual,
    f"WITH {PATH}, x AS (SELECT *, CASE WHEN lft BETWEEN 360 AND 480 THEN 'early' WHEN lft BETWEEN 180 AND 300 THEN 'mid' WHEN lft BETWEEN 10 AND 120 THEN 'late' END AS phase FROM path), "
    "f AS (SELECT *, round(abs(p - market), 6) AS g, p > market AS up FROM x WHERE phase IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, w, phase ORDER BY t, id) = 1), "
    "b AS (SELECT *, CASE WHEN g >= 0.1::DOUBLE AND g < 0.2::DOUBLE THEN '10-20' WHEN g >= 0.2::DOUBLE AND g < 1 THEN 'over 20' END AS band FROM f) "
    f"SELECT phase, band, count(*) AS n, {r('avg(CASE WHEN up THEN market ELSE 1 - market END)', 4)} AS implied, {r('avg((up = (y = 1))::INTEGER)', 4)} AS won, {r('100 * (avg((up = (y = 1))::INTEGER) - avg(CASE WHEN up THEN market ELSE 1 - market END))', 4)} AS residual FROM b WHERE band IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10",
)


def bets(spark, d):
    return T.windows(spark, d).withColumn("price", F.round(F.col("market") * 100))


_BETS = f"{T.WINDOWS}, bets AS (SELECT *, round(market * 100) AS price FROM windows), paid AS (SELECT *, ceil(round(7::DOUBLE * (price / 100) * (1 - price / 100), 9)) AS fee FROM bets)"


def operating_point(spark, d):
    return V.operating_point(bets(spark, d), 0.93)


add(
    "operating_point",
    operating_point,
    f"WITH {_BETS}, g AS (SELECT unnest(range(50, 96)) AS s), a AS (SELECT k, s, count(*) FILTER (kept) AS n, round(avg(y) FILTER (kept), 3) AS prec, round(sum(100 * y - price - fee) FILTER (kept), 1) AS profit, count(*) AS scored FROM (SELECT *, p >= greatest(s::DOUBLE / 100, (price + fee) / 100) AS kept FROM paid, g) GROUP BY 1, 2), "
    "b AS (SELECT *, prec >= 0.93::DOUBLE AS met FROM a WHERE n >= 15 QUALIFY row_number() OVER (PARTITION BY k ORDER BY prec >= 0.93::DOUBLE DESC, CASE WHEN prec >= 0.93::DOUBLE THEN 0 ELSE prec END DESC, profit DESC, s) = 1) "
    "SELECT k, coalesce(s::DOUBLE / 100, 0.5) AS theta, prec AS precision, round(n / scored, 3) AS coverage, profit, coalesce(n, 0) AS kept, coalesce(met, false) AS met_target FROM (SELECT DISTINCT k FROM bets) LEFT JOIN b USING (k)",
)


def selection_economics(spark, d):
    x = bets(spark, d)
    fee = S.fee_per_contract(F.col("price"))
    return rounded(V.selection_economics(x.where(F.col("p") >= 0.5).withColumn("pnl", 100 * F.col("y") - F.col("price") - fee)), 4)


add(
    "selection_economics",
    selection_economics,
    f"WITH {_BETS}, x AS (SELECT *, 100 * y - price - fee AS pnl, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY k) AS total FROM paid WHERE p >= 0.5), "
    "s AS (SELECT *, CASE WHEN i < floor(total * 0.6::DOUBLE) THEN 'train' WHEN i < floor(total * 0.8::DOUBLE) THEN 'validation' ELSE 'holdout' END AS split FROM x), c AS (SELECT *, sum(pnl) OVER (PARTITION BY k, split ORDER BY t) AS run FROM s), "
    "f AS (SELECT *, max(run) OVER (PARTITION BY k, split ORDER BY t) - run AS fall, row_number() OVER (PARTITION BY k, split ORDER BY pnl DESC, t) AS top FROM c) "
    f"SELECT k, split, count(*) AS n, {r('100 * avg((p - price / 100 - fee / 100) / (price / 100 + fee / 100))', 4)} AS mean_ev, {r('sum(pnl)', 4)} AS pnl, {r('avg((pnl > 0)::INTEGER)', 4)} AS win_rate, {r('max(fall)', 4)} AS drawdown, "
    f"{r('coalesce(sum(pnl) FILTER (pnl > 0 AND top <= 3), 0) / coalesce(nullif(sum(pnl) FILTER (pnl > 0), 0), 1)', 4)} AS top_share FROM f GROUP BY 1, 2",
)


def lead_lag(spark, d):
    """At each full hour of bars, of three kinds of events as venues."""
    at = T.hourly(spark, d).select("t").distinct()
    return rounded(V.lead_lag(at, T.ticks(spark, d), ("view", "click", "purchase"), "30 minutes", "120 minutes", "4 hours", "3 hours"), 4)


_LAGS = "(VALUES ('now', INTERVAL '0 minutes'), ('short', INTERVAL '30 minutes'), ('long', INTERVAL '120 minutes')) l(span, lag)"
add(
    "lead_lag",
    lead_lag,
    f"WITH {T.BARS}, q AS (SELECT k, t, px FROM ticks QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY id DESC) = 1), d AS (SELECT DISTINCT t AS moment FROM bars), a AS (SELECT moment, v.k, span, lag, moment - lag AS t FROM d, (VALUES ('view'), ('click'), ('purchase')) v(k), {_LAGS}), "
    "m AS (SELECT a.*, q.t AS qt, q.px FROM a ASOF LEFT JOIN q ON a.k = q.k AND a.t >= q.t), "
    "e AS (SELECT moment, k, max(px) FILTER (span = 'now') AS px, coalesce(bool_or(qt >= t - INTERVAL '3 hours') FILTER (span = 'now'), false) AS fresh, max(px) FILTER (span = 'now' AND qt >= t - INTERVAL '4 hours') AS p, "
    "max(px) FILTER (span = 'short' AND qt >= t - INTERVAL '4 hours' - lag) AS s, max(px) FILTER (span = 'long' AND qt >= t - INTERVAL '4 hours' - lag) AS l FROM m GROUP BY 1, 2), "
    "b AS (SELECT *, 10000 * ln(p / s) AS rs, 10000 * ln(p / l) AS rl FROM e), "
    "o AS (SELECT moment, count(*) FILTER (fresh AND k IN ('view', 'click')) = 2 AS ok, coalesce(max(rs) FILTER (k = 'view'), 0) AS a_s, coalesce(max(rs) FILTER (k = 'click'), 0) AS b_s, coalesce(max(rl) FILTER (k = 'purchase'), 0) AS c_l, coalesce(max(rl) FILTER (k = 'view'), 0) AS a_l, coalesce(max(rl) FILTER (k = 'click'), 0) AS b_l, coalesce(avg(rl), 0) AS cons, "
    "list_sort(list(rl) FILTER (rl IS NOT NULL)) AS ls, list_sort(list(px) FILTER (fresh)) AS ps, count(*) FILTER (fresh) AS nf FROM b GROUP BY 1), "
    "f AS (SELECT *, coalesce(ls[len(ls) // 2 + 1], 0) AS md, ps[len(ps) // 2 + 1] AS pm FROM o) "
    f"SELECT moment AS t, CASE WHEN ok THEN {r('a_s', 4)} END AS a_short, CASE WHEN ok THEN {r('b_s', 4)} END AS b_short, CASE WHEN ok THEN {r('c_l', 4)} END AS c_long, CASE WHEN ok THEN {r('cons', 4)} END AS consensus, "
    f"CASE WHEN ok THEN {r('CASE WHEN len(ps) >= 2 THEN 10000 * list_max(list_transform(ps, lambda x: abs(x - pm) / pm)) ELSE 0 END', 4)} END AS dispersion, CASE WHEN ok THEN {r('a_l - md', 4)} END AS a_lead, CASE WHEN ok THEN {r('b_l - md', 4)} END AS b_lead, nf AS n_fresh FROM f",
)


def graded_losses(spark, d):
    """Line items as lost bets, with numbers that hang on their keys."""
    x, key, part, supp = T.table(spark, d, "lineitem"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    n = F.col("l_quantity")
    ask = (F.lit(10.0) + part % 80).cast("double")
    losses = x.select(
        key.alias("id"), F.col("l_linenumber").alias("line"), F.when(key % 9 > 0, (key % 100) / 100).alias("p"), F.when(part % 17 > 0, ask).alias("ask"), (n * 2).alias("fee"), n.alias("contracts"), (n * ask).alias("stake"), (F.lit(100.0) + (supp % 50) * 100).alias("purse"),
        F.when(supp % 3 > 0, (supp % 10) / 10).alias("regime"), F.when(key % 4 == 0, 0.1).alias("tau"), F.lit(0.8).alias("cap"), (key % 41 == 0).cast("int").alias("win"), (-n).alias("pnl"), (key % 5 == 0).alias("limit_order"),
    )
    return V.graded_losses(losses).groupBy("grade", "severity", "cause").agg(F.count("*").alias("n"), F.sum("stake").alias("staked"))


add(
    "graded_losses",
    graded_losses,
    "WITH s AS (SELECT l_orderkey AS key, l_suppkey AS supp, CASE WHEN l_orderkey % 9 > 0 THEN (l_orderkey % 100)::DOUBLE / 100 END AS p, CASE WHEN l_partkey % 17 > 0 THEN 10.0::DOUBLE + l_partkey % 80 END AS ask, (10.0::DOUBLE + l_partkey % 80) * l_quantity AS stake, 100.0::DOUBLE + (l_suppkey % 50) * 100 AS purse, CASE WHEN l_suppkey % 3 > 0 THEN (l_suppkey % 10)::DOUBLE / 10 END AS regime, l_quantity AS n FROM lineitem), "
    "t AS (SELECT *, ask + n * 2 / greatest(n, 1) AS cost, stake / (purse + stake) AS share FROM s), u AS (SELECT *, greatest(0, (p - cost / 100) / nullif(1 - cost / 100, 0)) AS kelly FROM t), "
    "v AS (SELECT *, coalesce(kelly > 0 AND share > 2 * kelly AND p IS NOT NULL AND cost <> 100 AND cost IS NOT NULL, false) AS over, coalesce(abs(cost - 50) < 10, false) AS near, coalesce(regime < 0.62::DOUBLE, false) AS weak, coalesce(key % 4 = 0 AND p < 0.1::DOUBLE - 1e-9::DOUBLE, false) OR coalesce(ask > 85, false) OR share > 0.8::DOUBLE * 1.1::DOUBLE + 1e-9::DOUBLE AS breach FROM u), "
    "w AS (SELECT *, CASE WHEN key % 41 = 0 AND n > 0 THEN 0 WHEN breach THEN 1 WHEN p >= 0.77::DOUBLE THEN 2 WHEN over THEN 3 WHEN near OR weak THEN 4 ELSE 5 END AS severity, CASE WHEN over THEN 'sizing' WHEN key % 5 = 0 THEN 'execution' WHEN near THEN 'price' WHEN weak THEN 'regime' ELSE 'signal' END AS cause FROM v) "
    "SELECT ['INTEGRITY', 'POLICY_BREACH', 'CONFIDENT_WRONG', 'OVERSIZED', 'BAD_CONTEXT', 'EXPECTED_VARIANCE'][severity + 1] AS grade, severity, cause, count(*) AS n, sum(stake) AS staked FROM w GROUP BY 1, 2, 3",
)


def encoded_features(spark, d):
    """Customers as candidates, with states that hang on their keys; some are unknown or missing."""
    c = F.col("c_custkey")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by + 1).cast("int"))
    x = T.table(spark, d, "customer").select(
        c.alias("id"), pick(["up", "down", "flat"], c % 3).alias("direction"), ((c % 21 - 10) / 100).alias("expected_return"), (c % 97 / 100).alias("confidence"), F.when(c % 6 > 0, c % 5).alias("reward_risk"), (c % 11 / 10).alias("trend_strength"), pick(["uptrend", "downtrend", "ranging", "sideways"], c % 4).alias("trend"),
        F.when(c % 8 > 0, c % 40 / 10).alias("relative_volume"), F.when(c % 5 > 0, pick(["low", "normal", "high", "extreme", "wild"], c % 5)).alias("regime"), (c % 13 / 1000).alias("atr_pct"),
    )
    return rounded(V.encoded_features(x))


add(
    "encoded_features",
    encoded_features,
    "WITH s AS (SELECT c_custkey AS id, c_custkey AS c, CASE WHEN c_custkey % 8 > 0 THEN (c_custkey % 40)::DOUBLE / 10 ELSE 0 END AS rv, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 END AS g FROM customer) "
    f"SELECT id, (c % 3 = 0)::INTEGER::DOUBLE AS forecast_up, {r('(c % 21 - 10)::DOUBLE / 100')} AS expected_return, {r('(c % 97)::DOUBLE / 100')} AS confidence, CASE WHEN c % 6 > 0 THEN c % 5 ELSE 0 END::DOUBLE AS reward_risk, 0.0::DOUBLE AS trouble_distance, {r('(c % 11)::DOUBLE / 10')} AS structure_score, "
    f"{r('least(rv / 2, 1.0)')} AS liquidity_score, (g IS NULL OR g = 1)::INTEGER::DOUBLE AS volatility_ok, {r('(c % 13)::DOUBLE / 1000')} AS atr_pct, CASE g WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END::DOUBLE AS regime_code, {r('rv')} AS relative_volume, {r('(c % 11)::DOUBLE / 10')} AS trend_strength, CASE c % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END::DOUBLE AS trend_code FROM s",
)


def ledger_audit(spark, d):
    """Line items as settled bets: is a recorded fee that of the order, is the decision in its envelope of 12 minutes, is
    a purse within its start, does no winner lose. Some rows carry a fee rounded for each contract."""
    x, key = T.table(spark, d, "lineitem"), F.col("l_orderkey")
    price, n = (F.lit(1) + F.col("l_partkey") % 98).cast("double"), F.col("l_quantity")
    fee = F.when(key % 10 == 0, S.fee_per_contract(price) * n).otherwise(S.fee_per_order(price, n))
    checks = {
        "fee parity": fee == S.fee_per_order(price, n), "decision quote age": F.when(key % 3 > 0, key % 14 <= 12.05), "purse within start": F.when(F.col("l_suppkey") % 7 > 0, F.col("l_extendedprice") <= 90_000.0), "winners gain": ~((key % 2 == 0) & (F.col("l_discount") < F.col("l_tax"))),
    }
    return V.audited(x, checks, "l_orderkey")


_FEE = "7::DOUBLE * (price / 100) * (1 - price / 100)"
add(
    "ledger_audit",
    ledger_audit,
    f"WITH s AS (SELECT *, l_orderkey AS key, (1 + l_partkey % 98)::DOUBLE AS price FROM lineitem), c AS (SELECT key, 'fee parity' AS \"check\", key % 10 > 0 OR ceil(round({_FEE}, 9)) * l_quantity = ceil(round({_FEE} * l_quantity, 9)) AS ok FROM s "
    "UNION ALL SELECT key, 'decision quote age', key % 14 <= 12.05 FROM s WHERE key % 3 > 0 UNION ALL SELECT key, 'purse within start', l_extendedprice <= 90000 FROM s WHERE l_suppkey % 7 > 0 UNION ALL SELECT key, 'winners gain', key % 2 = 1 OR l_discount >= l_tax FROM s) "
    'SELECT "check", count(*) AS n, count(*) FILTER (NOT ok) AS broken, min(key) FILTER (NOT ok) AS example FROM c GROUP BY 1',
)


def runtime_state(spark, d):
    """Users as desks, their events as reports, on the evening of 20 January."""
    x = T.ticks(spark, d)
    value = F.when(F.col("size") >= 90, "red").when(F.col("size") >= 40, "STALE").when(F.col("size") >= 5, "fine")
    reports = x.select(F.col("user_id").alias("k"), "t", "id", F.col("k").alias("name"), value.alias("value"))
    now = F.lit("2024-01-20 18:00:00").cast("timestamp_ntz")
    return V.runtime_state(T.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), reports, now, {"error": "red", "purchase": "red"}, "view", "12 days")


_WHY = " ".join(f"WHEN {n}_t IS NULL OR {n}_t < TIMESTAMP '2024-01-08 18:00:00' THEN '{n} missing or stale' WHEN {n}_v IS NULL THEN '{n} unreadable' WHEN {n}_v = 'red' THEN '{n} is red'" for n in ("error", "purchase"))
add(
    "runtime_state",
    runtime_state,
    f"WITH {T.TICKS}, s AS (SELECT user_id, k AS name, t, CASE WHEN size >= 90 THEN 'red' WHEN size >= 40 THEN 'STALE' WHEN size >= 5 THEN 'fine' END AS v FROM ticks WHERE t <= TIMESTAMP '2024-01-20 18:00:00' QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY t DESC, id DESC) = 1), "
    + "p AS (SELECT user_id AS k, "
    + ", ".join(f"max(t) FILTER (name = '{n}') AS {n}_t, max(v) FILTER (name = '{n}') AS {n}_v" for n in ("error", "purchase", "view"))
    + f" FROM s GROUP BY 1), w AS (SELECT c.c_custkey AS k, CASE {_WHY} END AS why, view_v IN ('STALE', 'UNKNOWN') AS dull FROM customer c LEFT JOIN p ON p.k = c.c_custkey) "
    "SELECT k, CASE WHEN why IS NOT NULL THEN 'FREEZE' WHEN dull THEN 'DEGRADED' ELSE 'NORMAL' END AS state, coalesce(why, CASE WHEN dull THEN 'view is STALE' END) AS why FROM w",
)


def treatments(spark, d):
    x = V.decisions_of(path(spark, d), 400.0)
    return rounded(V.paired_treatments(V.treatments(x, ["p", "market"], lookback=10, floor=0.55)))


_DECIDED = "dec AS (SELECT * FROM path WHERE lft <= 400 QUALIFY row_number() OVER (PARTITION BY k, w ORDER BY t, id) = 1)"
_EV = "CASE WHEN ({0}) = (y = 1) THEN (100 - ({1}) - ceil(round(7::DOUBLE * (({1}) / 100) * (1 - ({1}) / 100), 9))) / (({1}) + ceil(round(7::DOUBLE * (({1}) / 100) * (1 - ({1}) / 100), 9))) ELSE -1 END::DOUBLE"


def _arm_sql(arm: str) -> str:
    a = f"a_{arm}"
    return f"CASE WHEN {a} >= 5 AND {a} < 80 THEN {_EV.format(f'{arm} >= 0.5', a)} END AS e_{arm}"


def _trail_sql(arm: str) -> str:
    """The mean of the last twenty known values among all earlier ones, gathered in a list."""
    past = f"list_filter(list(e_{arm}) OVER z, lambda e: e IS NOT NULL)"
    return f"CASE WHEN len({past}) >= 5 THEN round(list_avg(({past})[-20:]), 9) END AS m_{arm}"


_ASK = "CASE WHEN {0} >= 0.5 THEN 100 * market + 2.5 ELSE 100 * (1 - market) + 2.5 END::DOUBLE AS a_{0}"
add(
    "treatments",
    treatments,
    f"WITH {PATH}, {_DECIDED}, a AS (SELECT *, {_ASK.format('p')}, {_ASK.format('market')} FROM dec), e AS (SELECT *, {_arm_sql('p')}, {_arm_sql('market')}, {_EV.format('p >= 0.5', 'a_p')} AS bet, {_EV.format('market >= 0.5', 'a_market')} AS bet_market FROM a), "
    f"m AS (SELECT *, {_trail_sql('p')}, {_trail_sql('market')}, CASE WHEN count(*) OVER y10 >= 10 THEN avg(((market >= 0.5) = (y = 1))::INTEGER) OVER y10 END AS regime FROM e WINDOW z AS (PARTITION BY k ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y10 AS (PARTITION BY k ORDER BY w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), "
    "g AS (SELECT *, coalesce(regime < 0.55::DOUBLE, false) AS bad, abs(market - 0.5) < 0.1 AS near FROM m), "
    "s AS (SELECT k, bet AS champion, CASE WHEN NOT bad THEN bet END AS regime, CASE WHEN NOT near THEN bet END AS knife, CASE WHEN a_p <= 51 THEN bet END AS cheap, CASE WHEN NOT bad AND NOT near THEN bet END AS \"both\", "
    "CASE WHEN m_p IS NULL AND m_market IS NULL THEN NULL WHEN m_p IS NULL OR m_market > m_p THEN bet_market ELSE bet END AS leader FROM g), "
    "u AS (" + " UNION ALL ".join(f"SELECT k, '{n}' AS policy, \"{n}\" AS ev, champion AS c FROM s" for n in ("champion", "regime", "knife", "cheap", "both", "leader")) + ") "
    f"SELECT k, policy, count(*) AS windows, count(ev) AS bets, {r('avg(ev)')} AS ev, {r('avg(coalesce(ev, 0) - coalesce(c, 0))')} AS difference FROM u GROUP BY 1, 2",
)


def economic_replay(spark, d):
    return rounded(V.economic_replay(V.decisions_of(path(spark, d), 400.0), 0.7))


_COST = f"({_SIDE.format('p >= 0.5', '')})"
add(
    "economic_replay",
    economic_replay,
    f"WITH {PATH}, {_DECIDED}, c AS (SELECT *, {_COST} + 7::DOUBLE * ({_COST} / 100) * (1 - {_COST} / 100) AS cost, greatest(p, 1 - p) >= 0.7 AS taken FROM dec), g AS (SELECT *, CASE WHEN NOT taken THEN 0 WHEN (p >= 0.5) = (y = 1) THEN (100 - cost) / cost ELSE -1 END AS gain FROM c), "
    "h AS (SELECT *, sum(gain) OVER (PARTITION BY k ORDER BY w) AS run FROM g), f AS (SELECT *, run - greatest(max(run) OVER (PARTITION BY k ORDER BY w), 0) AS fall FROM h) "
    f"SELECT k, count(*) AS n, count(*) FILTER (taken) AS fills, {r('avg(gain)')} AS ev_per_eligible, {r('sum(gain) / nullif(count(*) FILTER (taken), 0)')} AS gain_per_fill, {r('count(*) FILTER (taken) / count(*)')} AS coverage, {r('min(fall)')} AS drawdown FROM f GROUP BY 1",
)

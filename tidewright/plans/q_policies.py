"""Queries of policies, their pairing with the champion, and stakes."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tidewright.functions.scalar import fee_per_contract
from tidewright.operators import policies as P
from tidewright.sources import tables as T

from .registry import add
from .shaping import r, rounded


def _decisions(spark, d):
    """Windows as decisions, their other chances and later asks made from their own numbers."""
    w = T.windows(spark, d)
    far = lambda c: F.lit(0.5) + (F.col(c) - 0.5) * 8
    w = w.withColumn("m", far("market")).withColumn("q", far("p"))
    ask = lambda x: F.greatest(F.lit(1.0), F.least(F.lit(99.0), 100 * x + 2.5))
    later = F.array(*(F.struct((F.col("ask_yes") - s).alias("yes"), (F.col("ask_no") - s).alias("no")) for s in (1.0, 2.25, 4.0)))
    w = w.withColumn("ask_yes", ask(F.col("m"))).withColumn("ask_no", ask(1 - F.col("m")))
    return w.select(
        "k", "t", "n", F.col("q").alias("p"), "y", "ask_yes", "ask_no", (F.when(F.col("q") >= 0.5, F.col("ask_yes")).otherwise(F.col("ask_no")) + F.col("n") % 5).alias("ask_paid"), F.col("m").alias("market"), F.when(F.col("n") % 4 != 0, F.lit(0.5) + (F.col("n") % 3) / 10).alias("regime"),
        F.when(F.col("n") % 6 != 0, (F.col("q") + F.col("m")) / 2).alias("p_cal"), F.when(F.col("n") % 5 != 0, 1 - F.col("q")).alias("p_shared"), F.col("m").alias("p_earner"), F.when(F.col("n") % 2 == 0, later).otherwise(F.array().cast("array<struct<yes: double, no: double>>")).alias("later"),
    )


def policy_gains(spark, d):
    """Bets and mean gain of each policy."""
    x = P.policy_evs(_decisions(spark, d))
    return rounded(x.groupBy("k", "policy").agg(F.count("*").alias("windows"), F.count("ev").alias("bets"), F.avg("ev").alias("ev")))


_D = (
    f"{T.WINDOWS}, d0 AS (SELECT *, 0.5 + (market - 0.5) * 8 AS m, 0.5 + (p - 0.5) * 8 AS q FROM windows), d1 AS (SELECT *, greatest(1.0, least(99.0, 100 * m + 2.5)) AS ay, greatest(1.0, least(99.0, 100 * (1 - m) + 2.5)) AS an FROM d0), "
    "d AS (SELECT k, t, n, q, y, m, q >= 0.5 AS up, ay, an, CASE WHEN q >= 0.5 THEN ay ELSE an END AS own, CASE WHEN n % 4 <> 0 THEN 0.5 + (n % 3) / 10 END AS regime, CASE WHEN n % 6 <> 0 THEN (q + m) / 2 END AS pc, CASE WHEN n % 5 <> 0 THEN 1 - q END AS ps, m AS pe FROM d1)"
)
_G = lambda side, ask: f"CASE WHEN ({side}) IS NULL OR ({ask}) IS NULL THEN NULL WHEN ({side}) = (y = 1) THEN (100 - ({ask}) - ceil(round(7 * (({ask}) / 100) * (1 - ({ask}) / 100), 9))) / (({ask}) + ceil(round(7 * (({ask}) / 100) * (1 - ({ask}) / 100), 9))) ELSE -1.0 END"
_BY = lambda c: f"CASE WHEN {c} IS NOT NULL AND greatest({c}, 1 - {c}) >= 0.62 THEN {_G(f'{c} >= 0.5', f'CASE WHEN {c} >= 0.5 THEN ay ELSE an END')} END"
_CALM, _CLEAR, _OWN = "NOT coalesce(regime < 0.62, false)", "NOT coalesce(abs(m - 0.5) < 0.1, false)", _G("up", "own")
_LIMIT = _G("up", "CASE WHEN n % 2 = 0 THEN CASE WHEN own - 2.25 >= 5 THEN own - 2.25 END END")
_GUARD = f"CASE WHEN n % 5 <= 3 THEN {_G('up', 'own + n % 5')} END"
_EDGE = "100 * greatest(q, 1 - q) - (own + 7 * (own / 100) * (1 - own / 100))"
_EVS = {
    "champion": _OWN, "regime": f"CASE WHEN {_CALM} THEN {_OWN} END", "knife": f"CASE WHEN {_CLEAR} THEN {_OWN} END", "calibrated": _BY("pc"), "cheap": f"CASE WHEN own <= 51 THEN {_OWN} END", "both": f"CASE WHEN {_CALM} AND {_CLEAR} THEN {_OWN} END", "shared": _BY("ps"), "shared_regime": f"CASE WHEN {_CALM} THEN {_BY('ps')} END",
    "champion_paid": _G("up", "own + n % 5"), "guard": _GUARD, "guard_regime": f"CASE WHEN {_CALM} THEN {_GUARD} END", "limit": _LIMIT, "limit_regime": f"CASE WHEN {_CALM} THEN {_LIMIT} END", "earner": _BY("pe"), "edge_band": f"CASE WHEN {_EDGE} BETWEEN 2 AND 12 THEN {_OWN} END",
}
_V = f"{_D}, v AS (" + " UNION ALL ".join(f"SELECT k, t, n, regime, '{n}' AS policy, {e} AS ev FROM d" for n, e in _EVS.items()) + ")"
add("policy_gains", policy_gains, f"WITH {_V} SELECT k, policy, count(*) AS windows, count(ev) AS bets, {r('avg(ev)')} AS ev FROM v GROUP BY 1, 2")


def _pairs(spark, d):
    """All policies but the champion against it; a key and a policy are one name."""
    x = P.policy_evs(_decisions(spark, d))
    base = x.where("policy = 'champion'").select("k", "t", F.col("ev").alias("base"))
    more = _decisions(spark, d).select("k", "t", "n", "regime")
    out = x.where("policy in ('both', 'calibrated', 'edge_band')").join(base, ["k", "t"]).join(more, ["k", "t"])
    return out.withColumn("k", F.concat_ws(":", "k", "policy")).withColumn("regime_band", F.when(F.col("regime") < 0.62, "below").when(F.col("regime") >= 0.62, "above")).withColumn("hours", F.floor(F.hour("t") / 6)).withColumn("kind", F.when(F.col("n") % 3 != 0, F.col("n") % 3))


def policy_pairs(spark, d):
    return rounded(P.paired_review(_pairs(spark, d)), 5)


_PAIR = f"{_V}, pr AS (SELECT concat(v.k, ':', v.policy) AS k, v.t, v.n, v.regime, v.ev, c.ev AS base, coalesce(v.ev, 0) - coalesce(c.ev, 0) AS d FROM v JOIN v c ON c.k = v.k AND c.t = v.t AND c.policy = 'champion' WHERE v.policy IN ('both', 'calibrated', 'edge_band'))"
_CDF = lambda z: f"(1 + sign({z}) * (1 - (1 / (1 + abs({z}) / sqrt(2) * 0.3275911)) * (0.254829592 + (1 / (1 + abs({z}) / sqrt(2) * 0.3275911)) * (-0.284496736 + (1 / (1 + abs({z}) / sqrt(2) * 0.3275911)) * (1.421413741 + (1 / (1 + abs({z}) / sqrt(2) * 0.3275911)) * (-1.453152027 + (1 / (1 + abs({z}) / sqrt(2) * 0.3275911)) * 1.061405429)))) * exp(-({z}) * ({z}) / 2))) / 2"
_ZA, _ZB = NormalDist().inv_cdf(0.95), NormalDist().inv_cdf(0.8)
add(
    "policy_pairs",
    policy_pairs,
    f"WITH {_PAIR}, g AS (SELECT k, count(*) AS n, avg(d) AS mean, nullif(stddev_samp(d), 0) / sqrt(count(*)) AS se, quantile_cont(d, 0.5) AS median, sum(abs(d)) AS every, count(*) FILTER (ev IS NOT NULL AND base IS NOT NULL) AS together, count(*) FILTER (ev IS NOT NULL AND base IS NULL) AS alone, count(*) FILTER (ev IS NULL AND base IS NOT NULL) AS skips, "
    "count(*) FILTER (ev IS NULL AND base < 0) AS losses_avoided, count(*) FILTER (ev IS NULL AND base > 0) AS gains_forgone, coalesce(sum(base) FILTER (ev IS NULL), 0) AS on_skips FROM pr GROUP BY k), top AS (SELECT k, sum(abs(d)) AS x FROM (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(d) DESC) <= 3) GROUP BY k) "
    f"SELECT g.k, n, {r('mean', 5)} AS mean, {r('se', 5)} AS se, {r('median', 5)} AS median, {r(_CDF('mean / se'), 5)} AS p_above, {r(f'{_ZA + _ZB!r} * se', 5)} AS mde, {r(_CDF(f'(0.02 / se - {_ZA!r})'), 5)} AS power, {r('x / nullif(every, 0)', 5)} AS top3, together, alone, skips, losses_avoided, gains_forgone, {r('on_skips', 5)} AS base_on_skips, {r('-on_skips / n', 5)} AS veto_per_window FROM g JOIN top ON top.k = g.k",
)


def policy_slices(spark, d):
    return rounded(P.paired_slices(_pairs(spark, d), ["regime_band", "hours", "kind"]), 5)


_SL = lambda name, part: f"SELECT k, '{name}' AS slice, {part} AS part, count(*) AS n, {r('avg(d)', 5)} AS mean, {r('stddev_samp(d) / sqrt(count(*))', 5)} AS se FROM pr WHERE {part} IS NOT NULL GROUP BY 1, 3"
add("policy_slices", policy_slices, f"WITH {_PAIR} " + " UNION ALL ".join((_SL("regime_band", "CASE WHEN regime < 0.62 THEN 'below' WHEN regime >= 0.62 THEN 'above' END"), _SL("hours", "(hour(t) // 6)::VARCHAR"), _SL("kind", "CASE WHEN n % 3 <> 0 THEN (n % 3)::VARCHAR END"))))


def kelly_stakes(spark, d):
    """Contracts and stakes of half-Kelly bets on windows."""
    w = _decisions(spark, d)
    x = w.withColumn("s", P.kelly_contracts(F.least(F.greatest(F.col("p"), 1 - F.col("p")) + 0.2, F.lit(0.97)), F.col("ask_paid"), fee_per_contract(F.col("ask_paid")), F.lit(100_000), F.lit(2_000) + 500 * F.col("n")))
    return x.select("k", "t", "s.contracts", "s.stake")


_C = "(own + n % 5)"
add(
    "kelly_stakes",
    kelly_stakes,
    f"WITH {_D}, a AS (SELECT k, t, n, {_C} AS ask, {_C} + ceil(round(7 * ({_C} / 100) * (1 - {_C} / 100), 9)) AS cost, least(greatest(q, 1 - q) + 0.2, 0.97) AS p FROM d), b AS (SELECT *, CASE WHEN p * 100 - cost >= 10 THEN greatest(0, floor(least(floor(least(0.1::DOUBLE, 0.5::DOUBLE * greatest(0.0, (p - cost / 100) / (1 - cost / 100))) * 100000), 2000 + 500 * n) / cost)) ELSE 0 END::BIGINT AS c FROM a) "
    "SELECT k, t, c AS contracts, CASE WHEN c > 0 THEN floor(c * ask) + ceil(round(7 * (ask / 100) * (1 - ask / 100) * c, 9)) ELSE 0 END::BIGINT AS stake FROM b",
)

"""Policies on the same decision, what each would have gained, and how one stands against another on paired windows."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions.scalar import fee_continuous, fee_per_order, kelly, normal_cdf

from .live import bet_ev

#: Policies in order, with what they do. The last of each pair of names is priced at the ask that was paid.
POLICIES = {
    "champion": "the called side", "regime": "not while the market's trailing accuracy is under the floor", "knife": "not near a half", "calibrated": "side and gate by the calibrated chance", "cheap": "up to an ask", "both": "regime and knife",
    "shared": "side and gate by the expert-weighted arm", "shared_regime": "that and regime", "champion_paid": "the called side at the ask paid", "guard": "not if the ask paid is too far above the quote", "guard_regime": "that and regime",
    "limit": "a limit below the quote, filled by a later one or not at all", "limit_regime": "that and regime", "earner": "side and gate by the arm that earned most", "edge_band": "enough stated edge, and not too much",
}


def policy_evs(rows: DataFrame, tau: float = 0.62, floor: float = 0.62, knife: float = 0.10, cheap: float = 51.0, slip: float = 3.0, below: float = 2.0, least_ask: float = 5.0, edges: tuple[float, float] = (2.0, 12.0)) -> DataFrame:
    """(k, t, policy, ev): for each decision (k, t, p, y, ask_yes and ask_no in cents, ask_paid, market, regime, and the
    chances p_cal, p_shared, p_earner, null where there are none) the gain for the cost of each of POLICIES, null where it
    stands down; that is a decision, scored 0 by those who pair them. `later` holds the asks (yes, no) of the window's
    later minutes in order, for limits. Unsettled decisions (y null) have none. Nothing but the decision's own columns
    is looked at, so rows are spread at will."""
    up = F.col("p") >= 0.5
    ask = lambda side: F.when(side, F.col("ask_yes")).otherwise(F.col("ask_no"))
    gain = lambda side, price: bet_ev(side, price, F.col("y"))
    calm = ~F.coalesce(F.col("regime") < floor, F.lit(False))
    clear = ~F.coalesce(F.abs(F.col("market") - 0.5) < knife, F.lit(False))
    sure = lambda c: F.coalesce(F.greatest(F.col(c), 1 - F.col(c)) >= tau, F.lit(False)) & F.col(c).isNotNull()
    by = lambda c: F.when(sure(c), gain(F.col(c) >= 0.5, ask(F.col(c) >= 0.5)))
    own = gain(up, ask(up))
    paid = gain(up, F.col("ask_paid"))
    guard = F.when(~(F.round(F.col("ask_paid") - ask(up), 9) > slip), paid)
    reached = F.filter("later", lambda a: (F.when(up, a["yes"]).otherwise(a["no"]) >= least_ask) & (F.when(up, a["yes"]).otherwise(a["no"]) <= ask(up) - below))
    first = F.try_element_at(reached, F.lit(1))
    limit = gain(up, F.when(up, first["yes"]).otherwise(first["no"]))
    edge = 100 * F.greatest(F.col("p"), 1 - F.col("p")) - (ask(up) + fee_continuous(ask(up)))
    evs = {
        "champion": own, "regime": F.when(calm, own), "knife": F.when(clear, own), "calibrated": by("p_cal"), "cheap": F.when(ask(up) <= cheap, own), "both": F.when(calm & clear, own), "shared": by("p_shared"), "shared_regime": F.when(calm, by("p_shared")),
        "champion_paid": paid, "guard": guard, "guard_regime": F.when(calm, guard), "limit": limit, "limit_regime": F.when(calm, limit), "earner": by("p_earner"), "edge_band": F.when(edge.between(*edges), own),
    }
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), evs[n].alias("ev")) for n in POLICIES))).alias("v")
    return rows.select("k", "t", each).select("k", "t", "v.*")


def kelly_contracts(p: Column, ask: Column, fee: Column, bankroll: Column, depth: Column, least_edge: float = 10.0, half: float = 0.5, most: float = 0.10) -> Column:
    """A struct (contracts, stake) of a bet whose edge, after the fee, is least_edge cents or more: half of what Kelly bets,
    at most a share of the bankroll and the depth on offer, in whole contracts; the stake is their price cut to whole
    cents and the order's fee. Without a contract both are 0."""
    cost = ask + fee
    share = F.least(F.lit(most), half * kelly(p, cost / 100))
    n = F.when(p * 100 - cost >= least_edge, F.floor(F.least(F.floor(share * bankroll), depth) / cost)).otherwise(0).cast("long")
    n = F.greatest(F.coalesce(n, F.lit(0)), F.lit(0).cast("long"))
    return F.struct(n.alias("contracts"), F.when(n > 0, F.floor(n * ask) + fee_per_order(ask, n)).otherwise(0).cast("long").alias("stake"))


def _difference() -> Column:
    return F.coalesce("ev", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))


def paired_review(pairs: DataFrame, edge: float = 0.02, alpha: float = 0.05, beta: float = 0.2) -> DataFrame:
    """By k, of windows (k, t, ev, base): a policy's gains against those of another on the same windows, standing down (null)
    as 0. Windows n, mean, se and median of the difference, the chance that it is above 0 by the normal law, the least
    effect that n windows would show with these error rates (mde), the power to show `edge`, and the share that the three
    largest differences have of all. Windows where both bet, or one alone. Of windows that the policy skipped and the
    other didn't: how many, losses avoided, gains forgone, what the other made there, and what that adds to the mean.
    Null where n < 2 or nothing varies."""
    za, zb = NormalDist().inv_cdf(1 - alpha), NormalDist().inv_cdf(1 - beta)
    x = pairs.withColumn("_d", _difference())
    skipped = F.col("ev").isNull() & F.col("base").isNotNull()
    top = x.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc(F.abs("_d"))))).where("_r <= 3").groupBy("k").agg(F.sum(F.abs("_d")).alias("_top"))
    out = x.groupBy("k").agg(
        F.count("*").alias("n"), F.avg("_d").alias("mean"), F.stddev_samp("_d").alias("_sd"), F.percentile("_d", F.lit(0.5)).alias("median"), F.sum(F.abs("_d")).alias("_all"),
        F.count_if(F.col("ev").isNotNull() & F.col("base").isNotNull()).alias("together"), F.count_if(F.col("ev").isNotNull() & F.col("base").isNull()).alias("alone"), F.count_if(skipped).alias("skips"),
        F.count_if(skipped & (F.col("base") < 0)).alias("losses_avoided"), F.count_if(skipped & (F.col("base") > 0)).alias("gains_forgone"), F.coalesce(F.sum(F.when(skipped, F.col("base"))), F.lit(0.0)).alias("base_on_skips"),
    )
    se = F.when(F.col("_sd") > 0, F.col("_sd") / F.sqrt("n"))
    out = out.join(top, "k", "left").withColumn("se", se)
    out = out.withColumns({"p_above": normal_cdf(F.col("mean") / F.col("se")), "mde": (za + zb) * F.col("se"), "power": normal_cdf(F.lit(edge) / F.col("se") - za), "top3": F.try_divide("_top", "_all"), "veto_per_window": -F.col("base_on_skips") / F.col("n")})
    return out.drop("_sd", "_all", "_top")


def paired_slices(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(k, slice, part, n, mean, se) of the same difference, by each of some columns in one pass; a null part is left out."""
    x = pairs.withColumn("_d", _difference())
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("part")) for c in by))).alias("s")
    out = x.select("k", "_d", each).select("k", "_d", "s.*").where("part is not null").groupBy("k", "slice", "part")
    return out.agg(F.count("*").alias("n"), F.avg("_d").alias("mean"), (F.stddev_samp("_d") / F.sqrt(F.count("*"))).alias("se"))

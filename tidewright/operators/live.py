"""Live orders in windows: calls, resting limits and their settlement, dip entries, excursions, and audits of the rows.

A path has rows (k, w, t, id, left, p, market, bid, ask, y): what was known at t of the window w of a key, `left` minutes
before it closed: the forecast p that it ends up, the market's chance, quotes in cents, and how it ended. The rows of one
window meet on (k, w), so that a hot key is spread over its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions import scalar as S

from .asof import as_of


def side_ask(up: Column, bid: str | Column = "bid", ask: str | Column = "ask") -> Column:
    """Cents to buy a side: the other side's ask follows from the bid."""
    return F.when(up, F.col(ask) if isinstance(ask, str) else ask).otherwise(100 - (F.col(bid) if isinstance(bid, str) else bid))


def confidence(p: Column) -> Column:
    return F.greatest(p, 1 - p)


def minute_calls(path: DataFrame, phases: tuple[list[float], list[str]], calibration: dict[str, float], blend: dict[str, float], tau: float, least_left: float = 1.0) -> DataFrame:
    """One call for each minute of a window and variant: `calibrated`, p shrunk towards one half by the weight of its
    phase, and `blended`, that and the market's chance by another; both stay in [0.01, 0.99]. A minute's first row counts,
    and none in the last least_left minutes. Without a market the blend is the calibrated chance. `sure`: beyond tau."""
    slot = F.date_trunc("minute", F.col("t").cast("timestamp")).cast("timestamp_ntz")
    rows = path.where((F.col("left") >= least_left) & F.col("p").isNotNull()).withColumn("slot", slot)
    first = rows.groupBy("k", "w", "slot").agg(F.min_by(F.struct("left", "p", "market"), F.struct("t", "id")).alias("r")).select("k", "w", "slot", "r.*")
    phase = S.band(F.col("left"), *phases)
    weight = lambda by: F.coalesce(*(F.when(phase == name, F.lit(v)) for name, v in by.items()), F.lit(1.0))
    inside = lambda x: F.round(S.clamp(x, 0.01, 0.99), 4)
    calibrated = first.withColumn("calibrated", inside(0.5 + weight(calibration) * (F.col("p") - 0.5)))
    both = calibrated.withColumn("blended", F.coalesce(inside(weight(blend) * F.col("calibrated") + (1 - weight(blend)) * F.col("market")), F.col("calibrated")))
    variants = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).alias("p")) for v in ("calibrated", "blended")))).alias("v")
    out = both.select("k", "w", "slot", phase.alias("phase"), variants).select("k", "w", "slot", "phase", "v.*")
    return out.withColumn("call", (F.col("p") >= 0.5).cast("int")).withColumn("sure", (confidence(F.col("p")) >= tau).cast("int"))


def resting_limits(orders: DataFrame, path: DataFrame, margin: float | None = None, least_ask: float = 5.0) -> DataFrame:
    """Orders (k, w, t, id, up, limit) with their fill (filled_t, ask), the first later quote of the window from least_ask
    to the limit; one that never comes leaves `skipped`. Of several orders in one window the first rests, the others go.

    With a margin in cents, a quote fills only while the chance then still covers it, the fee and the margin.
    """
    w = Window.partitionBy("k", "w").orderBy("t", "id")
    one = orders.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("k", "w", F.struct(*(c for c in orders.columns if c not in ("k", "w"))).alias("o"))
    q = path.select("k", "w", F.struct("t", "id", "p", "bid", "ask").alias("q"))
    ask = side_ask(F.col("o.up"), F.col("q.bid"), F.col("q.ask"))
    fits = (F.col("q.t") > F.col("o.t")) & ask.between(F.lit(least_ask), F.col("o.limit"))
    if margin is not None:
        fits &= F.when(F.col("o.up"), F.col("q.p")).otherwise(1 - F.col("q.p")) * 100 >= ask + S.fee_continuous(ask) + margin
    fill = F.min(F.when(fits, F.struct(F.col("q.t").alias("t"), F.col("q.id").alias("id"), ask.alias("ask"))))
    out = one.join(q, ["k", "w"], "left").groupBy("k", "w").agg(F.any_value("o").alias("o"), fill.alias("f"))
    return out.select("k", "w", "o.*", F.col("f.t").alias("filled_t"), F.col("f.ask").alias("ask"), F.col("f").isNull().alias("skipped"))


def settle_limits(fills: DataFrame, results: DataFrame, stake_cents: float, start_cents: float) -> DataFrame:
    """Fills (k, w, up, filled_t, ask, skipped) with results (k, w, closes, y): whole contracts for at most stake_cents,
    stake with the order's fee, win, pnl, and the key's purse once the window is settled. A skipped order has outcome -1
    and a pnl of 0; a window without a result stays open, its stake spent, its purse null and, if filled, its outcome and pnl.

    The purse is one running sum over stakes, when made, and payouts, when due; it does not limit the contracts.
    """
    n = F.when(F.col("skipped"), 0.0).otherwise(F.floor(F.lit(stake_cents) / (F.col("ask") + S.fee_continuous(F.col("ask")))).cast("double"))
    x = fills.join(results.select("k", "w", "closes", "y"), ["k", "w"], "left").withColumn("contracts", n)
    spent = F.floor(F.col("contracts") * F.col("ask")) + S.fee_per_order(F.col("ask"), F.col("contracts"))
    x = x.withColumn("stake", F.when(F.col("contracts") > 0, spent).otherwise(0.0).cast("double"))
    x = x.withColumn("outcome", F.when(F.col("skipped"), -1).otherwise(F.col("y"))).withColumn("win", F.when(~F.col("skipped"), (F.col("up") == (F.col("y") == 1)).cast("int")))
    paid = F.when(F.col("skipped"), 0.0).otherwise(100 * F.col("contracts") * F.col("win"))
    x = x.withColumn("pnl", paid - F.col("stake")).withColumn("_paid", paid)
    out = F.struct(F.coalesce("filled_t", "closes").alias("at"), F.lit(0).alias("kind"), (-F.col("stake")).alias("cents"))
    back = F.struct(F.col("closes").alias("at"), F.lit(1).alias("kind"), F.coalesce(F.col("_paid"), F.lit(0.0)).alias("cents"))
    moves = x.select("*", F.explode(F.array(out, back)).alias("_m"))
    purse = F.lit(start_cents) + F.sum("_m.cents").over(Window.partitionBy("k").orderBy("_m.at", "_m.kind", "w").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return moves.withColumn("purse", F.when(F.col("outcome").isNotNull() & F.col("closes").isNotNull(), purse)).where("_m.kind = 1").select("k", "w", "contracts", "stake", "outcome", "win", "pnl", "purse")


def dip_entries(path: DataFrame, envelope: tuple[float, float], sure: float, floor: float, dip: float, cutoff: float) -> DataFrame:
    """How the thesis of each window ends: NO_THESIS without a call as sure in the envelope of minutes left; else what
    comes first, INVALIDATED (a confidence under the floor) or TRIGGERED (an ask `dip` cents under the call's), or MISSED
    by `cutoff` minutes before the close. The confidence is in the side of the call. Both at once is INVALIDATED."""
    is_call = F.col("left").between(*envelope) & (confidence(F.col("p")) >= sure)
    call = F.min(F.when(is_call, F.struct("t", "id", "p", "bid", "ask"))).over(Window.partitionBy("k", "w"))
    x = path.withColumn("_c", call).withColumn("_up", F.col("_c.p") >= 0.5)
    called, now = side_ask(F.col("_up"), F.col("_c.bid"), F.col("_c.ask")), side_ask(F.col("_up"))
    held = F.when(F.col("_up"), F.col("p")).otherwise(1 - F.col("p"))
    state = F.when(held < floor, "INVALIDATED").when(called - now >= dip, "TRIGGERED")
    later = (F.struct("t", "id") > F.struct(F.col("_c.t"), F.col("_c.id"))) & (F.col("left") >= cutoff)
    event = F.min(F.when(later & state.isNotNull(), F.struct("t", "id", state.alias("state"), now.alias("ask"))))
    out = x.groupBy("k", "w").agg(F.any_value("_up").alias("up"), F.any_value(called).alias("call_ask"), event.alias("e"))
    triggered = F.col("state") == "TRIGGERED"
    named = out.withColumn("state", F.when(F.col("up").isNull(), "NO_THESIS").otherwise(F.coalesce("e.state", F.lit("MISSED"))))
    return named.select("k", "w", "state", "up", "call_ask", F.when(triggered, F.col("e.ask")).alias("entry_ask"), F.when(triggered, F.col("call_ask") - F.col("e.ask")).alias("improvement"))


def excursions(path: DataFrame, envelope: tuple[float, float], bands: tuple[list[float], list[str]]) -> DataFrame:
    """By band of confidence: of each window's first call in the band and the envelope, the share that won, the mean ask
    then and at its least later, and how often it fell by 10 and by 20 cents. Calls without later rows don't count."""
    # What comes later, read from the end: a frame that only grows costs a step a row, one that shrinks all of its rows.
    after = Window.partitionBy("k", "w").orderBy(F.desc("t"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    up = F.col("p") >= 0.5
    x = path.withColumn("_later", F.when(up, F.min("ask").over(after)).otherwise(100 - F.max("bid").over(after))).withColumn("band", S.band(confidence(F.col("p")), *bands))
    first = Window.partitionBy("k", "w", "band").orderBy("t", "id")
    calls = x.where(F.col("left").between(*envelope)).withColumn("_r", F.row_number().over(first)).where((F.col("_r") == 1) & F.col("_later").isNotNull())
    fell = side_ask(up) - F.col("_later")
    share = lambda c: F.avg(c.cast("int"))
    return calls.groupBy("band").agg(F.count("*").alias("n"), share(up == (F.col("y") == 1)).alias("win_rate"), F.avg(side_ask(up)).alias("entry_ask"), F.avg("_later").alias("least_later_ask"), share(fell >= 10).alias("fell_10"), share(fell >= 20).alias("fell_20"))


def divergence(path: DataFrame, phases: dict[str, tuple[float, float]], bands: dict[str, tuple[float, float]], least: int = 10) -> DataFrame:
    """By phase of a window and distance of forecast from market: the market's chance of the forecast's side, how often
    that side won, and the residual in points. The first row of a phase speaks for its window."""
    phase = F.coalesce(*(F.when(F.col("left").between(*r), name) for name, r in phases.items()))
    firsts = path.withColumn("phase", phase).where("phase is not null").groupBy("k", "w", "phase").agg(F.min_by(F.struct("p", "market", "y"), F.struct("t", "id")).alias("r")).select("phase", "r.*")
    gap, up = F.col("p") - F.col("market"), F.col("p") > F.col("market")
    size = F.round(F.abs(gap), 6)
    band = F.coalesce(*(F.when((size >= lo) & (size < hi), name) for name, (lo, hi) in bands.items()))
    out = firsts.withColumn("band", band).where("band is not null").groupBy("phase", "band").agg(F.count("*").alias("n"), F.avg(F.when(up, F.col("market")).otherwise(1 - F.col("market"))).alias("implied"), F.avg((up == (F.col("y") == 1)).cast("int")).alias("won"))
    return out.where(F.col("n") >= least).withColumn("residual", 100 * (F.col("won") - F.col("implied")))


def operating_point(bets: DataFrame, target: float, least: int = 15) -> DataFrame:
    """Per key the threshold, 0.50 to 0.95, that keeps bets (k, p, price, y) best: of those with the target precision the
    most profitable, else the most precise, then most profitable; of equals the lowest. Bets under their cost, the fee
    included, are never kept, nor thresholds with fewer than `least` bets; without any the threshold is 0.5.

    Bets are counted once by hundredths of their chance and summed from above, instead of once for each threshold.
    """
    fee = S.fee_per_contract(F.col("price"))
    step = F.when(F.col("p") >= (F.col("price") + fee) / 100, F.least(F.floor(F.round(F.col("p") * 100, 6)), F.lit(95)).cast("int"))
    each = bets.select("k", step.alias("step"), "y", (100 * F.col("y") - F.col("price") - fee).alias("profit")).groupBy("k", "step").agg(F.count("*").alias("n"), F.sum("y").alias("wins"), F.sum("profit").alias("profit"))
    grid = each.groupBy("k").agg(F.sum("n").alias("scored")).select("k", "scored", F.explode(F.sequence(F.lit(50), F.lit(95))).alias("step"))
    above = Window.partitionBy("k").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = grid.join(each, ["k", "step"], "left").select("k", "scored", "step", *(F.sum(F.coalesce(F.col(c), F.lit(0))).over(above).alias(c) for c in ("n", "wins", "profit")))
    precision, profit = F.round(F.col("wins") / F.col("n"), 3), F.round("profit", 1)
    met = precision >= target
    rank = F.struct(met.alias("met"), F.when(met, 0.0).otherwise(precision).alias("_p"), profit.alias("profit"), (-F.col("step")).alias("_s"), precision.alias("precision"), F.col("n").alias("kept"))
    best = sums.groupBy("k", "scored").agg(F.max(F.when(F.col("n") >= least, rank)).alias("b"))
    return best.select("k", F.coalesce(-F.col("b._s") / 100, F.lit(0.5)).alias("theta"), F.col("b.precision").alias("precision"), F.round(F.col("b.kept") / F.col("scored"), 3).alias("coverage"), F.col("b.profit").alias("profit"), F.coalesce("b.kept", F.lit(0)).alias("kept"), F.coalesce("b.met", F.lit(False)).alias("met_target"))


def selection_economics(bets: DataFrame, cuts: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """Bets (k, t, p, price, pnl) of each key, split in time into train, validation and holdout: mean expected gain per
    dollar, profit, win rate, deepest fall of the running profit from its peak, and the three best gains' share."""
    w = Window.partitionBy("k").orderBy("t")
    x = bets.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("k")))
    x = x.withColumn("split", F.when(F.col("_i") < F.floor(F.col("_n") * cuts[0]), "train").when(F.col("_i") < F.floor(F.col("_n") * cuts[1]), "validation").otherwise("holdout"))
    run = Window.partitionBy("k", "split").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_sum", F.sum("pnl").over(run)).withColumn("_fall", F.max("_sum").over(run) - F.col("_sum"))
    x = x.withColumn("_top", F.row_number().over(Window.partitionBy("k", "split").orderBy(F.desc("pnl"), "t")) <= 3)
    price = F.col("price") / 100
    ev, gain = S.ev_per_dollar(F.col("p"), price, S.fee_per_contract(F.col("price")) / 100), F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)
    gains = F.sum(gain)
    return x.groupBy("k", "split").agg(
        F.count("*").alias("n"), (100 * F.avg(ev)).alias("mean_ev"), F.sum("pnl").alias("pnl"), F.avg((F.col("pnl") > 0).cast("int")).alias("win_rate"), F.max("_fall").alias("drawdown"),
        (F.sum(F.when(F.col("_top"), gain).otherwise(0.0)) / F.when(gains == 0, 1.0).otherwise(gains)).alias("top_share"),
    )


def lead_lag(decisions: DataFrame, quotes: DataFrame, venues: tuple[str, str, str], short: str, long: str, max_age: str, fresh: str) -> DataFrame:
    """At each decision time t, log returns in basis points of three venues' quotes (k, t, id, px): the first two over the
    short span, the third over the long one; the mean long return; the largest distance of a fresh price from the upper
    median; the lead of the first two over the upper median of long returns; and how many venues are fresh. A return
    needs quotes no older than max_age at both ends (the earlier one may be older by its span). Null unless the first
    two venues are fresh. One as-of join serves all venues and spans; quotes are never read later than t."""
    spans = {"now": "0 seconds", "short": short, "long": long}
    at = F.explode(F.array(*(F.struct(F.lit(v).alias("k"), F.lit(s).alias("span"), (F.col("t") - F.expr(f"interval {length}")).alias("t")) for v in venues for s, length in spans.items()))).alias("x")
    asked = decisions.select(F.col("t").alias("at"), at).select("at", "x.*")
    found = as_of(asked, quotes.where(F.col("k").isin(*venues)), "px")
    of = lambda span, c: F.max(F.when(F.col("span") == span, c))
    within = lambda *spans_: F.col("q_t") >= F.col("t") - sum((F.expr(f"interval {s}") for s in spans_[1:]), F.expr(f"interval {spans_[0]}"))
    each = found.groupBy("at", "k").agg(
        of("now", F.col("q_value")).alias("px"), F.coalesce(of("now", within(fresh)), F.lit(False)).alias("fresh"), of("now", F.when(within(max_age), F.col("q_value"))).alias("p"),
        of("short", F.when(within(max_age, short), F.col("q_value"))).alias("s"), of("long", F.when(within(max_age, long), F.col("q_value"))).alias("l"),
    )
    bps = lambda c: F.when((F.col("p") > 0) & (F.col(c) > 0), 10_000 * F.ln(F.col("p") / F.col(c)))
    each = each.withColumn("short", bps("s")).withColumn("long", bps("l"))
    upper = lambda c: F.get(F.array_sort(c), F.floor(F.array_size(c) / 2).cast("int"))
    by = lambda v, c: F.coalesce(F.max(F.when(F.col("k") == v, F.col(c))), F.lit(0.0))
    a, b, c = venues
    both = F.count(F.when(F.col("k").isin(a, b) & F.col("fresh"), 1)) == 2
    one = each.groupBy("at").agg(
        both.alias("ok"), by(a, "short").alias("a_short"), by(b, "short").alias("b_short"), by(c, "long").alias("c_long"), by(a, "long").alias("a_long"), by(b, "long").alias("b_long"), F.coalesce(F.avg("long"), F.lit(0.0)).alias("consensus"),
        F.collect_list("long").alias("longs"), F.collect_list(F.when(F.col("fresh") & (F.col("px") > 0), F.col("px"))).alias("pxs"), F.count(F.when(F.col("fresh"), 1)).alias("n_fresh"),
    )
    middle, mid = F.coalesce(upper(F.col("longs")), F.lit(0.0)), upper(F.col("pxs"))
    spread = F.when(F.array_size("pxs") >= 2, 10_000 * F.array_max(F.transform("pxs", lambda x: F.abs(x - mid) / mid))).otherwise(0.0)
    out = {"a_short": F.col("a_short"), "b_short": F.col("b_short"), "c_long": F.col("c_long"), "consensus": F.col("consensus"), "dispersion": spread, "a_lead": F.col("a_long") - middle, "b_lead": F.col("b_long") - middle}
    return one.select(F.col("at").alias("t"), *(F.when(F.col("ok"), x).alias(n) for n, x in out.items()), "n_fresh")


#: Grades of a loss, from the gravest.
GRADES = ("INTEGRITY", "POLICY_BREACH", "CONFIDENT_WRONG", "OVERSIZED", "BAD_CONTEXT", "EXPECTED_VARIANCE")


def graded_losses(losses: DataFrame, regime_floor: float = 0.62, ceiling: float = 85.0, confident: float = 0.77) -> DataFrame:
    """Losses (p, ask, fee, contracts, stake, purse, regime, tau, cap, win, pnl, limit_order) with `severity`, its
    `grade` and the dominant cause. tau and cap are the rule in force when the bet was made; purse is what the stake left.
    A check whose inputs are missing does not hold."""
    x = losses.withColumn("_cost", F.col("ask") + F.coalesce(F.col("fee"), F.lit(0.0)) / F.greatest(F.col("contracts"), F.lit(1)))
    before = F.coalesce(F.col("purse"), F.lit(0.0)) + F.coalesce(F.col("stake"), F.lit(0.0))
    x = x.withColumn("_share", F.when(before > 0, F.col("stake") / before)).withColumn("_kelly", S.kelly(F.col("p"), F.col("_cost") / 100))
    over = (F.col("_kelly") > 0) & (F.col("_share") > 2 * F.col("_kelly"))
    near, weak = F.abs(F.col("_cost") - 50) < 10, F.col("regime") < regime_floor
    breach = (F.col("p") < F.col("tau") - 1e-9) | (F.col("ask") > ceiling) | (F.col("_share") > F.col("cap") * 1.1 + 1e-9)
    checks = ((F.col("win") == 1) & (F.col("pnl") < 0) & (F.col("contracts") > 0), breach, F.col("p") >= confident, over, near | weak)
    severity = F.lit(len(checks))
    for i, holds in reversed(list(enumerate(checks))):
        severity = F.when(holds, i).otherwise(severity)
    cause = F.when(over, "sizing").when(F.col("limit_order"), "execution").when(near, "price").when(weak, "regime").otherwise("signal")
    out = x.withColumn("severity", severity).withColumn("cause", cause)
    return out.withColumn("grade", F.get(F.array(*map(F.lit, GRADES)), F.col("severity"))).drop("_cost", "_share", "_kelly")


#: Codes of states.
REGIME_CODES = {"low": 0.0, "normal": 1.0, "high": 2.0, "extreme": 3.0}
TREND_CODES = {"uptrend": 1.0, "downtrend": -1.0, "ranging": 0.0, "unknown": 0.0}


def encoded_features(rows: DataFrame) -> DataFrame:
    """Thirteen numbers of a candidate for a model, from (direction, expected_return, confidence, reward_risk,
    trend_strength, trend, relative_volume, regime, atr_pct). Missing numbers are 0, a missing or unknown regime is
    normal (1), an unknown trend 0."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    code = lambda c, codes, otherwise: F.coalesce(*(F.when(F.col(c) == n, F.lit(v)) for n, v in codes.items()), F.lit(otherwise))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    features = {
        "forecast_up": flag(F.col("direction") == "up"), "expected_return": number("expected_return"), "confidence": number("confidence"), "reward_risk": number("reward_risk"), "trouble_distance": F.lit(0.0), "structure_score": number("trend_strength"),
        "liquidity_score": F.least(number("relative_volume") / 2, F.lit(1.0)), "volatility_ok": flag(F.coalesce(F.col("regime"), F.lit("normal")).isin("low", "normal")), "atr_pct": number("atr_pct"), "regime_code": code("regime", REGIME_CODES, 1.0),
        "relative_volume": number("relative_volume"), "trend_strength": number("trend_strength"), "trend_code": code("trend", TREND_CODES, 0.0),
    }
    kept = [c for c in rows.columns if c in ("k", "t", "id")]
    return rows.select(*kept, *(x.alias(n) for n, x in features.items()))


def audited(rows: DataFrame, checks: dict[str, Column], example: str = "id") -> DataFrame:
    """For each named check, a condition that every row should meet: rows it applies to (not null), those that break it,
    and the least id of these. All checks share one pass."""
    sums = [a for i, (_, holds) in enumerate(checks.items()) for a in (F.count(holds).alias(f"n{i}"), F.count(F.when(~holds, 1)).alias(f"b{i}"), F.min(F.when(~holds, F.col(example))).alias(f"e{i}"))]
    named = F.array(*(F.struct(F.lit(name).alias("check"), F.col(f"n{i}").alias("n"), F.col(f"b{i}").alias("broken"), F.col(f"e{i}").alias("example")) for i, name in enumerate(checks)))
    return rows.agg(*sums).select(F.explode(named).alias("c")).select("c.*")


def runtime_state(desks: DataFrame, reports: DataFrame, now: Column, bad: dict[str, str], monitor: str, max_age: str) -> DataFrame:
    """For each desk (k) whether it may open trades at `now`, and why not, from reports (k, t, id, name, value): FREEZE
    if one named in `bad` is missing, older than max_age, unreadable (null) or has its bad value, the first such; else
    DEGRADED if the monitor's latest says STALE or UNKNOWN; else NORMAL. A desk without any report is frozen. Reports
    after `now` don't count. Closing and settling are never stopped."""
    names = [*bad, monitor]
    latest = lambda n: F.max_by(F.struct("t", "value"), F.when(F.col("name") == n, F.struct("t", "id")))
    each = reports.where(F.col("name").isin(*names) & (F.col("t") <= now)).groupBy("k").agg(*(latest(n).alias(f"_{i}") for i, n in enumerate(names)))
    x = desks.select("k").distinct().join(each, "k", "left")
    why = F.lit(None).cast("string")
    for i, (name, value) in reversed(list(enumerate(bad.items()))):
        stale = F.col(f"_{i}.t").isNull() | (F.col(f"_{i}.t") < now - F.expr(f"interval {max_age}"))
        why = F.when(stale, f"{name} missing or stale").when(F.col(f"_{i}.value").isNull(), f"{name} unreadable").when(F.col(f"_{i}.value") == value, f"{name} is {value}").otherwise(why)
    says = F.col(f"_{len(bad)}.value")
    return x.withColumn("_why", why).select(
        "k", F.when(F.col("_why").isNotNull(), "FREEZE").when(says.isin("STALE", "UNKNOWN"), "DEGRADED").otherwise("NORMAL").alias("state"), F.coalesce("_why", F.when(says.isin("STALE", "UNKNOWN"), F.concat(F.lit(f"{monitor} is "), says))).alias("why")
    )


def bet_ev(up: Column, ask: Column, outcome: Column) -> Column:
    """Gain per unit of cost of a bet on a side, the fee of whole cents included: what is won over the cost, or -1."""
    cost = ask + S.fee_per_contract(ask)
    return F.when(up.isNull() | ask.isNull() | outcome.isNull(), None).when(up == (outcome == 1), (100 - cost) / cost).otherwise(-1.0)


def decisions_of(path: DataFrame, envelope: float) -> DataFrame:
    """The earliest row of each window within the last `envelope` minutes: what could be known when deciding."""
    rows = path.where(F.col("left") <= envelope)
    kept = [c for c in path.columns if c not in ("k", "w")]
    return rows.groupBy("k", "w").agg(F.min_by(F.struct(*kept), F.struct("t", "id")).alias("r")).select("k", "w", "r.*")


def treatments(decisions: DataFrame, arms: list[str], spread: float = 2.5, lookback: int = 20, floor: float = 0.62, knife: float = 0.1, cheap: float = 51.0, last: int = 20, least: int = 5) -> DataFrame:
    """Policies side by side on the same settled windows (k, w, p, market, y, and chances of `arms`): a row per window and
    policy with its ev, null where it stands down. All pay the market's chance and a spread.

    champion bets on p's side; `regime` not while the market was right in under `floor` of the last windows, `knife` not
    near one half, `cheap` not above an ask, `both` by regime and knife; `leader` bets on the side of the arm whose last
    bets, of those at asks of 5 up to 80, gained most on average, the first of equals, and only with `least` of them.
    What a policy knows comes from earlier windows of the key alone: every trailing frame ends before the current one.
    """
    w = Window.partitionBy("k").orderBy("w")
    ask = lambda up: F.when(up, 100 * F.col("market") + spread).otherwise(100 * (1 - F.col("market")) + spread)
    right = ((F.col("market") >= 0.5) == (F.col("y") == 1)).cast("int")
    past = w.rowsBetween(-lookback, -1)
    x = decisions.withColumn("_right", right).withColumn("regime", F.when(F.count("_right").over(past) >= lookback, F.avg("_right").over(past)))
    best = F.lit(None).cast("struct<m: double, up: boolean>")
    for i, arm in enumerate(arms):
        up = F.col(arm) >= 0.5
        ev = F.when((ask(up) >= 5) & (ask(up) < 80), bet_ev(up, ask(up), F.col("y")))
        x = x.withColumn(f"_e{i}", ev).withColumn(f"_has{i}", ev.isNotNull())
        tail = Window.partitionBy("k", f"_has{i}").orderBy("w").rowsBetween(-(last - 1), 0)
        x = x.withColumn(f"_t{i}", F.when(F.col(f"_has{i}") & (F.count(f"_e{i}").over(Window.partitionBy("k", f"_has{i}").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)) >= least), F.avg(f"_e{i}").over(tail)))
        x = x.withColumn(f"_m{i}", F.round(F.last(f"_t{i}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), 9))
        mine = F.when(F.col(f"_m{i}").isNotNull(), F.struct(F.col(f"_m{i}").alias("m"), up.alias("up")))
        best = mine if i == 0 else F.when(best.isNull() | (F.col(f"_m{i}") > best["m"]), F.coalesce(mine, best)).otherwise(best)
    x = x.withColumn("_best", best)
    side = F.col("p") >= 0.5
    calm, clear = ~F.coalesce(F.col("regime") < floor, F.lit(False)), ~(F.abs(F.col("market") - 0.5) < knife)
    bet = bet_ev(side, ask(side), F.col("y"))
    leads = F.col("_best.up")
    evs = {"champion": bet, "regime": F.when(calm, bet), "knife": F.when(clear, bet), "cheap": F.when(ask(side) <= cheap, bet), "both": F.when(calm & clear, bet), "leader": bet_ev(leads, ask(leads), F.col("y"))}
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), e.alias("ev")) for n, e in evs.items()))).alias("v")
    return x.select("k", "w", rows).select("k", "w", "v.*")


def paired_treatments(scored: DataFrame, champion: str = "champion") -> DataFrame:
    """Per key and policy of treatments(): windows, bets, mean ev of a bet, and the mean difference to the champion on
    the same windows, where standing down counts as 0."""
    of = F.max(F.when(F.col("policy") == champion, F.col("ev"))).over(Window.partitionBy("k", "w"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scored.withColumn("_c", of).groupBy("k", "policy").agg(F.count("*").alias("windows"), F.count("ev").alias("bets"), F.avg("ev").alias("ev"), F.avg(zero(F.col("ev")) - zero(F.col("_c"))).alias("difference"))


def economic_replay(decisions: DataFrame, tau: float) -> DataFrame:
    """Per key, over decisions (w, p, bid, ask, y) in time: one contract on p's side where it is as sure as tau; gain per
    cost of each eligible decision and of each fill, their share, and the deepest fall below the best so far (or 0)."""
    up, conf = F.col("p") >= 0.5, confidence(F.col("p"))
    ask = side_ask(up)
    cost = ask + S.fee_continuous(ask)
    taken = F.coalesce((conf >= tau) & ask.isNotNull(), F.lit(False))
    gain = F.when(~taken, 0.0).when(up == (F.col("y") == 1), (100 - cost) / cost).otherwise(-1.0)
    run = Window.partitionBy("k").orderBy("w").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = decisions.withColumn("_taken", taken).withColumn("_gain", gain).withColumn("_sum", F.sum("_gain").over(run))
    x = x.withColumn("_fall", F.col("_sum") - F.greatest(F.max("_sum").over(run), F.lit(0.0)))
    fills = F.count(F.when(F.col("_taken"), 1))
    return x.groupBy("k").agg(F.count("*").alias("n"), fills.alias("fills"), F.avg("_gain").alias("ev_per_eligible"), F.try_divide(F.sum("_gain"), fills).alias("gain_per_fill"), (fills / F.count("*")).alias("coverage"), F.min("_fall").alias("drawdown"))

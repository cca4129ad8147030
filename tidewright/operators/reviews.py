"""Reviews of settled forecasts and bets: trailing scores, bands, weights by phase, frontiers with money, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions.scalar import clamp, fee_continuous

from .bars import in_time
from .decisions import tags
from .ledger import first_failing


def trailing_scores(rows: DataFrame, now: Column, hours: int = 6, least: int = 10) -> DataFrame:
    """By arm and horizon the scores of forecasts (arm, horizon, t, price_now, pred, actual, lo, hi) that were made in
    the last hours before `now` and are settled, if there are `least` of them.

    msse and mase are scaled by the errors of no change on the same rows, null where that made none; dir is the share of
    right directions among forecasts that move; cov and sharp are the share inside the band and its mean width, of rows
    with a band. Rows after `now` count too, as those made by then do.
    """
    recent = rows.where(F.col("actual").isNotNull() & (F.col("t") >= now - F.make_interval(hours=F.lit(hours))))
    err, naive = F.col("pred") - F.col("actual"), F.abs(F.col("actual") - F.col("price_now"))
    moves = F.col("pred") != F.col("price_now")
    right = (F.col("pred") > F.col("price_now")) == (F.col("actual") > F.col("price_now"))
    banded = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    out = recent.groupBy("arm", "horizon").agg(
        F.count("*").alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.avg(naive * naive).alias("_n2"), F.avg(naive).alias("_n1"), F.avg(F.when(moves, right.cast("double"))).alias("dir"),
        F.avg(F.when(banded, F.col("actual").between(F.col("lo"), F.col("hi")).cast("double"))).alias("cov"), F.avg(F.when(banded, F.col("hi") - F.col("lo"))).alias("sharp"),
    )
    out = out.where(F.col("n") >= least).withColumn("rmse", F.sqrt("mse")).withColumn("msse", F.try_divide("mse", "_n2")).withColumn("mase", F.try_divide("mae", "_n1"))
    return out.drop("_n1", "_n2")


def trailing_binary(rows: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """By k the same of binary calls (k, t, p, market, y): count, accuracy, Brier scores of the call and of the market,
    and the skill of the call against the market and against a coin."""
    recent = rows.where(F.col("y").isNotNull() & (F.col("t") >= now - F.make_interval(hours=F.lit(hours))))
    brier = lambda p: F.avg(F.pow(F.col(p) - F.col("y"), F.lit(2.0)))
    out = recent.groupBy("k").agg(F.count("*").alias("n"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("acc"), brier("p").alias("brier"), brier("market").alias("market_brier"))
    return out.withColumn("skill_market", 1 - F.try_divide("brier", "market_brier")).withColumn("skill_coin", 1 - F.col("brier") / 0.25)


def scaled_band(settled: DataFrame, rows: int = 100, least: int = 20, floor: float = 0.6) -> DataFrame:
    """Adds lo and hi, whole offsets from a forecast (k, t, pred, actual, sigma) to its 80 % band, from the rows before.

    Errors count in units of their row's sigma, so one width doesn't serve calm and wild times alike; of the last `rows`
    that are settled, with a sigma, the band takes those at the lower index of a tenth and of nine tenths. They are
    scaled by the sigma of now, or by the median of theirs where there is none, and by `floor` of that median at
    least. Ends are rounded outwards. Null with fewer than `least` rows.
    """
    usable = F.coalesce(F.col("actual").isNotNull() & (F.col("sigma") > 0), F.lit(False))
    good = settled.withColumn("_u", usable)
    seen = F.sum(F.col("_u").cast("long")).over(in_time().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    good = good.withColumn("_n", seen - F.col("_u").cast("long"))  # usable rows before this one
    pair = F.struct(((F.col("actual") - F.col("pred")) / F.col("sigma")).alias("z"), "sigma")
    ranked = good.where("_u").withColumn("_x", F.collect_list(pair).over(in_time().rowsBetween(-(rows - 1), 0)))
    z, s = F.array_sort(F.transform("_x", lambda p: p.z)), F.array_sort(F.transform("_x", lambda p: p.sigma))
    n = F.size("_x")
    at = lambda x, q: F.get(x, F.least(n - 1, F.floor(F.lit(q) * n)).cast("int"))
    bands = ranked.select(F.col("k").alias("_k"), (F.col("_n") + 1).alias("_m"), at(z, 0.1).alias("_lo"), at(z, 0.9).alias("_hi"), F.get(s, F.floor(n / 2).cast("int")).alias("_med"), n.alias("_c"))
    out = good.join(bands, F.col("k").eqNullSafe(F.col("_k")) & (F.col("_n") == F.col("_m")), "left")
    scale = F.greatest(F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.col("_med")), floor * F.col("_med"))
    enough = F.col("_c") >= least
    return out.select(*settled.columns, F.when(enough, F.floor(F.col("_lo") * scale)).alias("lo"), F.when(enough, F.ceil(F.col("_hi") * scale)).alias("hi"))


def phase(minutes: Column) -> Column:
    return F.when(minutes >= 10, "early").when(minutes >= 5, "mid").otherwise("late")


def phase_weights(calls: DataFrame, centre: str | None, last: int, least: int, most: float, default: float) -> DataFrame:
    """(k, phase, weight, n): for each phase of a window the weight w of what a call's chance p says beyond a centre, by
    least squares over the phase's last settled calls (k, t, id, mins_left, p, y): of the distances d = p - centre to
    those of the outcomes, sum(d * r) / sum(d * d), from 0 to `most`. The centre is a column (the market's chance: then w
    blends call and market), or a half (then w shrinks the call). All phases come out; one with fewer than `least`
    calls, or calls at the centre alone, gets the default."""
    c = F.col(centre) if centre else F.lit(0.5)
    used = calls.where(F.col("y").isNotNull() & c.isNotNull()).withColumn("phase", phase(F.col("mins_left")))
    tail = used.withColumn("_r", F.row_number().over(Window.partitionBy("k", "phase").orderBy(F.desc("t"), F.desc("id")))).where(F.col("_r") <= last)
    d = F.col("p") - c
    sums = tail.groupBy("k", "phase").agg(F.count("*").alias("n"), F.sum(d * (F.col("y") - c)).alias("_a"), F.sum(d * d).alias("_b"))
    every = calls.select("k").distinct().select("k", F.explode(F.array(*map(F.lit, ("early", "mid", "late")))).alias("phase"))
    out = every.join(sums, ["k", "phase"], "left")
    fit = (F.col("n") >= least) & (F.col("_b") > 1e-9)
    return out.select("k", "phase", F.when(fit, clamp(F.col("_a") / F.col("_b"), 0.0, most)).otherwise(default).alias("weight"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def entry_economics(rows: DataFrame) -> DataFrame:
    """Windows (k, t, p, market, y) as entries on the called side at the market's price, from 1 to 99 cents: edge and
    gain in cents for a contract after its fee, and the gain for its cost."""
    yes = F.col("p") >= 0.5
    price = clamp(100 * F.when(yes, F.col("market")).otherwise(1 - F.col("market")), 1.0, 99.0)
    out = rows.where("y is not null and p is not null and market is not null").withColumn("edge_c", 100 * F.when(yes, F.col("p")).otherwise(1 - F.col("p")) - price)
    cost = price + fee_continuous(price)
    won = (F.col("y") == 1) == yes
    return out.withColumn("gain_c", F.when(won, 100 - cost).otherwise(-cost)).withColumn("gain_per_cost", F.col("gain_c") / cost)


def economic_frontier(entries: DataFrame, thresholds: list[float], most_bad: float) -> DataFrame:
    """By k and threshold, of entries (of entry_economics) with that edge or more: share entered, share of all profitable
    ones (recall), share of entries that lose (bad), gains captured and missed, losses taken, and the mean gain for the
    cost; whether that is feasible (bad within the limit, mean gain above 0); and whether it is the one to operate at:
    the feasible one with the largest recall, of equals the lowest. Thresholds that nothing reaches are left out.

    A row falls into the step of the highest threshold that it reaches, and steps are summed up from above: rows are
    read once, however many thresholds there are.
    """
    steps = sorted(thresholds)
    step = F.lit(-1)
    for i, x in enumerate(steps):
        step = F.when(F.col("edge_c") >= x, i).otherwise(step)
    good = F.col("gain_c") > 0
    parts = {"n": F.lit(1).cast("long"), "good": good.cast("long"), "won": F.when(good, F.col("gain_c")).otherwise(0.0), "lost": F.when(good, 0.0).otherwise(F.col("gain_c")), "ratio": F.col("gain_per_cost")}
    sums = entries.groupBy("k", step.alias("_s")).agg(*(F.sum(v).alias(f"_{n}") for n, v in parts.items()))
    filled = sums.select("k").distinct().select("k", F.explode(F.array(*(F.lit(i) for i in range(-1, len(steps))))).alias("_s")).join(sums, ["k", "_s"], "left").fillna(0)
    above = Window.partitionBy("k").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("k")
    up = filled.select("k", "_s", *(F.sum(f"_{n}").over(above).alias(n) for n in parts), *(F.sum(f"_{n}").over(whole).alias(f"all_{n}") for n in ("n", "good", "won")))
    out = up.where("_s >= 0 and n > 0").withColumn("threshold", F.element_at(F.array(*map(F.lit, steps)), F.col("_s") + 1))
    out = out.select(
        "k", "threshold", "n", (F.col("n") / F.col("all_n")).alias("coverage"), (F.col("good") / F.greatest("all_good", F.lit(1))).alias("recall"), (1 - F.col("good") / F.col("n")).alias("bad"),
        F.col("won").alias("captured_c"), F.col("lost").alias("dicey_c"), (F.col("all_won") - F.col("won")).alias("missed_c"), (100 * F.col("ratio") / F.col("n")).alias("gain_per_100"),
    )
    out = out.withColumn("feasible", (F.col("bad") <= most_bad) & (F.col("gain_per_100") > 0))
    best = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("feasible"), F.desc("recall"), "threshold"))
    return out.withColumn("operating", F.col("feasible") & (best == 1))


#: Why a bet was lost, in order of priority.
FAILURES = ("SIGN_INVERSION", "MARKET_KNEW", "CONFIDENTLY_WRONG", "EXPENSIVE_LOSER", "LATE_ENTRY", "THIN_EDGE_LOST", "UNCLASSIFIED")


def bet_alignment() -> Column:
    """How a bet (side, p, edge_c, forced) stands to its model: forced; on the less likely side, by convention if the edge
    was none too bad; invalid if it was; else aligned."""
    taken = F.when(F.col("side") == "yes", F.coalesce("p", F.lit(0.5))).otherwise(1 - F.coalesce("p", F.lit(0.5)))
    rules = ((F.coalesce("forced", F.lit(False)), "EXPLICIT_OVERRIDE"), ((taken < 0.5) & (F.coalesce("edge_c", F.lit(0.0)) >= 0), "CONVENTION_NORMALIZED"), (taken < 0.5, "INVALID"))
    return first_failing(*rules, ok="ALIGNED")


def failure_tags() -> tuple[Column, Column]:
    """All of FAILURES that hold for a lost bet (side, p, price_c, mins_left, edge_c, forced, market), and the first. All
    are known before the entry; missing numbers are a half, 0, 99 minutes and no edge."""
    yes = F.col("side") == "yes"
    p, price, left, edge = (F.coalesce(c, F.lit(d)) for c, d in (("p", 0.5), ("price_c", 0.0), ("mins_left", 99.0), ("edge_c", 0.0)))
    taken = F.when(yes, p).otherwise(1 - p)
    other = F.when(yes, 1 - F.col("market")).otherwise(F.col("market"))
    holds = (
        (taken < 0.5) & (edge < 0) & ~F.coalesce("forced", F.lit(False)), F.coalesce(other >= 0.62, F.lit(False)), taken >= 0.65, price >= 70, left < 3, (taken >= 0.5) & (taken < 0.65),
    )
    none = F.lit(True)
    for c in holds:
        none = none & ~c
    return tags(*zip((*holds, none), FAILURES, strict=True))


def failure_clusters(bets: DataFrame, last: int) -> DataFrame:
    """By k how many of its last lost bets (k, t, id, pnl_c and what the tags need) have each first reason, how many
    lost, and of how many the side was invalid."""
    lost = bets.where("pnl_c < 0").withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t"), F.desc("id")))).where(F.col("_r") <= last)
    _, first = failure_tags()
    return lost.groupBy("k", first.alias("reason")).agg(F.count("*").alias("n"), F.sum("pnl_c").alias("pnl_c"), F.count_if(bet_alignment() == "INVALID").alias("invalid"))

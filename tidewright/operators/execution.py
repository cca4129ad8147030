"""What entries cost and what came after them: execution ledgers, splits, sensitivity to late quotes and dearer fills.

A ticker is one window of a market, and its path (ticker, t, p, base) has a row a minute or so; so a path is a short
array, orders meet it by one join on the ticker, and all quotes around an order are looked up in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalar import band, clamp, fee_continuous

from .ledger import first_qualifying

#: Half of the spread that is taken for granted between the market's chance and an ask, in cents.
HALF_SPREAD = 2.5


def _paths(path: DataFrame) -> DataFrame:
    row = F.struct("t", F.col("p").cast("double").alias("p"), F.col("base").cast("double").alias("base"))
    return path.where("t is not null and p is not null").groupBy("ticker").agg(F.array_sort(F.collect_list(row)).alias("_path"))


def _seconds(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def _at_or_before(t: Column, oldest: int) -> Column:
    return F.try_element_at(F.filter("_path", lambda r: (r.t <= t) & (r.t >= F.timestamp_add("SECOND", F.lit(-oldest), t))), F.lit(-1))


def _nearest(t: Column, tolerance: int) -> Column:
    """The row closest to t; of two the earlier."""
    near = F.filter("_path", lambda r: F.abs(_seconds(r.t, t)) <= tolerance)
    best = F.array_min(F.transform(near, lambda r: F.struct(F.abs(_seconds(r.t, t)).alias("d"), r.t.alias("t"), r.p.alias("p"), r.base.alias("base"))))
    return F.when(best.isNotNull(), best)


def modelled_ask(p: Column, side: Column) -> Column:
    """Cents for a side at the market's chance and half of the spread."""
    return 100 * F.when(side == "yes", p).otherwise(1 - p) + HALF_SPREAD


def gain_per_cost(win: Column, ask: Column) -> Column:
    return (100 * win.cast("double") - ask - fee_continuous(ask)) / ask


def execution_ledger(orders: DataFrame, path: DataFrame, marks: dict[str, int], price_marks: dict[str, int], oldest: int = 120, tolerance: int = 30) -> DataFrame:
    """Settled orders (ticker, t, side, ask_c, stake_c, pnl_c, win; skipped or unsettled ones go) with the quote that they
    were decided on: quote_age_s, market, modelled_ask and slippage (ask less that). mark_x is how far the market's
    chance has moved towards the side, in points, at each span of `marks` (seconds) after the quote, by the nearest row
    within `tolerance`; price_x the same of the base price in its own units. ev is the gain for the stake. `missing`
    says why there is no quote: no path of that ticker, or none of its rows within `oldest` seconds before."""
    done = orders.where(~F.coalesce("skipped", F.lit(False)) & F.col("win").isin(0, 1))
    spans = sorted(set(marks.values()) | set(price_marks.values()))
    # Marks hang on the quote alone, so each quote of a path looks for its own, once for all orders.
    later = lambda r: (_nearest(F.timestamp_add("SECOND", F.lit(s), r.t), tolerance).alias(f"m{s}") for s in spans)
    paths = _paths(path).withColumn("_path", F.transform("_path", lambda r: F.struct(r.t.alias("t"), r.p.alias("p"), r.base.alias("base"), *later(r))))
    out = done.join(paths, "ticker", "left")
    out = out.withColumn("_q", _at_or_before(F.col("t"), oldest))
    sign = F.when(F.col("side") == "yes", 1.0).otherwise(-1.0)
    ask = modelled_ask(F.col("_q.p"), F.col("side"))
    columns = {
        "quote_age_s": _seconds(F.col("_q.t"), F.col("t")), "market": F.col("_q.p"), "modelled_ask": ask, "slippage": F.col("ask_c") - ask,
        **{f"mark_{n}": sign * (F.col(f"_q.m{s}.p") - F.col("_q.p")) * 100 for n, s in marks.items()}, **{f"price_{n}": sign * (F.col(f"_q.m{s}.base") - F.col("_q.base")) for n, s in price_marks.items()},
        "ev": F.try_divide(F.col("pnl_c"), F.col("stake_c")), "missing": F.when(F.col("_path").isNull(), "no_path").when(F.col("_q").isNull(), "no_recent_quote"),
    }
    return out.withColumns(columns).drop("_path", "_q")


def bands(rows: DataFrame) -> DataFrame:
    """Adds bands of confidence (p), entry price (ask_c) and minutes left; unknown where there is none."""
    named = lambda c, cuts, labels: F.coalesce(band(F.col(c), cuts, labels), F.lit("unknown"))
    above = lambda c, cut, low, high, name: F.when(F.col(c) <= cut, low).when(F.col(c) > cut, high).otherwise(name)
    conf = F.when(F.col("p") < 0.7, "<0.7").otherwise(above("p", 0.8, "0.7-0.8", ">0.8", "unknown"))
    price = F.when(F.col("ask_c") < 40, "<40c").otherwise(above("ask_c", 60, "40-60c", ">60c", "unknown"))
    return rows.withColumns({"conf_band": conf, "price_band": price, "mins_band": named("mins_left", [8, 11], ["<8m", "8-11m", ">=11m"])})


def split_stats(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(split, part, orders, and for each value its count, mean, median, 10 % and 90 % points): over all rows, and by each
    of `keys` (null is `unknown`), in one pass of grouping sets. Rows are expanded once for each key, and percentiles are
    exact."""
    named = rows.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("unknown")) for k in keys})
    sets = named.groupingSets([[k] for k in keys] + [[]], *keys)
    of = lambda v: [F.count(v).alias(f"{v}_n"), F.avg(v).alias(f"{v}_mean"), *(F.percentile(v, F.lit(q)).alias(f"{v}_{n}") for q, n in ((0.5, "median"), (0.1, "p10"), (0.9, "p90")))]
    out = sets.agg(F.grouping_id().alias("_g"), F.count("*").alias("orders"), *(a for v in values for a in of(v)))
    every = (1 << len(keys)) - 1
    split = F.lit("all")
    for i, k in enumerate(keys):
        split = F.when(F.col("_g") == every - (1 << (len(keys) - 1 - i)), k).otherwise(split)
    return out.select(split.alias("split"), F.coalesce(*keys, F.lit("all")).alias("part"), *(c for c in out.columns if c not in (*keys, "_g")))


def sensitivity(decisions: DataFrame, path: DataFrame, deltas: list[int], slip: float, step: int = 60, oldest: int = 120, extra: float = 2.5, unfilled: float = 0.1, drop: float = 0.01) -> DataFrame:
    """(model, delta, ev, n, excluded, crossing): the mean gain for the cost of decisions (ticker, t, id, side, win) that
    have a quote within `oldest` seconds, at the modelled ask, from 1 to 99 cents.

    Models: `stale` and `delay` take the quote exactly `delta` steps before and after; `plain` the quote itself, `slipped`
    what `slip` cents more do, `stressed` `extra` cents more for those that are filled (a hash of the id leaves out the
    share `unfilled`), `mid` without the spread. excluded counts decisions without such a quote; crossing marks the first
    delta over 0 at which the mean falls by `drop` or more under that of `plain`. Rows are expanded once for each delta.
    """
    got = decisions.join(_paths(path), "ticker").withColumn("_q", _at_or_before(F.col("t"), oldest)).where("_q is not null")
    cases = [F.struct(F.lit(m).alias("model"), F.lit(d).alias("delta"), F.lit(s * step * d).alias("shift"), F.lit(0.0).alias("more")) for m, s in (("stale", -1), ("delay", 1)) for d in deltas]
    cases += [F.struct(F.lit(m).alias("model"), F.lit(0).alias("delta"), F.lit(0).alias("shift"), F.lit(c).alias("more")) for m, c in (("plain", 0.0), ("slipped", slip), ("stressed", extra), ("mid", -HALF_SPREAD))]
    many = got.select("*", F.explode(F.array(*cases)).alias("c"))
    at = F.timestamp_add("SECOND", F.col("c.shift"), F.col("_q.t"))
    many = many.withColumn("_p", F.try_element_at(F.filter("_path", lambda r: r.t == at), F.lit(1))["p"])
    ask = clamp(clamp(modelled_ask(F.col("_p"), F.col("side")), 1.0, 99.0) + F.col("c.more"), 1.0, 99.0)
    out_of = (F.col("c.model") == "stressed") & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(unfilled * 1_000_000))
    ev = F.when(~out_of & F.col("_p").isNotNull(), gain_per_cost(F.col("win"), ask))  # bounds would hide a missing quote
    sums = many.select("c.model", "c.delta", ev.alias("ev"), F.col("_p").isNull().alias("none")).groupBy("model", "delta").agg(F.avg("ev").alias("ev"), F.count("ev").alias("n"), F.count_if("none").alias("excluded"))
    plain = sums.where("model = 'plain'").select(F.max("ev")).scalar()
    sums = sums.withColumn("_low", (F.col("delta") > 0) & F.col("model").isin("stale", "delay") & (F.col("ev") < plain - drop))
    first = sums.where("_low").groupBy("model").agg(F.min("delta").alias("_first"))
    return sums.join(first, "model", "left").select("model", "delta", "ev", "n", "excluded", F.coalesce(F.col("delta") == F.col("_first"), F.lit(False)).alias("crossing"))


def one_bet(minutes: DataFrame, most: float = 80.0, edge: float = 3.0, forced_s: float = 180.0, door: float = 75.0, last_s: float = 60.0) -> DataFrame:
    """At most one bet for each window k, from its minutes (k, t, id, seconds_left, p, yes_bid, yes_ask): the first at which
    the called side costs under `most` cents and has the edge, or the end is near (forced), or its price is about to
    leave the range (door); or at which the end is near, the called side is priced out, and the other isn't. Adds side,
    price_c, edge_c and forced (of those without the edge). None in the last `last_s` seconds, or without quotes."""
    yes_edge, no_edge = 100 * F.col("p") - F.col("yes_ask"), 100 * (1 - F.col("p")) - (100 - F.col("yes_bid"))
    call = F.col("p") >= 0.5
    open_ = minutes.where((F.col("seconds_left") >= last_s) & F.col("p").isNotNull() & (F.col("yes_bid") > 0) & (F.col("yes_ask") > 0))
    pick = lambda yes: F.struct(F.when(yes, "yes").otherwise("no").alias("side"), F.when(yes, F.col("yes_ask")).otherwise(100 - F.col("yes_bid")).alias("price_c"), F.when(yes, yes_edge).otherwise(no_edge).alias("edge_c"))
    near = F.col("seconds_left") <= forced_s
    out = open_.withColumn("_c", pick(call)).withColumn("_o", pick(~call))
    mine = (F.col("_c.price_c") < most) & ((F.col("_c.edge_c") >= edge) | near | (F.col("_c.price_c") >= door))
    out = out.withColumn("_b", F.when(mine, F.col("_c")).when(near & (F.col("_o.price_c") < most), F.col("_o")))
    out = first_qualifying(out, F.col("_b").isNotNull(), "t", "id")
    return out.select(*minutes.columns, "_b.side", "_b.price_c", "_b.edge_c", ((F.col("seconds_left") <= forced_s) & (F.col("_b.edge_c") < edge)).alias("forced"))


def noise_floor(bars: DataFrame, horizons: dict[str, str], least: int = 30) -> DataFrame:
    """By key and horizon, over bars that have one exactly that much later: count, mean absolute move, its deviation, what
    the mean would be of normal moves of that deviation, and the share of rises. Few moves are left out."""
    ends = F.explode(F.array(*(F.struct(F.lit(n).alias("horizon"), (F.col("t") + F.expr(f"interval {s}")).alias("end")) for n, s in horizons.items())))
    moves = bars.select("k", F.col("c").alias("now"), ends.alias("e")).select("k", "now", "e.*").join(bars.select("k", F.col("t").alias("end"), "c"), ["k", "end"]).withColumn("m", F.col("c") - F.col("now"))
    out = moves.groupBy("k", "horizon").agg(F.count("*").alias("n"), F.avg(F.abs("m")).alias("floor"), F.stddev_pop("m").alias("sigma"), F.avg((F.col("m") > 0).cast("double")).alias("up"))
    return out.where(F.col("n") >= least).withColumn("normal_floor", F.col("sigma") * (2 / 3.141592653589793) ** 0.5)


def grid_verdicts(results: DataFrame, few: float = 2.0, many: float = 20.0) -> DataFrame:
    """Results of a grid (k, setting, n_bars, n_trades, win_rate, avg_gain, avg_loss) with trades for 100 bars, verdict
    (too_few, good, too_many), expectancy, and recommended with its reason: of the good settings the one of largest
    expectancy, of equals the lowest; else the lowest with a trade; else none."""
    rate = F.coalesce(F.try_divide(100 * F.col("n_trades"), F.col("n_bars")), F.lit(0.0))
    wr, zero = F.coalesce("win_rate", F.lit(0.0)), F.lit(0.0)
    out = results.withColumn("per_100", rate).withColumn("verdict", F.when(rate < few, "too_few").when(rate > many, "too_many").otherwise("good"))
    out = out.withColumn("expectancy", F.coalesce("avg_gain", zero) * wr + F.coalesce("avg_loss", zero) * (1 - wr))
    good = F.col("verdict") == "good"
    best = out.groupBy("k").agg(F.min_by("setting", F.when(good, F.struct((-F.col("expectancy")).alias("e"), "setting"))).alias("_g"), F.min(F.when(F.col("n_trades") > 0, F.col("setting"))).alias("_l"))
    out = out.join(best, "k")
    reason = F.when(F.col("_g").isNotNull(), "good_verdict_best_expectancy").when(F.col("_l").isNotNull(), "no_good_verdict_least_restrictive").otherwise("no_trades_all_thresholds")
    return out.withColumn("recommended", F.coalesce(F.col("setting") == F.coalesce("_g", "_l"), F.lit(False))).withColumn("reason", reason).drop("_g", "_l")

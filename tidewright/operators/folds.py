"""Ordered folds: recursions over a trailing slice or a whole series, as JVM-side higher-order functions.

A fold over a trailing slice costs its length for each row and needs one sort of each key. A fold over a whole series
holds that series in one row, so it suits states over sessions or trades of one account, not raw ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions.scalar import clamp

from .bars import in_time, trailing


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def wilder_atr(bars: DataFrame, window: int = 14, context: int = 100) -> DataFrame:
    """Adds atr: the mean of the slice's first true ranges, then Wilder's recursion. The slice is the last `context`
    bars, whose first has no close before it; null with fewer than `window` bars."""
    prev = F.lag("c").over(in_time())
    tr = F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - prev), F.abs(F.col("l") - prev))
    both = F.collect_list(F.struct(tr.alias("tr"), (F.col("h") - F.col("l")).alias("first"))).over(trailing(context))
    out = bars.withColumn("_x", both).withColumn("_x", F.transform("_x", lambda v, i: F.when(i == 0, v["first"]).otherwise(v["tr"])))
    seed = _mean(F.slice("_x", 1, window))
    value = F.aggregate(F.slice("_x", window + 1, context), seed, lambda a, v: (a * (window - 1) + v) / window)
    return out.withColumn("atr", F.when(F.size("_x") >= window, value)).drop("_x")


def percentile_of(x: Column, q: float) -> Column:
    """Linear interpolation in a sorted array."""
    at = (F.size(x) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(x, low), F.coalesce(F.get(x, low + 1), F.get(x, low))
    return a + (b - a) * (at - low)


def atr_regime(with_atr: DataFrame, rows: int = 50) -> DataFrame:
    """Adds regime: the place of atr among the last ones; normal with fewer than `rows`."""
    x = F.array_sort(F.collect_list("atr").over(trailing(rows)))
    out = with_atr.withColumn("_x", x)
    a = F.col("atr")
    label = F.when((F.size("_x") < rows) | a.isNull(), "normal").when(a >= percentile_of(F.col("_x"), 0.9), "extreme").when(a >= percentile_of(F.col("_x"), 0.75), "high").when(a <= percentile_of(F.col("_x"), 0.25), "low").otherwise("normal")
    return out.withColumn("regime", label).drop("_x")


def ema_of(x: Column, period: int) -> Column:
    """Exponential mean over an array, seeded with its first element."""
    alpha = 2.0 / (period + 1)
    return F.aggregate(F.slice(x, 2, 1_000_000), F.get(x, F.lit(0)), lambda a, v: a + (v - a) * alpha)


def ema(bars: DataFrame, period: int, rows: int) -> DataFrame:
    return bars.withColumn("ema", ema_of(F.collect_list("c").over(trailing(rows)), period))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, rows: int = 45) -> DataFrame:
    """Adds macd and its signal line, all three means seeded at the start of the tail."""
    x = F.collect_list("c").over(trailing(rows))
    a, b, s = (2.0 / (p + 1) for p in (fast, slow, signal))
    start = lambda v: F.struct(v.alias("f"), v.alias("s"), F.lit(0.0).alias("g"))

    def step(acc: Column, v: Column) -> Column:
        f, w = acc["f"] + (v - acc["f"]) * a, acc["s"] + (v - acc["s"]) * b
        return F.struct(f.alias("f"), w.alias("s"), (acc["g"] + (f - w - acc["g"]) * s).alias("g"))

    out = bars.withColumn("_x", x).withColumn("_m", F.aggregate(F.slice("_x", 2, rows), start(F.get("_x", F.lit(0))), step))
    return out.withColumn("macd", F.col("_m.f") - F.col("_m.s")).withColumn("signal", F.col("_m.g")).drop("_x", "_m")


def statistical_forecast(bars: DataFrame, rows: int = 32, horizon: int = 5, span: int = 12) -> DataFrame:
    """Adds expected return (mean of an exponential mean of log returns and a regression slope, over the horizon),
    its two parts, and confidence; without enough bars 0 and 0.05."""
    x = F.collect_list("c").over(trailing(rows))
    out = bars.withColumn("_x", x).withColumn("_r", F.transform(F.sequence(F.lit(1), F.greatest(F.size("_x") - 1, F.lit(1))), lambda i: F.ln(F.get("_x", i) / F.get("_x", i - 1))))
    ewm = ema_of(F.col("_r"), span) * horizon
    n = F.size("_x")
    mean_i, mean_x = (n - 1) / 2, _mean(F.col("_x"))
    cov = F.aggregate(F.transform("_x", lambda v, i: (i - mean_i) * (v - mean_x)), F.lit(0.0), lambda a, v: a + v)
    var = F.aggregate(F.transform("_x", lambda v, i: (i - mean_i) * (i - mean_i)), F.lit(0.0), lambda a, v: a + v)
    slope = F.try_divide(cov, var) * horizon / F.col("c")
    sd = F.sqrt(F.greatest(_mean(F.transform("_r", lambda v: v * v)) - F.pow(_mean(F.col("_r")), F.lit(2.0)), F.lit(0.0)))
    out = out.withColumn("ewm", ewm).withColumn("slope", slope).withColumn("_sd", sd)
    strength = F.try_divide(F.abs((F.col("ewm") + F.col("slope")) / 2), F.col("_sd") * horizon**0.5)
    confidence = clamp(F.coalesce(strength, F.lit(0.0)), 0.05, 0.95) * F.when(F.signum("ewm") * F.signum("slope") < 0, 0.6).otherwise(1.0)
    enough = n >= rows
    return out.select(*bars.columns, F.when(enough, F.col("ewm")).otherwise(0.0).alias("ewm"), F.when(enough, F.col("slope")).otherwise(0.0).alias("slope"), F.when(enough, (F.col("ewm") + F.col("slope")) / 2).otherwise(0.0).alias("expected"), F.when(enough, confidence).otherwise(0.05).alias("confidence"))


def series(rows: DataFrame, values: list[str], *order: str) -> DataFrame:
    """One row per key: its rows in order of time as an array xs."""
    return rows.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("t", *order, *values))).alias("xs"))


def price_zones(points: DataFrame, price: str, width: float = 0.002) -> DataFrame:
    """Sorted prices of a key fall into zones: a new one starts where a price is farther than `width` of the running
    zone's mean from that mean. The mean moves as the zone grows, so this is a fold, not a gap rule. Nothing lies within
    a share of a mean of 0, so each price of 0 is a zone of its own."""
    sorted_ = points.groupBy("k").agg(F.sort_array(F.collect_list(price)).alias("xs"))
    zone = "struct<total: double, n: bigint, lo: double, hi: double>"
    start = F.struct(F.array().cast(f"array<{zone}>").alias("done"), F.lit(None).cast(zone).alias("now"))

    def step(a: Column, p: Column) -> Column:
        mean = a["now"]["total"] / a["now"]["n"]
        fits = F.coalesce(F.try_divide(F.abs(p - mean), mean) <= width, F.lit(False))
        fresh = F.struct(p.alias("total"), F.lit(1).cast("long").alias("n"), p.alias("lo"), p.alias("hi"))
        grown = F.struct((a["now"]["total"] + p).alias("total"), (a["now"]["n"] + 1).alias("n"), a["now"]["lo"].alias("lo"), p.alias("hi"))
        done = F.when(fits | a["now"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["now"]))
        return F.struct(done.alias("done"), F.when(fits, grown).otherwise(fresh).alias("now"))

    folded = sorted_.select("k", F.aggregate("xs", start, step, lambda a: F.array_append(a["done"], a["now"])).alias("zones"))
    return folded.select("k", F.explode("zones").alias("z")).select("k", (F.col("z.total") / F.col("z.n")).alias("mid"), F.col("z.n").alias("n"), F.col("z.lo").alias("low"), F.col("z.hi").alias("high"))


def sprt(rows: DataFrame, value: str, effect: float, alpha: float = 0.05, beta: float = 0.2, warm: int = 12, floor: float = 0.01, least: int = 40) -> DataFrame:
    """One row per key: Welford variance, log likelihood ratio of mean `effect` against 0 after the warm-up, and the
    verdict at its boundaries once there are enough rows."""
    xs = series(rows, [value])
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.lit(0.0).alias("llr"))

    def step(a: Column, x: Column) -> Column:
        v = x[value]
        n = a["n"] + 1
        mean = a["mean"] + (v - a["mean"]) / n
        m2 = a["m2"] + (v - a["mean"]) * (v - mean)
        var = F.greatest(F.lit(floor), F.when(n > 1, m2 / F.greatest(n - 1, F.lit(1))).otherwise(0.0))
        gain = F.when(n > warm, (effect * v - effect * effect / 2) / var).otherwise(0.0)
        return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"), (a["llr"] + gain).alias("llr"))

    import math

    upper, lower = math.log((1 - beta) / alpha), math.log(beta / (1 - alpha))
    out = xs.select("k", F.aggregate("xs", start, step).alias("s")).select("k", "s.n", "s.mean", "s.llr")
    return out.withColumn("verdict", F.when(F.col("n") < least, "CONTINUE").when(F.col("llr") >= upper, "ACCEPT").when(F.col("llr") <= lower, "REJECT").otherwise("CONTINUE"))


def fixed_share(rows: DataFrame, losses: list[str], eta: float = 0.5, share: float = 0.05) -> DataFrame:
    """One row per key: weights of experts after multiplicative updates by their losses, a share of which is spread
    evenly each time so that a late leader can recover."""
    xs = series(rows, losses)
    m = len(losses)
    start = F.array(*[F.lit(1.0 / m)] * m)

    def step(w: Column, x: Column) -> Column:
        raw = F.array(*(F.get(w, F.lit(i)) * F.exp(-eta * x[c]) for i, c in enumerate(losses)))
        total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
        return F.transform(raw, lambda v: (1 - share) * v / total + share / m)

    out = xs.select("k", F.aggregate("xs", start, step).alias("w"))
    return out.select("k", *(F.get("w", F.lit(i)).alias(f"w_{c}") for i, c in enumerate(losses)))


def adaptive_state(rows: DataFrame, value: str, alpha: float = 0.3, most: float = 0.05, low: float = 0.3, high: float = 0.9, start: float = 0.5) -> DataFrame:
    """One row per key: a threshold moved towards each session's value by an exponential mean, in steps of at most
    `most` and within bounds."""
    xs = series(rows, [value])
    begin = F.struct(F.lit(start).alias("ema"), F.lit(start).alias("threshold"))

    def step(a: Column, x: Column) -> Column:
        e = a["ema"] * (1 - alpha) + x[value] * alpha
        return F.struct(e.alias("ema"), clamp(a["threshold"] + clamp(e - a["threshold"], -most, most), low, high).alias("threshold"))

    return xs.select("k", F.aggregate("xs", begin, step).alias("s")).select("k", "s.ema", "s.threshold")


def bankroll(trades: DataFrame, start: str, *order: str, block: str = "day") -> DataFrame:
    """Exact cash of each key in DECIMAL at its end, and the least it ever was. Trades meet only others of their block of
    time (a unit of date_trunc), whose sum and lowest running sum are enough to go on."""
    inside = Window.partitionBy("k", "_block").orderBy("t", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = trades.select("k", "t", *order, F.col("pnl").cast("decimal(20,4)").alias("_v"), F.date_trunc(block, F.col("t")).alias("_block")).withColumn("_c", F.sum("_v").over(inside))
    blocks = cut.groupBy("k", "_block").agg(F.count("*").alias("n"), F.sum("_v").alias("_sum"), F.min("_c").alias("_low"))
    base = F.coalesce(F.sum("_sum").over(Window.partitionBy("k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cash = F.lit(start).cast("decimal(20,4)")
    out = blocks.withColumn("_low", base + F.col("_low")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("_sum").alias("_sum"), F.min("_low").alias("_low"))
    return out.select("k", "n", (cash + F.col("_sum")).cast("double").alias("last"), (cash + F.col("_low")).cast("double").alias("lowest"))


def simulate_portfolio(bars: DataFrame, cash: float = 10_000.0, stop: float = 0.2, target: float = 0.3, risk: float = 0.1) -> DataFrame:
    """One row per key: a long-only account with one position at a time, bar by bar on closes.

    A position is bought at the close where the bar rose, sized to risk a share of equity at the stop, and sold at
    exactly the stop or target once a close reaches it; the stop is looked at first.
    """
    xs = series(bars, ["o", "c"])
    begin = F.struct(F.lit(cash).alias("cash"), F.lit(0.0).alias("qty"), F.lit(0.0).alias("entry"), F.lit(0).cast("long").alias("trades"), F.lit(0).cast("long").alias("stops"))

    def step(a: Column, x: Column) -> Column:
        held = a["qty"] > 0
        stopped, hit = held & (x["c"] <= a["entry"] * (1 - stop)), held & (x["c"] >= a["entry"] * (1 + target))
        price = F.when(stopped, a["entry"] * (1 - stop)).otherwise(a["entry"] * (1 + target))
        closed = stopped | hit
        money = F.when(closed, a["cash"] + a["qty"] * price).otherwise(a["cash"])
        want = F.floor(F.least(money * risk / (x["c"] * stop), money / x["c"])).cast("double")
        buys = ~held & (x["c"] > x["o"]) & (want >= 1)
        return F.struct(
            F.when(buys, money - want * x["c"]).otherwise(money).alias("cash"), F.when(buys, want).when(closed, 0.0).otherwise(a["qty"]).alias("qty"), F.when(buys, x["c"]).when(closed, 0.0).otherwise(a["entry"]).alias("entry"),
            (a["trades"] + F.when(closed, 1).otherwise(0)).alias("trades"), (a["stops"] + F.when(stopped, 1).otherwise(0)).alias("stops"),
        )

    out = xs.select("k", F.aggregate("xs", begin, step).alias("s"), F.element_at("xs", -1)["c"].alias("last"))
    return out.select("k", F.col("s.trades").alias("trades"), F.col("s.stops").alias("stops"), (F.col("s.cash") + F.col("s.qty") * F.col("last")).alias("equity"))

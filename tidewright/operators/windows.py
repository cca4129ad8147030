"""Features of the past: every value at time t hangs on rows up to t alone, unless a column says when it is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bars import in_time, trailing


def true_range(bars: DataFrame) -> DataFrame:
    """Adds tr. greatest() skips nulls, so a key's first bar has high less low."""
    prev = F.lag("c").over(in_time())
    return bars.withColumn("tr", F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - prev), F.abs(F.col("l") - prev)))


def swings(bars: DataFrame, side: int = 5) -> DataFrame:
    """Adds swing_high, swing_low and known_at. A swing is strictly beyond all of `side` bars before and after it, so
    it is known only at the last of those."""
    before, after = in_time().rowsBetween(-side, -1), in_time().rowsBetween(1, side)
    full = (F.count("*").over(before) == side) & (F.count("*").over(after) == side)
    high = full & (F.col("h") > F.max("h").over(before)) & (F.col("h") > F.max("h").over(after))
    low = full & (F.col("l") < F.min("l").over(before)) & (F.col("l") < F.min("l").over(after))
    return bars.withColumn("swing_high", high).withColumn("swing_low", low).withColumn("known_at", F.when(high | low, F.lead("t", side).over(in_time())))


def trend(swung: DataFrame, last: int = 4, need: float = 0.75) -> DataFrame:
    """One row per key: the shares of rising swing highs and lows among the last few, and the trend they tell."""

    def share(flag: str, value: str, name: str) -> DataFrame:
        only = swung.where(flag)
        newest = only.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t")))).where(F.col("_r") <= last)
        rising = newest.withColumn("_up", (F.col(value) > F.lag(value).over(in_time())).cast("double"))
        return rising.groupBy("k").agg(F.avg("_up").alias(name))

    out = swung.select("k").distinct().join(share("swing_high", "h", "higher_highs"), "k", "left").join(share("swing_low", "l", "higher_lows"), "k", "left")
    both = (F.col("higher_highs") + F.col("higher_lows")) / 2
    label = F.when(both.isNull(), "unknown").when(both >= need, "uptrend").when(both <= 1 - need, "downtrend").otherwise("ranging")
    return out.withColumn("trend", label)


def liquidity(bars: DataFrame, rows: int = 20) -> DataFrame:
    """Adds avg_volume, relative_volume and spread (range over close)."""
    avg = F.avg("v").over(trailing(rows))
    return bars.withColumn("avg_volume", avg).withColumn("relative_volume", F.try_divide(F.col("v"), avg)).withColumn("spread", F.try_divide(F.col("h") - F.col("l"), F.col("c")))


def returns(bars: DataFrame, steps: tuple[int, ...] = (1, 5, 15)) -> DataFrame:
    """Adds ret_k: the change over k bars, 0 where there are too few."""
    for k in steps:
        bars = bars.withColumn(f"ret_{k}", F.coalesce(F.try_divide(F.col("c"), F.lag("c", k).over(in_time())) - 1, F.lit(0.0)))
    return bars


def rsi(bars: DataFrame, rows: int = 14) -> DataFrame:
    """Adds rsi from plain sums of gains and losses: 50 with too few bars, 100 without losses."""
    step = bars.withColumn("_d", F.col("c") - F.lag("c").over(in_time()))
    gain, loss = F.sum(F.greatest("_d", F.lit(0.0))).over(trailing(rows)), F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).over(trailing(rows))
    value = F.when(F.count("_d").over(trailing(rows)) < rows, 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    return step.withColumn("rsi", value).drop("_d")


def bollinger(bars: DataFrame, rows: int = 20) -> DataFrame:
    """Adds sma, boll_z and boll_width; 0 for z and width without spread or with too few bars."""
    w = trailing(rows)
    enough = F.count("*").over(w) == rows
    mean, sd = F.avg("c").over(w), F.stddev_pop("c").over(w)
    out = bars.withColumn("sma", F.when(enough, mean)).withColumn("_sd", F.when(enough, sd))
    return out.withColumn("boll_z", F.coalesce(F.try_divide(F.col("c") - F.col("sma"), F.col("_sd")), F.lit(0.0))).withColumn("boll_width", F.coalesce(F.try_divide(4 * F.col("_sd"), F.col("sma")), F.lit(0.0))).drop("_sd")


def volatility(bars: DataFrame, rows: int = 30, short: int = 5, long: int = 60) -> DataFrame:
    """Adds realised volatility of returns, short over long mean volume, place in the long range, and whether short
    and long drifts agree."""
    out = returns(bars, (1,))
    first, last = F.first("c").over(trailing(long)), F.col("c")
    span = F.max("h").over(trailing(long)) - F.min("l").over(trailing(long))
    out = out.withColumn("realised_vol", F.coalesce(F.stddev_pop("ret_1").over(trailing(rows)), F.lit(0.0)))
    out = out.withColumn("volume_ratio", F.coalesce(F.try_divide(F.avg("v").over(trailing(short)), F.avg("v").over(trailing(long))), F.lit(1.0)))
    out = out.withColumn("range_position", F.coalesce(F.try_divide(last - F.min("l").over(trailing(long)), span), F.lit(0.5)))
    return out.withColumn("trend_alignment", F.signum(last - first) * F.signum(last - F.first("c").over(trailing(short)))).drop("ret_1")


def return_sequence(bars: DataFrame, rows: int = 60) -> DataFrame:
    """Adds seq: the last `rows` returns, padded with zeros on the left."""
    out = returns(bars, (1,))
    seq = F.collect_list("ret_1").over(trailing(rows))
    return out.withColumn("seq", F.concat(F.array_repeat(F.lit(0.0), rows - F.size(seq)), seq)).drop("ret_1")


def trailing_accuracy(settled: DataFrame, hit: str = "y", rows: int = 20) -> DataFrame:
    """Adds regime_acc: the share of hits among the `rows` rows before this one; null with fewer."""
    w = trailing(rows, skip=1)
    return settled.withColumn("regime_acc", F.when(F.count(hit).over(w) == rows, F.avg(hit).over(w)))


def losing_streak(closed: DataFrame, *order: str, block: str = "day") -> DataFrame:
    """One row per key: how many of its last trades in a row made no gain. Trades meet only others of their block of time
    (a unit of date_trunc); of a block its gains and the trades after the last of them are enough."""
    inside = Window.partitionBy("k", "_block").orderBy(F.desc("t"), *(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = closed.select("k", "t", *order, F.coalesce(F.col("pnl") > 0, F.lit(False)).cast("long").alias("_gain"), F.date_trunc(block, F.col("t")).alias("_block"))
    blocks = cut.withColumn("_g", F.sum("_gain").over(inside)).groupBy("k", "_block").agg(F.count_if(F.col("_g") == 0).alias("_after"), F.max("_g").alias("_gains"))
    later = F.sum("_gains").over(Window.partitionBy("k").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("_later", F.coalesce(later, F.lit(0))).groupBy("k").agg(F.sum(F.when(F.col("_later") == 0, F.col("_after")).otherwise(0)).alias("streak"))


def drawdown(points: DataFrame, value: str, *order: str, floor: float | None = None) -> DataFrame:
    """Adds peak and down: how far the running sum of `value` lies below its peak so far (at least `floor`)."""
    w = in_time("k", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = points.withColumn("running", F.sum(value).over(w))
    peak = F.max("running").over(w)
    return out.withColumn("peak", peak if floor is None else F.greatest(F.lit(floor), peak)).withColumn("down", F.col("peak") - F.col("running"))


def crossings(path: DataFrame, strike: str, value: str = "px", key: str = "k") -> DataFrame:
    """One row per key: share of the path above its strike, how often it crossed, and its last drift."""
    w = in_time(key, "id")
    side = path.withColumn("_s", F.signum(F.col(value) - F.col(strike))).withColumn("_p", F.lag("_s").over(w)).withColumn("_d", F.col(value) - F.lag(value, 3).over(w))
    crossed = F.sum((F.col("_s") * F.col("_p") < 0).cast("long"))
    return side.groupBy(key).agg(F.avg((F.col("_s") > 0).cast("double")).alias("above"), F.coalesce(crossed, F.lit(0)).alias("crossings"), F.max_by("_d", F.struct("t", "id")).alias("drift"))


def order_flow(ticks: DataFrame, seconds: tuple[int, ...] = (60, 300, 900), whale: float = 90.0) -> DataFrame:
    """Adds for each span the imbalance of buys and sells, and counts of trades and of large ones, up to each tick.
    Ticks at one time see each other. A span with an infinite size, or one that is no number, has no imbalance (NaN).

    A key's time is cut into blocks of an hour or the longest span, and a block has the ticks of such a span before it,
    too. A span is the difference of two sums from the block's start, so its length and how dense ticks are cost nothing.
    """
    longest = max(seconds) * 1_000_000
    width = max(longest, 3_600_000_000)
    row = F.struct(*(F.col(f"`{c}`") for c in ticks.columns))
    u = F.unix_micros(F.col("t").cast("timestamp"))
    known = F.coalesce(F.abs("size") < float("inf"), F.lit(True))  # not of NaN, which is more than all others
    size = F.when(known, F.col("size"))
    x = ticks.select("k", u.alias("_u"), row.alias("_row"), F.when(F.col("taker_buy"), size).otherwise(0.0).alias("_buys"), size.alias("_size"), F.lit(1).cast("long").alias("_n"), F.coalesce(F.col("size") >= whale, F.lit(False)).cast("long").alias("_whales"), (~known).cast("long").alias("_odd"))
    block = F.col("_u") - F.pmod("_u", F.lit(width))
    own = x.withColumn("_block", block)
    context = x.where(F.pmod("_u", F.lit(width)) >= width - longest).withColumn("_block", block + width).withColumn("_row", F.lit(None).cast(own.schema["_row"].dataType))
    both = own.unionByName(context)
    w = Window.partitionBy("k", "_block").orderBy("_u")
    values = ("_buys", "_size", "_n", "_whales", "_odd")
    sums = {f"_to{v}": F.coalesce(F.sum(v).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) for v in values}
    for s in seconds:
        past = w.rangeBetween(Window.unboundedPreceding, -s * 1_000_000 - 1)
        sums |= {f"_{s}{v}": F.when(F.col("_u").isNull(), F.lit(0)).otherwise(F.coalesce(F.sum(v).over(past), F.lit(0))) for v in values}
    out, added = both.withColumns(sums).where("_row is not null"), []
    for s in seconds:
        buys, every, n, whales, odd = (F.col(f"_to{v}") - F.col(f"_{s}{v}") for v in values)
        imbalance = F.when(odd > 0, float("nan")).otherwise(F.coalesce(F.try_divide(2 * buys - every, every), F.lit(0.0)))
        added += [imbalance.alias(f"imbalance_{s}"), n.cast("long").alias(f"trades_{s}"), whales.cast("long").alias(f"whales_{s}")]
    return out.select("_row.*", *added)


def recency_weight(bars: DataFrame, late: float = 1.1) -> DataFrame:
    """Adds weight: `late` for the later half of a key's bars, else 1."""
    n = F.count("*").over(Window.partitionBy("k"))
    return bars.withColumn("weight", F.when(F.row_number().over(in_time()) - 1 >= F.floor(n / 2), late).otherwise(1.0))


def first_in_bucket(rows: DataFrame, bucket: Column, *order: str) -> DataFrame:
    """The first row of each key and bucket."""
    w = Window.partitionBy("k", "_b").orderBy("t", *order)
    return rows.withColumn("_b", bucket).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumnRenamed("_b", "bucket")


def expanding(bars: DataFrame, value: str, steps: int = 5) -> DataFrame:
    return bars.withColumn("expanding", F.coalesce(F.col(value) > F.lag(value, steps).over(in_time()), F.lit(False)))


def discretised(bars: DataFrame) -> DataFrame:
    """Adds state: four three-way codes of momentum, trend, volatility and volume."""
    three = lambda x, a, b: F.when(x < a, 0).when(x > b, 2).otherwise(1)
    out = returns(bars, (1, 5))
    out = volatility(out)
    state = F.array(three(F.col("ret_5"), -0.05, 0.05), three(F.col("range_position"), 0.33, 0.67), three(F.col("realised_vol"), 0.5, 1.5), three(F.col("volume_ratio"), 0.8, 1.2))
    return out.withColumn("state", state)

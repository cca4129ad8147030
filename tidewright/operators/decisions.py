"""Decisions and their review: tags, alignment, roll-ups, fills, stakes, settlement, verdicts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions.scalar import clamp

from .bars import in_time, trailing


def newest_first(*by: str, order: tuple[str, ...] = ()) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("t"), *(F.desc(c) for c in order)))


def tail(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows of each key."""
    return rows.withColumn("_r", newest_first("k", order=order)).where(F.col("_r") <= n).drop("_r")


def thinned(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """At most about `most` rows of each key, evenly spaced, the first kept."""
    w = Window.partitionBy("k")
    stride = F.greatest(F.ceil(F.count("*").over(w) / most), F.lit(1))
    return rows.withColumn("_s", stride).withColumn("_i", F.row_number().over(in_time("k", *order)) - 1).where("_i % _s = 0").drop("_s", "_i")


def tags(*rules: tuple[Column, str]) -> tuple[Column, Column]:
    """All tags that apply, and the first of them in the order given."""
    every = F.array_compact(F.array(*(F.when(c, n) for c, n in rules)))
    return every, F.get(every, F.lit(0))


def alignment(call: Column, market: Column, outcome: Column) -> Column:
    """How a call stands to the market's and to the outcome."""
    return F.when((call == outcome) & (market == outcome), "both_right").when(call == outcome, "alone_right").when(market == outcome, "alone_wrong").otherwise("both_wrong")


def daily(rows: DataFrame) -> DataFrame:
    """By day: count, win rate, the rate needed to break even at the mean price, and the edge over it."""
    out = rows.groupBy(F.date_trunc("day", "t").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.avg("y").alias("win_rate"), F.avg("market").alias("break_even"))
    return out.withColumn("edge", F.col("win_rate") - F.col("break_even"))


def one_decision(rows: DataFrame, window: list[str], left: str, most: float) -> DataFrame:
    """The row of each window with the most minutes left, of those within the limit."""
    ok = rows.where(F.col(left) <= most)
    return ok.withColumn("_r", F.row_number().over(Window.partitionBy(*window).orderBy(F.desc(left), "id"))).where("_r = 1").drop("_r")


def direction_pnl(bars: DataFrame) -> DataFrame:
    """Paper gain, in basis points, of following the last move for one bar, and its change from first to second half."""
    w = in_time()
    ret = F.try_divide(F.lead("c").over(w), F.col("c")) - 1
    x = bars.withColumn("_b", F.signum(F.col("c") - F.lag("c").over(w)) * ret * 10_000).where(F.col("_b").isNotNull())
    x = x.withColumn("_h", F.row_number().over(w) <= F.floor(F.count("*").over(Window.partitionBy("k")) / 2))
    out = x.groupBy("k").agg(F.count("*").alias("n"), F.sum("_b").alias("bps"), F.avg(F.when(F.col("_h"), F.col("_b"))).alias("_x"), F.avg(F.when(~F.col("_h"), F.col("_b"))).alias("_y"))
    return out.select("k", "n", "bps", (F.col("_y") - F.col("_x")).alias("improvement"))


def fill_curve(orders: DataFrame, quotes: DataFrame, distances: list[float], within: str) -> DataFrame:
    """For limits so far below each order's price: the share that a later quote of the key reaches, and the mean wait.

    Orders meet the quotes of their own and the next stretch of time, each as long as `within`, an interval of fixed
    length. The first quote that reaches a limit is found by steps over minima of 1, 2, 4... quotes, so that no pairs
    of orders and quotes arise and a task holds the rows of two stretches of a key.
    """

    def rows(x: DataFrame, is_order: bool) -> DataFrame:
        micros = lambda t: F.unix_micros(t.cast("timestamp"))
        until = micros(F.col("t") + F.expr(f"interval {within}"))
        return x.select("k", micros(F.col("t")).alias("at"), until.alias("until"), F.col("px").cast("double").alias("px"), F.lit(is_order).alias("is_order")).withColumn("stretch", F.expr("at div (until - at)"))

    q = rows(quotes.dropna(subset=["k", "t", "px"]), False)
    both = rows(orders, True).unionByName(q.withColumn("stretch", F.explode(F.array("stretch", F.col("stretch") - 1))))
    kind = orders.schema["k"].dataType.simpleString()

    def first_hits(group: pa.Table) -> pa.Table:
        is_order = group["is_order"].to_numpy()
        mine, theirs = group.filter(pa.array(is_order)), group.filter(pa.array(~is_order)).sort_by("at")
        at, px = theirs["at"].to_numpy(), theirs["px"].to_numpy()
        least = [px]  # of 2 ** level quotes from each on
        while 2 ** len(least) <= len(px):
            half = 2 ** (len(least) - 1)
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        known = mine.filter(pc.and_(pc.is_valid(mine["at"]), pc.is_valid(mine["px"])))
        t0, until, price = (known[c].to_numpy() for c in ("at", "until", "px"))
        out = []
        for d in distances:
            k = np.searchsorted(at, t0, "right")
            for level in range(len(least) - 1, -1, -1):
                can = np.flatnonzero(k + 2**level <= len(at))
                can = can[least[level][k[can]] > price[can] - d]
                k[can] += 2**level
            hit = np.flatnonzero(k < len(at))
            hit = hit[at[k[hit]] <= until[hit]]
            out.append((float(d), len(mine), len(hit), int((at[k[hit]] // 1_000_000 - t0[hit] // 1_000_000).sum())))
        columns = list(zip(*out, strict=True))
        return pa.table({"k": pa.array([group["k"][0].as_py()] * len(out), group.schema.field("k").type), "distance": pa.array(columns[0], pa.float64()), "n": pa.array(columns[1], pa.int64()), "hits": pa.array(columns[2], pa.int64()), "waited": pa.array(columns[3], pa.int64())})

    found = both.groupBy("k", "stretch").applyInArrow(first_hits, f"k {kind}, distance double, n long, hits long, waited long")
    summed = found.groupBy("k", "distance").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("waited").alias("waited")).where("n > 0")
    return summed.select("k", "distance", "n", (F.col("hits") / F.col("n")).alias("filled"), F.when(F.col("hits") > 0, F.col("waited") / F.col("hits")).alias("wait_s"))


def missingness(rows: DataFrame, kept: Column, value: str) -> DataFrame:
    """Kept and left-out rows side by side: count, upper median, share of ups. A median needs as much memory as there
    are distinct values; they are counted before the shuffle."""
    median = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")
    return rows.groupBy(kept.alias("kept")).agg(F.count("*").alias("n"), median.alias("median"), F.avg("y").alias("up"))


def consensus(votes: DataFrame, arm: str, vote: str, loss: str, rows: int = 50) -> DataFrame:
    """Per slot the median vote without the arm that did worst over its last rows, ties to the later name; the median
    of an even number is the lower middle."""
    scored = votes.withColumn("_l", F.avg(loss).over(Window.partitionBy(arm).orderBy("t").rowsBetween(-rows, -1)))
    worst = F.max(F.when(F.col("_l").isNotNull(), F.struct("_l", arm))).over(Window.partitionBy("t"))
    stay = scored.withColumn("_w", worst).where(F.col("_w").isNull() | (F.col(arm) != F.col(f"_w.{arm}")))
    x = F.array_sort(F.collect_list(vote))
    return stay.groupBy("t").agg(F.count("*").alias("voters"), F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")).alias("consensus"))


def agreed_median(rows: DataFrame, value: str, long: int = 30, short: int = 10) -> DataFrame:
    """Adds agreed: of the medians of the last `long` and `short` rows the smaller in size, if they have one sign, cut
    to a whole number; else 0."""

    def median(n: int) -> Column:
        x = F.array_sort(F.collect_list(value).over(trailing(n)))
        at = lambda i: F.get(x, F.floor(i).cast("int"))
        return (at((F.size(x) - 1) / 2) + at(F.size(x) / 2)) / 2

    a, b = median(long), median(short)
    return rows.withColumn("agreed", F.when(F.signum(a) * F.signum(b) > 0, F.when(F.abs(a) <= F.abs(b), a).otherwise(b).cast("long")).otherwise(0))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins from low to high; values outside fall into the first or last."""
    b = clamp(F.floor((F.col(value) - low) / (high - low) * bins), 0, bins - 1).cast("int")
    return rows.groupBy("k", b.alias("bin")).agg(F.count("*").alias("n"))


def episode_score(rows: DataFrame, forecast: str, actual: str) -> DataFrame:
    """Whole-number hits, shares within 1, 10 and 50, MAE and RMSE."""
    e = F.abs(F.col(forecast) - F.col(actual))
    inside = lambda x: F.avg((e <= x).cast("double"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.avg((F.col(forecast).cast("long") == F.col(actual).cast("long")).cast("double")).alias("exact"), inside(1.0).alias("within_1"), inside(10.0).alias("within_10"), inside(50.0).alias("within_50"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def shaped_reward(error: Column, band: Column, same_direction: Column) -> Column:
    """1 at no error, falling through 0 at twice the band to a floor of -1; a little more for the right direction."""
    u = error / band
    return F.greatest(F.lit(-1.0), F.when(u <= 1, 1 - u / 2).otherwise((2 - u) / 2)) + F.when(same_direction, 0.1).otherwise(0.0)


def stake(bankroll: Column, price: Column, fee: Column, share: float, most_depth: Column) -> Column:
    """Whole contracts for a share of the bankroll, at price and fee in cents, within the depth on offer."""
    return F.greatest(F.lit(0), F.floor(F.least(bankroll * share / (price + fee), most_depth))).cast("long")


def settle_binary(calls: DataFrame, bars: DataFrame, back: str) -> DataFrame:
    """Calls (k, close_t, strike, p) with the outcome: did the bar `back` before the close end at the strike or above."""
    final = bars.select("k", (F.col("t") + F.expr(f"interval {back}")).alias("close_t"), F.col("c").alias("final"))
    out = calls.join(final, ["k", "close_t"], "left").withColumn("actual", (F.col("final") >= F.col("strike")).cast("int"))
    return out.withColumn("hit", ((F.col("p") >= 0.5).cast("int") == F.col("actual")).cast("int")).withColumn("brier", F.pow(F.col("p") - F.col("actual"), F.lit(2.0)))


def zombies(opened: DataFrame, closed: DataFrame, key: list[str], now: Column) -> DataFrame:
    """Positions past their time that nothing closed."""
    return opened.where(F.col("t") < now).join(closed.select(*key), key, "left_anti")


def ablation(results: DataFrame, config: str, baseline: str, value: str, band: float = 0.5) -> DataFrame:
    """Each configuration's difference to the baseline of its key; positive: leaving the part out helped."""
    base = results.where(F.col(config) == baseline).select("k", F.col(value).alias("_b"))
    out = results.where(F.col(config) != baseline).join(base, "k").withColumn("delta", F.col(value) - F.col("_b")).drop("_b")
    return out.withColumn("label", F.when(F.col("delta") > band, "positive").when(F.col("delta") < -band, "negative").otherwise("neutral"))


def snapped_median(values: DataFrame, value: str, allowed: list[float]) -> DataFrame:
    """The median over all rows, moved to the nearest allowed setting, the smaller of two."""
    m = values.agg(F.median(value).alias("median"))
    return m.withColumn("a", F.explode(F.array(*map(F.lit, allowed)))).groupBy("median").agg(F.min_by("a", F.struct(F.abs(F.col("a") - F.col("median")), F.col("a"))).alias("snapped"))


def verdict(per_key: DataFrame) -> DataFrame:
    """One row: a ladder of verdicts over keys with their trades, win rate and drawdown."""
    traded = F.col("n") > 0
    out = per_key.agg(F.sum(traded.cast("long")).alias("traded"), F.avg(F.when(traded, (F.col("win_rate") > 0.4).cast("double"))).alias("good"), F.bool_and(F.col("drawdown") < 0.2).alias("calm"))
    return out.withColumn("verdict", F.when(F.col("traded") == 0, "FAILS").when((F.col("traded") >= 3) & (F.col("good") >= 0.5) & F.col("calm"), "READY").when(~F.col("calm"), "NEEDS_RISK").otherwise("NEEDS_EDGE"))

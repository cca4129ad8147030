"""Training sets of decisions: what was done, what might have been done, and what was known when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalar import clamp

from .ledger import last_wins

#: Weights of what was done and of what might have been.
REAL, MIGHT = 3.0, 1.0


def decision_features(side: Column, price: Column, p: Column, minutes: Column, forced: Column, third: Column, path: Column) -> Column:
    """Fifteen numbers known at a decision: one, the taken side's chance, its price, the edge, how deep into a window of
    15 minutes, forced, side; a third forecast's chance less a half, twice its size, and its presence; and the path in
    the window (occupancy, whipsaw, drift, drift of quotes) towards the taken side, and its presence."""
    yes = side == "yes"
    taken = F.when(yes, p).otherwise(1 - p)
    other = F.when(yes, third).otherwise(1 - third) - 0.5
    sign = F.when(yes, 1.0).otherwise(-1.0)
    there = path.isNotNull() & (F.size(path) == 4)
    along = [sign * F.get(path, F.lit(0)), F.get(path, F.lit(1)), sign * F.get(path, F.lit(2)) / 4, sign * F.get(path, F.lit(3)) * 5]
    first = [F.lit(1.0), taken, price / 100, (100 * taken - price) / 100, clamp(minutes, 0.0, 15.0) / 15, forced.cast("double"), yes.cast("double")]
    thirds = [F.coalesce(other, F.lit(0.0)), F.coalesce(2 * F.abs(other), F.lit(0.0)), third.isNotNull().cast("double")]
    return F.array(*first, *thirds, *(F.when(there, a).otherwise(0.0) for a in along), F.coalesce(there, F.lit(False)).cast("double"))


def supervised_set(bets: DataFrame, calls: DataFrame, thirds: DataFrame, ask_over_mid: float = 2.5) -> DataFrame:
    """(ticker, t, label_t, x, y, weight, price, real): a row for each settled bet (ticker, t, close_t, side, price in
    cents, p, mins_left, forced, win, path), and one for each settled call (ticker, t, close_t, p, call, hit, market,
    mins_left, path) as the bet that it would have been: on the called side, at the market's chance and what the ask
    lies above it, if that is a price from 1 to 99 cents.

    A third forecast (ticker, t, mins_left, p) of the same whole minute is a feature; of several the latest. Both kinds
    have features of their own minute alone, and are labelled when their window closes (label_t).
    """
    real = bets.where("win is not null").select("ticker", "t", F.col("close_t").alias("label_t"), "side", F.col("price").cast("double").alias("price"), "p", "mins_left", F.coalesce("forced", F.lit(False)).alias("forced"), F.col("win").cast("int").alias("y"), F.lit(REAL).alias("weight"), "path", F.lit(True).alias("real"))
    side = F.when(F.col("call") == 1, "yes").otherwise("no")
    price = 100 * F.when(side == "yes", F.col("market")).otherwise(1 - F.col("market")) + ask_over_mid
    might = calls.where("hit is not null and market is not null").select("ticker", "t", F.col("close_t").alias("label_t"), side.alias("side"), price.alias("price"), "p", "mins_left", F.lit(False).alias("forced"), F.col("hit").cast("int").alias("y"), F.lit(MIGHT).alias("weight"), "path", F.lit(False).alias("real"))
    minute = F.bround(F.col("mins_left")).cast("int")
    rows = real.unionByName(might.where(F.col("price").between(1, 99))).withColumn("_m", minute)
    third = last_wins(thirds.withColumn("_m", minute), ["ticker", "_m"], [F.desc("t"), F.desc("p")]).select("ticker", "_m", F.col("p").alias("_third"))
    out = rows.join(third, ["ticker", "_m"], "left")
    x = decision_features(F.col("side"), F.col("price"), F.col("p"), F.col("mins_left"), F.col("forced"), F.col("_third"), F.col("path"))
    return out.select("ticker", "t", "label_t", x.alias("x"), "y", "weight", "price", "real")


def embargoed(rows: DataFrame, cut: Column, embargo: str) -> DataFrame:
    """Adds part: test from the cut on; train if labelled before it by the embargo or more; else neither, null, as the
    label came too close to what is tested, or after it."""
    before = F.col("label_t") <= cut - F.expr(f"interval {embargo}")
    return rows.withColumn("part", F.when(F.col("t") >= cut, "test").when(before, "train"))


def journal_set(trades: DataFrame, names: list[str]) -> DataFrame:
    """Trades with a map of features, as an array in the order of `names` (0 where one is missing) and y: did they
    gain? Trades without features are left out; a trade without a result didn't gain."""
    value = [F.coalesce(F.try_element_at("features", F.lit(n)).cast("double"), F.lit(0.0)) for n in names]
    there = trades.where(F.col("features").isNotNull() & (F.size("features") > 0))
    return there.withColumn("x", F.array(*value)).withColumn("y", (F.coalesce("pnl", F.lit(0.0)) > 0).cast("int")).drop("features")

"""Journals of trades: what is closed, how each went, what the desk did, and how it compares with holding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bars import in_time

#: A gain or loss under this is none.
EVEN = 1e-8


def closed(trades: DataFrame) -> DataFrame:
    """Trades with an exit."""
    return trades.where(F.col("exit_price").isNotNull())


def of_era(rows: DataFrame, since: Column, by: str = "t") -> DataFrame:
    """Rows from the time on at which an era, or a rule, was registered; those without a time belong to none."""
    return rows.where(F.col(by) >= since)


def _feature(name: str) -> Column:
    return F.try_element_at("features", F.lit(name)).try_cast("double")


def diagnostics(trades: DataFrame) -> DataFrame:
    """Closed trades (id, k, side, entry_t, exit_t, entry_price, exit_price, stop_price, target_price, pnl, reason, and
    features, a map of strings) with outcome, holding_hours, reward_risk, direction and confidence.

    A trade ends in a win, a loss, or even. Holding time is 0 without both times, and never below. Reward to risk is the
    features' (fta_reward_risk if that is not 0, else reward_risk), else that of the prices, 0 without a risk. Direction
    and confidence are the features', or null.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    risk, reward = F.abs(zero("entry_price") - zero("stop_price")), F.abs(zero("target_price") - zero("entry_price"))
    first = _feature("fta_reward_risk")
    up = _feature("forecast_direction_up")
    pnl = zero("pnl")
    columns = {
        "outcome": F.when(pnl > EVEN, "win").when(pnl < -EVEN, "loss").otherwise("breakeven"),
        "holding_hours": F.greatest(F.lit(0.0), F.coalesce(F.timestamp_diff("MICROSECOND", F.col("entry_t"), F.col("exit_t")) / 3.6e9, F.lit(0.0))),
        "reward_risk": F.coalesce(F.when(first != 0, first), _feature("reward_risk"), F.when(risk == 0, 0.0).otherwise(F.try_divide(reward, risk))),
        "direction": F.when(up >= 0.5, "up").when(up.isNotNull(), "down"), "confidence": _feature("forecast_confidence"), "reason": F.coalesce("reason", F.lit("unknown")),
    }
    return closed(trades).withColumns(columns).drop("features")


def decision_report(trades: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """By k: candidates, accepted trades and their share (1 without any), candidates refused by each gate (`rejected`: k,
    gate, where a log has them), mean and deviation of confidences of closed trades (0 without, or with one), and counts
    of exits by reason, as a map."""
    d = diagnostics(trades)
    each = d.groupBy("k", "reason").agg(F.count("*").alias("n"))
    reasons = each.groupBy("k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("exits"))
    conf = d.groupBy("k").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence_mean"), F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("confidence_std"))
    accepted = trades.groupBy("k").agg(F.count("*").alias("accepted"))
    none = trades.where(F.lit(False)).select("k", F.lit(None).cast("string").alias("gate"))
    gates = (none if rejected is None else rejected.select("k", "gate")).groupBy("k", "gate").agg(F.count("*").alias("n"))
    refused = gates.groupBy("k").agg(F.sum("n").alias("refused"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("gate", "n")))).alias("gates"))
    out = accepted.join(refused, "k", "full").join(conf, "k", "left").join(reasons, "k", "left")
    a, b = F.coalesce("accepted", F.lit(0)), F.coalesce("refused", F.lit(0))
    share = F.when(a + b == 0, 1.0).otherwise(a / (a + b))
    return out.select("k", (a + b).alias("candidates"), a.alias("accepted"), share.alias("acceptance"), "gates", F.coalesce("confidence_mean", F.lit(0.0)).alias("confidence_mean"), F.coalesce("confidence_std", F.lit(0.0)).alias("confidence_std"), "exits")


def buy_and_hold(bars: DataFrame, capital: float, skip: int = 0, slippage: float = 0.0, fee: float = 0.0) -> DataFrame:
    """By k what holding whole units gains from the close of the bar after the first `skip` to the last, less its cost on
    the entry; a key with no bar after the first `skip` is left out."""
    numbered = bars.select("k", "t", "c", F.row_number().over(in_time()).alias("_i"))
    ends = numbered.groupBy("k").agg(F.count("*").alias("n_bars"), F.max(F.when(F.col("_i") == skip + 1, F.col("c"))).alias("entry"), F.max_by("c", "t").alias("exit")).where("entry is not null")
    qty = F.floor(F.lit(capital) / F.col("entry"))
    pnl = (F.col("exit") - F.col("entry")) * qty - F.col("entry") * qty * (slippage + fee)
    out = ends.withColumn("quantity", qty.cast("long")).withColumn("pnl", pnl)
    return out.select("k", F.lit("buy_and_hold").alias("config"), "n_bars", F.lit(1).cast("long").alias("n_trades"), "quantity", "pnl", (F.col("pnl") / capital * 100).alias("return_pct"), (F.col("pnl") > 0).cast("double").alias("win_rate"), (F.greatest("pnl", F.lit(0.0)) / F.greatest(-F.col("pnl"), F.lit(1e-9))).alias("profit_factor"))


def comparison(results: DataFrame) -> DataFrame:
    """Results (k, config, return_pct ...) with their place by return, the largest first, and by config where equal."""
    return results.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.desc_nulls_last("return_pct"), "config")).cast("long"))

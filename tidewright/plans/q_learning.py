"""Queries of learners. Their steps are iterative, so SQL has no counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import learning as M
from tidewright.operators import structure as Z
from tidewright.operators import windows as W
from tidewright.sources import tables as T

from .registry import add


def calibrated_forecasts(spark, d):
    return M.online_platt(T.windows(spark, d))


add("calibrated_forecasts", calibrated_forecasts)


def bandit_choices(spark, d):
    """Three arms bet up, down or not at all on a window; the forecasts are the context."""
    x = T.windows(spark, d).withColumn("reward_0", F.col("y") - 0.5).withColumn("reward_1", 0.5 - F.col("y")).withColumn("reward_2", F.lit(0.0))
    return M.linucb(x.select("k", "t", "p", "market", "reward_0", "reward_1", "reward_2"), ["p", "market"], 3)


add("bandit_choices", bandit_choices)


def close_quantiles(spark, d):
    x = W.returns(T.hourly(spark, d))
    return M.quantile_regression(x, ["ret_1", "ret_5", "v"], "c", 0.9)


add("close_quantiles", close_quantiles)


def logistic_weights(spark, d):
    x = T.windows(spark, d).withColumn("w", F.when(F.col("n") > 1, 3.0).otherwise(1.0))
    return M.weighted_logistic(x.select("k", "t", "p", "market", "y", "w"), ["p", "market"], "y", "w")


add("logistic_weights", logistic_weights)


def boosted_chances(spark, d):
    x = Z.splits(T.windows(spark, d)).select("k", "t", "p", "market", F.col("n").cast("double").alias("n"), "y", "part")
    return M.boosted_chance(x.where("part = 'train'"), x.where("part = 'test'"), ["p", "market", "n"], "y", 5).select("k", "t", "y", "chance")


add("boosted_chances", boosted_chances)

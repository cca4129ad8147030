"""A statistical forecast of returns with its confidence and paths of quantiles, from the last closes of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalar import clamp

from .bars import trailing
from .folds import ema_of


def _mean(x: Column) -> Column:
    return F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), F.size(x))


def forecast_paths(bars: DataFrame, horizon: int = 5, rows: int = 32, span: int = 12, least: float = 0.10, most: float = 0.85) -> DataFrame:
    """Bars (k, t, c) with a forecast over `horizon` bars from the last `rows` closes: ewm, an exponential mean of log
    returns, and trend, the least squares slope of log closes, both times the horizon; expected, their mean; confidence,
    the size of that in deviations of log returns, within bounds, less where the two disagree; and q10, q50, q90, arrays of
    prices that go on by the exponential mean, less a deviation, as it is, or more a deviation, bar by bar.

    With fewer than `rows` closes the forecast is 0, with the least confidence, and the paths stay at the close. Closes
    must be above 0.
    """
    x = F.collect_list("c").over(trailing(rows))
    out = bars.withColumn("_x", x).withColumn("_l", F.transform("_x", lambda v: F.ln(v)))
    n = F.size("_x")
    out = out.withColumn("_r", F.transform(F.slice("_l", 2, rows), lambda v, i: v - F.get("_l", i)))
    ewm = ema_of(F.col("_r"), span)
    sd = F.sqrt(F.greatest(_mean(F.transform("_r", lambda v: (v - F.col("_m")) * (v - F.col("_m")))), F.lit(0.0)))
    out = out.withColumn("_m", _mean(F.col("_r"))).withColumn("_sd", sd).withColumn("_e", ewm)
    mid = (n - 1) / 2
    cov = F.aggregate(F.transform("_l", lambda v, i: (i - mid) * v), F.lit(0.0), lambda a, v: a + v)
    var = n * (n * n - 1) / 12
    out = out.withColumn("_ewm", F.col("_e") * horizon).withColumn("_trend", F.try_divide(cov, var) * horizon)
    expected = (F.col("_ewm") + F.col("_trend")) / 2
    base = clamp(F.abs(expected) / F.when(F.col("_sd") > 1e-8, F.col("_sd")).otherwise(0.01), least, most)
    confidence = clamp(base * F.when(F.col("_ewm") * F.col("_trend") < 0, 0.6).otherwise(1.0), least, most)
    enough = n >= rows
    path = lambda shift: F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.col("c") * F.exp(i * F.when(enough, F.col("_e") + shift).otherwise(0.0)))
    zero = lambda c: F.when(enough, c).otherwise(0.0)
    return out.select(
        *bars.columns, zero(F.col("_ewm")).alias("ewm"), zero(F.col("_trend")).alias("trend"), zero(expected).alias("expected"), F.when(enough, confidence).otherwise(least).alias("confidence"),
        path(-F.col("_sd")).alias("q10"), path(F.lit(0.0)).alias("q50"), path(F.col("_sd")).alias("q90"),
    )

"""Calibration of forecasts by Newton steps whose sums Spark makes: no key's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalar import clamp
from tidewright.sources.scratch import forgotten, kept


def calibration_fit(rows: DataFrame, steps: int = 25, edge: float = 1e-6, spread: int = 16) -> DataFrame:
    """By key k the fit y ~ a + b * logit(p): a (0 if unbiased), b (1 if neither timid nor bold), rows and steps.

    Equal forecasts are one point with its number of rows and outcomes, so a step reads points, not rows. Each step is
    one job for all keys: sums of the gradient and of the 2 x 2 curvature, partly made before the shuffle; points of a
    key are dealt over `spread` tasks where they meet its coefficients. A key stops when a step moves it by under 1e-8,
    or when its curvature is singular (as with one distinct forecast), where it keeps its last coefficients. Rows
    without key, forecast or outcome don't count. Coefficients of keys that are perfectly separable grow until the
    steps end.
    """
    q = clamp(F.col("p"), edge, 1 - edge)
    usable = rows.where("k is not null and p is not null and y is not null").select("k", F.log(q / (1 - q)).alias("x"), F.col("y").cast("double").alias("y"))
    points = kept(usable.groupBy("k", "x").agg(F.count("*").alias("n"), F.sum("y").alias("s")).withColumn("_d", F.pmod(F.xxhash64("x"), F.lit(spread))))
    state = kept(points.groupBy("k").agg(F.sum("n").alias("n")).select("k", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), "n", F.lit(0).alias("steps"), F.lit(False).alias("done")))
    for _ in range(steps):
        now = state.where(~F.col("done")).select("k", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("_d"))
        mu = 1 / (1 + F.exp(-clamp(F.col("a") + F.col("b") * F.col("x"), -30.0, 30.0)))
        at = points.join(now, ["k", "_d"]).withColumn("_r", F.col("s") - F.col("n") * mu).withColumn("_w", F.col("n") * F.greatest(mu * (1 - mu), F.lit(1e-9)))
        x = F.col("x")
        sums = at.groupBy("k").agg(F.sum("_r").alias("ga"), F.sum(F.col("_r") * x).alias("gb"), F.sum("_w").alias("haa"), F.sum(F.col("_w") * x).alias("hab"), F.sum(F.col("_w") * x * x).alias("hbb"))
        det = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
        moved = state.join(sums, "k", "left").withColumn("_ok", ~F.col("done") & (F.abs(det) >= 1e-12))
        da, db = (F.col("ga") * F.col("hbb") - F.col("gb") * F.col("hab")) / det, (F.col("gb") * F.col("haa") - F.col("ga") * F.col("hab")) / det
        moved = moved.withColumn("_da", F.when(F.col("_ok"), da).otherwise(0.0)).withColumn("_db", F.when(F.col("_ok"), db).otherwise(0.0))
        new = moved.select("k", (F.col("a") + F.col("_da")).alias("a"), (F.col("b") + F.col("_db")).alias("b"), "n", (F.col("steps") + F.col("_ok").cast("int")).alias("steps"), (F.col("done") | (F.abs("_da") + F.abs("_db") < 1e-8)).alias("done"))
        before, state = state, kept(new)
        forgotten(before)
        if state.where(~F.col("done")).isEmpty():
            break
    forgotten(points)
    return state.select("k", F.col("a").alias("intercept"), F.col("b").alias("slope"), "n", "steps")

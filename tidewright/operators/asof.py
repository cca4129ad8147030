"""Joins in time. None is ever a nearest match in the future unless its name says so.

As-of joins are a union and one running maximum per key, so they need one shuffle and no range join, whatever the
number of matches; Spark sorts each key's rows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _union(left: DataFrame, right: DataFrame, value: str, right_first: bool) -> DataFrame:
    """Rows of both sides with their time in microseconds; at equal times the right side first, or last."""
    row = F.struct(*left.columns)
    a = left.select("k", "t", F.lit(1 if right_first else 0).alias("_side"), row.alias("_row"), F.lit(None).cast("timestamp_ntz").alias("_rt"), F.lit(None).cast("long").alias("_rid"), F.lit(None).cast("double").alias("_rv"))
    b = right.select("k", "t", F.lit(0 if right_first else 1).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col("t").alias("_rt"), F.col("id").alias("_rid"), F.col(value).cast("double").alias("_rv"))
    return a.unionByName(b)


def as_of(left: DataFrame, right: DataFrame, value: str, max_age: str | None = None, prefix: str = "q") -> DataFrame:
    """Left rows with the latest right row at or before them: {prefix}_t and {prefix}_value, null without one or where
    it is older than max_age. Of right rows at one time the largest id counts."""
    both = _union(left, right, value, True)
    w = Window.partitionBy("k").orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.max(F.when(F.col("_rt").isNotNull(), F.struct("_rt", "_rid", "_rv"))).over(w)
    out = both.withColumn("_m", latest).where(F.col("_row").isNotNull())
    fresh = F.lit(True) if max_age is None else F.col("_m._rt") >= F.col("t") - F.expr(f"interval {max_age}")
    return out.select("_row.*", F.when(fresh, F.col("_m._rt")).alias(f"{prefix}_t"), F.when(fresh, F.col("_m._rv")).alias(f"{prefix}_value"))


def as_of_forward(left: DataFrame, right: DataFrame, value: str, max_delay: str, prefix: str = "n") -> DataFrame:
    """Left rows with the first right row at or after them within max_delay. Of right rows at one time the smallest id."""
    both = _union(left, right, value, False)
    w = Window.partitionBy("k").orderBy("t", "_side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    first = F.min(F.when(F.col("_rt").isNotNull(), F.struct("_rt", "_rid", "_rv"))).over(w)
    out = both.withColumn("_m", first).where(F.col("_row").isNotNull())
    soon = F.col("_m._rt") <= F.col("t") + F.expr(f"interval {max_delay}")
    return out.select("_row.*", F.when(soon, F.col("_m._rt")).alias(f"{prefix}_t"), F.when(soon, F.col("_m._rv")).alias(f"{prefix}_value"))


def nearest(left: DataFrame, right: DataFrame, value: str, tolerance: str, prefix: str = "m") -> DataFrame:
    """Left rows with the closest right row within the tolerance on either side; of two at one distance the earlier."""
    both = as_of_forward(as_of(left, right, value, tolerance, "_b"), right, value, tolerance, "_f")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    back = F.col("_b_t").isNotNull() & (F.col("_f_t").isNull() | (us("t") - us("_b_t") <= us("_f_t") - us("t")))
    return both.select(*left.columns, F.when(back, F.col("_b_t")).otherwise(F.col("_f_t")).alias(f"{prefix}_t"), F.when(back, F.col("_b_value")).otherwise(F.col("_f_value")).alias(f"{prefix}_value"))


def at_offset(bars: DataFrame, offset: str, value: str = "c") -> DataFrame:
    """Bars with their own key's value exactly `offset` later; a gap there drops the row, unlike a lead over rows."""
    later = bars.select("k", (F.col("t") - F.expr(f"interval {offset}")).alias("t"), F.col(value).alias("later"))
    return bars.join(later, ["k", "t"])


def paired(rows: DataFrame, arm: str, a: str, b: str, slot: list[str], value: str) -> DataFrame:
    """Slots where both arms have a row, with both values."""
    left = rows.where(F.col(arm) == a).select(*slot, F.col(value).alias("a"))
    return left.join(rows.where(F.col(arm) == b).select(*slot, F.col(value).alias("b")), slot)


def delivered(left: DataFrame, bars: DataFrame, delay: str, width: str, value: str = "c") -> DataFrame:
    """As of receipt: only bars that had closed and arrived by a row's time count."""
    available = bars.withColumn("t", F.col("t") + F.expr(f"interval {width}") + F.expr(f"interval {delay}")).withColumn("id", F.lit(0).cast("long"))
    return as_of(left, available, value, prefix="bar")


def first_touch(levels: DataFrame, bars: DataFrame, beyond: Column) -> DataFrame:
    """For each level (k, level) the first bar time for which `beyond` holds (of columns level and those of bars)."""
    hits = levels.join(bars, "k").where(beyond)
    return levels.join(hits.groupBy("k", "level").agg(F.min("t").alias("touched_at")), ["k", "level"], "left")


def touching(zones: DataFrame, bars: DataFrame, tolerance: float, weight: str | None = None) -> DataFrame:
    """For each zone (k, mid) how many bars come within tolerance of its middle, and their weight."""
    near = (F.abs(F.col("h") - F.col("mid")) <= tolerance * F.col("mid")) | (F.abs(F.col("l") - F.col("mid")) <= tolerance * F.col("mid"))
    hits = zones.select("k", "mid").distinct().join(bars, "k").where(near)
    counted = hits.groupBy("k", "mid").agg(F.count("*").alias("touches"), F.sum(F.lit(1.0) if weight is None else F.col(weight)).alias("strength"))
    return zones.join(counted, ["k", "mid"], "left").fillna({"touches": 0, "strength": 0.0})


def nearest_level(points: DataFrame, zones: DataFrame, price: str) -> DataFrame:
    """Points with the nearest zone middle above and below their price."""
    both = points.join(zones.select("k", "mid"), "k", "left").groupBy(*points.columns)
    return both.agg(F.min(F.when(F.col("mid") > F.col(price), F.col("mid"))).alias("above"), F.max(F.when(F.col("mid") < F.col(price), F.col("mid"))).alias("below"))


def not_seen(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    return new.join(old.select(*key), key, "left_anti")


def only_slots(rows: DataFrame, slots: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(slots.select(*key), key, "left_semi")


def sweep(rows: DataFrame, grid: DataFrame, most: int = 10_000) -> DataFrame:
    """Every row under every setting of a small grid; one of more than `most` settings is refused, not broadcast."""
    if grid.limit(most + 1).count() > most:
        raise ValueError(f"a sweep takes {most} settings at most")
    return rows.join(F.broadcast(grid))

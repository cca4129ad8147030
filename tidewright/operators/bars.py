"""Bars: validity, clamping, resampling, flooring, gap filling, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_time(key: str = "k", *order: str) -> WindowSpec:
    """Rows of a key in order of time (and tiebreaks); no frame, so that only earlier rows are looked at by choice."""
    return Window.partitionBy(key).orderBy("t", *order)


def trailing(rows: int, skip: int = 0, key: str = "k", *order: str) -> WindowSpec:
    """The last `rows` rows up to the current one, or up to `skip` rows before it."""
    return in_time(key, *order).rowsBetween(-(rows - 1) - skip, -skip)


def is_valid() -> Column:
    return F.col("o").between(F.col("l"), F.col("h")) & F.col("c").between(F.col("l"), F.col("h")) & (F.col("v") >= 0)


def clamped(bars: DataFrame) -> DataFrame:
    """Open and close moved into [low, high]; what is still invalid goes."""
    inside = lambda c: F.greatest(F.col("l"), F.least(F.col("h"), F.col(c)))
    return bars.withColumn("o", inside("o")).withColumn("c", inside("c")).where(is_valid())


def bucket(width: str, column: str = "t") -> Column:
    """The start of the left-closed bucket; keeps TIMESTAMP_NTZ, which date_trunc does not."""
    return F.window(column, width)["start"]


def resample(ticks: DataFrame, width: str, keep_last: bool = False) -> DataFrame:
    """Open, high, low, close, volume and count per key and bucket. The newest bucket of a key may still grow, so it
    is dropped; a key with one bucket has no bars. Ties in time are broken by id."""
    at = F.struct("t", "id")
    out = ticks.groupBy("k", bucket(width).alias("b")).agg(
        F.min_by("px", at).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", at).alias("c"), F.sum("size").alias("v"), F.count("*").alias("n")
    )
    return (out if keep_last else _without_last(out, "b")).select("k", F.col("b").alias("t"), "o", "h", "l", "c", "v", "n")


def coarser(bars: DataFrame, width: str) -> DataFrame:
    """Bars from finer valid bars, by the same rules."""
    out = bars.where(is_valid()).groupBy("k", bucket(width).alias("b")).agg(F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.sum("v").alias("v"), F.count("*").alias("n"))
    return _without_last(out, "b").select("k", F.col("b").alias("t"), "o", "h", "l", "c", "v", "n")


def _without_last(buckets: DataFrame, column: str) -> DataFrame:
    last = F.max(column).over(Window.partitionBy("k"))
    return buckets.withColumn("_last", last).where(F.col(column) < F.col("_last")).drop("_last")


def native_or(native: DataFrame, derived: DataFrame) -> DataFrame:
    """Native bars of a key where there are any, else derived ones."""
    return native.unionByName(derived.join(native.select("k").distinct(), "k", "left_anti"))


def last_per(ticks: DataFrame, width: str) -> DataFrame:
    """The last price of each key in each bucket that has one."""
    return ticks.groupBy("k", bucket(width).alias("b")).agg(F.max_by("px", F.struct("t", "id")).alias("px"), F.count("*").alias("n")).select("k", F.col("b").alias("t"), "px", "n")


def filled(points: DataFrame, width: str, value: str = "px") -> DataFrame:
    """A row for each bucket between a key's first and last; missing ones carry the last value and are marked."""
    ends = points.groupBy("k").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    grid = ends.select("k", F.explode(F.sequence("a", "z", F.expr(f"interval {width}"))).alias("t"))
    out = grid.join(points.select("k", "t", value), ["k", "t"], "left")
    carried = F.last(value, ignorenulls=True).over(in_time().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.select("k", "t", carried.alias(value), F.col(value).isNull().alias("synthetic"))


def grid_clear_of(grid: DataFrame, outages: DataFrame, back: str, ahead: str) -> DataFrame:
    """Grid points (k, t) whose span from `back` before to `ahead` after meets no outage (k, a, z)."""
    g, o = grid.alias("g"), outages.alias("o")
    meets = (F.col("g.k") == F.col("o.k")) & (F.col("o.a") < F.col("g.t") + F.expr(f"interval {ahead}")) & (F.col("o.z") > F.col("g.t") - F.expr(f"interval {back}"))
    return g.join(o, meets, "left_anti")

"""Algebra of time spans over many sources: union, intersection, difference, silences, coverage net of outages.

Spans [a, z) become their edges, and a running sum over the edges of a group tells how many spans cover each moment.
So nothing is joined by range, whatever overlaps whatever, and the edges of one group are dealt over blocks of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prefix import running


def where_covered(spans: DataFrame, group: list[str], sets: dict[str, Column], holds: Column, block: str = "day") -> DataFrame:
    """The longest spans (group, a, z) during which `holds`, a condition on the columns named in `sets`: how many spans
    of each set cover a moment. `sets` maps a name to the condition that puts a span into the set.

    Empty, reversed and unbounded spans (a null end) cover nothing. A moment that no span covers must not hold.
    """
    at = F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("d")), F.struct(F.col("z").alias("t"), F.lit(-1).alias("d"))))
    edges = spans.where("a < z").select(*group, *(c.cast("long").alias(n) for n, c in sets.items()), at.alias("e"))
    edges = edges.groupBy(*group, F.col("e.t").alias("t")).agg(*(F.sum(F.coalesce(F.col(n), F.lit(0)) * F.col("e.d")).alias(f"_step_{n}") for n in sets))
    after = running(edges, group, "t", [], {n: f"_step_{n}" for n in sets}, block)
    now = after.withColumn("_now", F.coalesce(holds, F.lit(False)))
    was = now.withColumns({n: F.col(n) - F.col(f"_step_{n}") for n in sets}).withColumn("_was", F.coalesce(holds, F.lit(False)))
    turns = was.where(F.col("_now") != F.col("_was")).select(*group, "t", F.col("_now").cast("long").alias("_start"))
    # Starts and ends alternate: the n-th end closes the n-th start.
    return running(turns, group, "t", [], {"_n": "_start"}, block).groupBy(*group, "_n").agg(F.min("t").alias("a"), F.max("t").alias("z")).drop("_n")


def union(spans: DataFrame, group: list[str], block: str = "day") -> DataFrame:
    """What any span covers; spans that touch become one."""
    return where_covered(spans, group, {"_any": F.lit(True)}, F.col("_any") > 0, block)


def in_all(spans: DataFrame, group: list[str], source: str, sources: int, block: str = "day") -> DataFrame:
    """What spans of at least `sources` different sources cover. Spans of one source are united first."""
    return where_covered(union(spans, [*group, source], block), group, {"_n": F.lit(True)}, F.col("_n") >= sources, block)


def minus(spans: DataFrame, other: DataFrame, group: list[str], block: str = "day") -> DataFrame:
    """What spans cover and no span of the other does."""
    both = spans.select(*group, "a", "z", F.lit(True).alias("_mine")).unionByName(other.select(*group, "a", "z", F.lit(False).alias("_mine")))
    return where_covered(both, group, {"_in": F.col("_mine"), "_out": ~F.col("_mine")}, (F.col("_in") > 0) & (F.col("_out") == 0), block)


def both(spans: DataFrame, other: DataFrame, group: list[str], block: str = "day") -> DataFrame:
    """What spans of either side cover."""
    all_ = spans.select(*group, "a", "z", F.lit(True).alias("_mine")).unionByName(other.select(*group, "a", "z", F.lit(False).alias("_mine")))
    return where_covered(all_, group, {"_in": F.col("_mine"), "_out": ~F.col("_mine")}, (F.col("_in") > 0) & (F.col("_out") > 0), block)


def _minute() -> Column:
    return F.date_trunc("minute", F.col("t")).cast("timestamp_ntz")


def presence(points: DataFrame, source: str = "k") -> DataFrame:
    """Minutes with a point of a source, as spans."""
    return points.select(F.col(source).alias("k"), _minute().alias("a")).distinct().withColumn("z", F.col("a") + F.expr("interval 1 minute"))


def silences_in_all(points: DataFrame, longest: int, source: str = "k", block: str = "day") -> DataFrame:
    """Spans [a, z) of whole minutes in which no source has a point, where the minutes before and after them lie more
    than `longest` minutes apart. Before the first and after the last point of all there is no silence."""
    seen = presence(points, source).groupBy().agg(F.min("a").alias("a"), F.max("z").alias("z"))
    quiet = minus(seen, presence(points, source).select("a", "z"), [], block)
    return quiet.where(F.col("z") >= F.col("a") + F.make_interval(mins=F.lit(longest)))


def _minutes(a: Column, z: Column) -> Column:
    return F.timestamp_diff("MINUTE", a, z)


def coverage_net_of(points: DataFrame, silent: DataFrame, source: str = "k") -> DataFrame:
    """By source: shares of minutes and of five-minute buckets that have a point, of those outside `silent` (spans of
    whole minutes in which no source has any). The range runs from the first minute of all sources to the last; a
    bucket that a silence touches is left out whole."""
    five = lambda t: F.timestamp_seconds(F.floor(F.unix_seconds(t.cast("timestamp")) / 300) * 300).cast("timestamp_ntz")
    have = presence(points, source)
    whole = have.select(F.min("a").alias("lo"), F.max("a").alias("hi")).select(_minutes(F.col("lo"), F.col("hi")) + 1).scalar()
    out_minutes = silent.select(F.coalesce(F.sum(_minutes(F.col("a"), F.col("z"))), F.lit(0))).scalar()
    touched = union(silent.select(five(F.col("a")).alias("a"), (five(F.col("z") - F.expr("interval 1 minute")) + F.expr("interval 5 minutes")).alias("z")), [])
    out_buckets = touched.select(F.coalesce(F.sum(_minutes(F.col("a"), F.col("z")) / 5), F.lit(0.0)).cast("long")).scalar()
    each = have.groupBy("k").agg(F.count("*").alias("minutes"), F.count_distinct(five(F.col("a"))).alias("buckets"))
    return each.select(
        "k", "minutes", (F.col("minutes") / F.greatest(F.lit(1), whole - out_minutes)).alias("minute_presence"),
        (F.col("buckets") / F.greatest(F.lit(1), F.ceil(whole / 5) - out_buckets)).alias("bucket_presence"),
    )


def gaps_net_of(points: DataFrame, silent: DataFrame, longest: int, source: str = "k", block: str = "day") -> DataFrame:
    """By source: gaps (a, z: the minutes with a point on either side) of more than `longest` minutes, less the minutes
    of silence in them. Each silence lies within a gap of every source, so its length is a step of one running sum for all."""
    have = presence(points, source).select("k", F.col("a").alias("t"), F.lit(0).cast("long").alias("m"))
    steps = silent.select(F.col("a").alias("t"), _minutes(F.col("a"), F.col("z")).alias("m"))
    steps = steps.select(F.lit(None).cast(have.schema["k"].dataType).alias("k"), "t", "m", F.lit(True).alias("_step"))
    every = have.withColumn("_step", F.lit(False)).unionByName(steps)
    summed = running(every, [], "t", [], {"_out": "m"}, block).where(~F.col("_step"))
    by = Window.partitionBy("k").orderBy("t")  # a source has a row for each minute at most
    pairs = summed.select("k", F.lag("t").over(by).alias("a"), F.col("t").alias("z"), (F.col("_out") - F.lag("_out").over(by)).alias("out"))
    return pairs.withColumn("hole", _minutes(F.col("a"), F.col("z")) - F.col("out")).where(F.col("hole") > longest).select("k", "a", "z", "hole")


def reference_price(points: DataFrame, source: str = "k") -> DataFrame:
    """By minute the upper median over sources of their last price, and how many sources there are."""
    last = points.groupBy(F.col(source).alias("k"), _minute().alias("t")).agg(F.max_by("px", F.struct(F.col("t"), F.col("id"))).alias("px"))
    return last.groupBy("t").agg(F.get(F.array_sort(F.collect_list("px")), F.floor(F.count("px") / 2).cast("int")).alias("price"), F.count("px").alias("sources"))

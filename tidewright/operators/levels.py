"""Zones of support and resistance, votes with the price of now, and the inventory of what a store covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import touching
from .folds import price_zones
from .ledger import last_wins
from .windows import recency_weight

#: Touches, the later half of the bars counting more, with which a zone is as strong as can be.
TOUCHES = 5


def zones(swung: DataFrame, margin: float = 0.002) -> DataFrame:
    """(k, side, low, high, mid, n, strength, place) from bars with swings: swing highs that lie together are a resistance,
    swing lows a support. A zone reaches half a margin beyond its prices; its strength is that of the bars whose high or
    low comes within a margin of its middle, from 0 to 1. Resistances are placed from the lowest low up, supports from the
    highest high down. A key's levels are few beside its bars."""
    bars = recency_weight(swung)
    found = None
    for side, flag, price in (("resistance", "swing_high", "h"), ("support", "swing_low", "l")):
        z = price_zones(swung.where(flag), price, margin).select("k", F.lit(side).alias("side"), (F.col("low") * (1 - margin / 2)).alias("low"), (F.col("high") * (1 + margin / 2)).alias("high"), "n")
        z = touching(z.withColumn("mid", (F.col("low") + F.col("high")) / 2), bars, margin, "weight")
        found = z if found is None else found.unionByName(z)
    out = found.withColumn("strength", F.least(F.col("strength") / TOUCHES, F.lit(1.0)))
    near = F.when(F.col("side") == "resistance", F.col("low")).otherwise(-F.col("high"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("k", "side").orderBy(near)).cast("long")).select("k", "side", "low", "high", "mid", "n", "strength", "place")


def voted(votes: DataFrame, control: str, rows: int = 50, least: int = 20, arms: int = 3) -> DataFrame:
    """(horizon, t, voters, dropped, pred): for each slot of votes (arm, horizon, t, pred, price_now, abs_err: null until
    settled) that has the control's and another's, the middle of the votes and the control's whole price of now, without
    the arm of the largest mean error over its last `rows` settled slots before, of arms with `least` of them; none is
    dropped unless `arms` have. Of equals the first by name is. The middle of an even number is the mean of the two,
    rounded down. Votes are whole numbers."""
    before = Window.partitionBy("arm", "horizon").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    settled = F.col("abs_err").isNotNull()
    x = votes.withColumn("_i", F.sum(settled.cast("long")).over(before))
    by = Window.partitionBy("arm", "horizon").orderBy("t").rowsBetween(-(rows - 1), 0)
    ends = votes.where(settled).select(F.col("arm").alias("_a"), F.col("horizon").alias("_h"), F.row_number().over(Window.partitionBy("arm", "horizon").orderBy("t")).cast("long").alias("_n"), F.count("*").over(by).alias("_c"), F.avg("abs_err").over(by).alias("_mean"))
    x = x.join(ends, (F.col("arm") == F.col("_a")) & (F.col("horizon") == F.col("_h")) & (F.col("_i") == F.col("_n")), "left")
    trail = F.when(F.col("_c") >= least, F.col("_mean"))
    slot = x.groupBy("horizon", "t").agg(
        F.count("*").alias("_all"), F.max(F.when(F.col("arm") == control, F.struct(F.col("price_now").cast("long").alias("now")))).alias("_control"), F.count(trail).alias("_known"),
        F.collect_list(F.struct("arm", trail.alias("m"), F.col("pred").cast("long").alias("pred"))).alias("_votes"),
    )
    worst = F.array_max(F.transform(F.filter("_votes", lambda v: v.m.isNotNull()), lambda v: v.m))
    first = F.array_min(F.transform(F.filter("_votes", lambda v: v.m == worst), lambda v: v.arm))
    slot = slot.where(F.col("_control").isNotNull() & (F.col("_all") > 1)).withColumn("dropped", F.when(F.col("_known") >= arms, first))
    polled = F.array_sort(F.concat(F.transform(F.filter("_votes", lambda v: ~v.arm.eqNullSafe(F.col("dropped"))), lambda v: v.pred), F.array(F.col("_control.now"))))
    slot = slot.withColumn("_p", polled)
    n = F.size("_p")
    high, low = F.get("_p", F.floor(n / 2).cast("int")), F.get("_p", (F.floor(n / 2) - 1).cast("int"))
    return slot.select("horizon", "t", n.cast("long").alias("voters"), "dropped", F.when(n % 2 == 1, high).otherwise(F.floor((high + low) / 2)).alias("pred"))


class Inventory:
    """What a store holds of each key and timeframe: first and last time, rows, when it was fetched. Records are appended
    and the latest of each counts, so an update is an insert and never rewrites what is there."""

    SCHEMA = "k string, timeframe string, first_t timestamp_ntz, last_t timestamp_ntz, n long, fetched_at timestamp_ntz, updated_at timestamp_ntz"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def update(self, records: DataFrame) -> None:
        """Records in the order of SCHEMA's names; an older update never takes the place of a newer one."""
        records.select(*(x.split()[0] for x in self.SCHEMA.split(", "))).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        """The latest record of each key and timeframe; of one time that with the most rows."""
        return last_wins(self._read(), ["k", "timeframe"], [F.desc("updated_at"), F.desc("n"), F.desc("last_t")])

    def get(self, key: str, timeframe: str) -> DataFrame:
        return last_wins(self._read().where((F.col("k") == key) & (F.col("timeframe") == timeframe)), ["k", "timeframe"], [F.desc("updated_at"), F.desc("n"), F.desc("last_t")])

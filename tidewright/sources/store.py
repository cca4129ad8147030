"""A partitioned store of bars, and tolerant readers of files.

Bars lie under key / timeframe / month as Parquet. Readers never fail on a bad value: what doesn't parse is null and
the row goes; malformed JSON lines go too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tidewright.operators.bars import is_valid
from tidewright.operators.ledger import last_wins
from tidewright.operators.prefix import meet

from .scratch import checkpointed

PARTS = ["k", "timeframe", "month"]
COLUMNS = ["k", "timeframe", "month", "t", "o", "h", "l", "c", "v"]


def month_of(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def with_parts(bars: DataFrame, timeframe: str, sequence: Column) -> DataFrame:
    return bars.select("k", F.lit(timeframe).alias("timeframe"), month_of(F.col("t")).alias("month"), "t", "o", "h", "l", "c", "v", sequence.alias("_q"))


def merged(old: DataFrame, new: DataFrame, newest: list[Column]) -> DataFrame:
    """Old bars with new ones over them, by key, timeframe and time; of new ones of one time, the first in `newest`."""
    both = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, ["k", "timeframe", "t"], [F.desc("_s"), *newest]).select(*COLUMNS)


#: Which of several new bars of one time stays where no sequence tells: the one with the largest values, on any run.
_VALUES = ("v", "c", "h", "l", "o")


class BarStore:
    """Parquet under `path`. An upsert rewrites only the months that new bars fall into."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def upsert(self, bars: DataFrame, timeframe: str, sequence: str | None = None) -> None:
        """The column `sequence` tells which of several new bars of one time is the latest. A damaged file of a month
        to be rewritten is an error, and nothing is written: what it holds would be lost."""
        order = [F.desc("_q"), *map(F.desc, _VALUES)]
        new = with_parts(bars, timeframe, F.col(sequence) if sequence else F.lit(0))
        if self.exists():
            months = new.select(*PARTS).distinct()
            # Read the touched months only, of which a calendar has few, and write them to the side before they replace
            # themselves.
            touched = [r.month for r in months.select("month").distinct().collect()]
            old = self.read(tolerant=False).where(F.col("month").isin(touched)).join(months, PARTS, "left_semi")
            new = checkpointed(merged(old, new, order))
        else:
            new = last_wins(new, ["k", "timeframe", "t"], order).select(*COLUMNS)
        writer = new.repartition(*PARTS).sortWithinPartitions("t").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*PARTS).parquet(self.path)

    def exists(self) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def read(self, tolerant: bool = True) -> DataFrame:
        """All bars; damaged files are left out, unless an upsert reads what it is to replace."""
        schema = "t timestamp_ntz, o double, h double, l double, c double, v double, k string, timeframe string, month string"
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", str(tolerant).lower()).parquet(self.path).select(*COLUMNS)

    def load(self, key: str, timeframe: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
        """Bars of a key from start to end, both included; months outside are not opened."""
        out = self.read().where((F.col("k") == key) & (F.col("timeframe") == timeframe))
        if start is not None:
            out = out.where((F.col("month") >= month_of(start)) & (F.col("t") >= start))
        if end is not None:
            out = out.where((F.col("month") <= month_of(end)) & (F.col("t") <= end))
        return out

    def keys(self, timeframe: str) -> DataFrame:
        return self.read().where(F.col("timeframe") == timeframe).select("k").distinct()

    def ranges(self) -> DataFrame:
        return self.read().groupBy(*PARTS).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


def first_with_enough(sources: list[DataFrame], least: int) -> DataFrame:
    """Rows of each key from the first source that has at least `least` of them."""
    tagged = [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)]
    every = tagged[0]
    for s in tagged[1:]:
        every = every.unionByName(s)
    chosen = every.groupBy("k", "_p").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).groupBy("k").agg(F.min("_p").alias("_p"))
    return every.join(chosen, ["k", "_p"]).drop("_p")


def read_daily_csv(spark: SparkSession, path: str, key: str, hour: int = 16) -> DataFrame:
    """Daily bars: dates stamped with the closing hour, open and close clamped, impossible rows gone."""
    raw = spark.read.option("header", "true").csv(path)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    num = lambda c: F.col(c).try_cast("double")
    out = raw.select(F.lit(key).alias("k"), (F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd")) + F.expr(f"interval {hour} hours")).cast("timestamp_ntz").alias("t"), *(num(a).alias(b) for a, b in zip(("open", "high", "low", "close", "volume"), "ohlcv", strict=True)))
    good = (F.col("h") >= F.col("l")) & (F.least("o", "h", "l", "c") > 0) & (F.col("v") >= 0)
    inside = lambda c: F.greatest(F.col("l"), F.least(F.col("h"), F.col(c)))
    return out.dropna().where(good).withColumn("o", inside("o")).withColumn("c", inside("c")).where(is_valid())


def parse_series_payload(payloads: DataFrame, column: str = "body") -> DataFrame:
    """Bars (k, t, o, h, l, c, v) of JSON bodies whose time series is a map of times to maps of named strings; rows
    that don't parse are skipped, and a body with a note instead of a series has none."""
    kind = Ty.MapType(Ty.StringType(), Ty.StringType())
    top = payloads.select("k", F.from_json(column, kind).alias("m"))
    series = top.select("k", F.explode("m").alias("name", "body")).where(F.contains(F.lower("name"), F.lit("time series")))
    rows = series.select("k", F.explode(F.from_json("body", Ty.MapType(Ty.StringType(), kind))).alias("at", "bar"))
    field = lambda n: F.try_element_at("bar", F.lit(n)).try_cast("double")
    out = rows.select("k", F.coalesce(F.try_to_timestamp("at", F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp("at", F.lit("yyyy-MM-dd"))).cast("timestamp_ntz").alias("t"), *(field(n).alias(c) for n, c in (("1. open", "o"), ("2. high", "h"), ("3. low", "l"), ("4. close", "c"), ("5. volume", "v"))))
    return out.dropna().where(is_valid())


def newest(bars: DataFrame, limit: int) -> DataFrame:
    from pyspark.sql.window import Window

    return bars.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t")))).where(F.col("_r") <= limit).drop("_r")


NEWS = "title string, url string, source string, summary string, time_published string, overall_sentiment_score double, topics array<string>, ticker_sentiment array<struct<ticker: string, relevance_score: double, ticker_sentiment_score: double>>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_new(spark: SparkSession, path: str, rows: DataFrame, schema: str, key: list[str]) -> None:
    """Appends rows whose key is not there yet, where null equals null; rows repeated among the new are written once."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fresh = rows.dropDuplicates(key)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        fresh = meet(fresh, read_jsonl(spark, path, schema).select(*key), key, "left_anti")
    fresh.select(*spark.createDataFrame([], schema).columns).write.mode("append").json(path)


class NewsStore:
    """Articles as JSON lines by key and month of publication, each title and time once.

    Rows have k, title, time_published (a timestamp) and the store's other columns. What is new meets the keys of its
    own months alone: other months are not opened. Those keys are cut down to the ones that are among the new before the
    new lose theirs, so that a month's articles are not shuffled where the new ones fit a broadcast, which Spark decides
    by their size. Null titles and times are values like others; without a time the month is `unknown`.
    """

    KEY = ("k", "title", "time_published")

    def __init__(self, spark: SparkSession, path: str, schema: str = "title string, time_published timestamp_ntz, url string, source string, summary string, score double, topics array<string>"):
        self.spark, self.path, self.columns = spark, path, schema

    def _exists(self) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _read(self, schema: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{schema or self.columns}, k string, month string").option("mode", "DROPMALFORMED")
        return rows.json(self.path)

    def add(self, rows: DataFrame) -> int:
        """Stores what is new; how many articles that were."""
        names = self.spark.createDataFrame([], self.columns).columns
        month = F.coalesce(month_of(F.col("time_published")), F.lit("unknown"))
        new = rows.select("k", *names, month.alias("month")).dropDuplicates(list(self.KEY))
        if self._exists():
            new = checkpointed(new)
            months = [r.month for r in new.select("month").distinct().collect()]  # a calendar has few
            there = self._read("title string, time_published timestamp_ntz").where(F.col("month").isin(months)).select(*self.KEY)
            again = meet(there, new.select(*self.KEY), list(self.KEY), "left_semi").distinct()
            new = meet(new, again, list(self.KEY), "left_anti")
        new = checkpointed(new)
        n = new.count()
        if n:
            new.repartition("k", "month").sortWithinPartitions("time_published", "title").write.mode("append").partitionBy("k", "month").json(self.path)
        return n

    def load(self, key: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
        """Articles of a key from since to until, both included, the newest first; other months are not opened. With
        either, articles without a time are left out. Lines that don't parse are."""
        rows = self._read().where(F.col("k") == key)
        for bound, low in ((since, True), (until, False)):
            if bound is not None:
                of, month = F.col("time_published"), F.col("month")
                rows = rows.where((month >= month_of(bound)) & (of >= bound) if low else (month <= month_of(bound)) & (of <= bound))
        return rows.orderBy(F.desc("time_published"), "title")

"""Bulk ingest of bars with a log, and sinks for CSV and reports.

A source that cannot be read fails alone: its error goes into the log and the others are stored.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.bars import is_valid

from .scratch import checkpointed
from .store import BarStore

LOG = "provider string, endpoint string, k string, timeframe string, request string, fetched_at timestamp_ntz, status string, n long, error string"
#: What a log record says of its outcome.
STATUSES = ("ok", "error", "rate_limited", "cached")


def read_hourly_csv(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Hourly bars from a file with a header in any case and order; times in UTC. Rows with a value that does not parse,
    or with impossible prices, go. A column that is missing is an error."""
    raw = spark.read.option("header", "true").csv(path)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    # A zone in the text counts; one without is UTC already, whatever the session's zone is.
    text = F.trim("timestamp")
    zoned = F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone())
    at = F.coalesce(F.when(text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), zoned.cast("timestamp_ntz")), text.try_cast("timestamp_ntz"))
    values = (F.col(a).try_cast("double").alias(b) for a, b in zip(("open", "high", "low", "close", "volume"), "ohlcv", strict=True))
    return raw.select(F.lit(key).alias("k"), at.alias("t"), *values).dropna().where(is_valid())


class IngestLog:
    """Records as JSON lines, one folder for each day, appended and never rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, records: list[tuple]) -> None:
        """Records in the order of LOG."""
        bad = {r[6] for r in records} - set(STATUSES)
        if bad:
            raise ValueError(f"unknown status: {', '.join(sorted(map(str, bad)))}")
        rows = self.spark.createDataFrame(records, LOG).withColumn("day", F.date_format("fetched_at", "yyyy-MM-dd"))
        rows.coalesce(1).write.mode("append").partitionBy("day").json(self.path)

    def read(self, day: str | None = None) -> DataFrame:
        """Records of a day, or of all; lines that don't parse are left out, and other days' folders are not opened."""
        rows = self.spark.read.schema(f"{LOG}, day string").option("mode", "DROPMALFORMED").json(self.path)
        return rows if day is None else rows.where(F.col("day") == day)


def ingest(store: BarStore, log: IngestLog, sources: dict[str, str], timeframe: str, read: Callable[[SparkSession, str, str], DataFrame], provider: str, now: dt.datetime) -> dict[str, int]:
    """Stores the bars of all sources (key to path) that can be read, in one upsert, and logs each; gives the rows of
    those stored. A source without a usable row, or with a broken file, is an error in the log and stops no other.

    Each source is counted by a job of its own, which is what tells a broken one apart; `sources` is the caller's list.
    """
    spark, stored, records, good = store.spark, {}, [], []
    for key, path in sources.items():
        n, error = 0, ""
        try:
            bars = read(spark, path, key)
            n = bars.count()
            if n == 0:
                raise ValueError("no rows are left after cleaning")
            good.append(bars)
            stored[key] = n
        except (PySparkException, ValueError) as e:
            error = str(e).splitlines()[0][:500]
        records.append((provider, "csv_import", key, timeframe, path, now, "error" if error else "ok", n, error))
    if good:
        every = good[0]
        for bars in good[1:]:
            every = every.unionByName(bars)
        store.upsert(every, timeframe)
    if records:
        log.add(records)
    return stored


def ingest_files(store: BarStore, log: IngestLog, sources: dict[str, str], timeframe: str, provider: str, now: dt.datetime) -> dict[str, int]:
    """As ingest() of hourly CSV files, in two passes over all of them, however many there are: one finds each file's
    header, whose columns may stand in any order, the other parses and counts. `sources` maps keys to files or folders.

    A source that does not exist, has no usable header or no usable row is an error in the log, and stops no other.
    """
    spark = store.spark
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    roots = {}
    for key, path in sources.items():  # metadata alone
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(hadoop)
        if fs.exists(at):
            roots[key] = at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().getPath()
    counts: dict[str, int] = {}
    errors = {k: "no such path" for k in sources.keys() - roots.keys()}
    if roots:
        text = spark.read.text([sources[k] for k in roots]).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
        heads = text.where("_b = 0").groupBy("_f").agg(F.min_by("value", "_i").alias("_head"))
        named = spark.createDataFrame(list(roots.items()), "k string, _root string")
        plain = F.regexp_replace(F.url_decode(F.regexp_replace("_f", r"\+", "%2B")), "^[a-z0-9]+:/*", "/")
        heads = heads.withColumn("_path", plain).join(named, (F.col("_path") == F.col("_root")) | F.startswith("_path", F.concat("_root", F.lit("/"))))
        heads = heads.select("_f", "k", "_head", F.transform(F.split("_head", ","), lambda c: F.lower(F.trim(c))).alias("_names"))
        needs = ("timestamp", "open", "high", "low", "close", "volume")
        usable = F.array_size(F.array_intersect("_names", F.array(*map(F.lit, needs)))) == len(needs)
        found = {r.k: r.ok for r in heads.groupBy("k").agg(F.bool_and(usable).alias("ok")).collect()}  # a row a source
        errors |= {k: "no usable header" for k in roots if not found.get(k, False)}
        cells = text.join(heads.where(usable), "_f").where(F.col("value") != F.col("_head"))
        at_ = lambda n: F.trim(F.get(F.split("value", ","), F.array_position("_names", n).cast("int") - 1))
        when = at_("timestamp")
        zoned = F.to_utc_timestamp(F.try_to_timestamp(when), F.current_timezone()).cast("timestamp_ntz")
        t = F.coalesce(F.when(when.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), zoned), when.try_cast("timestamp_ntz"))
        bars = checkpointed(cells.select("k", t.alias("t"), *(at_(a).try_cast("double").alias(b) for a, b in zip(needs[1:], "ohlcv", strict=True))).dropna().where(is_valid()))
        counts = {r.k: r.n for r in bars.groupBy("k").agg(F.count("*").alias("n")).collect() if r.k not in errors}
        errors |= {k: "no rows are left after cleaning" for k in roots if k not in counts and k not in errors}
        if counts:
            store.upsert(bars.where(~F.col("k").isin(*errors)) if errors else bars, timeframe)
    if sources:
        log.add([(provider, "csv_import", k, timeframe, p, now, "error" if k in errors else "ok", counts.get(k, 0), errors.get(k, "")) for k, p in sources.items()])
    return counts


def write_csv(bars: DataFrame, path: str) -> None:
    """Bars as CSV, by key and month, with a header, columns in their usual order and times in ISO form. Months of keys
    that these bars have are replaced; all others under the path stay."""
    iso = F.translate(F.col("t").cast("timestamp_ntz").cast("string"), " ", "T")
    out = bars.select("k", F.date_format("t", "yyyy-MM").alias("month"), iso.alias("timestamp"), *(F.col(b).alias(a) for a, b in zip(("open", "high", "low", "close", "volume"), "ohlcv", strict=True)))
    writer = out.repartition("k", "month").sortWithinPartitions("timestamp").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("header", "true").partitionBy("k", "month").csv(path)


def publish_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON under `path` in place of what was there. They are written beside it first, so a failed write leaves
    the old report. Between two renames there is none for a moment: readers that may not meet that use Report."""
    spark = rows.sparkSession
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    made, old, at = Path(f"{path}.new-{uuid.uuid4().hex}"), Path(f"{path}.old-{uuid.uuid4().hex}"), Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows.write.json(made.toString())
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(made, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"cannot publish {path}")
    if had:
        fs.delete(old, True)


class Report:
    """A report in versions, each a folder of its own. The current one is the latest that was written to its end, which
    an empty file in it tells, made in one step; so readers meet the old version or the new one, whole, at any moment.
    The last `keep` versions stay for those who read them still."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path, keep
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        fs, at = self._fs(), self._path(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _whole(self, name: str) -> bool:
        return self._fs().exists(self._path(f"{self.path}/{name}/_SUCCESS"))

    def publish(self, rows: DataFrame) -> None:
        """A failed write leaves the current version; what it wrote goes with a later one."""
        known = self._versions()
        name = f"v{int(known[-1][1:13]) + 1 if known else 0:012d}-{uuid.uuid4().hex}"
        rows.write.json(f"{self.path}/{name}")
        whole = [v for v in known if self._whole(v)] + [name]
        for old in known:
            if old not in whole[-self.keep :]:
                self._fs().delete(self._path(f"{self.path}/{old}"), True)

    def read(self) -> DataFrame:
        whole = [v for v in self._versions() if self._whole(v)]
        if not whole:
            raise FileNotFoundError(f"nothing was published under {self.path}")
        return self.spark.read.json(f"{self.path}/{whole[-1]}")


def news_between(rows: DataFrame, since: Column | None = None, until: Column | None = None, time: str = "time_published") -> DataFrame:
    """News from since to until, both included, the newest first; rows without a time are in no range."""
    out = rows
    if since is not None:
        out = out.where(F.col(time) >= since)
    if until is not None:
        out = out.where(F.col(time) <= until)
    return out.orderBy(F.desc(time), "title")


def recent_news(rows: DataFrame, hours: int, time: str = "published", fetched: str = "fetched_at") -> DataFrame:
    """News of the last hours before it was fetched, not before the time of the question."""
    return rows.where(F.col(time) >= F.col(fetched) - F.make_interval(hours=F.lit(hours)))

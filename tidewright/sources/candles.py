"""Bars of a paged remote service as a Spark data source, and a store that asks it only for what it lacks.

The partitions of the source are ranges of time that are missing, cut into pages; executors call the service, so that
calls run side by side and a lost executor's pages are called again. A page that fails after its retries gives a row
with the error instead of bars, and stops no other.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidewright.operators import intervals as I
from tidewright.operators.bars import is_valid
from tidewright.operators.ledger import last_wins

from .ingest import IngestLog
from .retry import SourceError, retried
from .scratch import checkpointed
from .store import BarStore

SCHEMA = "k string, t timestamp_ntz, o double, h double, l double, c double, v double, a timestamp_ntz, z timestamp_ntz, error string"
#: Names of fields in the service's answers, and of the notes that stand in place of a series.
FIELDS = ("1. open", "2. high", "3. low", "4. close", "5. volume")
NOTES, ERRORS = ("Note", "Information"), ("Error Message",)


@dataclass
class Pages(InputPartition):
    """Some pages of one key: [a, z), each `page` long."""

    k: str
    a: dt.datetime
    z: dt.datetime


def bars_of(body: str) -> Iterator[tuple[dt.datetime, tuple[float, ...]]]:
    """Times and values in an answer; entries that don't parse are skipped. A note on limits is a transient error."""
    try:
        answer = json.loads(body)
    except ValueError as e:
        raise SourceError(f"no JSON: {str(e)[:100]}", True) from e
    for names, transient in ((NOTES, True), (ERRORS, False)):
        for n in names:
            if n in answer:
                raise SourceError(f"{n}: {str(answer[n])[:200]}", transient)
    for series in (v for k, v in answer.items() if "time series" in k.lower() and isinstance(v, dict)):
        for at, bar in series.items():
            try:
                yield dt.datetime.fromisoformat(at), tuple(float(bar[f]) for f in FIELDS)
            except (ValueError, KeyError, TypeError):
                continue


class CandleSource(DataSource):
    """A paged service. Subclasses say how to call it.

    Options: ranges, a JSON list of [key, from, to) with ISO times; page_minutes, the longest span of a call; attempts;
    task_pages, how many pages a partition has at most; retry_seconds, the base of the waits between attempts.
    """

    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CandleReader(self)

    def call(self, key: str, a: dt.datetime, z: dt.datetime) -> str:
        """The service's answer for a key from a to z, both included."""
        raise NotImplementedError


class CandleReader(DataSourceReader):
    def __init__(self, source: CandleSource):
        self.source = source
        o = source.options
        self.page = dt.timedelta(minutes=int(o.get("page_minutes", 240)))
        self.attempts, self.task_pages, self.wait = int(o.get("attempts", 4)), int(o.get("task_pages", 32)), float(o.get("retry_seconds", 0.5))
        self.ranges = [(k, dt.datetime.fromisoformat(a), dt.datetime.fromisoformat(z)) for k, a, z in json.loads(o.get("ranges", "[]"))]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Ranges of other keys and times are never asked for. Spark applies all filters again, as pages are whole."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("k",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ranges = [r for r in self.ranges if r[0] in wanted]
            elif isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == ("t",):
                at = f.value.replace(tzinfo=None)
                late = isinstance(f, GreaterThan | GreaterThanOrEqual)
                upto = at + dt.timedelta(microseconds=1)
                cut = [(k, max(a, at), z) if late else (k, a, min(z, upto)) for k, a, z in self.ranges]
                self.ranges = [r for r in cut if r[1] < r[2]]
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        step = self.page * self.task_pages
        out = []
        for k, a, z in self.ranges:
            while a < z:
                out.append(Pages(k, a, min(a + step, z)))
                a += step
        return out or [Pages("", dt.datetime.min, dt.datetime.min)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        a = partition.a
        while a < partition.z:
            z = min(a + self.page, partition.z)
            try:
                for at, values in retried(lambda a=a, z=z: list(bars_of(self.source.call(partition.k, a, z))), self.attempts, self.wait):
                    if a <= at <= z:
                        yield (partition.k, at, *values, None, None, None)
            except (SourceError, TimeoutError, ConnectionError) as e:
                yield (partition.k, None, None, None, None, None, None, a, z, f"{'rate_limited' if getattr(e, 'transient', True) else 'error'}: {e}"[:300])
            a = z


class RecordedCandles(CandleSource):
    """Answers as recorded by record(): a JSON file for each key and day under the option `recorded`."""

    @classmethod
    def name(cls) -> str:
        return "recorded_candles"

    def call(self, key: str, a: dt.datetime, z: dt.datetime) -> str:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(re.sub("^file:/+", "/", self.options["recorded"]))
        found: dict = {}
        day = a.date()
        while day <= z.date():
            folder = f"{root}/k={key}/day={day}"
            for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.base_name.startswith("part-"):
                    with system.open_input_stream(f.path) as s:
                        for line in s.read().decode().splitlines():
                            found |= json.loads(line)
            day += dt.timedelta(days=1)
        return json.dumps({"Time Series": {k: v for k, v in found.items() if a.isoformat(" ") <= k <= z.isoformat(" ")}})


def record(bars: DataFrame, path: str) -> None:
    """Bars as a service's answers, for RecordedCandles; a key's day is a file."""
    bar = F.create_map(*(x for name, c in zip(FIELDS, "ohlcv", strict=True) for x in (F.lit(name), F.col(c).cast("string"))))
    days = bars.groupBy("k", F.date_format("t", "yyyy-MM-dd").alias("day")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.date_format("t", "yyyy-MM-dd HH:mm:ss"), bar)))).alias("value"))
    days.repartition("k").write.mode("overwrite").partitionBy("k", "day").text(path)


def register(spark: SparkSession, source: type[CandleSource]) -> None:
    """Makes a source known to the session. Spark refuses readers that take filters unless the session allows them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


class LocalFirst:
    """Bars of a store, after what it lacks of a range was fetched from a source.

    What the source was asked for and answered, with or without bars, is noted under `asked`, and not asked again;
    failed pages are not noted, so the next call asks for them.
    """

    def __init__(self, store: BarStore, source: type[CandleSource], timeframe: str, minutes: int, asked: str, log: IngestLog | None = None, most: int = 10_000, **options: str):
        self.store, self.source, self.timeframe, self.minutes, self.asked, self.log, self.most, self.options = store, source, timeframe, minutes, asked, log, most, options
        self.spark: SparkSession = store.spark
        register(self.spark, source)

    def _noted(self) -> DataFrame:
        schema = "k string, timeframe string, a timestamp_ntz, z timestamp_ntz"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.asked)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        rows = self.spark.read.schema(schema).parquet(self.asked) if there else self.spark.createDataFrame([], schema)
        return rows.where(F.col("timeframe") == self.timeframe).select("k", "a", "z")

    def missing(self, keys: DataFrame, start: Column, end: Column) -> DataFrame:
        """Spans [a, z) of each key between start and end (both included) that are neither stored nor noted as asked."""
        width = F.make_interval(mins=F.lit(self.minutes))
        want = keys.select("k", start.cast("timestamp_ntz").alias("a"), (end + width).cast("timestamp_ntz").alias("z")).distinct()
        have = self._noted()
        if self.store.exists():
            rows = self.store.read(tolerant=False).where((F.col("timeframe") == self.timeframe) & (F.col("t") >= start) & (F.col("t") <= end))
            have = have.unionByName(rows.join(keys.select("k"), "k", "left_semi").select("k", F.col("t").alias("a"), (F.col("t") + width).alias("z")))
        return I.minus(want, have, ["k"], "month")

    def fill(self, keys: DataFrame, start: Column, end: Column, now: dt.datetime) -> dict[str, int]:
        """Fetches and stores what is missing up to `now`; how many ranges were asked for, bars stored, pages failed.

        The ranges are listed on the driver, `most` of them at most: a service would not bear more calls at once.
        """
        cut = self.missing(keys, start, end).select("k", "a", F.least("z", F.lit(now)).alias("z")).where("a < z")
        ranges = cut.limit(self.most + 1).collect()
        if len(ranges) > self.most:
            raise ValueError(f"more than {self.most} ranges are missing: ask for fewer keys or less time at once")
        if not ranges:
            return {"ranges": 0, "bars": 0, "failed": 0}
        listed = json.dumps([[r.k, r.a.isoformat(), r.z.isoformat()] for r in ranges])
        got = checkpointed(self.spark.read.format(self.source.name()).options(**self.options, ranges=listed).load())
        bars = last_wins(got.where("error is null").where(is_valid()), ["k", "t"], [F.desc(c) for c in "vchlo"])
        failed = got.where("error is not null").select("k", "a", "z", "error")
        n, bad = bars.count(), failed.count()
        if n:
            self.store.upsert(bars, self.timeframe)
        answered = self.spark.createDataFrame([(r.k, r.a, r.z) for r in ranges], "k string, a timestamp_ntz, z timestamp_ntz")
        answered = I.minus(answered, failed, ["k"], "month") if bad else answered
        answered.select("k", F.lit(self.timeframe).alias("timeframe"), "a", "z").coalesce(1).write.mode("append").parquet(self.asked)
        if self.log is not None:
            said = got.groupBy("k").agg(F.count_if(F.col("error").isNull()).alias("n"), F.max("error").alias("error")).collect()  # keys of the ranges
            none = {r.k for r in ranges} - {r.k for r in said}
            status = lambda e: "ok" if e is None else "rate_limited" if e.startswith("rate_limited") else "error"
            self.log.add([(self.source.name(), "gap_fill", k, self.timeframe, f"{len(ranges)} ranges", now, status(e), c, e or "") for k, c, e in [*((r.k, r.n, r.error) for r in said), *((k, 0, None) for k in sorted(none))]])
        return {"ranges": len(ranges), "bars": n, "failed": bad}

    def get(self, keys: DataFrame, start: Column, end: Column, now: dt.datetime) -> DataFrame:
        """Bars of the keys from start to end, both included, after a fill."""
        self.fill(keys, start, end, now)
        if not self.store.exists():
            return self.spark.createDataFrame([], "k string, timeframe string, month string, t timestamp_ntz, o double, h double, l double, c double, v double")
        rows = self.store.read().where((F.col("timeframe") == self.timeframe) & (F.col("t") >= start) & (F.col("t") <= end))
        return rows.join(keys.select("k").distinct(), "k", "left_semi")

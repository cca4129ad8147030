"""The gap-driven source: what is asked for, retried, noted and stored."""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewright.sources import candles as C
from tidewright.sources.ingest import IngestLog
from tidewright.sources.store import BarStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers don't have this module
START, NOW = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


class Service(C.CandleSource):
    """Hourly bars by rule; every call leaves a file, and some fail the first time or always."""

    @classmethod
    def name(cls):
        return "service"

    def call(self, key, a, z):
        calls = self.options["calls"]
        name = f"{key}-{a.isoformat()}-{z.isoformat()}".replace(":", "")
        before = sum(f.startswith(name) for f in os.listdir(calls))
        open(f"{calls}/{name}-{uuid.uuid4().hex}", "w").close()
        if key == "flaky" and not before:
            return json.dumps({"Note": "too many calls"})
        if key == "busy":
            return json.dumps({"Information": "too many calls"})
        if key == "unknown":
            return json.dumps({"Error Message": "no such key"})
        if key == "broken":
            return "<html>"
        out, t = {}, a.replace(minute=0, second=0)
        while t <= z:
            if t >= a and t.weekday() < 5:
                out[t.isoformat(" ")] = dict(zip(C.FIELDS, ("1", "3", "0.5", str(t.hour % 3 + 0.5), "7"), strict=True))
            t += dt.timedelta(hours=1)
        out["yesterday"], out["2024-01-01 00:30:00"] = {}, {"1. open": "x"}
        return json.dumps({"Meta": 1, "Time Series (60min)": out})


@pytest.fixture
def local(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoint"))
    return C.LocalFirst(BarStore(spark, str(tmp_path / "store")), Service, "1h", 60, str(tmp_path / "asked"), IngestLog(spark, str(tmp_path / "log")), calls=str(tmp_path / "calls"), retry_seconds="0.001", task_pages="3")


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "k string")


def day(n, hour=0):
    return F.lit(dt.datetime(2024, 1, n, hour)).cast("timestamp_ntz")


def calls(tmp_path):
    return sorted(f.rsplit("-", 1)[0] for f in os.listdir(tmp_path / "calls"))


def test_only_gaps_are_asked_for(spark, local, tmp_path):
    got = local.get(keys(spark, "a"), day(2), day(3, 23), NOW)
    assert got.count() == 48 and got.agg(F.count_distinct("t")).first()[0] == 48  # pages share their edges
    first = calls(tmp_path)
    assert len(first) == 12 and len(set(first)) == 12  # 2 days in pages of 4 hours
    assert local.get(keys(spark, "a"), day(2), day(3, 23), NOW).count() == 48 and calls(tmp_path) == first  # nothing is read again
    assert local.get(keys(spark, "a", "b"), day(1, 12), day(4, 3), NOW).where("k = 'a'").count() == 64
    new = [c for c in calls(tmp_path) if c not in first]
    assert {c.split("-")[0] for c in new} == {"a", "b"}
    assert [c for c in new if c.startswith("a")] == ["a-2024-01-01T120000-2024-01-01T160000", "a-2024-01-01T160000-2024-01-01T200000", "a-2024-01-01T200000-2024-01-02T000000", "a-2024-01-04T010000-2024-01-04T040000"]  # the bar at midnight came with the page before


def test_holes_without_bars_are_asked_for_once(spark, local, tmp_path):
    weekend = dt.datetime(2024, 1, 6)
    assert weekend.weekday() == 5
    assert local.get(keys(spark, "a"), day(5), day(8, 23), NOW).count() == 48
    n = len(calls(tmp_path))
    assert local.fill(keys(spark, "a"), day(5), day(8, 23), NOW) == {"ranges": 0, "bars": 0, "failed": 0} and len(calls(tmp_path)) == n
    assert local.missing(keys(spark, "a"), day(5), day(9, 1)).count() == 1
    store = local.store.read().where("t < '2024-01-05 05:00:00'")
    assert store.count() == 5


def test_failures_stop_no_other_and_are_asked_again(spark, local, tmp_path):
    done = local.fill(keys(spark, "a", "flaky", "busy", "unknown", "broken"), day(2), day(2, 7), NOW)
    assert done == {"ranges": 5, "bars": 18, "failed": 6}  # a page includes its end
    by_key = {k: sum(c.startswith(k + "-") for c in calls(tmp_path)) for k in ("a", "flaky", "busy", "unknown", "broken")}
    assert by_key == {"a": 2, "flaky": 4, "busy": 8, "unknown": 2, "broken": 8}  # permanent errors aren't tried again
    assert {(x.k, x.status) for x in local.log.read().collect()} == {("a", "ok"), ("flaky", "ok"), ("busy", "rate_limited"), ("unknown", "error"), ("broken", "rate_limited")}
    again = local.fill(keys(spark, "a", "flaky", "busy"), day(2), day(2, 7), NOW)
    assert again == {"ranges": 1, "bars": 0, "failed": 2}


def test_the_future_is_not_asked_for(spark, local, tmp_path):
    assert local.get(keys(spark, "a"), day(2), day(20), dt.datetime(2024, 1, 2, 12)).count() >= 12
    assert all("2024-01-02" in c for c in calls(tmp_path))
    more = local.missing(keys(spark, "a"), day(2), day(20)).collect()
    assert len(more) == 1 and more[0].a >= dt.datetime(2024, 1, 2, 12)
    with pytest.raises(ValueError):
        C.LocalFirst(local.store, Service, "1h", 60, local.asked, most=1, calls=str(tmp_path / "calls")).fill(keys(spark, "x", "y"), day(2), day(3), NOW)


def test_filters_cut_what_is_read(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    C.register(spark, Service)
    ranges = json.dumps([[k, "2024-01-02T00:00:00", "2024-01-05T00:00:00"] for k in "abc"])
    rows = spark.read.format("service").options(ranges=ranges, calls=str(tmp_path / "calls")).load()
    got = rows.where("k = 'b' and t >= timestamp_ntz'2024-01-03 01:00:00' and t < timestamp_ntz'2024-01-03 05:00:00'")
    assert got.select("t").distinct().count() == 4
    assert calls(tmp_path) == ["b-2024-01-03T010000-2024-01-03T050000", "b-2024-01-03T050000-2024-01-03T050000.000001"][: len(calls(tmp_path))]
    assert spark.read.format("service").options(calls=str(tmp_path / "calls")).load().count() == 0


def test_recorded_answers_round_trip(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1, 22) + dt.timedelta(hours=i), 0.1 * i, 0.1 * i + 1, -1 / 3, 0.1 * i, float(i)) for k in ("a", "b c") for i in range(6)]
    C.record(spark.createDataFrame(rows, "k string, t timestamp_ntz, o double, h double, l double, c double, v double"), str(tmp_path / "remote"))
    C.register(spark, C.RecordedCandles)
    ranges = json.dumps([["a", "2024-01-01T23:00:00", "2024-01-02T02:00:00"], ["none", "2024-01-01T23:00:00", "2024-01-02T02:00:00"]])
    got = spark.read.format("recorded_candles").options(ranges=ranges, recorded=f"file:{tmp_path}/remote").load().orderBy("t").collect()
    assert [tuple(x)[:7] for x in got] == rows[1:5]

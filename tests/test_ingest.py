"""Bulk ingest, its log, and sinks."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright.sources import ingest as I
from tidewright.sources import store as S

NOW = dt.datetime(2024, 5, 1, 12)
HEAD = " Timestamp,CLOSE,Open,High,Low,Volume\n"


def test_hourly_csv_takes_any_header_and_drops_what_does_not_parse(spark, tmp_path):
    (tmp_path / "x.csv").write_text(HEAD + "2024-01-02 10:00:00,2,1,3,1,5\n2024-01-02T11:00:00+02:00,2,1,3,1,5\n2024-01-02 12:00:00Z,2,1,3,1,5\nnonsense,2,1,3,1,5\n2024-01-02 13:00:00,x,1,3,1,5\n2024-01-02 14:00:00,9,1,3,1,5\n,2,1,3,1,5\n")
    got = I.read_hourly_csv(spark, str(tmp_path / "x.csv"), "x").orderBy("t").collect()
    assert [(r.t.hour, r.o, r.c) for r in got] == [(9, 1.0, 2.0), (10, 1.0, 2.0), (12, 1.0, 2.0)]


def test_broken_sources_fail_alone_and_are_logged(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "2024-01-02 10:00:00,2,1,3,1,5\n2024-02-02 10:00:00,2,1,3,1,5\n")
    (tmp_path / "b.csv").write_text("something,else\n1,2\n")
    (tmp_path / "c.csv").write_text(HEAD + "never,2,1,3,1,5\n")
    (tmp_path / "d.csv").write_text(HEAD + "2024-01-02 10:00:00,3,1,3,1,5\n")
    store, log = S.BarStore(spark, str(tmp_path / "bars")), I.IngestLog(spark, str(tmp_path / "log"))
    sources = {k: str(tmp_path / f"{k}.csv") for k in ("a", "b", "c", "d", "missing")}
    assert I.ingest(store, log, sources, "1h", I.read_hourly_csv, "csv", NOW) == {"a": 2, "d": 1}
    assert sorted((r.k, r.c) for r in store.read().collect()) == [("a", 2.0), ("a", 2.0), ("d", 3.0)]
    assert {r.k: (r.status, r.n) for r in log.read("2024-05-01").collect()} == {"a": ("ok", 2), "b": ("error", 0), "c": ("error", 0), "d": ("ok", 1), "missing": ("error", 0)}
    assert all(r.error for r in log.read().where("status = 'error'").collect())
    assert I.ingest(store, log, {}, "1h", I.read_hourly_csv, "csv", NOW) == {}


def test_log_appends_by_day(spark, tmp_path):
    log = I.IngestLog(spark, str(tmp_path / "log"))
    record = lambda day, status: ("p", "e", "a", "1h", "{}", dt.datetime(2024, 5, day), status, 1, "")
    log.add([record(1, "ok"), record(2, "cached")])
    log.add([record(2, "rate_limited")])
    assert sorted(r.status for r in log.read("2024-05-02").collect()) == ["cached", "rate_limited"]
    assert log.read().count() == 3
    with pytest.raises(ValueError, match="unknown status"):
        log.add([record(1, "fine")])


def test_csv_sink_comes_back(spark, tmp_path):
    bars = spark.createDataFrame([("a", dt.datetime(2024, m, 2, 16), 1.0, 3.0, 1.0, 2.0, 5.0) for m in (1, 2)], "k string, t timestamp_ntz, o double, h double, l double, c double, v double")
    I.write_csv(bars, str(tmp_path / "csv"))
    back = I.read_hourly_csv(spark, str(tmp_path / "csv"), "a")
    assert sorted(back.collect()) == sorted(bars.collect())
    header = next((tmp_path / "csv" / "k=a" / "month=2024-01").glob("*.csv")).read_text().splitlines()
    assert header == ["timestamp,open,high,low,close,volume", "2024-01-02T16:00:00,1.0,3.0,1.0,2.0,5.0"]


def test_a_failed_report_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "report")
    I.publish_json(spark.range(3), path)
    I.publish_json(spark.range(2), path)
    assert spark.read.json(path).count() == 2
    with pytest.raises(Exception, match="no good"):
        I.publish_json(spark.range(2).select(F.raise_error(F.lit("no good")).cast("long").alias("id")), path)
    assert spark.read.json(path).count() == 2
    assert not list(tmp_path.glob("report.old-*"))


def test_news_by_time(spark):
    rows = spark.createDataFrame([("a", "20240101T0000", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 5)), ("b", "20240102T0000", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 5)), ("c", None, None, dt.datetime(2024, 1, 5))], "title string, time_published string, published timestamp_ntz, fetched_at timestamp_ntz")
    assert [r.title for r in I.news_between(rows, F.lit("20240101T0000"), F.lit("20240102T0000")).collect()] == ["b", "a"]
    assert [r.title for r in I.news_between(rows, since=F.lit("20240101T0001")).collect()] == ["b"]
    assert [r.title for r in I.recent_news(rows, 24).collect()] == ["a"]

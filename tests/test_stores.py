"""Sinks that keep what they don't replace, news by month, many files in two passes, reports in versions."""

from __future__ import annotations

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from tidewright.sources import ingest as I
from tidewright.sources import store as S

T = dt.datetime(2024, 1, 31, 23, 30)
BARS = "k string, t timestamp_ntz, o double, h double, l double, c double, v double"


def bars(spark, *rows):
    return spark.createDataFrame([(k, t, 1.0, 3.0, 1.0, float(c), 5.0) for k, t, c in rows], BARS)


def test_csv_keeps_other_keys_and_months(spark, tmp_path):
    path = str(tmp_path / "csv")
    I.write_csv(bars(spark, ("a", T, 1), ("a", T + dt.timedelta(days=1), 2)), path)
    I.write_csv(bars(spark, ("b", T, 3)), path)
    I.write_csv(bars(spark, ("a", T + dt.timedelta(days=2, microseconds=250_000), 2.5)), path)
    got = spark.read.option("header", "true").csv(path).collect()
    assert sorted((r.k, r.timestamp, r.close) for r in got) == [("a", "2024-01-31T23:30:00", "1.0"), ("a", "2024-02-02T23:30:00.25", "2.5"), ("b", "2024-01-31T23:30:00", "3.0")]
    assert I.read_hourly_csv(spark, f"{path}/k=a/month=2024-02", "a").first().t == T + dt.timedelta(days=2, microseconds=250_000)


def test_report_is_whole_at_any_moment(spark, tmp_path):
    report = I.Report(spark, str(tmp_path / "report"), keep=20)
    with pytest.raises(FileNotFoundError):
        report.read()
    report.publish(spark.range(1))
    stop, seen = threading.Event(), []

    def reader():
        while not stop.is_set():
            try:
                seen.append(report.read().count())
            except Exception:
                seen.append(-1)

    other = threading.Thread(target=reader)
    other.start()
    for n in range(2, 12):
        report.publish(spark.range(n))
    with pytest.raises(Exception, match="no good"):
        report.publish(spark.range(2).select(F.raise_error(F.lit("no good")).cast("long").alias("id")))
    stop.set()
    other.join()
    assert report.read().count() == 11 and seen == sorted(seen) and set(seen) <= set(range(1, 12))
    few = I.Report(spark, str(tmp_path / "report"))
    few.publish(spark.range(9))
    assert few.read().count() == 9 and len(os.listdir(tmp_path / "report")) == 2


def news(spark, *rows):
    return spark.createDataFrame([(k, title, t, "u", "s", None, 0.5, ["x"]) for k, title, t in rows], "k string, title string, time_published timestamp_ntz, url string, source string, summary string, score double, topics array<string>").repartition(3)


def test_news_are_stored_once_by_month(spark, tmp_path):
    store = S.NewsStore(spark, str(tmp_path / "news"))
    feb, mar = dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 5)
    assert store.add(news(spark, ("a", "x", feb), ("a", "x", feb), ("a", None, feb), ("a", "x", None), ("a", None, None), (None, "x", feb), ("b", "x", feb))) == 6
    assert store.add(news(spark, ("a", "x", feb), ("a", None, feb), ("a", "x", None), ("a", None, None), (None, "x", feb), ("b", "x", feb), ("b", "x", mar), ("b", "x", mar))) == 1
    assert store.add(news(spark, ("b", "x", mar))) == 0
    assert sorted(os.listdir(tmp_path / "news" / "k=a")) == ["month=2024-02", "month=unknown"]
    assert store.add(news(spark, ("b", "y", mar), ("b", "w", mar), ("b", "z", dt.datetime(2024, 3, 9)))) == 3
    assert [(r.title, r.topics) for r in store.load("b", F.lit(mar), F.lit(dt.datetime(2024, 4, 1))).collect()] == [("z", ["x"]), ("w", ["x"]), ("x", ["x"]), ("y", ["x"])]
    assert store.load("b").count() == 5 and store.load("nobody").count() == 0


def test_untouched_months_are_not_opened(spark, tmp_path):
    store = S.NewsStore(spark, str(tmp_path / "news"))
    store.add(news(spark, ("a", "x", dt.datetime(2024, 1, 1)), ("a", "x", dt.datetime(2024, 2, 1))))
    folder = tmp_path / "news" / "k=a" / "month=2024-01"
    for f in folder.iterdir():
        f.unlink()
    (folder / "part-0.json").mkdir()  # whoever opens this as a file fails
    (folder / "part-0.json" / "x").write_text("x")
    assert store.add(news(spark, ("a", "x", dt.datetime(2024, 2, 1)), ("a", "y", dt.datetime(2024, 2, 1)))) == 1
    assert store.load("a", F.lit(dt.datetime(2024, 2, 1))).count() == 2


def test_append_takes_null_keys_once(spark, tmp_path):
    schema = "title string, time_published string"
    rows = spark.createDataFrame([(None, "1"), ("a", None), ("a", "1")], schema)
    for _ in range(2):
        S.append_new(spark, str(tmp_path / "x"), rows, schema, ["title", "time_published"])
    assert S.read_jsonl(spark, str(tmp_path / "x"), schema).count() == 3


def test_many_files_in_two_passes(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoint"))
    head = " Timestamp,CLOSE,Open,High,Low,Volume"
    put = lambda name, *lines: (tmp_path / name).write_text("\n".join(lines) + "\n")
    put("a.csv", head, "2024-01-02 10:00:00,2,1,3,1,5", "2024-02-02T10:00:00+02:00,2,1,3,1,5", "2024-01-02 12:00:00,x,1,3,1,5", "short")
    put("b.csv", "something,else", "1,2")
    put("c.csv", head, "never,2,1,3,1,5")
    put("d e+f.csv", "volume,low,high,open,close,timestamp,more", "5,1,3,1,2.5,2024-01-02 10:00:00,z", "5,1,3,1,9,2024-01-02 11:00:00,z")
    (tmp_path / "g").mkdir()
    put("g/1.csv", head, "2024-01-02 10:00:00,2,1,3,1,5")
    put("g/2.csv", "timestamp,open,high,low,close,volume", "2024-01-02 11:00:00,1,3,1,2,5")
    put("h.csv", "")
    store, log, now = S.BarStore(spark, str(tmp_path / "bars")), I.IngestLog(spark, str(tmp_path / "log")), dt.datetime(2024, 5, 1)
    sources = {k: str(tmp_path / f) for k, f in (("a", "a.csv"), ("b", "b.csv"), ("c", "c.csv"), ("d", "d e+f.csv"), ("g", "g"), ("h", "h.csv"), ("none", "none.csv"))}
    assert I.ingest_files(store, log, sources, "1h", "csv", now) == {"a": 2, "d": 1, "g": 2}
    got = sorted((r.k, r.t.month, r.t.hour, r.c) for r in store.read().collect())
    assert got == [("a", 1, 10, 2.0), ("a", 2, 8, 2.0), ("d", 1, 10, 2.5), ("g", 1, 10, 2.0), ("g", 1, 11, 2.0)]
    assert {r.k: (r.status, r.n) for r in log.read().collect()} == {"a": ("ok", 2), "b": ("error", 0), "c": ("error", 0), "d": ("ok", 1), "g": ("ok", 2), "h": ("error", 0), "none": ("error", 0)}
    assert I.ingest_files(store, log, {}, "1h", "csv", now) == {} and I.ingest_files(store, log, {"none": "/nowhere"}, "1h", "csv", now) == {}

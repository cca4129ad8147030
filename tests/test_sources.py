"""The bar store and the tolerant readers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewright.sources import store as S


def bars(spark, days, price, key="a"):
    return spark.createDataFrame([(key, dt.datetime(2024, m, d, 16), price, price + 1, price - 1, price, 5.0) for m, d in days], "k string, t timestamp_ntz, o double, h double, l double, c double, v double")


def test_store_upsert_and_load(spark, tmp_path):
    store = S.BarStore(spark, str(tmp_path / "bars"))
    store.upsert(bars(spark, [(1, 2), (1, 3), (2, 1)], 10.0), "1d")
    store.upsert(bars(spark, [(1, 3), (1, 4)], 20.0), "1d")
    store.upsert(bars(spark, [(3, 1)], 30.0, "b"), "1d")
    got = {r.t.strftime("%m-%d"): r.c for r in store.load("a", "1d").collect()}
    assert got == {"01-02": 10.0, "01-03": 20.0, "01-04": 20.0, "02-01": 10.0}
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    part = store.load("a", "1d", at("2024-01-03 16:00:00"), at("2024-01-31 00:00:00"))
    assert sorted(r.t.day for r in part.collect()) == [3, 4]
    assert "month" in part._jdf.queryExecution().toString() and "PartitionFilters: [" in part._jdf.queryExecution().toString()
    assert sorted(r.k for r in store.keys("1d").collect()) == ["a", "b"]
    assert {(r.k, r.month): r.n for r in store.ranges().collect()} == {("a", "2024-01"): 3, ("a", "2024-02"): 1, ("b", "2024-03"): 1}


def test_daily_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Timestamp,Open,High,Low,Close,Volume\n2024-01-03,10,9,11,10,5\n2024-01-02,12,11,9,10,5\nnonsense,1,1,1,1,1\n2024-01-01,10,11,x,10,5\n2024-01-04,10,11,9,10,-1\n")
    got = S.read_daily_csv(spark, str(tmp_path / "x.csv"), "x").collect()
    assert [(r.t, r.o) for r in got] == [(dt.datetime(2024, 1, 2, 16), 11.0)]


def test_series_payload(spark):
    body = '{"Meta": {"x": "y"}, "Time Series (60min)": {"2024-01-02 10:00:00": {"1. open": "1", "2. high": "2", "3. low": "1", "4. close": "2", "5. volume": "7"}, "2024-01-02 11:00:00": {"1. open": "bad"}, "when": {}}}'
    got = S.parse_series_payload(spark.createDataFrame([("a", body), ("b", '{"Note": "slow down"}'), ("c", "not json")], "k string, body string")).collect()
    assert [(r.k, r.t, r.c, r.v) for r in got] == [("a", dt.datetime(2024, 1, 2, 10), 2.0, 7.0)]


def test_jsonl_store(spark, tmp_path):
    path, schema = str(tmp_path / "news"), "title string, time_published string"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    S.append_new(spark, path, rows(("a", "1"), ("a", "1"), ("b", "1")), schema, ["title", "time_published"])
    S.append_new(spark, path, rows(("a", "1"), ("a", "2")), schema, ["title", "time_published"])
    (tmp_path / "news" / "broken.json").write_text('{"title": "c", "time_pub\n')
    assert sorted((r.title, r.time_published) for r in S.read_jsonl(spark, path, schema).collect() if r.title) == [("a", "1"), ("a", "2"), ("b", "1")]


def test_first_source_with_enough(spark):
    one, two = bars(spark, [(1, 1)], 1.0), bars(spark, [(1, 1), (1, 2)], 2.0)
    assert sorted(r.c for r in S.first_with_enough([one, two], 2).collect()) == [2.0, 2.0]
    assert S.newest(two, 1).first().t.day == 2


def test_upsert_keeps_the_latest_of_a_batch_and_never_loses_a_month(spark, tmp_path):
    import glob

    import pytest

    store = S.BarStore(spark, str(tmp_path / "bars"))
    twice = bars(spark, [(1, 2)], 10.0).withColumn("s", F.lit(2)).unionByName(bars(spark, [(1, 2)], 99.0).withColumn("s", F.lit(1)))
    store.upsert(twice, "1d", "s")
    assert [r.c for r in store.read().collect()] == [10.0]
    store.upsert(twice.withColumn("c", F.col("c") + 1), "1d", "s")
    assert [r.c for r in store.read().collect()] == [11.0]
    store.upsert(twice, "1d")
    assert [r.c for r in store.read().collect()] == [99.0]
    store.upsert(bars(spark, [(1, d) for d in range(3, 13)] + [(2, 1)], 5.0), "1d")
    (file,) = glob.glob(f"{tmp_path}/bars/k=a/timeframe=1d/month=2024-01/*.parquet")
    body = open(file, "rb").read()
    open(file, "wb").write(body[: len(body) // 2])
    with pytest.raises(Exception):
        store.upsert(bars(spark, [(1, 20)], 7.0), "1d")
    assert open(file, "rb").read() == body[: len(body) // 2]
    store.upsert(bars(spark, [(2, 20)], 7.0), "1d")
    assert sorted(r.t.day for r in store.read().collect()) == [1, 20]

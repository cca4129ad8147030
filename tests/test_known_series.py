"""Operators on small series whose results are known."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.functions import scalar as S
from tidewright.operators import asof as J
from tidewright.operators import bars as B
from tidewright.operators import evaluation as E
from tidewright.operators import folds as X
from tidewright.operators import ledger as L
from tidewright.operators import windows as W

T0 = dt.datetime(2024, 1, 1, 9)


def series(spark, closes, key="a", spread=0.5):
    rows = [(key, T0 + dt.timedelta(hours=i), float(c), c + spread, c - spread, float(c), 10.0, 1) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, o double, h double, l double, c double, v double, n long")


def points(spark, rows, value="px"):
    return spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), i, float(x)) for k, s, i, x in rows], f"k string, t timestamp_ntz, id long, {value} double")


def test_resample_drops_the_newest_bucket(spark):
    ticks = points(spark, [("a", 0, 1, 5), ("a", 10, 2, 7), ("a", 10, 3, 6), ("a", 3700, 4, 1), ("b", 0, 5, 1)]).withColumn("size", F.lit(1.0))
    got = B.resample(ticks, "1 hour").collect()
    assert [(r.k, r.o, r.h, r.l, r.c, r.n) for r in got] == [("a", 5, 7, 5, 6, 3)]
    assert B.resample(ticks, "1 hour", keep_last=True).count() == 3


def test_plateau_is_no_swing(spark):
    up = [1, 2, 3, 4, 5, 9, 5, 4, 3, 2, 1]
    assert W.swings(series(spark, up)).where("swing_high").count() == 1
    assert W.swings(series(spark, [*up[:6], 9, *up[6:]])).where("swing_high").count() == 0


def test_no_future_row_changes_the_past(spark):
    closes = [10 + (i * 7) % 5 for i in range(40)]
    short, long = series(spark, closes[:30]), series(spark, closes)
    for feature, columns in ((W.rsi, ["rsi"]), (W.bollinger, ["boll_z"]), (W.volatility, ["realised_vol", "range_position"]), (X.wilder_atr, ["atr"]), (X.macd, ["macd", "signal"])):
        a = [tuple(r) for r in feature(short).orderBy("t").select(*columns).collect()]
        b = [tuple(r) for r in feature(long).orderBy("t").select(*columns).collect()]
        assert a == b[:30]


def test_wilder_atr_by_hand(spark):
    bars = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), c, h, l, c, 1.0, 1) for i, (h, l, c) in enumerate([(11.0, 9.0, 10.0), (12.0, 10.0, 11.0), (13.0, 10.0, 12.0), (15.0, 11.0, 14.0)])], "k string, t timestamp_ntz, o double, h double, l double, c double, v double, n long")
    got = [r.atr for r in X.wilder_atr(bars, window=3).orderBy("t").collect()]
    assert got[:2] == [None, None] and got[2] == pytest.approx(7 / 3) and got[3] == pytest.approx((7 / 3 * 2 + 4) / 3)


def test_as_of_edges(spark):
    left = points(spark, [("a", 100, 1, 0), ("a", 5, 2, 0), ("b", 100, 3, 0)])
    right = points(spark, [("a", 100, 1, 1), ("a", 100, 2, 2), ("a", 90, 3, 3), ("a", 111, 4, 4)])
    got = {r.id: r.q_value for r in J.as_of(left, right, "px").collect()}
    assert got == {1: 2.0, 2: None, 3: None}
    assert {r.id: r.q_value for r in J.as_of(left, right.where("id >= 3"), "px", "5 seconds").collect()} == {1: None, 2: None, 3: None}
    assert {r.id: r.n_value for r in J.as_of_forward(left, right, "px", "90 seconds").collect()} == {1: 1.0, 2: 3.0, 3: None}
    assert {r.id: r.m_value for r in J.nearest(left, right.where("id >= 3"), "px", "12 seconds").collect()} == {1: 3.0, 2: None, 3: None}


def test_gap_drops_an_offset_pair(spark):
    bars = series(spark, range(6)).where(F.hour("t") != 11)
    assert sorted(r.c for r in J.at_offset(bars.select("k", "t", "c"), "1 hour").collect()) == [0, 3, 4]


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([("a", 0.1, 0), ("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.9, 1), ("b", 0.2, 1)], "k string, p double, y int")
    assert {r.k: r.auc for r in E.rank_auc(rows).collect()} == {"a": 0.875, "b": None}


def test_reasons(spark):
    x = spark.range(4).select("id", L.first_failing((F.col("id") > 2, "BIG"), (F.col("id") > 0, "SOME")).alias("first"), L.all_failing((F.col("id") > 2, "BIG"), (F.col("id") > 0, "SOME")).alias("all"))
    assert [(r.first, r["all"]) for r in x.orderBy("id").collect()] == [("ok", []), ("SOME", ["SOME"]), ("SOME", ["SOME"]), ("BIG", ["BIG", "SOME"])]


def test_upsert_newer_source_wins(spark):
    old = spark.createDataFrame([("a", 1, 9), ("b", 2, 1)], "k string, v int, seq int")
    new = spark.createDataFrame([("a", 3, 1), ("a", 4, 2), ("c", 5, 1)], "k string, v int, seq int")
    assert {r.k: r.v for r in L.upsert(old, new, ["k"], "seq").collect()} == {"a": 4, "b": 2, "c": 5}


def test_weekdays(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(9)]
    pairs = [(a, z) for a in days for z in days]
    got = spark.createDataFrame(pairs, "a date, z date").select("a", "z", L.weekdays_between(F.col("a"), F.col("z")).alias("n")).collect()
    for r in got:
        assert r.n == sum((r.a + dt.timedelta(days=i)).weekday() < 5 for i in range(max(0, (r.z - r.a).days + 1)))


def test_scalars(spark):
    x = spark.range(1).select(S.normal_cdf(F.lit(1.96)).alias("cdf"), S.fee_per_contract(F.lit(50.0)).alias("fee"), S.or_default(F.lit(0.0), 7.0).alias("d"), S.compact_timestamp(F.lit("20240102T0304")).cast("string").alias("ts"), S.session_label(F.lit(dt.datetime(2024, 7, 1, 13, 30))).alias("s")).first()
    assert x.cdf == pytest.approx(0.9750021, abs=1e-6) and (x.fee, x.d, x.ts, x.s) == (2.0, 7.0, "2024-01-02 03:04:00", "open")


def test_document_events_read_whole_texts(spark, tmp_path):
    from tidewright.plans.q_structure import document_events

    texts = ["x " * 300 + "The SEC files a lawsuit", "bitcoin etf " + "y " * 300, "z " * 500]
    spark.createDataFrame([("s", t) for t in texts], "source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.event: r.n for r in document_events(spark, str(tmp_path)).collect()}
    from tidewright.operators.structure import EVENT_WORDS

    expected = [next((name for name, words in EVENT_WORDS if any(w in t.lower() for w in words)), "none") for t in texts]
    assert expected[0] != "none" and got == {e: expected.count(e) for e in expected}


def test_fill_curve_takes_all_ticks_as_orders(spark):
    from tidewright.plans.q_decisions import limit_fill_curve
    from tidewright.sources import tables as T

    d = "/root/testdata/sf0.001"
    ticks = T.ticks(spark, d).select("k", "t", "px").toPandas()
    expected = {}
    for k, x in ticks.groupby("k"):
        for distance in (0.0, 2.0, 5.0, 10.0):
            waits = []
            for t, px in zip(x.t, x.px, strict=True):
                hit = x.t[(x.t > t) & (x.t <= t + pd.Timedelta("2h")) & (x.px <= px - distance)]
                waits += [hit.min().floor("s") - t.floor("s")] if len(hit) else []
            expected[k, distance] = (len(x), round(len(waits) / len(x), 6), round(sum(w.total_seconds() for w in waits) / len(waits), 6) if waits else None)
    got = {(r.k, r.distance): (r.n, r.filled, r.wait_s) for r in limit_fill_curve(spark, d).collect()}
    assert sum(n for n, _, _ in got.values()) == 4 * len(ticks)
    assert got.keys() == expected.keys()
    for key, (n, filled, wait) in expected.items():
        assert got[key][0] == n and abs(got[key][1] - filled) < 1e-6 and (got[key][2] is None) == (wait is None) and (wait is None or abs(got[key][2] - wait) < 1e-5)

"""Learners summed up by slices against plain loops; calibration against NumPy; training sets and episodes by hand."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def logged(n=700, seed=1):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.8 else "b", T0 + dt.timedelta(hours=r.randrange(4000)), i, r.choice(["00", "01"]), r.randrange(3), r.uniform(-1, 1), r.random(), None if r.random() < 0.1 else r.random()) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(logged(), "k string, t timestamp_ntz, id long, state string, action int, r double, u double, v double").repartition(5).cache()


def test_tabular_values_match_a_loop(rows):
    from tidewright.operators.agents import tabular_q

    want: dict = {}
    for k, _, _, s, a, r, _, _ in sorted(logged(), key=lambda x: (x[0], x[1], x[2])):
        q, n = want.get((k, s, a), (0.0, 0))
        want[(k, s, a)] = (q + 0.2 * (r - q), n + 1)
    for by in ("day", "month"):
        got = {(x.k, x.state, x.action): (x.q, x.n) for x in tabular_q(rows, 0.2, by).collect()}
        assert got.keys() == want.keys() and all(abs(got[x][0] - want[x][0]) < 1e-9 and got[x][1] == want[x][1] for x in want)


def test_linear_values_match_a_loop(rows):
    from tidewright.operators.agents import linear_q

    want: dict = {}
    for k, _, _, _, a, r, u, v in sorted(logged(), key=lambda x: (x[0], x[1], x[2])):
        x = np.array([1.0, u, v or 0.0])
        w, n = want.get((k, a), (np.zeros(3), 0))
        want[(k, a)] = (w + 0.1 * (r - w @ x) * x, n + 1)
    put = rows.withColumn("one", F.lit(1.0)).withColumnRenamed("action", "arm")
    for by in ("day", "year"):
        got = {(x.k, x.arm): (x.w, x.pulls) for x in linear_q(put, ["one", "u", "v"], 0.1, by).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[x][0], want[x][0], atol=1e-9) and got[x][1] == want[x][1] for x in want)


def test_logit_matches_a_loop(spark, rows):
    from tidewright.operators.agents import binary_logit

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # weights go on from batch to batch
    try:
        put = rows.select("k", "t", "id", F.when(F.col("id") % 9 != 0, (F.col("r") > 0).cast("int")).alias("y"), F.lit(1.0).alias("one"), "u")
        got = {x.id: x.p for x in binary_logit(put, ["one", "u"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held: dict = {}
    for k, _, i, _, _, r, u, _ in sorted(logged(), key=lambda x: (x[0], x[1], x[2])):
        w, n = held.get(k, (np.zeros(2), 0))
        x = np.array([1.0, u])
        p = 1 / (1 + np.exp(-x @ w))
        assert abs(got[i] - p) < 1e-12
        if i % 9:
            held[k] = (w - 0.05 / (1 + n / 400) * ((p - (r > 0)) * x + 1e-4 * w), n + 1)


def test_calibration_matches_newton(spark):
    from tidewright.operators.calibrate import calibration_fit

    r = np.random.Generator(np.random.PCG64(3))
    data = []
    for k, a, b in (("timid", 0.3, 2.0), ("bold", -0.5, 0.4)):
        p = np.round(r.uniform(0.02, 0.98, 3000), 2)
        z = a + b * np.log(p / (1 - p))
        data += [(k, float(x), int(y)) for x, y in zip(p, r.random(3000) < 1 / (1 + np.exp(-z)), strict=True)]
    data += [("one", 0.7, 1), ("one", 0.7, 0), ("edge", 0.0, 0), ("edge", 1.0, 1), ("edge", 0.5, 1), ("edge", 0.4, 0), (None, 0.5, 1), ("none", None, 1), ("none", 0.5, None)]
    got = {x.k: x for x in calibration_fit(spark.createDataFrame(data, "k string, p double, y int").repartition(4)).collect()}
    assert set(got) == {"timid", "bold", "one", "edge"}
    for k in ("timid", "bold"):
        p, y = (np.array(x) for x in zip(*[(p, y) for n, p, y in data if n == k], strict=True))
        x, w = np.log(p / (1 - p)), np.array([0.0, 1.0])
        a = np.stack([np.ones_like(x), x], 1)
        for _ in range(25):
            mu = 1 / (1 + np.exp(-a @ w))
            w = w + np.linalg.solve((a * (mu * (1 - mu))[:, None]).T @ a, a.T @ (y - mu))
        assert abs(got[k].intercept - w[0]) < 1e-6 and abs(got[k].slope - w[1]) < 1e-6 and got[k].n == 3000 and got[k].steps < 10
    assert (got["one"].intercept, got["one"].slope, got["one"].steps) == (0.0, 1.0, 0)
    assert calibration_fit(spark.createDataFrame([], "k string, p double, y int")).count() == 0


def test_embargo_keeps_labels_apart(spark):
    from tidewright.operators.supervised import embargoed, journal_set

    hours = lambda h: T0 + dt.timedelta(hours=h)
    rows = spark.createDataFrame([(hours(0), hours(1)), (hours(7), hours(8)), (hours(7), hours(9)), (hours(9), hours(11)), (hours(10), hours(11)), (hours(12), None), (hours(3), None)], "t timestamp_ntz, label_t timestamp_ntz")
    out = embargoed(rows, F.lit(hours(10)).cast("timestamp_ntz"), "2 hours").collect()
    assert [x.part for x in out] == ["train", "train", None, None, "test", "test", None]
    last = max(x.label_t for x in out if x.part == "train")
    assert all(x.t - last >= dt.timedelta(hours=2) for x in out if x.part == "test")
    trades = spark.createDataFrame([(1.0, {"a": 2.0}), (0.0, {"b": 3.0, "a": None}), (5.0, {}), (5.0, None), (None, {"b": 1.0})], "pnl double, features map<string, double>")
    assert [(x.x, x.y) for x in journal_set(trades, ["a", "b"]).collect()] == [([2.0, 0.0], 1), ([0.0, 3.0], 0), ([0.0, 1.0], 0)]


def test_supervised_rows_know_their_minute_alone(spark):
    from tidewright.operators.supervised import supervised_set

    t, c = T0, T0 + dt.timedelta(minutes=15)
    bets = spark.createDataFrame([("w", t, c, "no", 40.0, 0.3, 7.0, None, True, [0.5, 0.25, 1.0, 0.1]), ("w", t, c, "yes", 40.0, 0.3, 7.0, True, None, None)], "ticker string, t timestamp_ntz, close_t timestamp_ntz, side string, price double, p double, mins_left double, forced boolean, win boolean, path array<double>")
    calls = spark.createDataFrame([("w", t, c, 0.8, 1, 1, 0.6, 30.5, None), ("w", t, c, 0.8, 1, 1, 0.99, 3.0, None), ("w", t, c, 0.8, 1, None, 0.6, 3.0, None), ("w", t, c, 0.8, 0, 0, None, 3.0, None)], "ticker string, t timestamp_ntz, close_t timestamp_ntz, p double, call int, hit int, market double, mins_left double, path array<double>")
    thirds = spark.createDataFrame([("w", t, 7.2, 0.9), ("w", c, 6.9, 0.1), ("v", t, 7.0, 0.9)], "ticker string, t timestamp_ntz, mins_left double, p double")
    real, might = sorted(supervised_set(bets, calls, thirds).collect(), key=lambda x: -x.weight)
    assert real.x == pytest.approx([1, 0.7, 0.4, 0.3, 7 / 15, 0, 0, 0.4, 0.8, 1, -0.5, 0.25, -0.25, -0.5, 1]) and (real.y, real.weight, real.real, real.label_t) == (1, 3.0, True, c)
    assert might.x == pytest.approx([1, 0.8, 0.625, 0.175, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0]) and (might.y, might.weight, might.price) == (1, 1.0, 62.5)


def test_episodes_stay_in_their_day(spark):
    from tidewright.operators.agents import episodes, prediction_reward

    at = [T0 + dt.timedelta(minutes=15 * i) for i in (88, 90, 91, 92, 93, 94, 95, 96, 97, 98, 99, 100, 101)]
    bars = spark.createDataFrame([("a", t, 1.0, 2.0, 0.5, float(i), 1.0) for i, t in enumerate(at)], "k string, t timestamp_ntz, o double, h double, l double, c double, v double")
    got = sorted((x.t, x.horizon, x.price_now, x.price_future, x.target_slot) for x in episodes(bars, {"a": "15 minutes", "b": "30 minutes"}, 2, ("00:45",)).collect())
    first, second = [(i, h) for i in (2, 3, 4, 5) for h in "ab" if i + (1 if h == "a" else 2) <= 6], [(i, h) for i in (9, 10, 11) for h in "ab" if i + (1 if h == "a" else 2) <= 12]
    assert [(t, h) for t, h, *_ in got] == [(at[i], h) for i, h in first + second]
    assert [x[:2] for x in got if x[4]] == [(at[9], "a")] and all(x[3] - x[2] == (1 if x[1] == "a" else 2) for x in got)
    r = spark.createDataFrame([(0.0, 5.0, 1.0), (0.0, 7.5, 0.5), (0.0, 100.0, -1.0)], "p double, a double, want double").withColumn("r", prediction_reward(F.col("p"), F.col("a"), F.lit(5.0)))
    assert all(x.r == x.want for x in r.collect())

"""Learners on data whose answer is known."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tidewright.operators import learning as M

T0 = dt.datetime(2024, 1, 1)


def frame(spark, columns, **kinds):
    n = len(next(iter(columns.values())))
    rows = [("a", T0 + dt.timedelta(minutes=i), *(float(columns[c][i]) if kinds.get(c) != "int" else int(columns[c][i]) for c in columns)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns))


def test_platt_corrects_overconfidence(spark):
    r = np.random.Generator(np.random.PCG64(1))
    true = r.uniform(0.35, 0.65, 600)
    p = 1 / (1 + np.exp(-4 * np.log(true / (1 - true))))
    out = M.online_platt(frame(spark, {"p": p, "y": r.uniform(size=600) < true}, y="int")).toPandas().sort_values("t")
    late = out[100:]
    assert ((late.p_cal - late.y) ** 2).mean() < ((late.p - late.y) ** 2).mean() - 0.01
    assert out.p_cal[:20].to_numpy() == pytest.approx(out.p[:20].to_numpy())


def test_platt_looks_back_only(spark):
    r = np.random.Generator(np.random.PCG64(2))
    p, y = r.uniform(size=80), r.integers(0, 2, 80)
    whole = M.online_platt(frame(spark, {"p": p, "y": y}, y="int")).toPandas().sort_values("t").p_cal.to_numpy()
    part = M.online_platt(frame(spark, {"p": p[:50], "y": y[:50]}, y="int")).toPandas().sort_values("t").p_cal.to_numpy()
    assert whole[:50] == pytest.approx(part)


def test_bandit_finds_the_better_arm(spark):
    r = np.random.Generator(np.random.PCG64(3))
    x = r.normal(size=400)
    out = M.linucb(frame(spark, {"x": x, "reward_0": x, "reward_1": -x}), ["x"], 2).toPandas().sort_values("t")
    assert (out.reward[50:] > 0).mean() > 0.95


def test_quantile_is_covered(spark):
    r = np.random.Generator(np.random.PCG64(4))
    x = r.normal(size=2000)
    got = M.quantile_regression(frame(spark, {"x": x, "c": 3 * x + r.normal(size=2000)}), ["x"], "c", 0.9, steps=2000).first()
    assert got.weights[1] == pytest.approx(3 * x.std(), abs=0.2) and got.weights[0] == pytest.approx(1.28 + 3 * x.mean(), abs=0.2)


def test_logistic_sign_and_weight(spark):
    r = np.random.Generator(np.random.PCG64(5))
    x = r.normal(size=500)
    got = M.weighted_logistic(frame(spark, {"x": x, "y": x > 0, "w": np.ones(500)}), ["x"], "y", "w").first()
    assert got.weights[1] > 1 and abs(got.weights[0]) < 0.5
    assert M.weighted_logistic(frame(spark, {"x": x, "y": x > 0, "w": np.zeros(500)}), ["x"], "y", "w").first().weights == [0.0, 0.0]

"""Journals and the forecast with its paths, by hand and against a loop."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
TRADES = "id string, k string, side string, entry_t timestamp_ntz, exit_t timestamp_ntz, entry_price double, exit_price double, stop_price double, target_price double, pnl double, reason string, features map<string,string>"


def trade(i, k="a", **change):
    base = dict(id=str(i), k=k, side="long", entry_t=T0, exit_t=T0 + dt.timedelta(minutes=90), entry_price=100.0, exit_price=101.0, stop_price=95.0, target_price=110.0, pnl=1.0, reason="target", features={})
    return tuple((base | change).values())


def test_diagnostics(spark):
    from tidewright.operators.journal import diagnostics

    rows = [
        trade(0), trade(1, exit_price=None), trade(2, pnl=-2.0, exit_t=T0 - dt.timedelta(hours=1), features={"fta_reward_risk": "0", "reward_risk": "0.0", "forecast_direction_up": "0.5", "forecast_confidence": "0.7"}),
        trade(3, pnl=5e-9, exit_t=None, stop_price=100.0, reason=None, features={"fta_reward_risk": "3.5", "forecast_direction_up": "0.4", "forecast_confidence": "x"}), trade(4, pnl=None, features=None, target_price=None), trade(5, features={"fta_reward_risk": "x", "forecast_direction_up": "y"}),
    ]
    got = {x.id: (x.outcome, x.holding_hours, x.reward_risk, x.direction, x.confidence, x.reason) for x in diagnostics(spark.createDataFrame(rows, TRADES)).collect()}
    assert got == {
        "0": ("win", 1.5, 2.0, None, None, "target"), "2": ("loss", 0.0, 0.0, "up", 0.7, "target"), "3": ("breakeven", 0.0, 3.5, "down", None, "unknown"), "4": ("breakeven", 1.5, 20.0, None, None, "target"), "5": ("win", 1.5, 2.0, None, None, "target"),
    }


def test_decision_report(spark):
    from tidewright.operators.journal import decision_report

    rows = [trade(0, features={"forecast_confidence": "0.4"}), trade(1, features={"forecast_confidence": "0.8"}, reason="stop"), trade(2, exit_price=None), trade(3, k="b", reason=None)]
    trades = spark.createDataFrame(rows, TRADES)
    refused = spark.createDataFrame([("a", "risk"), ("a", "risk"), ("a", "rr"), ("c", "rr")], "k string, gate string")
    got = {x.k: x for x in decision_report(trades, refused).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.candidates, a.accepted, a.acceptance, a.gates, a.exits) == (6, 3, 0.5, {"risk": 2, "rr": 1}, {"stop": 1, "target": 1}) and a.confidence_mean == pytest.approx(0.6) and a.confidence_std == pytest.approx(statistics.stdev([0.4, 0.8]))
    assert (b.acceptance, b.confidence_mean, b.confidence_std, b.exits, b.gates) == (1.0, 0.0, 0.0, {"unknown": 1}, None) and (c.candidates, c.accepted, c.acceptance, c.exits) == (1, 0, 0.0, None)
    assert decision_report(trades).where("acceptance <> 1").count() == 0


def test_holding_and_places(spark):
    from tidewright.operators.journal import buy_and_hold, comparison, of_era

    bars = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), float(c)) for i, c in enumerate([1, 30, 40, 33])] + [("b", T0, 5.0), ("c", T0, 200.0), ("c", T0 + dt.timedelta(hours=2), 100.0), ("c", T0 + dt.timedelta(hours=3), 1.0)], "k string, t timestamp_ntz, c double")
    got = {x.k: x for x in buy_and_hold(bars, 100.0, 1, 0.01, 0.01).collect()}
    assert set(got) == {"a", "c"} and (got["a"].quantity, got["a"].pnl, got["a"].n_bars, got["a"].win_rate) == (3, pytest.approx(9 - 1.8), 4, 1.0) and (got["c"].quantity, got["c"].profit_factor, got["c"].win_rate) == (1, 0.0, 0.0)
    assert {x.k for x in buy_and_hold(of_era(bars, F.lit(T0 + dt.timedelta(hours=3)).cast("timestamp_ntz")), 100.0).collect()} == {"a", "c"}
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "w", 1.0), ("a", "z", 5.0), ("a", "n", None)], "k string, config string, return_pct double")
    assert [x.config for x in comparison(rows).orderBy("place").collect()] == ["z", "w", "x", "n"]


def test_paths_match_a_loop(spark):
    from tidewright.operators.forecast import forecast_paths

    r, closes = random.Random(3), [100.0]
    for _ in range(60):
        closes.append(closes[-1] * math.exp(r.uniform(-0.02, 0.021)))
    bars = [("a", T0 + dt.timedelta(hours=i), c) for i, c in enumerate(closes)] + [("flat", T0 + dt.timedelta(hours=i), 7.0) for i in range(40)]
    got = {(x.k, x.t): x for x in forecast_paths(spark.createDataFrame(bars, "k string, t timestamp_ntz, c double"), 3, 20, 5).collect()}
    for i in (5, 19, 40, 60):
        x, p = got[("a", T0 + dt.timedelta(hours=i))], closes[max(0, i - 19) : i + 1]
        if len(p) < 20:
            assert (x.expected, x.confidence, x.q10, x.q90) == (0.0, 0.1, [p[-1]] * 3, [p[-1]] * 3)
            continue
        steps = [math.log(b / a) for a, b in zip(p, p[1:], strict=False)]
        e = steps[0]
        for s in steps[1:]:
            e += (s - e) * 2 / 6
        slope = statistics.linear_regression(range(20), [math.log(c) for c in p]).slope
        sd = statistics.pstdev(steps)
        expected = (3 * e + 3 * slope) / 2
        conf = max(0.1, min(0.85, abs(expected) / sd)) * (0.6 if e * slope < 0 else 1)
        assert x.expected == pytest.approx(expected) and x.trend == pytest.approx(3 * slope) and x.confidence == pytest.approx(max(0.1, min(0.85, conf)))
        for name, z in (("q10", -sd), ("q50", 0), ("q90", sd)):
            assert x[name] == pytest.approx([p[-1] * math.exp((e + z) * j) for j in (1, 2, 3)])
    flat = got[("flat", T0 + dt.timedelta(hours=39))]
    assert (flat.expected, flat.confidence, flat.q90) == (pytest.approx(0.0, abs=1e-12), 0.1, [7.0] * 3)

"""Execution ledgers, splits, sensitivity, the one bet and grid verdicts, by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def at(minutes, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


@pytest.fixture(scope="module")
def path(spark):
    rows = [("w", at(m), p, b) for m, p, b in ((0, 0.5, 100.0), (1, 0.6, 101.0), (2, 0.4, 99.0), (4, 0.7, None), (9, 0.9, 90.0))]
    return spark.createDataFrame([*rows, ("w", None, 0.1, 1.0), ("w", at(3), None, 1.0), ("v", at(0), 0.5, 1.0)], "ticker string, t timestamp_ntz, p double, base double").repartition(3)


def test_ledger_rows(spark, path):
    from tidewright.operators.execution import execution_ledger

    order = lambda i, ticker, t, side="yes", win=1, skipped=None: (ticker, t, i, side, 65.0, 650.0, 350.0 if win else -650.0, win, skipped)
    rows = [order(1, "w", at(1, 30)), order(2, "w", at(1, 30), "no", 0), order(3, "none", at(1)), order(4, "w", at(8)), order(5, "w", at(1), win=None), order(6, "w", at(1), skipped=True), order(7, "w", at(2, 30)), order(7, "w", at(2, 30))]
    orders = spark.createDataFrame(rows, "ticker string, t timestamp_ntz, id long, side string, ask_c double, stake_c double, pnl_c double, win int, skipped boolean")
    got = {}
    for x in execution_ledger(orders, path, {"1m": 60, "3m": 180, "5m": 300}, {"1m": 60, "3m": 180}).collect():
        got.setdefault(x.id, []).append(x)
    assert sorted(got) == [1, 2, 3, 4, 7] and len(got[7]) == 2
    x = got[1][0]
    assert (x.quote_age_s, x.market, x.modelled_ask, x.slippage, x.missing) == (30.0, 0.6, 62.5, 2.5, None)
    assert x.mark_1m == pytest.approx(-20.0) and x.mark_3m == pytest.approx(10.0) and x.mark_5m is None and x.price_1m == -2.0 and x.price_3m is None and x.ev == pytest.approx(350 / 650)
    y = got[2][0]
    assert y.modelled_ask == pytest.approx(42.5) and y.mark_1m == pytest.approx(20.0) and y.ev == -1.0
    assert (got[3][0].missing, got[3][0].market) == ("no_path", None) and got[4][0].missing == "no_recent_quote"


def test_splits_cover_all_rows(spark):
    from tidewright.operators.execution import bands, split_stats

    rows = spark.createDataFrame([("yes", 0.6, 39.0, 7.0, 1.0), ("no", 0.8, 40.0, 8.0, 2.0), (None, 0.9, 61.0, 11.0, None), ("no", None, None, None, 4.0)], "side string, p double, ask_c double, mins_left double, v double")
    got = {(x.split, x.part): (x.orders, x.v_n, x.v_mean, x.v_median, x.v_p10) for x in split_stats(bands(rows), ["side", "conf_band", "price_band", "mins_band"], ["v"]).collect()}
    assert got[("all", "all")] == (4, 3, pytest.approx(7 / 3), 2.0, pytest.approx(1.2)) and got[("side", "unknown")] == (1, 0, None, None, None) and got[("side", "no")][:3] == (2, 2, 3.0)
    assert {k[1] for k in got if k[0] == "conf_band"} == {"<0.7", "0.7-0.8", ">0.8", "unknown"} and {k[1] for k in got if k[0] == "price_band"} == {"<40c", "40-60c", ">60c", "unknown"} and {k[1] for k in got if k[0] == "mins_band"} == {"<8m", "8-11m", ">=11m", "unknown"}
    assert all(sum(v[0] for (s, _), v in got.items() if s == k) == 4 for k in ("side", "conf_band", "price_band", "mins_band"))


def test_sensitivity(spark, path):
    from tidewright.operators.execution import sensitivity

    decisions = spark.createDataFrame([("w", at(1, 10), 1, "yes", 1), ("w", at(8), 2, "yes", 1), ("none", at(1), 3, "yes", 1)], "ticker string, t timestamp_ntz, id long, side string, win int")
    got = {(x.model, x.delta): x for x in sensitivity(decisions, path, [0, 1, 2, 3], 2.0, unfilled=0.0).collect()}
    ev = lambda ask: (100 - ask - 7 * ask / 100 * (1 - ask / 100)) / ask
    assert got[("plain", 0)].ev == pytest.approx(ev(62.5)) and got[("slipped", 0)].ev == pytest.approx(ev(64.5)) and got[("stressed", 0)].ev == pytest.approx(ev(65.0)) and got[("mid", 0)].ev == pytest.approx(ev(60.0))
    assert got[("stale", 1)].ev == pytest.approx(ev(52.5)) and got[("delay", 1)].ev == pytest.approx(ev(42.5)) and got[("delay", 3)].ev == pytest.approx(ev(72.5))
    assert (got[("delay", 2)].n, got[("delay", 2)].excluded, got[("stale", 2)].ev) == (0, 1, None)
    assert [k for k, x in got.items() if x.crossing] == [("delay", 3)]
    assert sensitivity(decisions, path, [0], 0.0, unfilled=1.0).where("model = 'stressed'").first().n == 0


def test_one_bet(spark):
    from tidewright.operators.execution import one_bet

    minute = lambda k, i, left, p, bid, ask: (k, at(i), i, float(left), p, bid, ask)
    rows = [
        minute("edge", 0, 800, 0.5, 50.0, 54.0), minute("edge", 1, 700, 0.6, 50.0, 57.0), minute("edge", 2, 600, 0.9, 50.0, 54.0), minute("door", 0, 800, 0.7, 70.0, 74.0), minute("door", 1, 700, 0.7, 72.0, 76.0),
        minute("force", 0, 800, 0.5, 50.0, 60.0), minute("force", 1, 180, 0.4, 50.0, 60.0), minute("other", 0, 100, 0.95, 96.0, 98.0), minute("out", 0, 800, 0.95, 96.0, 98.0), minute("late", 0, 59, 0.9, 10.0, 12.0), minute("none", 0, 800, None, 10.0, 12.0), minute("none", 1, 800, 0.9, None, 12.0),
    ]
    got = {x.k: (x.id, x.side, x.price_c, round(x.edge_c, 6), x.forced) for x in one_bet(spark.createDataFrame(rows, "k string, t timestamp_ntz, id long, seconds_left double, p double, yes_bid double, yes_ask double")).collect()}
    assert got == {"edge": (1, "yes", 57.0, 3.0, False), "door": (1, "yes", 76.0, -6.0, False), "force": (1, "no", 50.0, 10.0, False), "other": (0, "no", 4.0, 1.0, True)}


def test_grid_verdicts(spark):
    from tidewright.operators.execution import grid_verdicts, noise_floor

    rows = [("a", 1.0, 100, 30, 0.5, 2.0, -1.0), ("a", 2.0, 100, 10, 0.5, 2.0, -1.0), ("a", 3.0, 100, 5, 0.5, 2.0, -1.0), ("a", 4.0, 100, 0, None, None, None), ("b", 1.0, 100, 0, None, None, None), ("b", 2.0, 100, 1, 1.0, 5.0, None), ("c", 1.0, 0, 0, None, None, None)]
    out = grid_verdicts(spark.createDataFrame(rows, "k string, setting double, n_bars long, n_trades long, win_rate double, avg_gain double, avg_loss double")).collect()
    assert {(x.k, x.setting, x.reason) for x in out if x.recommended} == {("a", 2.0, "good_verdict_best_expectancy"), ("b", 2.0, "no_good_verdict_least_restrictive")}
    assert {x.verdict for x in out if x.k == "a"} == {"too_many", "good", "too_few"} and {x.reason for x in out if x.k == "c"} == {"no_trades_all_thresholds"}
    bars = spark.createDataFrame([("a", at(i), float((i * i) % 5)) for i in range(40)], "k string, t timestamp_ntz, c double")
    x = noise_floor(bars, {"1m": "1 minute"}, 30).first()
    moves = [((i + 1) ** 2) % 5 - (i * i) % 5 for i in range(39)]
    assert x.n == 39 and x.floor == pytest.approx(sum(map(abs, moves)) / 39) and x.up == pytest.approx(sum(m > 0 for m in moves) / 39)
    assert noise_floor(bars.where(F.col("c") < 0), {"1m": "1 minute"}).count() == 0

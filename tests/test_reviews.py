"""Reviews against plain loops."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def test_bands_match_a_loop(spark):
    from tidewright.operators.reviews import scaled_band

    r = random.Random(4)
    rows = [(k, T0 + dt.timedelta(minutes=i), r.uniform(90, 110), r.uniform(90, 110) if r.random() > 0.1 else None, r.choice([None, 0.0, 0.2, 1.0, 1.5, 6.0])) for k in ("a", None) for i in range(90)]
    got = {(x.k, x.t): (x.lo, x.hi) for x in scaled_band(spark.createDataFrame(rows, "k string, t timestamp_ntz, pred double, actual double, sigma double").repartition(3), 30, 10).collect()}
    assert len(got) == len(rows)
    for k in ("a", None):
        past = []
        for _, t, pred, actual, sigma in (x for x in rows if x[0] == k):
            v = past[-30:]
            want = (None, None)
            if len(v) >= 10:
                zs, ss = sorted(z for z, _ in v), sorted(s for _, s in v)
                scale = max(sigma or ss[len(ss) // 2], 0.6 * ss[len(ss) // 2])
                want = math.floor(zs[int(0.1 * len(zs))] * scale), math.ceil(zs[min(len(zs) - 1, int(0.9 * len(zs)))] * scale)
            assert got[(k, t)] == want
            if actual is not None and sigma:
                past.append(((actual - pred) / sigma, sigma))


def test_frontier_matches_a_sweep(spark):
    from tidewright.operators.reviews import economic_frontier, entry_economics

    r = random.Random(5)
    rows = [(k, r.random(), r.choice([0.0, 0.3, 0.5, 0.8, 1.0]), r.randint(0, 1)) for k in ("a", "b") for _ in range(150)] + [("c", None, 0.5, 1), ("c", 0.9, None, 1), ("c", 0.9, 0.5, None)]
    entries = entry_economics(spark.createDataFrame(rows, "k string, p double, market double, y int"))
    steps = [-5.0, 0.0, 5.0, 10.0, 200.0]
    got = {(x.k, x.threshold): x for x in economic_frontier(entries, steps, 0.6).collect()}
    for k in ("a", "b"):
        every = []
        for _, p, m, y in (x for x in rows if x[0] == k):
            yes = p >= 0.5
            price = min(99.0, max(1.0, 100 * (m if yes else 1 - m)))
            cost = price + 7 * price / 100 * (1 - price / 100)
            every.append((100 * (p if yes else 1 - p) - price, 100 - cost if (y == 1) == yes else -cost, cost))
        good = [g for _, g, _ in every if g > 0]
        feasible = []
        for s in steps:
            entered = [x for x in every if x[0] >= s]
            if not entered:
                assert (k, s) not in got
                continue
            won = [g for _, g, _ in entered if g > 0]
            x = got[(k, s)]
            assert (x.n, x.coverage, x.recall) == (len(entered), len(entered) / len(every), len(won) / len(good))
            assert x.bad == pytest.approx(1 - len(won) / len(entered)) and x.captured_c == pytest.approx(sum(won)) and x.missed_c == pytest.approx(sum(good) - sum(won), abs=1e-9)
            mean = 100 * sum(g / c for _, g, c in entered) / len(entered)
            assert x.gain_per_100 == pytest.approx(mean) and x.feasible == (x.bad <= 0.6 and mean > 0)
            if x.feasible:
                feasible.append((-x.recall, s))
        assert [s for s in steps if (k, s) in got and got[(k, s)].operating] == ([min(feasible)[1]] if feasible else [])
    assert not [x for x in got if x[0] == "c"]


def test_phases_have_defaults(spark):
    from tidewright.operators.reviews import phase_weights

    t = lambda i: T0 + dt.timedelta(minutes=i)
    calls = [("a", t(i), i, 12.0, 0.5 + 0.01 * (i % 7), 0.5, int(i % 7 > 3)) for i in range(40)] + [("a", t(99), 99, 7.0, 0.9, 0.5, 1), ("b", t(1), 1, 3.0, 0.9, None, 1), ("b", t(2), 2, 3.0, 0.9, 0.5, None)]
    calls = spark.createDataFrame(calls, "k string, t timestamp_ntz, id long, mins_left double, p double, market double, y int")
    got = {(x.k, x.phase): (x.weight, x.n) for x in phase_weights(calls, "market", 20, 10, 1.0, 0.5).collect()}
    assert got == {("a", "early"): (1.0, 20), ("a", "mid"): (0.5, 1), ("a", "late"): (0.5, 0), ("b", "early"): (0.5, 0), ("b", "mid"): (0.5, 0), ("b", "late"): (0.5, 0)}
    own = {(x.k, x.phase): (x.weight, x.n) for x in phase_weights(calls, None, 400, 1, 1.2, 1.0).collect()}
    assert own[("a", "early")] == (1.2, 40) and own[("b", "late")][1] == 1 and own[("b", "late")][0] == pytest.approx(1.2)


def test_failures(spark):
    from tidewright.operators.reviews import FAILURES, bet_alignment, failure_clusters, failure_tags

    base = dict(side="yes", p=0.55, price_c=50.0, mins_left=9.0, edge_c=1.0, forced=False, market=0.5)
    cases = [
        (dict(p=0.4, edge_c=-1.0), ["SIGN_INVERSION"], "INVALID"), (dict(p=0.4, edge_c=-1.0, forced=True), ["UNCLASSIFIED"], "EXPLICIT_OVERRIDE"), (dict(p=0.4), ["UNCLASSIFIED"], "CONVENTION_NORMALIZED"),
        (dict(market=0.38, p=0.7, price_c=70.0, mins_left=2.0), ["MARKET_KNEW", "CONFIDENTLY_WRONG", "EXPENSIVE_LOSER", "LATE_ENTRY"], "ALIGNED"), (dict(), ["THIN_EDGE_LOST"], "ALIGNED"),
        (dict(side="no", p=0.3, market=0.62), ["MARKET_KNEW", "CONFIDENTLY_WRONG"], "ALIGNED"), (dict(p=None, price_c=None, mins_left=None, edge_c=None, forced=None, market=None), ["THIN_EDGE_LOST"], "ALIGNED"),
    ]
    rows = [("a", T0 + dt.timedelta(minutes=i), i, -1.0 - i, *(base | c).values()) for i, (c, _, _) in enumerate(cases)] + [("a", T0, 99, 5.0, *base.values())]
    bets = spark.createDataFrame(rows, "k string, t timestamp_ntz, id long, pnl_c double, side string, p double, price_c double, mins_left double, edge_c double, forced boolean, market double")
    every, first = failure_tags()
    got = bets.where("pnl_c < 0").orderBy("id").select(every.alias("e"), first.alias("f"), bet_alignment().alias("a")).collect()
    assert [(x.e, x.f, x.a) for x in got] == [(tags, tags[0], a) for _, tags, a in cases] and set(FAILURES) >= {t for _, tags, _ in cases for t in tags}
    last = {x.reason: (x.n, x.invalid) for x in failure_clusters(bets, 3).collect()}
    assert last == {"THIN_EDGE_LOST": (2, 0), "MARKET_KNEW": (1, 0)}
    assert failure_clusters(bets, 100).where("invalid > 0").count() == 1


def test_trailing_scores(spark):
    from tidewright.operators.reviews import trailing_binary, trailing_scores

    now, t = F.lit(T0 + dt.timedelta(hours=6)).cast("timestamp_ntz"), lambda h: T0 + dt.timedelta(hours=h)
    rows = [("a", 5, t(1), 100.0, 102.0, 103.0, 101.0, 104.0), ("a", 5, t(2), 100.0, 99.0, 101.0, None, None), ("a", 5, t(0), 100.0, 100.0, 100.0, 0.0, 1.0), ("a", 5, t(-1), 0.0, 9.0, 9.0, None, None), ("a", 5, t(3), 1.0, 1.0, None, None, None), ("b", 5, t(1), 1.0, 1.0, 1.0, None, None)]
    x = trailing_scores(spark.createDataFrame(rows, "arm string, horizon int, t timestamp_ntz, price_now double, pred double, actual double, lo double, hi double"), now, 6, 2).collect()
    assert len(x) == 1 and (x[0].n, x[0].mse, x[0].mae, x[0].dir, x[0].cov, x[0].sharp) == (3, pytest.approx(5 / 3), 1.0, 0.5, 0.5, 2.0)
    assert x[0].msse == pytest.approx((5 / 3) / (10 / 3)) and x[0].mase == pytest.approx(1 / (4 / 3)) and x[0].rmse == pytest.approx(math.sqrt(5 / 3))
    b = trailing_binary(spark.createDataFrame([("a", t(1), 0.8, 0.6, 1), ("a", t(2), 0.4, None, 1), ("a", t(-1), 0.4, 0.5, 1)], "k string, t timestamp_ntz, p double, market double, y int"), now).first()
    assert (b.n, b.acc) == (2, 0.5) and b.brier == pytest.approx(0.2) and b.market_brier == pytest.approx(0.16) and b.skill_market == pytest.approx(-0.25) and b.skill_coin == pytest.approx(0.2)

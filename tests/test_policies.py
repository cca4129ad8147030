"""Policies and their pairing, by hand."""

from __future__ import annotations

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, t timestamp_ntz, p double, y int, ask_yes double, ask_no double, ask_paid double, market double, regime double, p_cal double, p_shared double, p_earner double, later array<struct<yes: double, no: double>>"
BASE = dict(k="a", t=T0, p=0.7, y=1, ask_yes=60.0, ask_no=45.0, ask_paid=62.0, market=0.65, regime=0.7, p_cal=0.4, p_shared=0.3, p_earner=0.9, later=[(59.0, 46.0), (4.0, 96.0), (57.5, 47.5), (50.0, 55.0)])


def won(ask):
    cost = ask + math.ceil(round(7 * ask / 100 * (1 - ask / 100), 9))
    return (100 - cost) / cost


def evs(spark, **change):
    from tidewright.operators.policies import policy_evs

    row = BASE | change
    got = {x.policy: x.ev for x in policy_evs(spark.createDataFrame([tuple(row[n.split()[0].split(":")[0]] for n in ("k", "t", "p", "y", "ask_yes", "ask_no", "ask_paid", "market", "regime", "p_cal", "p_shared", "p_earner", "later"))], SCHEMA)).collect()}
    return {n: None if v is None else round(v, 9) for n, v in got.items()}


def test_each_policy(spark):
    from tidewright.operators.policies import POLICIES

    w = {a: round(won(a), 9) for a in (60.0, 62.0, 57.5, 45.0)}
    got = evs(spark)
    assert list(got) == list(POLICIES)
    assert got == dict(champion=w[60.0], regime=w[60.0], knife=w[60.0], calibrated=None, cheap=None, both=w[60.0], shared=-1.0, shared_regime=-1.0, champion_paid=w[62.0], guard=w[62.0], guard_regime=w[62.0], limit=w[57.5], limit_regime=w[57.5], earner=w[60.0], edge_band=w[60.0])
    bad = evs(spark, regime=0.5, market=0.55, ask_paid=63.5, p_cal=0.3, p=0.95, later=None)
    assert bad == dict(champion=w[60.0], regime=None, knife=None, calibrated=-1.0, cheap=None, both=None, shared=-1.0, shared_regime=None, champion_paid=round(won(63.5), 9), guard=None, guard_regime=None, limit=None, limit_regime=None, earner=w[60.0], edge_band=None)
    no = evs(spark, p=0.3, y=0, regime=None, market=None, ask_paid=None, p_cal=None, p_shared=None, p_earner=None, later=[])
    assert no["champion"] == no["cheap"] == no["regime"] == no["knife"] == no["both"] == w[45.0] and no["calibrated"] is no["shared"] is no["earner"] is no["limit"] is no["champion_paid"] is None
    assert set(evs(spark, y=None).values()) == {None}


def test_pairs(spark):
    from tidewright.operators.policies import paired_review, paired_slices

    pairs = [(0.5, 0.1), (None, -1.0), (None, 0.4), (0.2, None), (None, None), (-1.0, -1.0), (0.3, 0.0)]
    d = [(a or 0.0) - (b or 0.0) for a, b in pairs]
    rows = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), a, b, "x" if i % 2 else None, i % 2) for i, (a, b) in enumerate(pairs)] + [("one", T0, 0.1, 0.0, None, 1), ("same", T0, 0.1, 0.1, None, 1), ("same", T0, 0.1, 0.1, None, 1)], "k string, t timestamp_ntz, ev double, base double, x string, z int")
    got = {x.k: x for x in paired_review(rows).collect()}
    x, n = got["a"], len(d)
    se = statistics.stdev(d) / n**0.5
    law = statistics.NormalDist()
    assert x.mean == pytest.approx(sum(d) / n) and x.se == pytest.approx(se) and x.median == pytest.approx(statistics.median(d))
    assert x.p_above == pytest.approx(law.cdf(x.mean / se), abs=1e-6) and x.power == pytest.approx(law.cdf(0.02 / se - law.inv_cdf(0.95)), abs=1e-6) and x.mde == pytest.approx((law.inv_cdf(0.95) + law.inv_cdf(0.8)) * se)
    assert x.top3 == pytest.approx(sum(sorted(map(abs, d))[-3:]) / sum(map(abs, d)))
    assert (x.n, x.together, x.alone, x.skips, x.losses_avoided, x.gains_forgone) == (7, 3, 1, 2, 1, 1) and x.base_on_skips == pytest.approx(-0.6) and x.veto_per_window == pytest.approx(0.6 / 7)
    assert (got["one"].se, got["one"].p_above, got["same"].se, got["same"].top3) == (None, None, None, None)
    parts = {(s.slice, s.part): (s.n, s.mean) for s in paired_slices(rows.where("k = 'a'"), ["x", "z"]).collect()}
    assert set(parts) == {("x", "x"), ("z", "0"), ("z", "1")} and parts[("x", "x")] == parts[("z", "1")] and parts[("z", "0")][0] == 4


def test_kelly(spark):
    from tidewright.operators.policies import kelly_contracts

    rows = spark.createDataFrame([(0.8, 60.0, 2.0, 100_000, 1_000_000), (0.8, 60.0, 2.0, 100_000, 500), (0.71, 60.0, 2.0, 100_000, 10**6), (0.9, 60.0, 2.0, 50, 10**6), (None, 60.0, 2.0, 10, 10)], "p double, a double, f double, b long, d long").coalesce(1)
    got = [tuple(x[0]) for x in rows.select(kelly_contracts(*(F.col(c) for c in ("p", "a", "f", "b", "d")))).collect()]
    n = math.floor(math.floor(0.10 * 100_000) / 62)
    assert got == [(n, n * 60 + math.ceil(7 * n * 0.24)), (8, 480 + math.ceil(7 * 8 * 0.24)), (0, 0), (0, 0), (0, 0)]

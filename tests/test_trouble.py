"""The scoring of candidates, by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

BASE = dict(side="long", entry=150.0, stop=145.0, expected=0.10, above=162.0, below=140.0, trend="uptrend", strength=0.8, last_break="bullish", relative_volume=1.5, spread_estimate=0.01, atr=2.0, regime="normal")
SCHEMA = "side string, entry double, stop double, expected double, above double, below double, trend string, strength double, last_break string, relative_volume double, spread_estimate double, atr double, regime string"


def scored(spark, *changes):
    from tidewright.operators.structure import trouble_score

    rows = [tuple((BASE | c)[n.split()[0]] for n in SCHEMA.split(", ")) for c in changes]
    return trouble_score(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()


def test_a_sound_long_candidate(spark):
    (x,) = scored(spark, {})
    assert (x.trouble, x.reward_risk, x.cleared, x.volatility_ok, x.reasons, x.accepted) == (162.0, 3.0, True, True, [], True)
    assert x.distance == pytest.approx(0.08) and x.structure_score == pytest.approx(0.5 + 0.24 + 0.04) and x.liquidity_score == 0.75
    assert x.score == pytest.approx(0.35 * 0.75 + 0.25 + 0.2 * 0.78 + 0.15 * 0.75 + 0.05)


def test_a_sound_short_candidate(spark):
    short = dict(side="short", stop=155.0, expected=-0.10, trend="downtrend", last_break="bearish")
    x, far, wrong = scored(spark, short, short | dict(below=None), short | dict(expected=0.1))
    assert (x.trouble, x.reward_risk, x.accepted) == (140.0, 3.0, True) and x.distance == pytest.approx(10 / 150)
    assert far.trouble == 135.0 and far.reasons == ["FTA_NOT_CLEARED"]
    assert "FTA_NOT_CLEARED" in wrong.reasons  # the forecast points the other way


def test_every_reason_alone_and_all_at_once(spark):
    changes = {
        "REWARD_RISK_BELOW_THRESHOLD": dict(stop=130.0), "FTA_NOT_CLEARED": dict(above=170.0), "WEAK_STRUCTURE": dict(trend="downtrend", strength=0.9, last_break="bearish"), "POOR_LIQUIDITY": dict(relative_volume=0.4),
        "UNSUITABLE_VOLATILITY": dict(regime="extreme"), "INSUFFICIENT_FTA_DISTANCE": dict(above=150.5),
    }
    got = scored(spark, *changes.values(), dict(stop=30.0, above=150.1, expected=-0.1, trend="downtrend", strength=0.0, last_break="bearish", relative_volume=0.0, atr=9.0))
    for name, x in zip(changes, got, strict=False):
        assert x.reasons == [name] and not x.accepted
    assert got[-1].reasons == list(changes)


def test_edges(spark):
    none, wide, calm, high, same, nothing = scored(spark, dict(above=None, last_break=None), dict(spread_estimate=0.11), dict(atr=7.5, regime="low", spread_estimate=0.0), dict(regime="high"), dict(stop=150.0), dict(relative_volume=None, strength=None, trend="unknown"))
    assert none.trouble == pytest.approx(165.0) and none.structure_score == pytest.approx(0.74)
    assert wide.liquidity_score == pytest.approx(0.75 * 0.7) and calm.volatility_ok and not high.volatility_ok
    assert same.reward_risk == 0.0 and nothing.liquidity_score == 0.0 and nothing.structure_score == pytest.approx(0.14)


def test_probability(spark):
    from tidewright.operators.structure import probability

    rows = spark.createDataFrame([(0.5, 2.0, 0.8, 1.0, "normal"), (1.0, 9.0, 1.0, 9.0, "low"), (0.0, 0.0, 0.0, 0.0, "extreme"), (0.5, 2.0, 0.8, 1.0, "other")], "c double, rr double, s double, v double, r string").coalesce(1)
    got = [x[0] for x in rows.select(probability(F.col("c"), F.col("rr"), F.col("s"), F.col("v"), F.col("r"))).collect()]
    assert got == pytest.approx([0.175 + 0.125 + 0.16 + 0.05 + 0.1 * 2 / 3, 1.0, 0.0, 0.175 + 0.125 + 0.16 + 0.05 + 0.1 * 2 / 3])

"""Prices of zero, and halves in rounding."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def test_zones_at_a_price_of_zero(spark):
    from tidewright.operators.asof import touching
    from tidewright.operators.folds import price_zones

    points = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("a", 5.0), ("a", 5.005)], "k string, p double")
    got = sorted((x.mid, x.n) for x in price_zones(points, "p").collect())
    assert got[:2] == [(0.0, 1), (0.0, 1)] and [n for _, n in got[2:]] == [2]
    bars = spark.createDataFrame([("a", 1.0, 0.0), ("a", 0.0, 0.0)], "k string, h double, l double")
    zones = spark.createDataFrame([("a", 0.0), ("a", 0.0)], "k string, mid double")
    assert [(x.touches, x.strength) for x in touching(zones, bars, 0.002).collect()] == [(2, 2.0)] * 2


def test_halves_are_rounded_as_in_sql(spark):
    import duckdb

    from tidewright.plans.shaping import rounded

    values = [333.905425, 406.865265, 65.9937715, -0.0000005, 2.5, -1.0049995, 0.0, float("inf"), float("-inf")]
    for places in (4, 5, 6):
        got = [x[0] for x in rounded(spark.createDataFrame([(v,) for v in values], "x double"), places).collect()]
        want = [duckdb.execute("SELECT round(?::DOUBLE, ?) + 0.0", [v, places]).fetchall()[0][0] for v in values]
        assert got == want
    assert math.isnan(rounded(spark.createDataFrame([(float("nan"),)], "x double")).collect()[0][0])

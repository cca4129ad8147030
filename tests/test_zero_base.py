"""Changes of an outside series on a value of zero."""

from __future__ import annotations

import datetime as dt
import math


def test_change_on_a_value_of_zero(spark):
    from tidewright.operators.bitemporal import exogenous

    at = lambda m: dt.datetime(2024, 3, 1) + dt.timedelta(minutes=m)
    series = spark.createDataFrame([(k, at(e), at(e), v) for k, e, v in (("up", 0, 0.0), ("up", 60, 4.0), ("still", 0, 0.0), ("still", 60, 0.0))], "k string, t timestamp_ntz, received timestamp_ntz, value double")
    asked = spark.createDataFrame([(k, at(90)) for k in ("up", "still", "none")], "k string, t timestamp_ntz")
    got = {x.k: x.x_ret_a for x in exogenous(asked, series, {"a": "30 minutes"}, infinite=True).collect()}
    assert got["up"] == math.inf and math.isnan(got["still"]) and got["none"] is None
    assert all(x.x_ret_a is None for x in exogenous(asked, series, {"a": "30 minutes"}).collect())

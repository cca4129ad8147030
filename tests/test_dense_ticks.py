"""Spans of dense ticks against a plain count, and the frames that they are read by."""

from __future__ import annotations

import datetime as dt
import math
import random

T0 = dt.datetime(2024, 1, 1)


def test_order_flow(spark):
    from tidewright.operators.windows import order_flow

    r = random.Random(4)
    rows = [(r.choice("ab"), T0 + dt.timedelta(seconds=r.randrange(0, 9000)), i, r.choice([1.0, 2.5, 95.0, None]), r.random() < 0.5) for i in range(500)]
    rows += [("odd", T0 + dt.timedelta(seconds=s), s, v, True) for s, v in ((0, float("nan")), (10, 1.0), (120, 3.0), (5000, float("inf")), (5100, 2.0))] + [("none", None, 1, 4.0, True), ("none", T0, 2, 0.0, False)]
    df = order_flow(spark.createDataFrame(rows, "k string, t timestamp_ntz, id long, size double, taker_buy boolean").repartition(3), (60, 900))
    got = {(x.k, x.id): x for x in df.collect()}
    assert len(got) == len(rows)
    for k, t, i, _, _ in rows:
        for s in (60, 900):
            near = [x for x in rows if x[0] == k and ((t is None and x[1] is None) or (t and x[1] and t - dt.timedelta(seconds=s) <= x[1] <= t))]
            sizes = [x[3] or 0.0 for x in near]
            x = got[k, i]
            assert (x[f"trades_{s}"], x[f"whales_{s}"]) == (len(near), sum(v >= 90 or v != v for v in sizes))
            if all(map(math.isfinite, sizes)):
                buys = sum(v for v, y in zip(sizes, near, strict=True) if y[4])
                assert math.isclose(x[f"imbalance_{s}"], (2 * buys - sum(sizes)) / sum(sizes) if sum(sizes) else 0.0, abs_tol=1e-9)
            else:
                assert math.isnan(x[f"imbalance_{s}"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, -" not in plan and "_block" in plan  # no frame that slides


def test_excursions_read_no_shrinking_frame(spark):
    from tidewright.operators.live import excursions

    row = lambda t, left, p, ask: ("a", T0, T0 + dt.timedelta(minutes=t), t, left, p, ask - 1.0, ask, 1)
    path = spark.createDataFrame([row(1, 300.0, 0.8, 70.0), row(2, 299.0, 0.8, 45.0), row(3, 298.0, 0.2, 60.0)], "k string, w timestamp_ntz, t timestamp_ntz, id long, left double, p double, bid double, ask double, y int")
    df = excursions(path, (120.0, 420.0), ([0.75], ["low", "high"]))
    got = df.collect()
    assert [(x.band, x.n, x.entry_ask, x.least_later_ask, x.fell_20) for x in got] == [("high", 1, 70.0, 45.0, 1.0)]
    assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()

"""As-of joins by receipt against a plain search of all rows."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import numpy as np

START = dt.datetime(2024, 3, 1)


def minutes(x):
    return None if x is None else START + dt.timedelta(minutes=x)


def plain(t, rows, age, horizons, steps):
    """Features from a scan of all rows (event, received, value) of a key."""
    known = {}
    for e, r, v in sorted((x for x in rows if None not in x and x[1] <= t and t - age <= x[0] <= t), key=lambda x: (x[0], x[1], x[2])):
        known[e] = v  # of revisions the last received
    e = sorted(known, reverse=True)
    if len(e) < 2:
        return None
    v = [known[x] for x in e]
    pct = lambda a, b: 100 * (a - b) / b if b else None
    past = [next((known[x] for x in e if x <= e[0] - h), v[0]) for h in horizons]
    steps_ = [p for p in (pct(a, b) for a, b in zip(v, v[1:], strict=False)) if p is not None] if len(v) <= steps else [p for p in (pct(v[i], v[i + 1]) for i in range(steps)) if p is not None]
    return [minutes(e[0]), t - e[0], v[0], v[0] - v[1], *(pct(v[0], p) for p in past), statistics.stdev(steps_) if len(steps_) > 1 else None]


def near(a, b):
    return len(a) == len(b) and all(x == y or (isinstance(x, float) and isinstance(y, float | int) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b, strict=True))


def test_features_match_a_scan(spark):
    from tidewright.operators.bitemporal import exogenous

    r = random.Random(7)
    series, asked = [], []
    for k in ("hot", "b", None):
        for _ in range(900 if k == "hot" else 80):
            e = r.randrange(0, 20_000)
            series.append((k, e, e + r.choice([0, 1, 5, 300, 2000, -3]), float(r.choice([0, 1, 2, 3, 5, 8]))))
            if r.random() < 0.2:
                series.append((k, e, e + r.randrange(0, 4000), float(r.randrange(1, 9))))
    series += [("b", None, 5, 1.0), ("b", 5, None, 1.0), ("b", 6, 6, None)]
    for i in range(600):
        asked.append((r.choice(["hot", "hot", "b", "none", None]), r.randrange(-100, 26_000) if r.random() > 0.02 else None, i))
    asked += asked[:3]
    left = spark.createDataFrame([(k, minutes(t), i, "clash") for k, t, i in asked], "k string, t timestamp_ntz, id long, value string").repartition(3)
    right = spark.createDataFrame([(k, minutes(e), minutes(x), v) for k, e, x, v in series], "k string, t timestamp_ntz, received timestamp_ntz, value double").repartition(4)
    for piece in ("3 days", "60 days"):
        out = exogenous(left, right, {"a": "90 minutes", "b": "1 day"}, max_age="2 days", piece=piece, steps=4)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        got = {}
        for x in out.collect():
            got.setdefault((x.id, x.k), []).append(x)
        assert sum(map(len, got.values())) == len(asked)
        for k, t, i in asked:
            want = plain(t, [x[1:] for x in series if x[0] == k], 2880, (90, 1440), 4) if t is not None and k is not None else None
            for x in got[(i, k)]:
                assert x.x_present == (want is not None)
                have = [x.x_t, x.x_staleness_min, x.x_value, x.x_change, x.x_ret_a, x.x_ret_b, x.x_vol]
                assert near(have, want) if want else have == [None] * 7
    assert exogenous(left.limit(0), right, {}).count() == 0
    assert exogenous(left, right.limit(0), {}).where("x_present").count() == 0


def test_last_received_passes_over_any_number_of_rows():
    from tidewright.operators.bitemporal import Received

    r = np.random.Generator(np.random.PCG64(1))
    for n in (1, 2, 7, 64, 200):
        got = r.integers(0, 20, n)
        held = Received(np.arange(n), got, np.zeros(n))
        place, by = r.integers(-1, n, 300), r.integers(-1, 21, 300)
        want = [max((i for i in range(p + 1) if got[i] <= b), default=-1) for p, b in zip(place, by, strict=True)]
        assert held.last(place, by).tolist() == want

"""Zones, votes and the inventory."""

from __future__ import annotations

import datetime as dt
import random

import pytest

T0 = dt.datetime(2024, 1, 1)


def test_zones(spark):
    from tidewright.operators.levels import zones
    from tidewright.operators.windows import swings

    highs = {8: 110.0, 20: 110.1, 32: 120.0, 44: 110.05}
    rows = [("a", T0 + dt.timedelta(hours=i), 100.0, highs.get(i, 101.0 + (i % 2) / 10), 90.0 + (i % 12 != 2) * 2 + i / 100, 100.0, 1.0) for i in range(56)]
    got = zones(swings(spark.createDataFrame(rows, "k string, t timestamp_ntz, o double, h double, l double, c double, v double"))).collect()
    up = sorted((x for x in got if x.side == "resistance"), key=lambda x: x.place)
    assert [(x.n, x.place) for x in up] == [(3, 1), (1, 2)] and up[0].low == pytest.approx(110.0 * 0.999) and up[0].high == pytest.approx(110.1 * 1.001)
    assert up[0].strength == pytest.approx((1.0 + 1.0 + 1.1) / 5) and up[1].strength == pytest.approx(1.1 / 5)
    down = sorted((x for x in got if x.side == "support"), key=lambda x: x.place)
    assert [x.high for x in down] == sorted((x.high for x in down), reverse=True) and 0 < max(x.strength for x in down) <= 1.0


def brute(rows, control, last, least, arms):
    out = {}
    for h, t in {(x[1], x[2]) for x in rows}:
        votes = {x[0]: x for x in rows if (x[1], x[2]) == (h, t)}
        if control not in votes or len(votes) < 2:
            continue
        trail = {}
        for a in votes:
            errs = [x[5] for x in sorted(rows, key=lambda x: x[2]) if x[0] == a and x[1] == h and x[2] < t and x[5] is not None][-last:]
            if len(errs) >= least:
                trail[a] = sum(errs) / len(errs)
        worst = min((a for a in trail if trail[a] == max(trail.values())), default=None) if len(trail) >= arms else None
        polled = sorted([v[3] for a, v in votes.items() if a != worst] + [int(votes[control][4])])
        mid = len(polled) // 2
        out[(h, t)] = (len(polled), worst, polled[mid] if len(polled) % 2 else (polled[mid - 1] + polled[mid]) // 2)
    return out


def test_votes_match_a_loop(spark):
    from tidewright.operators.levels import voted

    r = random.Random(8)
    rows = [(a, h, T0 + dt.timedelta(minutes=i), r.randint(-20, 20), r.uniform(0, 30), None if r.random() < 0.2 else float(r.randint(0, 6))) for a in ("c", "d", "e", "f") for h in (1, 5) for i in range(40) if r.random() < 0.85]
    got = voted(spark.createDataFrame(rows, "arm string, horizon int, t timestamp_ntz, pred int, price_now double, abs_err double").repartition(3), "c", 8, 4, 3).collect()
    assert {(x.horizon, x.t): (x.voters, x.dropped, x.pred) for x in got} == brute(rows, "c", 8, 4, 3)
    assert any(x.dropped for x in got) and not all(x.dropped for x in got)


def test_inventory(spark, tmp_path):
    from tidewright.operators.levels import Inventory

    at = Inventory(spark, str(tmp_path / "inventory"))
    assert at.all().count() == 0 and at.get("a", "1h").count() == 0
    record = lambda k, n, day: (k, "1h", T0, T0, n, None, T0 + dt.timedelta(days=day))
    put = lambda *x: at.update(spark.createDataFrame(list(x), Inventory.SCHEMA))
    put(record("a", 5, 2), record("b", 1, 1))
    put(record("a", 9, 3), record("a", 8, 3))
    put(record("a", 1, 1))  # an older one comes late
    assert sorted((x.k, x.n) for x in at.all().collect()) == [("a", 9), ("b", 1)] and at.get("a", "1h").first().n == 9

"""Steps that cut a key's time into blocks, against a plain walk over all its rows."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest

T0 = dt.datetime(2024, 1, 1)


def trades(seed=3, n=400):
    r = random.Random(seed)
    rows = [(r.choice("aab"), T0 + dt.timedelta(hours=r.randrange(0, 400)), i, float(r.randrange(0, 100)), r.choice([-7.25, -1.0, 2.0, 5.5])) for i in range(n)]
    return rows + [("late", T0, 1, 1.0, -3.0), ("late", T0 + dt.timedelta(days=3), 2, None, -4.0), ("late", T0 + dt.timedelta(days=9), 3, 50.0, None), ("none", None, 1, 9.0, -1.0), ("none", T0, 2, 1.0, -2.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, id long, score double, pnl double").repartition(3)


def by_key(rows):
    out = {}
    for x in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or T0, x[2])):
        out.setdefault(x[0], []).append(x)
    return out


def blocks_only(df):
    """No window meets a key's rows whole: each is by key and block, or over blocks."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in text.splitlines() if "Window [" in line and "pnl" in line and "_block" not in line] == []


@pytest.mark.parametrize("block", ["hour", "day", "year"])
def test_threshold_sweep(spark, block):
    from tidewright.operators.evaluation import threshold_sweep

    rows, levels = trades(), [0.0, 30.0, 80.0]
    df = threshold_sweep(frame(spark, rows), "score", levels, "id", block=block)
    got = {(x.k, x.threshold): (x.n, x.win_rate, x.total, x.drawdown) for x in df.collect()}
    want = {}
    for k, xs in by_key(rows).items():
        for level in levels:
            kept = [x for x in xs if level <= 0 or (x[3] is not None and x[3] >= level)]
            known, total, peak, down = [x[4] for x in kept if x[4] is not None], 0.0, 0.0, None
            for v in known:
                total += v
                peak = max(peak, total)
                down = max(down or 0.0, peak - total)
            if kept:
                want[k, level] = (len(kept), sum(v > 0 for v in known) / len(known) if known else None, total if known else None, down)
    assert got == {k: tuple(pytest.approx(v) if v is not None else None for v in x) for k, x in want.items()}
    assert blocks_only(df)


@pytest.mark.parametrize("block", ["hour", "day", "year"])
def test_bankroll(spark, block):
    from tidewright.operators.folds import bankroll

    rows, want = trades(5), {}
    df = bankroll(frame(spark, rows), "100", "id", block=block)
    for k, xs in by_key(rows).items():
        cash, low = Decimal(100), None
        for v in (x[4] for x in xs if x[4] is not None):
            cash += Decimal(str(v))
            low = cash if low is None else min(low, cash)
        want[k] = (len(xs), float(cash), float(low))
    assert {x.k: (x.n, x.last, x.lowest) for x in df.collect()} == want
    assert blocks_only(df)


@pytest.mark.parametrize("block", ["hour", "day", "year"])
def test_losing_streak(spark, block):
    from tidewright.operators.windows import losing_streak

    rows, want = [*trades(8), *(("a", T0 + dt.timedelta(days=40 + i), i, 1.0, -1.0) for i in range(5))], {}
    df = losing_streak(frame(spark, rows), "id", block=block)
    for k, xs in by_key(rows).items():
        gains = [i for i, x in enumerate(xs) if x[4] is not None and x[4] > 0]
        want[k] = len(xs) - 1 - (gains[-1] if gains else -1)
    assert {x.k: x.streak for x in df.collect()} == want and want["a"] >= 5 and want["late"] == 3
    assert blocks_only(df)

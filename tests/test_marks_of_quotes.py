"""Marks of an execution ledger are looked for once for each quote, not for each order."""

from __future__ import annotations

import datetime as dt


def test_marks_are_of_the_path(spark):
    from tidewright.operators.execution import execution_ledger

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    path = spark.createDataFrame([("a", at(m), m / 100, float(m)) for m in range(0, 60, 5)], "ticker string, t timestamp_ntz, p double, base double")
    orders = spark.createDataFrame([("a", at(m), i, s, 40.0, 400.0, 600.0, 1, False) for i, (m, s) in enumerate(((11, "yes"), (12, "no"), (58, "yes")))], "ticker string, t timestamp_ntz, id long, side string, ask_c double, stake_c double, pnl_c double, win int, skipped boolean")
    df = execution_ledger(orders, path, {"15m": 900}, {"15m": 900}, 600, 60)
    got = {x.id: (x.market, x.mark_15m, x.price_15m) for x in df.collect()}
    assert got[0][::2] == (0.1, 15.0) and got[1][::2] == (0.1, -15.0) and abs(got[0][1] - 15) < 1e-9 and abs(got[1][1] + 15) < 1e-9 and got[2] == (0.55, None, None)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    above = text[: text.index("Join ")]
    assert "array_min" not in above and "array_min" in text

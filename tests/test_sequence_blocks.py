"""Rows out of order, with and without blocks of the sequence."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F


def test_out_of_order_over_blocks(spark):
    from tidewright.operators.ledger import out_of_order

    r, t0 = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(r.choice("aab"), i, None if r.random() < 0.05 else t0 + dt.timedelta(hours=r.randrange(50))) for i in range(300)] + [("a", None, t0 + dt.timedelta(hours=60))]
    want = set()
    for k in "ab":
        mine = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0))
        want |= {(k, x[1]) for p, x in zip(mine, mine[1:], strict=False) if p[2] and x[2] and x[2] < p[2]}
    df = spark.createDataFrame(rows, "k string, seq long, t timestamp_ntz").repartition(3)
    for block in (None, F.floor(F.col("seq") / 7), F.floor(F.col("seq") / 100)):
        got = out_of_order(df, "seq", block)
        assert got.columns == df.columns and {(x.k, x.seq) for x in got.collect()} == want
    hot = out_of_order(df, "seq", F.floor(F.col("seq") / 7))
    assert not [x for x in hot._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [lag" in x and "_block" not in x]

"""Captured trades and late settlement: messages, lateness, restarts, repeats."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
MS = 1_704_067_200_000
HOUR = dt.timedelta(hours=1)


def line(body, receive=MS + 1000, id_="x"):
    return json.dumps({"id": id_, "receive": receive, "persist": receive + 5, "body": body if isinstance(body, str) else json.dumps(body)})


def test_messages_become_trades(spark):
    from tidewright.streaming import capture as C

    good = {
        "flagged": [({"e": "trade", "t": 12, "T": MS, "p": "10.5", "q": "2", "m": True}, ["x", 10.5, 2.0, False])],
        "batched": [({"data": [{"tradeId": "1", "ts": str(MS), "px": "10", "sz": "1", "side": "buy"}, {"tradeId": "2", "ts": str(MS), "px": "11", "sz": "0", "side": "sell"}]}, ["1", 10.0, 1.0, True, "2", 11.0, 0.0, False])],
        "nested": [([7, [["10", "1", "1704067200.000000", "s", "m", "9"]], "trade", "X/Y"], ["9", 10.0, 1.0, False])],
        "maker": [({"type": "match", "trade_id": "5", "time": "2024-01-01T00:00:00.000Z", "price": "3", "size": "4", "side": "sell"}, ["5", 3.0, 4.0, True])],
    }
    bad = [line("<html>"), "no json", line({}), line([]), line(["a", "b"]), line({"e": "quote"}), line({"e": "trade", "T": MS, "p": "x", "q": "1", "m": True}), line({"data": [{"ts": None, "px": "1"}]}), line({"type": "match", "price": "1", "size": "1", "time": "2024-01-01T00:00:00Z", "side": "?"}), line([7, [["0", "1", "1", "b"]], "trade", "X"])]
    for kind, messages in good.items():
        rows = spark.createDataFrame([(line(m),) for m, _ in messages] + [(b,) for b in bad] + [(None,)], "value string")
        got = C.normalised("v", kind, rows).withColumn("ms", F.unix_millis("exchange_t")).orderBy("id").collect()
        assert [y for x in got for y in (x.id, x.px, x.qty, x.taker_buy)] == messages[0][1]
        assert {(x.venue, x.ms, (x.receive_t - x.exchange_t).total_seconds()) for x in got} == {("v", MS, 1.0)}


def feed(spark, path, rows):
    """(venue, id, seconds of the exchange, seconds of receipt, price)"""
    out = [(v, line({"e": "trade", "T": MS + 1000 * x, "p": str(px), "q": "1", "m": False}, MS + 1000 * r, i)) for v, i, x, r, px in rows]
    spark.createDataFrame(out, "venue string, value string").write.mode("append").partitionBy("venue").text(path)


def minutes(spark, path, run, policy="min"):
    from tidewright.streaming import capture as C
    from tidewright.streaming import streams as S

    lines = spark.readStream.schema("value string, venue string").text(path)
    trades = {v: (C.normalised(v, "flagged", lines.where(F.col("venue") == v).select("value")), late) for v, late in (("a", "60 seconds"), ("b", "120 seconds"))}
    with C.watermark_policy(spark, policy):
        out, said = S.run_into(C.by_minute(C.united(trades)), "append", run)
    return {(x.venue, int((x.t - T0).total_seconds()) // 60): (x.n, x.last_px, x.late, x.ahead) for x in out.collect()}, said


def test_a_restart_goes_on_and_late_trades_are_counted(spark, tmp_path):
    first = [("a", "1", 0, 1, 5.0), ("a", "2", 50, 50, 6.0), ("a", "2", 50, 50, 6.0), ("b", "1", 10, 12, 1.0), ("a", "3", 70, 60, 7.0), ("b", "2", 100, 100, 2.0)]
    second = [("a", "4", 55, 110, 6.5), ("a", "5", 30, 130, 9.0), ("b", "3", 20, 139, 3.0), ("a", "6", 400, 400, 8.0), ("b", "4", 500, 500, 4.0)]
    feed(spark, f"{tmp_path}/one", first + second)
    whole, said = minutes(spark, f"{tmp_path}/one", f"{tmp_path}/run-one")
    assert said["dropped"] == 0
    feed(spark, f"{tmp_path}/two", first)
    begun, _ = minutes(spark, f"{tmp_path}/two", f"{tmp_path}/run-two")
    assert begun == {}  # the slower watermark stands at the beginning still
    feed(spark, f"{tmp_path}/two", second)
    again, said = minutes(spark, f"{tmp_path}/two", f"{tmp_path}/run-two")
    assert again == whole and said["dropped"] == 0
    assert whole == {("a", 0): (3, 6.5, 0, 0), ("a", 1): (1, 7.0, 0, 1), ("a", 2): (0, None, 1, 0), ("b", 0): (2, 3.0, 0, 0), ("b", 1): (1, 2.0, 0, 0)}
    quiet, said = minutes(spark, f"{tmp_path}/two", f"{tmp_path}/run-two")
    assert quiet == whole


def test_policies(spark, tmp_path):
    """With the fastest source's watermark, one that stands still holds up none, and what it sends later is dropped."""
    feed(spark, f"{tmp_path}/feed", [("a", "1", 0, 0, 5.0), ("b", "1", 0, 0, 1.0), ("a", "2", 900, 900, 6.0)])
    assert minutes(spark, f"{tmp_path}/feed", f"{tmp_path}/min")[0] == {}
    fast, _ = minutes(spark, f"{tmp_path}/feed", f"{tmp_path}/max", "max")
    assert set(fast) == {("a", 0), ("b", 0)}
    feed(spark, f"{tmp_path}/feed", [("b", "2", 30, 31, 1.0)])
    fast, said = minutes(spark, f"{tmp_path}/feed", f"{tmp_path}/max", "max")
    assert fast[("b", 0)][0] == 1 and said["dropped"] >= 1


POSITION, BAR = "k string, bar timestamp_ntz, id long, strike double, yes boolean, stake double, payout double, at timestamp", "k string, bar timestamp_ntz, price double, synthetic boolean, at timestamp"


def settle(spark, path, run):
    from tidewright.streaming import settling as G
    from tidewright.streaming import streams as S

    read = lambda schema, name: spark.readStream.schema(schema).parquet(f"{path}/{name}")
    with G.timers(spark):
        out, _ = S.run_into(G.late_settlement(read(POSITION, "p"), read(BAR, "b"), "1 hour"), "append", run)
    hours = lambda t: None if t is None else (t - T0).total_seconds() / 3600
    return sorted((x.k, hours(x.bar), x.id, x.status, x.win, x.pnl, hours(x.credited), x.late) for x in out.collect())


def test_late_settlement_over_restarts(spark, tmp_path):
    p = lambda k, bar, i, strike, at, yes=True: (k, T0 + HOUR * bar, i, float(strike), yes, 4.0, 10.0, T0 + HOUR * at)
    b = lambda k, bar, price, at, synthetic=False: (k, T0 + HOUR * bar, float(price), synthetic, T0 + HOUR * at)
    parts = [
        ([p("a", 0, 1, 10, 0.2), p("a", 0, 2, 20, 0.3), p("a", 0, 3, 10, 0.4, False), p("a", 1, 4, 5, 1.5), p("a", 0, 1, 99, 0.6), (None, T0, 8, 1.0, True, 1.0, 2.0, T0)], [b("a", 0, 50, 1, True), b("z", 0, 1, 1)]),
        ([p("a", 0, 1, 10, 2), p("a", 0, 5, 12, 4)], [b("a", 0, 12, 3), b("a", 0, 99, 3.5), b("a", 1, 5, 2 + 1 / 60)]),
        ([p("a", 0, 2, 20, 5), p("c", 90, 9, 1, 90)], [b("a", 0, 99, 5), b("z", 91, 1, 92)]),
        ([p("a", 0, 7, 1, 100), p("c", 200, 10, 1, 200)], [b("c", 90, 2, 100, True), b("z", 200, 1, 201)]),
    ]
    want = [
        ("a", 0.0, 1, "settled", True, 6.0, 3.0, True), ("a", 0.0, 2, "settled", False, -4.0, 3.0, True), ("a", 0.0, 3, "settled", False, -4.0, 3.0, True), ("a", 0.0, 5, "settled", True, 6.0, 4.0, True), ("a", 1.0, 4, "settled", True, 6.0, 2.0, False),
        ("c", 90.0, 9, "unsettled", None, None, None, None),
    ]
    for i, (positions, bars) in enumerate(parts):  # each part meets a new start of the query
        spark.createDataFrame(positions, POSITION).write.mode("append").parquet(f"{tmp_path}/split/p")
        spark.createDataFrame(bars, BAR).write.mode("append").parquet(f"{tmp_path}/split/b")
        got = settle(spark, f"{tmp_path}/split", f"{tmp_path}/run-split")
        if i == 0:
            assert got == []  # a synthetic bar settles nothing
    assert got == want
    for positions, bars in parts:
        spark.createDataFrame(positions, POSITION).write.mode("append").parquet(f"{tmp_path}/whole/p")
        spark.createDataFrame(bars, BAR).write.mode("append").parquet(f"{tmp_path}/whole/b")
    assert settle(spark, f"{tmp_path}/whole", f"{tmp_path}/run-whole") == want

"""Mean delays of captured trades that end in a half of the last place."""

from __future__ import annotations

import datetime as dt

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def test_delay_is_rounded_as_in_sql(spark, tmp_path):
    import duckdb

    from tidewright.streaming import capture as C
    from tidewright.streaming import streams as S

    delays = [44_173] * 79 + [44_234]
    at = lambda ms: T0 + dt.timedelta(milliseconds=ms)
    rows = [("v", str(i), at(i), at(i + d), at(i + d), 1.0, 1.0, True) for i, d in enumerate(delays)] + [("v", "end", at(90_000_000), at(90_000_001), at(90_000_001), 1.0, 1.0, True)]
    schema = "venue string, id string, exchange_t timestamp, receive_t timestamp, persist_t timestamp, px double, qty double, taker_buy boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "feed"))
    trades = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
    out, _ = S.run_into(C.by_minute(C.united({"v": (trades, "10 minutes")}), "10 minutes"), "append", str(tmp_path / "run"))
    want = duckdb.execute("SELECT round(avg(d) / 1000, 6) FROM (SELECT unnest(?::BIGINT[]) AS d)", [delays]).fetchall()[0][0]
    assert [(x.n, x.delay_s) for x in out.collect()] == [(80, want)] and want == 44.173762

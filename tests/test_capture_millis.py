"""Captured trades between two milliseconds, and beyond the usual years, compared with the SQL."""

from __future__ import annotations

import datetime as dt

import pytest

VENUES = ("click", "purchase", "signup", "view", "error")


@pytest.mark.parametrize("end", [dt.datetime(2024, 1, 30), dt.datetime(2101, 1, 1)])
def test_events_are_rounded_to_milliseconds_and_all_fed(spark, tmp_path, end):
    import duckdb

    from tidewright.plans import q_capture, registry

    at = lambda day, *more: dt.datetime(2024, 1, day, 0, *more)
    times = [at(2, 9, 59, 999_499), at(2, 9, 59, 999_500), at(2, 9, 59, 999_501), at(13, 9, 59, 999_960), at(13, 10, 0, 400), at(25, 9, 59, 999_999), at(25, 8), end - dt.timedelta(microseconds=100), end + dt.timedelta(hours=1)]
    ids = iter(i for i in range(1, 1000) if i % 50 and i % 77)
    rows = [(next(ids), t, 1, v, 2.5 + n, '{"k": 3}') for v in VENUES for n, t in enumerate(times)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = sorted(con.sql(registry.oracle_sql()["stream_captured_trades"]).fetchall())
    got = sorted(map(tuple, q_capture.stream_captured_trades(spark, str(tmp_path)).collect()))
    assert got == want and len(got) == 6 * len(VENUES)

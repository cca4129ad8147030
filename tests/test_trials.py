"""Synthetic series, retries and the cache."""

from __future__ import annotations

import pytest

from tidewright.operators import bars as B
from tidewright.sources import retry, synthetic


def test_synthetic_bars_are_valid_and_repeat(spark):
    for make in (synthetic.random_walk, synthetic.waves):
        a, b = make(spark, "x", 60, seed=3), make(spark, "x", 60, seed=3)
        assert a.collect() == b.collect() and a.where(B.is_valid()).count() == 60
    assert {r.t.hour for r in synthetic.waves(spark, "x", 60).collect()} == set(range(14, 21))


def test_retries_only_transient_failures():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise retry.SourceError("busy", transient=True)
        return "done"

    assert retry.retried(flaky, sleep=waits.append, draw=lambda a, b: b) == "done" and waits == [0.5, 1.0]
    with pytest.raises(retry.SourceError):
        retry.retried(lambda: (_ for _ in ()).throw(retry.SourceError("gone", transient=False)), sleep=waits.append)
    assert len(waits) == 2


def test_cache_expires(spark):
    now = [0.0]
    cache, loads = retry.Cached(10, lambda: now[0]), []
    load = lambda: loads.append(1) or spark.range(3)
    assert cache.get("a", load) is cache.get("a", load)
    now[0] = 11.0
    assert cache.get("a", load).count() == 3 and len(loads) == 2

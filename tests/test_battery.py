"""The battery of checks, answers of a news service, and events in news."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, t timestamp_ntz, close_t timestamp_ntz, p double, market double, y int, bid double, ask double"


def rows(k, n=1500, late=0, leak=0, again=0, cheap=False, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t, y = T0 + dt.timedelta(minutes=15 * (i if i >= again else 0)), r.randint(0, 1)
        p = float(y) if i < leak else r.uniform(0.02, 0.98)
        out.append((k, t, t + dt.timedelta(minutes=15 if i >= late else 0), p, 0.5, y, 60.0 if cheap else 48.0, 40.0 if cheap else 52.0))
    return out


def test_each_fault_fails_its_check(spark):
    from tidewright.operators.battery import HARD, battery, verdict

    data = rows("good") + rows("late", late=1, seed=1) + rows("leak", leak=20, seed=2) + rows("again", again=3, seed=3) + rows("cheap", cheap=True, seed=4) + [("few", T0, T0 + dt.timedelta(minutes=1), 0.5, None, 1, None, None)]
    checks = battery(spark.createDataFrame(data, SCHEMA).repartition(3)).cache()
    got = {x.k: x for x in verdict(checks).collect()}
    assert (got["good"].verdict, got["good"].failed) == ("PASS", []) and got["few"].verdict == "PASS"
    assert {k: got[k].failed for k in ("late", "leak", "again", "cheap")} == {"late": ["timestamp_ordering"], "leak": ["outcome_leak_canary"], "again": ["duplicate_windows"], "cheap": ["random_strategy"]}
    value = {(x.k, x.check): x.value for x in checks.collect()}
    assert value[("again", "duplicate_windows")] == 2.0 and value[("leak", "outcome_leak_canary")] == pytest.approx(20 / 1500) and value[("good", "market_brier")] == 0.25
    assert 0.4 < value[("leak", "label_shuffle")] < 0.6 and value[("good", "persistence_brier")] == pytest.approx(0.5, abs=0.06)
    assert {x.check for x in checks.where("result is null").collect()} == {"market_brier", "persistence_brier"} and checks.where("k = 'good' and result = 'PASS'").count() == len(HARD)


def test_articles_are_parsed_tolerantly(spark):
    from tidewright.operators.battery import articles

    feed = [
        {"title": "A", "time_published": "20240102T0304", "overall_sentiment_score": "0.25", "topics": [{"topic": "Earnings", "relevance_score": "1"}, {"other": 1}], "ticker_sentiment": [{"ticker": "X", "relevance_score": "0.5", "ticker_sentiment_score": "bad"}, {"relevance_score": "1"}]},
        {"time_published": "20240102T030405", "overall_sentiment_score": 0.5}, {"title": "no time"}, {"title": "bad time", "time_published": "yesterday"}, {"title": "bad score", "time_published": "20240102T0304", "overall_sentiment_score": "x"},
    ]
    bodies = [("a", json.dumps({"items": 5, "feed": feed})), ("b", json.dumps({"Note": "slow down"})), ("c", "<html>"), ("d", None), ("e", json.dumps({"feed": []}))]
    x, y = sorted(articles(spark.createDataFrame(bodies, "k string, body string")).collect(), key=lambda x: x.title, reverse=True)
    assert (x.k, x.title, x.time_published, x.score, x.label, x.topics) == ("a", "A", dt.datetime(2024, 1, 2, 3, 4), 0.25, "Neutral", ["Earnings"]) and [tuple(t) for t in x.tickers] == [("X", 0.5, 0.0, "Neutral")]
    assert (y.title, y.url, y.time_published, y.score, y.topics, y.tickers) == ("", "", dt.datetime(2024, 1, 2, 3, 4, 5), 0.5, [], [])


def test_events_by_recency(spark):
    from tidewright.operators.battery import major_events

    now = T0 + dt.timedelta(days=2)
    n = lambda k, title, minutes, topics=None, score=0.0: (k, title, topics, now - dt.timedelta(minutes=minutes), score)
    news = [
        n("hour", "calm", 5), n("hour", "Buyout talk", 10), n("hour", "EPS beat", 20), n("hour", "earnings", 90), n("day", "x", 61), n("day", "the SEC acts", 70), n("day", "merger", 80), n("topic", "quiet", 1, ["Economy"]), n("part", "quiet", 1, ["the economy"]),
        n("late", "calm", 100), *(n("late", f"calm {i}", 101 + i) for i in range(4)), n("late", "earnings", 200), n("strong", "calm", 3, None, -0.6), n("weak", "calm", 3, None, 0.5), n("future", "earnings", -5), n("future", None, 5), n("old", "earnings", 1441),
    ]
    got = {x.k: (x.event, x.articles) for x in major_events(spark.createDataFrame(news, "k string, title string, topics array<string>, time_published timestamp_ntz, score double"), F.lit(now).cast("timestamp_ntz")).collect()}
    assert got == {"hour": ("merger", 4), "day": ("regulatory", 3), "topic": ("macro", 1), "part": ("none", 1), "late": ("none", 6), "strong": ("other", 1), "weak": ("none", 1), "future": ("none", 1)}

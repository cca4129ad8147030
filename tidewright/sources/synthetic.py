"""Seeded synthetic bars, made on the driver: a few series for trials, not data at scale."""

from __future__ import annotations

import datetime as dt
import math
import random

from pyspark.sql import DataFrame, SparkSession


def random_walk(spark: SparkSession, key: str, n: int, start: float = 100.0, trend: float = 0.0, volatility: float = 0.01, seed: int = 0, begin: dt.datetime = dt.datetime(2024, 1, 1, 9)) -> DataFrame:
    """n hourly bars of a log random walk."""
    draw, price, rows = random.Random(seed), start, []
    for i in range(n):
        close = price * math.exp(trend + volatility * draw.gauss(0, 1))
        wick = 1 + abs(draw.gauss(0, volatility / 2))
        rows.append((key, begin + dt.timedelta(hours=i), price, max(price, close) * wick, min(price, close) / wick, close, float(draw.randint(1_000, 10_000)), 1))
        price = close
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, o double, h double, l double, c double, v double, n long")


def waves(spark: SparkSession, key: str, n: int, period: int = 40, height: float = 0.05, start: float = 100.0, seed: int = 0, first_hour: int = 14, last_hour: int = 20) -> DataFrame:
    """n bars that rise and fall in waves with noise, at session hours of working days."""
    draw, t, rows, last = random.Random(seed), dt.datetime(2024, 1, 1, first_hour), [], start
    while len(rows) < n:
        if t.weekday() < 5 and first_hour <= t.hour <= last_hour:
            close = start * (1 + height * math.sin(2 * math.pi * len(rows) / period) + draw.gauss(0, height / 20))
            rows.append((key, t, last, max(last, close) * 1.002, min(last, close) * 0.998, close, float(draw.randint(100, 1_000)), 1))
            last = close
        t += dt.timedelta(hours=1)
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, o double, h double, l double, c double, v double, n long")

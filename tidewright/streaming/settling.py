"""Positions settled by bars that may come late, as a stream with timers.

State is kept by (key, bar): the open positions on a bar, and the bar once it has come. A timer at the end of the
horizon gives what is still open as unsettled and forgets the bar, so state holds the bars of one horizon.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "k string, bar timestamp_ntz, id long, status string, win boolean, pnl double, credited timestamp_ntz, late boolean"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Streams started inside can have timers, which need this kind of state store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _ntz(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


class Settling(StatefulProcessor):
    """Rows are positions and bars of one (key, bar), each with `us`, when it came."""

    def __init__(self, horizon_us: int, grace_us: int, width_us: int):
        self.horizon, self.grace, self.width = horizon_us, grace_us, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", "price double, us long")
        self.open = handle.getMapState("open", "id long", "strike double, yes boolean, stake double, payout double, us long")
        self.done = handle.getMapState("done", "id long", "us long")

    def _settled(self, key: tuple, n: int, position: tuple, bar: tuple, end: int) -> dict:
        strike, yes, stake, payout, us = position
        win = bool((bar[0] >= strike) == yes)
        credited = max(us, bar[1])
        late = credited > end + self.grace
        return {"k": key[0], "bar": _ntz(key[1]), "id": n, "status": "settled", "win": win, "pnl": payout - stake if win else -stake, "credited": _ntz(credited if late else end), "late": late}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start = int(key[1])
        end, expiry = start + self.width, start + self.horizon
        frame = pd.concat(list(rows)).sort_values(["us", "is_bar", "id"], kind="stable")
        frame = frame[frame["us"] < expiry]  # what comes after the horizon finds the key forgotten
        if not len(frame):
            return
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(-(-expiry // 1000))
        out, bar = [], self.bar.get() if self.bar.exists() else None
        for x in frame.itertuples(index=False):
            if x.is_bar:
                if bar is None and not x.synthetic:  # only an authoritative bar settles, and only the first
                    bar = (float(x.price), int(x.us))
                    self.bar.update(bar)
                    for (n,), position in list(self.open.iterator()):
                        out.append(self._settled(key, n, position, bar, end))
                        self.done.updateValue((n,), (bar[1],))
                    self.open.clear()
            elif not self.done.containsKey((int(x.id),)) and not self.open.containsKey((int(x.id),)):
                position = (float(x.strike), bool(x.yes), float(x.stake), float(x.payout), int(x.us))
                if bar is None:
                    self.open.updateValue((int(x.id),), position)
                else:
                    out.append(self._settled(key, int(x.id), position, bar, end))
                    self.done.updateValue((int(x.id),), (int(x.us),))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = [{"k": key[0], "bar": _ntz(int(key[1])), "id": n, "status": "unsettled", "win": None, "pnl": None, "credited": pd.NaT, "late": None} for (n,), _ in self.open.iterator()]
        for state in (self.bar, self.open, self.done):
            state.clear()
        if left:
            yield pd.DataFrame(left).astype({"win": "boolean", "late": "boolean", "pnl": "float64"})


def late_settlement(positions: DataFrame, bars: DataFrame, lateness: str, horizon: str = "2 days", grace: str = "2 minutes", width: str = "1 hour") -> DataFrame:
    """Positions (k, bar, id, strike, yes, stake, payout, at) settled by bars (k, bar, price, synthetic, at); `bar` is a
    bar's start and `at` when a row came.

    A position on yes wins if the bar's close is its strike or more. It settles once, with the first authoritative bar:
    at the bar's end, or if that or the position itself came more than `grace` after it, when it came (late). Repeats
    of positions and bars change nothing. What has no such bar within `horizon` of the bar's start comes out unsettled
    when the watermark passes that, and is forgotten. Rows more than `lateness` out of order may be dropped. Rows
    without key, bar or time are no rows.

    Run it inside timers(). The state holds each (key, bar) for a horizon at most; a busy key is spread over its bars.
    """
    us = lambda span: int(pd.Timedelta(span).value // 1000)
    none = lambda kind: F.lit(None).cast(kind)
    p = positions.select("k", F.unix_micros(F.col("bar").cast("timestamp")).alias("bar"), "at", F.lit(False).alias("is_bar"), F.col("id").cast("long").alias("id"), F.col("strike").cast("double").alias("strike"), "yes", F.col("stake").cast("double").alias("stake"), F.col("payout").cast("double").alias("payout"), none("double").alias("price"), none("boolean").alias("synthetic"))
    b = bars.select("k", F.unix_micros(F.col("bar").cast("timestamp")).alias("bar"), "at", F.lit(True).alias("is_bar"), none("long").alias("id"), none("double").alias("strike"), none("boolean").alias("yes"), none("double").alias("stake"), none("double").alias("payout"), F.col("price").cast("double").alias("price"), "synthetic")
    both = p.withWatermark("at", lateness).unionByName(b.withWatermark("at", lateness)).where("k is not null and bar is not null and at is not null").withColumn("us", F.unix_micros("at"))
    return both.groupBy("k", "bar").transformWithStateInPandas(Settling(us(horizon), us(grace), us(width)), RESULT, "Append", "EventTime")

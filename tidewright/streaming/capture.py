"""Trades captured from several venues, with three times each, as one stream.

A trade has the time of the exchange, of its receipt and of its writing. Windows are by the exchange's time, as far as
a trade comes within the lateness of its venue; one that comes later is counted where it was received, and moves no
window. So what is late hangs on the row alone, not on how files fall into batches, and state drops nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import scalar as S

#: Fields of four kinds of message. `flagged` tells by m that the buyer was the maker; `batched` has many
#: trades and the taker's side; `nested` has arrays and one letter; `maker` names the maker's side, so the taker's is
#: the other.
FLAGGED = "e string, t string, T long, p string, q string, m boolean"
BATCHED = "data array<struct<tradeId: string, ts: string, px: string, sz: string, side: string>>"
MAKER = "type string, trade_id string, time string, price string, size string, side string"
LINE = "id string, receive long, persist long, body string"

TRADE = ("venue", "id", "exchange_t", "receive_t", "persist_t", "px", "qty", "taker_buy")


def _at(ms: Column) -> Column:
    return F.timestamp_millis(ms.try_cast("long"))


def _trades(venue: str, rows: DataFrame, id_: Column, at: Column, px: Column, qty: Column, buy: Column) -> DataFrame:
    out = rows.select(F.lit(venue).alias("venue"), id_.alias("id"), at.alias("exchange_t"), _at(F.col("receive")).alias("receive_t"), _at(F.col("persist")).alias("persist_t"), px.try_cast("double").alias("px"), qty.try_cast("double").alias("qty"), buy.alias("taker_buy"))
    return out.where("exchange_t is not null and receive_t is not null and px > 0 and qty >= 0 and taker_buy is not null")


def normalised(venue: str, kind: str, lines: DataFrame) -> DataFrame:
    """Lines of JSON (value) with id, receive and persist times in milliseconds and a message body, as TRADE rows.
    Messages that are no trades, and those without a time, a price or a side, are left out."""
    rows = lines.select(F.from_json("value", LINE).alias("x")).select("x.*")
    if kind == "flagged":
        b = rows.withColumn("b", F.from_json("body", FLAGGED, {"caseSensitive": "true"})).where("b.e = 'trade'")
        return _trades(venue, b, F.col("id"), _at(F.get_json_object("body", "$.T")), F.col("b.p"), F.col("b.q"), ~F.col("b.m"))
    if kind == "batched":
        b = rows.select("*", F.explode(F.from_json("body", BATCHED)["data"]).alias("b"))
        return _trades(venue, b, F.col("b.tradeId"), _at(F.col("b.ts")), F.col("b.px"), F.col("b.sz"), F.when(F.col("b.side").isin("buy", "sell"), F.col("b.side") == "buy"))
    if kind == "nested":
        b = rows.where(F.try_element_at(F.from_json("body", "array<string>"), F.lit(-2)) == "trade").select("*", F.explode(F.from_json(F.try_element_at(F.from_json("body", "array<string>"), F.lit(2)), "array<array<string>>")).alias("b"))
        get = lambda i: F.get("b", F.lit(i))
        return _trades(venue, b, get(5), F.timestamp_micros(F.round(get(2).try_cast("decimal(20,6)") * 1_000_000).cast("long")), get(0), get(1), F.when(get(3).isin("b", "s"), get(3) == "b"))
    if kind == "maker":
        b = rows.withColumn("b", F.from_json("body", MAKER)).where("b.type = 'match'")
        return _trades(venue, b, F.col("b.trade_id"), F.try_to_timestamp("b.time"), F.col("b.price"), F.col("b.size"), F.when(F.col("b.side").isin("buy", "sell"), F.col("b.side") == "sell"))
    raise ValueError(f"unknown kind of message: {kind}")


@contextmanager
def watermark_policy(spark: SparkSession, policy: str) -> Iterator[None]:
    """Streams started inside follow the slowest source (min: nothing in time is lost) or the fastest (max: a venue that
    stands still holds up none)."""
    name = "spark.sql.streaming.multipleWatermarkPolicy"
    before = spark.conf.get(name, "min")
    spark.conf.set(name, policy)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def united(trades: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """TRADE rows of all venues with late and at: a trade received more than its venue's lateness (an interval) after
    the exchange's time is late, and stands at its receipt, else at the exchange's time. Each venue has its own
    watermark on `at`, so trades must come in order of receipt, or out of it by no more than the lateness."""
    out = None
    for rows, lateness in trades.values():
        late = F.col("receive_t") > F.col("exchange_t") + F.expr(f"interval {lateness}")
        one = rows.withColumn("late", late).withColumn("at", F.when(late, F.col("receive_t")).otherwise(F.col("exchange_t"))).withWatermark("at", lateness)
        out = one if out is None else out.unionByName(one)
    return out


def by_minute(trades: DataFrame, width: str = "1 minute", tolerance: str = "2 seconds") -> DataFrame:
    """By venue and window: trades in time and their last price, volume and mean delay in seconds; how many of them the
    exchange dates after their receipt, beyond the tolerance of clocks, and by how many seconds at most; and how many
    late ones were received then. Repeats of a trade count once for each watermark."""
    once = trades.dropDuplicatesWithinWatermark(["venue", "id"])
    in_time = ~F.col("late")
    delay = F.unix_micros("receive_t") - F.unix_micros("exchange_t")
    ahead = F.col("exchange_t") > F.col("receive_t") + F.expr(f"interval {tolerance}")
    w = F.window("at", width)
    out = once.groupBy("venue", w).agg(
        F.count_if(in_time).alias("n"), F.max_by("px", F.when(in_time, F.struct("exchange_t", "id"))).alias("last_px"), S.rounded(F.sum(F.when(in_time, F.col("qty"))), 6).alias("volume"),
        S.rounded(F.avg(F.when(in_time, delay / 1000)) / 1000, 6).alias("delay_s"), F.count_if(in_time & ahead).alias("ahead"), S.rounded(F.max(F.when(in_time & ahead, -delay)) / 1e6, 6).alias("most_ahead_s"), F.count_if(F.col("late")).alias("late"),
    )
    return out.select("venue", F.col("window.start").cast("timestamp_ntz").alias("t"), "n", "last_px", "volume", "delay_s", "ahead", "most_ahead_s", "late")

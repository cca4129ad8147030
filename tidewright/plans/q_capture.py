"""Streams of captured trades and of late settlement, fed in parts, with a restart for each."""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import functions as F

from tidewright.sources import tables as T
from tidewright.streaming import capture as C
from tidewright.streaming import settling as G
from tidewright.streaming import streams as S

from .registry import add

#: What comes before each time is a part of the feed, and so is the rest.
CUTS = ("2024-01-12 00:00:00", "2024-01-21 00:00:00")
#: Kinds of event as venues: the kind of their messages and how late a trade may come.
VENUES = {"click": ("flagged", "10 minutes"), "purchase": ("batched", "20 minutes"), "signup": ("nested", "15 minutes"), "view": ("maker", "5 minutes"), "error": ("flagged", "10 minutes")}


def _parts(feed, time):
    """The feed's rows before each cut, from the one before, and those from the last on."""
    rest = feed
    for cut in CUTS:
        yield rest.where(F.col(time) < F.lit(cut).cast("timestamp_ntz"))
        rest = rest.where(F.col(time) >= F.lit(cut).cast("timestamp_ntz"))
    yield rest


def _messages(spark, d):
    """Events as messages of four kinds, with the times of their receipt: seconds later, hours later, or too early by
    the exchange's clock; some twice. Times are rounded to milliseconds, as the SQL does, not cut to them."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("t"))
    x = T.ticks(spark, d).withColumn("ms", (F.round(us, -3) / 1000).cast("long"))
    delay = F.when(F.col("id") % 50 == 0, 3 * 3_600_000).when(F.col("id") % 77 == 0, -5000).otherwise(F.col("id") * 7919 % 90_000)
    x = x.withColumn("receive", F.col("ms") + delay).withColumn("received", F.timestamp_add("MILLISECOND", "receive", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    px, qty, key = F.col("px").cast("string"), F.col("size").cast("string"), F.col("id").cast("string")
    one = lambda **c: F.struct(*(v.alias(n) for n, v in c.items()))
    flagged = F.to_json(one(e=F.lit("trade"), T=F.col("ms"), p=px, q=qty, m=~F.col("taker_buy")))
    batched = F.to_json(one(data=F.array(one(tradeId=key, ts=F.col("ms").cast("string"), px=px, sz=qty, side=F.when(F.col("taker_buy"), "buy").otherwise("sell")))))
    seconds = (F.col("ms").cast("decimal(20,3)") / 1000).cast("decimal(20,6)").cast("string")
    nested = F.concat(F.lit("[7,"), F.to_json(F.array(F.array(px, qty, seconds, F.when(F.col("taker_buy"), "b").otherwise("s"), F.lit("m"), key))), F.lit(',"trade","X/Y"]'))
    maker = F.to_json(one(type=F.lit("match"), trade_id=key, time=F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), price=px, size=qty, side=F.when(F.col("taker_buy"), "sell").otherwise("buy")))
    body = F.lit(None).cast("string")
    for venue, (kind, _) in VENUES.items():
        body = F.when(F.col("k") == venue, {"flagged": flagged, "batched": batched, "nested": nested, "maker": maker}[kind]).otherwise(body)
    line = F.to_json(F.struct(key.alias("id"), "receive", (F.col("receive") + 40).alias("persist"), body.alias("body")))
    copies = F.explode(F.when(F.col("id") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return x.select("k", "received", line.alias("value"), copies.alias("copy")).drop("copy")


def stream_captured_trades(spark, d):
    """Ten-minute windows of all venues, as far as the slowest venue's watermark has come."""
    at, out = S.shared_path(spark), None
    for part in _parts(_messages(spark, d), "received"):
        part.select("k", "value").write.mode("append").partitionBy("k").text(f"{at}/feed")
        lines = spark.readStream.schema("value string, k string").text(f"{at}/feed")
        trades = {v: (C.normalised(v, kind, lines.where(F.col("k") == v).select("value")), late) for v, (kind, late) in VENUES.items()}
        with C.watermark_policy(spark, "min"):
            out, _ = S.run_into(C.by_minute(C.united(trades), "10 minutes"), "append", f"{at}/run")
    return out


_RECEIVED = "CASE WHEN event_id % 50 = 0 THEN 10800000 WHEN event_id % 77 = 0 THEN -5000 ELSE event_id * 7919 % 90000 END"
_LATENESS = "CASE event_type " + " ".join(f"WHEN '{v}' THEN {int(late.split()[0]) * 60_000}" for v, (_, late) in VENUES.items()) + " END"
add(
    "stream_captured_trades",
    stream_captured_trades,
    f"WITH m AS (SELECT event_type AS venue, event_id::VARCHAR AS id, epoch_ms(ts) AS x, epoch_ms(ts) + {_RECEIVED} AS r, {_LATENESS} AS l, value AS px, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty FROM events), "
    "f AS (SELECT *, r > x + l AS late, CASE WHEN r > x + l THEN r ELSE x END AS at_ FROM m WHERE px > 0 AND qty >= 0), wm AS (SELECT min(w) AS w FROM (SELECT max(at_) - any_value(l) AS w FROM f GROUP BY venue)), "
    "g AS (SELECT venue, at_ // 600000 * 600000 AS s, * EXCLUDE (venue) FROM f) SELECT venue, make_timestamp(s * 1000) AS t, count(*) FILTER (NOT late) AS n, arg_max(px, (x, id)) FILTER (NOT late) AS last_px, round(sum(qty) FILTER (NOT late), 6) AS volume, round(avg(r - x) FILTER (NOT late) / 1000, 6) AS delay_s, "
    "count(*) FILTER (NOT late AND x > r + 2000) AS ahead, round((max(x - r) FILTER (NOT late AND x > r + 2000)) / 1000, 6) AS most_ahead_s, count(*) FILTER (late) AS late FROM g, wm WHERE s + 600000 <= wm.w GROUP BY venue, s",
)


def _positions(spark, d):
    x = T.ticks(spark, d).where("k = 'purchase'")
    one = x.select(F.lit("all").alias("k"), F.date_trunc("hour", "t").cast("timestamp_ntz").alias("bar"), "id", F.col("px").alias("strike"), "taker_buy", F.lit(40.0).alias("stake"), F.lit(100.0).alias("payout"), "t")
    again = one.where("id % 10 = 0").withColumn("t", F.col("t") + F.expr("interval 30 hours"))
    return one.unionByName(again).select("k", "bar", "id", "strike", F.col("taker_buy").alias("yes"), "stake", "payout", F.col("t").alias("at"))


def _bars(spark, d):
    """Hours of views; some bars are synthetic, some come again with another price, all some hours late."""
    x = T.ticks(spark, d).where("k = 'view'").groupBy(F.date_trunc("hour", "t").cast("timestamp_ntz").alias("bar")).agg(F.max_by("px", F.struct("t", "id")).alias("price"))
    n = F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("bar"))
    sent = lambda where, hours, price, synthetic: x.where(where).select(F.lit("all").alias("k"), "bar", price.alias("price"), synthetic.alias("synthetic"), F.timestamp_add("HOUR", hours, F.col("bar")).alias("at"))
    first = sent(F.lit(True), 1 + n * 53 % 20, F.col("price"), n % 7 == 0)
    return first.unionByName(sent(n % 14 == 0, F.lit(31), F.col("price"), F.lit(False))).unionByName(sent(n % 5 == 0, F.lit(26), F.col("price") + 1, F.lit(False)))


def stream_late_settlement(spark, d):
    """Purchases as positions on the close of their hour."""
    at, out = S.shared_path(spark), None
    positions, bars = "k string, bar timestamp_ntz, id long, strike double, yes boolean, stake double, payout double, at timestamp_ntz", "k string, bar timestamp_ntz, price double, synthetic boolean, at timestamp_ntz"
    for p, b in zip(_parts(_positions(spark, d), "at"), _parts(_bars(spark, d), "at"), strict=True):
        p.write.mode("append").parquet(f"{at}/positions")
        b.write.mode("append").parquet(f"{at}/bars")
        read = lambda schema, name: spark.readStream.schema(schema).parquet(f"{at}/{name}").withColumn("at", F.col("at").cast("timestamp"))
        with ExitStack() as both:
            both.enter_context(G.timers(spark))
            both.enter_context(C.watermark_policy(spark, "min"))
            out, _ = S.run_into(G.late_settlement(read(positions, "positions"), read(bars, "bars"), "12 hours", grace="2 hours"), "append", f"{at}/run")
    return out


add(
    "stream_late_settlement",
    stream_late_settlement,
    "WITH p AS (SELECT date_trunc('hour', ts) AS bar, event_id AS id, value AS strike, event_id % 2 = 0 AS yes, ts AS at_ FROM events WHERE event_type = 'purchase'), "
    "h AS (SELECT date_trunc('hour', ts) AS bar, arg_max(value, (ts, event_id)) AS price, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', any_value(ts))) AS n FROM events WHERE event_type = 'view' GROUP BY 1), "
    "b AS (SELECT bar, price, n % 7 = 0 AS synthetic, bar + INTERVAL 1 HOUR * (1 + n * 53 % 20) AS at_ FROM h UNION ALL SELECT bar, price, false, bar + INTERVAL 31 HOURS FROM h WHERE n % 14 = 0 UNION ALL SELECT bar, price + 1, false, bar + INTERVAL 26 HOURS FROM h WHERE n % 5 = 0), "
    "f AS (SELECT bar, arg_min(price, at_) AS price, min(at_) AS came FROM b WHERE NOT synthetic AND at_ < bar + INTERVAL 2 DAYS GROUP BY bar), "
    "wm AS (SELECT least((SELECT max(at_) FROM (SELECT at_ FROM p UNION ALL SELECT at_ + INTERVAL 30 HOURS FROM p WHERE id % 10 = 0)), (SELECT max(at_) FROM b)) - INTERVAL 12 HOURS AS w), "
    "j AS (SELECT p.*, f.price, (price >= strike) = yes AS win, CASE WHEN came IS NOT NULL THEN greatest(p.at_, came) END AS c FROM p LEFT JOIN f USING (bar)) "
    "SELECT 'all' AS k, bar, id, CASE WHEN price IS NULL THEN 'unsettled' ELSE 'settled' END AS status, win, CASE WHEN win THEN 60.0 WHEN NOT win THEN -40.0 END AS pnl, CASE WHEN c > bar + INTERVAL 3 HOURS THEN c ELSE CASE WHEN c IS NOT NULL THEN bar + INTERVAL 1 HOUR END END AS credited, c > bar + INTERVAL 3 HOURS AS late FROM j, wm WHERE price IS NOT NULL OR bar + INTERVAL 2 DAYS <= wm.w",
)

"""Reading tables and binding them to the entities that the operators work on.

An operator never names a table: it takes columns k (key), t (event time), id (tiebreak) and values. The functions
here give the shapes that the registered queries use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import bars as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades (k, t, id, px, size, taker_buy): one per event, keyed by event type."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("k"), F.col("ts").alias("t"), F.col("event_id").alias("id"), F.col("value").alias("px"),
        F.get_json_object("props", "$.k").cast("double").alias("size"), F.col("user_id"), (F.col("event_id") % 2 == 0).alias("taker_buy"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of ticks."""
    return B.resample(ticks(spark, sf_dir), "1 hour")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15-minute windows (k, t, strike, final, y, p, market, pnl): did a window end above its start, and forecasts of it.

    p and market are functions of earlier ticks alone: the first price of the window against the last of the previous
    one, squeezed into (0, 1).
    """
    bars = B.resample(ticks(spark, sf_dir), "15 minutes")
    w = B.in_time()
    squeeze = lambda x: F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.round(x, 6)))
    prev = F.coalesce(F.lag("c").over(w), F.col("o"))
    out = bars.withColumn("p", squeeze(F.lit(0.5) + (prev - F.col("o")) / 250)).withColumn("market", squeeze(F.lit(0.5) + (prev - F.col("o")) / 400))
    return out.select("k", "t", F.col("o").alias("strike"), F.col("c").alias("final"), (F.col("c") >= F.col("o")).cast("int").alias("y"), "p", "market", "n")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades (k, t, id, line, entry, qty, pnl, day): one per line item, keyed by return flag."""
    items = table(spark, sf_dir, "lineitem")
    pnl = F.round(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")), 4)
    return items.select(
        F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("reason"), F.col("l_shipdate").alias("t"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("entry"), F.col("l_quantity").alias("qty"), pnl.alias("pnl"),
    )


#: The same shapes in DuckDB SQL, as common table expressions for the oracles.
TICKS = "ticks AS (SELECT event_type AS k, ts AS t, event_id AS id, value AS px, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, user_id, event_id % 2 = 0 AS taker_buy FROM events)"


def bars_sql(name: str, width: str) -> str:
    return (
        f"{name}_all AS (SELECT k, time_bucket(INTERVAL '{width}', t) AS t, first(px ORDER BY t, id) AS o, max(px) AS h, min(px) AS l, last(px ORDER BY t, id) AS c, sum(size) AS v, count(*) AS n FROM (SELECT k, t, id, px, size FROM ticks) GROUP BY 1, 2), "
        f"{name} AS (SELECT * FROM {name}_all QUALIFY t < max(t) OVER (PARTITION BY k))"
    ).replace("time_bucket(INTERVAL '" + width + "', t) AS t, first(px ORDER BY t, id)", "time_bucket(INTERVAL '" + width + "', ts) AS t, first(px ORDER BY ts, id)").replace("last(px ORDER BY t, id)", "last(px ORDER BY ts, id)").replace("SELECT k, t, id, px, size FROM ticks", "SELECT k, t AS ts, id, px, size FROM ticks")


BARS = f"{TICKS}, {bars_sql('bars', '1 hour')}"
WINDOWS = (
    f"{TICKS}, {bars_sql('quarters', '15 minutes')}, windows AS (SELECT k, t, o AS strike, c AS final, CAST(c >= o AS INTEGER) AS y, "
    "greatest(0.01, least(0.99, round(0.5 + (coalesce(lag(c) OVER (PARTITION BY k ORDER BY t), o) - o) / 250, 6))) AS p, "
    "greatest(0.01, least(0.99, round(0.5 + (coalesce(lag(c) OVER (PARTITION BY k ORDER BY t), o) - o) / 400, 6))) AS market, n FROM quarters)"
)
TRADES = (
    "trades AS (SELECT l_returnflag AS k, l_linestatus AS reason, l_shipdate AS t, l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS entry, l_quantity AS qty, "
    "round(l_extendedprice * (l_discount - l_tax), 4) AS pnl FROM lineitem)"
)

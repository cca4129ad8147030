"""Event-time streaming: tumbling, sliding and session windows, deduplication, settlement, keyed state.

Each function takes and returns a streaming DataFrame; drained() runs one to the end of what is there and gives its
result as a table. Watermarks bound the state: rows later than that are dropped, as the source's lateness allows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared_path(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """Events as they arrive in files; event time must be a TIMESTAMP for a watermark."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_into(stream: DataFrame, mode: str, path: str) -> tuple[DataFrame, dict[str, int]]:
    """Runs the query over all that is available, from where an earlier run into `path` ended; its result so far, and
    the number of batches of this run and of rows that state dropped as late.

    Each batch goes to a folder of its own, written anew on a retry, so results are exactly once; in complete mode the
    last batch holds everything.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    said = query.recentProgress
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in said for s in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(f"{path}/out/batch=*"), {"batches": len(said), "dropped": dropped}


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """The result of a run from the beginning over all that is available."""
    return run_into(stream, mode, shared_path(stream.sparkSession))[0]


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy("event_type", w).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("t"), "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str) -> DataFrame:
    w = F.window("ts", width, step)
    return events.withWatermark("ts", late).groupBy("event_type", w).agg(F.count("*").alias("n"), F.max("value").alias("top")).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("t"), "n", "top")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of a user: events less than a gap apart."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("a"), "n")


def once(events: DataFrame, key: str, late: str) -> DataFrame:
    """Events by id, each once, as long as a repeat is no later than `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def settled(positions: DataFrame, prices: DataFrame, within: str, late: str) -> DataFrame:
    """Positions with each price of their key that arrives up to `within` later. One that no price can reach any more,
    as the watermark tells, comes out unsettled, its price null; until then it is open and in the state."""
    p = positions.withWatermark("ts", late).alias("p")
    q = prices.withWatermark("ts", late).alias("q")
    on = (F.col("p.user_id") == F.col("q.user_id")) & (F.col("q.ts") >= F.col("p.ts")) & (F.col("q.ts") <= F.col("p.ts") + F.expr(f"interval {within}"))
    return p.join(q, on, "left_outer").select(F.col("p.event_id").alias("position"), F.col("q.event_id").alias("price"), F.col("q.value").alias("value"))


def running_accounts(events: DataFrame, limit: float) -> DataFrame:
    """State of each user over batches: events seen, sum, and how often the sum passed `limit` and was paid out. An
    account has no end, so its state of three numbers never times out: it grows with users, not with events."""
    out = Ty.StructType([Ty.StructField("user_id", Ty.LongType()), Ty.StructField("n", Ty.LongType()), Ty.StructField("payouts", Ty.LongType())])
    state = Ty.StructType([Ty.StructField("n", Ty.LongType()), Ty.StructField("held", Ty.DoubleType()), Ty.StructField("payouts", Ty.LongType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        n, held, payouts = group.get if group.exists else (0, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for value in rows["value"]:
            held += value
            if held >= limit:
                held, payouts = 0.0, payouts + 1
        n += len(rows)
        group.update((n, held, payouts))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "payouts": [payouts]})

    return events.groupBy("user_id").applyInPandasWithState(step, out, state, "update", GroupStateTimeout.NoTimeout)

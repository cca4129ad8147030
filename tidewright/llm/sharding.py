"""Sharding by global byte-size prefix sums: contiguous shards of nearly equal size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, in_order, written


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per document with its size, shard and gapless slot in the shard.

    Documents stand in order of id (then of checksum and size). A document's global byte offset is its offset inside
    its range partition plus the totals of the partitions before it; it belongs to the shard that holds its middle
    byte, when the whole is cut at `shards` equal targets. Texts are read once, for a table of ids, sizes and checksums,
    and only that is sorted. Any document weighs only its own bytes, so hot sources and copies need no special care.

    Null text counts as empty, and so weighs `overhead`. Null ids come first. Repeated rows are placed one by one. An
    empty table gives no rows. Other columns are not read. A document larger than a target makes its shard that large.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(1).cast("long").alias("_one"))
    rows = written(rows)
    placed = written(in_order(rows, [id_col, "text_crc32", "size"], {"_before": "size", "_rank": "_one"}))
    dropped(rows)
    total = placed.agg(F.sum("size")).first()[0] or 1
    middle = F.col("_before") + F.floor(F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / F.lit(total)), F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_rank") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

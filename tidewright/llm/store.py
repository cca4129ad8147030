"""Reading tables and cutting lineage.

Intermediate results go to the folder in spark.checkpoint.dir, which all executors share, so they survive the
loss of any executor. Only where that is unset and the master is local, as in tests, a temporary folder is used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


_OWNER: ContextVar[list[DataFrame] | None] = ContextVar("owner", default=None)


@contextmanager
def owned() -> Iterator[list[DataFrame]]:
    """Collects the tables that written() makes inside. They belong to the caller, who passes them to dropped() once
    the results that read them are written; nobody else's tables are among them."""
    made: list[DataFrame] = []
    token = _OWNER.set(made)
    try:
        yield made
    finally:
        _OWNER.reset(token)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads take only the columns that they need.

    Spark drops the shuffle files of a finished job once the driver's garbage is collected, so that is asked for. The
    table lasts until it is passed to dropped(), by its maker or by the caller's owned().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if (made := _OWNER.get()) is not None:
        made.append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more; those deleted before are ignored."""
    for t in tables:
        spark = t.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._scratch)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bundled(df: DataFrame, plain: list[str]) -> tuple[DataFrame, list[Column]]:
    """df with all columns but `plain` in one struct, `_rest`, so that their names can't clash with those of results;
    and the columns that give df back."""
    rest = [c for c in df.columns if c not in plain]
    one = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(None).cast("int")
    back = [F.col(f"`{c}`") if c in plain else F.col(f"_rest.`{c}`").alias(c) for c in df.columns]
    return df.select(*(F.col(f"`{c}`") for c in plain), one.alias("_rest")), back


def schema_with(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    """Some columns of df, then those of a DDL string."""
    return T.StructType([df.schema[c] for c in columns] + T.StructType.fromDDL(more).fields)


def looked_up(rows: DataFrame, groups: DataFrame, on: list[str], by: list[str], spread: int = 64) -> DataFrame:
    """rows joined with groups on some columns, where one key may hold any share of the rows: groups are repeated over
    `spread` more keys, over which rows are dealt by a hash of other columns. groups should be much the smaller."""
    dealt = rows.withColumn("_spread", F.pmod(F.xxhash64(*on, *by), F.lit(spread)).cast("int"))
    repeated = groups.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return dealt.join(repeated, [*on, "_spread"]).drop("_spread")


def in_order(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds for each row the exclusive prefix sum of some columns in a total order; `sums` names new column -> column.

    Rows are range-partitioned and written once, so that the partition of a row is settled. Each partition's
    totals (a row per partition) give its base; only prefix sums inside a partition need its rows in order.
    A total order over the rows is the caller's duty; ties may be broken either way.
    """
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy("_part").agg(*(F.sum(c).alias(f"_base_{n}") for n, c in sums.items()))
    bases = bases.select("_part", *(F.coalesce(F.sum(f"_base_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums))
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.select("*", *((F.sum(c).over(inner) - F.col(c)).alias(n) for n, c in sums.items()))
    # One row for each range partition: at most spark.sql.shuffle.partitions rows, whatever the input.
    out = out.join(F.broadcast(bases), "_part")
    return out.select(*df.columns, *((F.col(n) + F.col(f"_base_{n}")).alias(n) for n in sums))

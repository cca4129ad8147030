"""Running sums of a key whose rows are spread over tasks by time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def meet(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """a with the columns of b that it lacks, joined on `names`, where null equals null."""
    mine = b.select(*(F.col(n).alias(f"_r_{n}") for n in names), *(c for c in b.columns if c not in a.columns))
    on = reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names))
    return a.join(mine, on, how).drop(*(f"_r_{n}" for n in names))


def running(rows: DataFrame, key: list[str], time: str, order: list[str], sums: dict[str, str | Column], block: str = "day") -> DataFrame:
    """Adds running sums (the row included) of a key's rows by time, then `order`; `sums` maps a new name to a value.

    A key's time is cut into blocks (a unit of date_trunc). Sums of whole blocks, a row for each key and block, are
    summed up by a window over the key; rows only meet the others of their block. So a key that holds most rows is
    dealt over its blocks, and no task sorts it whole. Sums are as exact as their type: use whole numbers or decimals.
    Null values add nothing; rows of a null time come first, as one block; null keys are a key.
    """
    cut = rows.withColumn("_block", F.date_trunc(block, F.col(time))).withColumns({f"_in_{n}": F.expr(v) if isinstance(v, str) else v for n, v in sums.items()})
    by = [*key, "_block"]
    whole = cut.groupBy(*by).agg(*(F.sum(f"_in_{n}").alias(f"_of_{n}") for n in sums))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select(*by, *(F.coalesce(F.sum(f"_of_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums))
    inside = Window.partitionBy(*by).orderBy(time, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.select("*", *(F.coalesce(F.sum(f"_in_{n}").over(inside), F.lit(0)).alias(f"_own_{n}") for n in sums))
    return meet(own, base, by).select(*(F.col(f"`{c}`") for c in rows.columns), *((F.col(f"_own_{n}") + F.col(f"_base_{n}")).alias(n) for n in sums))

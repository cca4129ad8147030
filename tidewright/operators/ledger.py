"""Trades and ledgers: metrics, groupings, audits, sizing, settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions.scalar import correlation

from .bars import in_time


def trade_metrics(trades: DataFrame) -> DataFrame:
    """Counts, win rate, mean gain and loss, profit factor by k; a trade without gain is a loss; null where empty."""
    win = F.col("pnl") > 0
    out = trades.groupBy("k").agg(
        F.count("*").alias("n"), F.sum(win.cast("long")).alias("winners"), F.avg(win.cast("double")).alias("win_rate"), F.avg(F.when(win, F.col("pnl"))).alias("avg_gain"), F.avg(F.when(~win, F.col("pnl"))).alias("avg_loss"),
        F.sum("pnl").alias("total"), F.sum(F.when(win, F.col("pnl")).otherwise(0.0)).alias("_g"), F.sum(F.when(~win, F.col("pnl")).otherwise(0.0)).alias("_l"),
    )
    return out.withColumn("profit_factor", F.try_divide(F.col("_g"), F.abs("_l"))).drop("_g", "_l")


def sharpe(points: DataFrame, value: str, periods: float = 252.0, bound: float = 10.0) -> DataFrame:
    """Mean over sample deviation of step returns, by year, within bounds; null with under two returns or no spread."""
    ret = points.withColumn("_r", F.try_divide(F.col(value), F.lag(value).over(in_time())) - 1)
    out = ret.groupBy("k").agg(F.avg("_r").alias("m"), F.stddev_samp("_r").alias("s"))
    return out.select("k", F.greatest(F.lit(-bound), F.least(F.lit(bound), F.try_divide(F.col("m"), F.col("s")) * periods**0.5)).alias("sharpe"))


def max_drawdown(points: DataFrame, value: str) -> DataFrame:
    """Largest fall from a peak, in percent of it and in units."""
    peak = F.max(value).over(in_time().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = points.withColumn("_p", peak)
    return out.groupBy("k").agg(F.max(F.try_divide(F.col("_p") - F.col(value), F.col("_p")) * 100).alias("percent"), F.max(F.col("_p") - F.col(value)).alias("units"))


def totals(trades: DataFrame) -> DataFrame:
    """Sums by key, by reason, by year, and overall, in one pass of grouping sets; level tells which."""
    rows = trades.withColumn("year", F.year("t"))
    cube = rows.groupingSets([["k"], ["reason"], ["year"], []], "k", "reason", "year")
    return cube.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum("pnl").alias("pnl"))


def diagnostics(trades: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Outcome of each trade in three states, and percent of its entry."""
    outcome = F.when(F.col("pnl") > eps, "win").when(F.col("pnl") < -eps, "loss").otherwise("breakeven")
    return trades.withColumn("outcome", outcome).withColumn("pct", F.try_divide(F.col("pnl"), F.col("entry")) * 100)


def top_losses(trades: DataFrame, n: int, *order: str) -> DataFrame:
    """The n worst trades."""
    return trades.orderBy("pnl", *order).limit(n)


def concentration(trades: DataFrame, by: str, n: int = 3) -> DataFrame:
    """The share of all gains that the n best groups of each key make."""
    each = trades.groupBy("k", by).agg(F.sum("pnl").alias("pnl")).where("pnl > 0")
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("pnl"), by)))
    return ranked.groupBy("k").agg((F.sum(F.when(F.col("_r") <= n, F.col("pnl")).otherwise(0.0)) / F.sum("pnl")).alias("share"))


def stress(trades: DataFrame, rates: list[float]) -> DataFrame:
    """Totals after a cost of each rate on entry value; passes with half of the total without cost, or if that is none."""
    many = trades.withColumn("rate", F.explode(F.array(*map(F.lit, rates))))
    out = many.groupBy("k", "rate").agg(F.sum("pnl").alias("base"), F.sum(F.col("pnl") - F.col("entry") * F.col("rate")).alias("net"))
    return out.withColumn("passes", (F.col("base") <= 0) | (F.col("net") >= 0.5 * F.col("base")))


def last_wins(rows: DataFrame, key: list[str], newest: list[Column]) -> DataFrame:
    """One row for each key: the one that comes first in `newest`."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """Old rows with new ones over them; of rows of one key the newer source, then the larger sequence, wins."""
    both = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    return last_wins(both, key, [F.desc("_s"), F.desc(sequence)]).drop("_s")


def coverage(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


def weekdays_between(a: Column, z: Column) -> Column:
    """Working days from date a to date z, both included, in closed form."""
    days = F.datediff(z, a) + 1
    rest, start = days % 7, F.weekday(a)
    extra = F.aggregate(F.when(rest > 0, F.sequence(F.lit(0), rest - 1)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda s, i: s + F.when((start + i) % 7 < 5, 1).otherwise(0))
    return F.when(days > 0, F.floor(days / 7) * 5 + extra).otherwise(0)


def edge_gaps(covered: DataFrame, start: Column, end: Column) -> DataFrame:
    """What is missing before and after the covered span of each key; holes inside are not looked for."""
    head, tail = F.struct(F.lit("head").alias("side"), start.alias("a"), F.date_sub(F.to_date("first_t"), 1).alias("z")), F.struct(F.lit("tail").alias("side"), F.date_add(F.to_date("last_t"), 1).alias("a"), end.alias("z"))
    out = covered.select("k", F.explode(F.array(head, tail)).alias("g")).select("k", "g.*").where("a <= z")
    return out.withColumn("missing_days", weekdays_between(F.col("a"), F.col("z")).cast("long"))


def outages(points: DataFrame, longest: str) -> DataFrame:
    """Silences longer than allowed, with all sources taken together."""
    w = Window.partitionBy("k").orderBy("t")
    nxt = points.select("k", "t").distinct().withColumn("z", F.lead("t").over(w))
    return nxt.where(F.col("z") > F.col("t") + F.expr(f"interval {longest}")).select("k", F.col("t").alias("a"), "z")


def merged(spans: DataFrame, closer: str) -> DataFrame:
    """Spans (k, a, z) less than `closer` apart become one."""
    w = Window.partitionBy("k").orderBy("a")
    starts = F.coalesce(F.col("a") >= F.lag("z").over(w) + F.expr(f"interval {closer}"), F.lit(True)).cast("int")
    grouped = spans.withColumn("_n", starts).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy("k", "_g").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.count("*").alias("n")).drop("_g")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def out_of_order(rows: DataFrame, sequence: str, block: Column | None = None) -> DataFrame:
    """Rows whose time lies before that of the row before them in sequence.

    `block` must rise with the sequence: rows then meet only others of their block and the last row of the one before,
    so that a hot key is dealt over its blocks. Without it a key is one block.
    """
    by = F.struct(F.col(sequence))
    cut = rows.select("k", (F.lit(0) if block is None else block).alias("_block"), F.lit(1).alias("_own"), by.alias("_s"), F.col("t").alias("_t"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"))
    ends = cut.groupBy("k", "_block").agg(F.max_by("_t", "_s").alias("_t"))
    follows = F.lead("_block").over(Window.partitionBy("k").orderBy("_block"))
    carried = ends.select("k", follows.alias("_block"), F.lit(0).alias("_own"), F.lit(None).cast(cut.schema["_s"].dataType).alias("_s"), "_t", F.lit(None).cast(cut.schema["_row"].dataType).alias("_row")).where("_block is not null")
    before = F.lag("_t").over(Window.partitionBy("k", "_block").orderBy("_own", "_s"))
    return cut.unionByName(carried).withColumn("_p", before).where((F.col("_own") == 1) & (F.col("_t") < F.col("_p"))).select("_row.*")


def position_size(price: Column, stop: Column, equity: Column, cash: Column, risk: float, exposure: float) -> Column:
    """Whole units within risk, exposure and cash, but at least one."""
    by_risk, by_exposure, by_cash = F.try_divide(equity * risk, F.abs(price - stop)), F.try_divide(equity * exposure, price), F.try_divide(cash, price)
    return F.greatest(F.lit(1), F.floor(F.least(by_risk, by_exposure, by_cash))).cast("long")


def first_failing(*rules: tuple[Column, str], ok: str = "ok") -> Column:
    """The code of the first rule that holds."""
    out = F.lit(ok)
    for condition, code in reversed(rules):
        out = F.when(condition, code).otherwise(out)
    return out


def all_failing(*rules: tuple[Column, str]) -> Column:
    """Codes of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, code) for c, code in rules)))


def first_qualifying(rows: DataFrame, qualifies: Column, *order: str) -> DataFrame:
    """Exactly one row for each key: the first that qualifies."""
    hits = rows.where(qualifies)
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(*order))).where("_r = 1").drop("_r")


def future_label_canary(rows: DataFrame, fields: list[str], outcome: str, bound: float = 0.95) -> DataFrame:
    """Fields that follow the outcome too closely to be known before it."""
    long = rows.unpivot([outcome], fields, "field", "value")
    return long.groupBy("field").agg(F.abs(correlation("value", outcome)).alias("r")).withColumn("leaks", F.coalesce(F.col("r") > bound, F.lit(False)))


def parity(live: DataFrame, replay: DataFrame, key: list[str], value: str, quantum: float = 1e-4) -> DataFrame:
    """Rows of either side that the other lacks or that differ by more than a quantum."""
    both = live.select(*key, F.col(value).alias("live")).join(replay.select(*key, F.col(value).alias("replay")), key, "full")
    return both.where(F.col("live").isNull() | F.col("replay").isNull() | (F.abs(F.col("live") - F.col("replay")) > quantum))

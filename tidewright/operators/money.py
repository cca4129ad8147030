"""Money of ledgers, to the cent: what each account should hold, and seven checks of what its rows say.

Amounts are whole cents (bigint), prices of fills decimals of a cent; nothing is a floating number.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prefix import meet, running

#: Names of the checks, in order.
CHECKS = ("fee-parity", "stake-parity", "pnl-parity", "win-flag-consistency", "bankroll-conservation", "treatments-ev-parity", "skip-row-hygiene")
#: A stamp may lack the stakes of so many trades that were placed but not settled when it was made.
IN_FLIGHT = 4


def order_fee(contracts: Column, ask: Column) -> Column:
    """The fee of an order in cents: 7 % of contracts * p * (1 - p), rounded up once; ask in cents."""
    raw = contracts.cast("decimal(12,0)") * ask.cast("decimal(8,4)") * (F.lit(100) - ask.cast("decimal(8,4)")) * F.lit(7).cast("decimal(1,0)")
    return F.ceil(raw / F.lit(10000).cast("decimal(5,0)")).cast("long")


def contract_fee(contracts: Column, ask: Column) -> Column:
    """The older fee: rounded up for each contract."""
    one = ask.cast("decimal(8,4)") * (F.lit(100) - ask.cast("decimal(8,4)")) * F.lit(7).cast("decimal(1,0)")
    return contracts * F.ceil(one / F.lit(10000).cast("decimal(5,0)")).cast("long")


def settled() -> Column:
    return ~F.coalesce(F.col("skipped"), F.lit(False)) & F.col("win").isNotNull() & F.col("actual").isin(0, 1)


def _cents(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long")


def row_checks(ledger: DataFrame) -> DataFrame:
    """Adds a column for each check that a row alone decides: true, false, or null where it doesn't apply.

    Ledger rows have ask (cents, decimal), contracts, stake_c, pnl_c, win, actual (1 up, 0 not), side (yes, no),
    skipped. A fee may follow either rule, within a cent where ask is no whole number; what was debited counts for
    the stake, whose tolerance is a cent.
    """
    ask = F.col("ask").cast("decimal(8,4)")
    cost = F.col("contracts").cast("decimal(12,0)") * ask
    implied = _cents("stake_c").cast("decimal(24,4)") - cost
    whole = ask == F.floor(ask)
    slack = F.when(whole, F.lit(0)).otherwise(F.lit(1))
    now, old = order_fee(F.col("contracts"), ask), contract_fee(F.col("contracts"), ask)
    near = lambda fee: F.abs(implied - fee) <= slack
    taken = F.when(near(now), now.cast("decimal(24,4)")).when(near(old), old.cast("decimal(24,4)")).otherwise(implied)
    won = F.when(F.col("side") == "yes", F.col("actual") == 1).otherwise(F.col("actual") == 0)
    due = F.when(F.col("win"), F.col("contracts") * 100 - _cents("stake_c")).otherwise(-_cents("stake_c"))
    ok = {"fee-parity": near(now) | near(old), "stake-parity": F.abs(_cents("stake_c") - cost - taken) <= 1, "pnl-parity": _cents("pnl_c") == due, "win-flag-consistency": F.col("win") == won}
    return ledger.withColumns({name: F.when(settled(), F.coalesce(c, F.lit(False))) for name, c in ok.items()})


def cash_walk(ledger: DataFrame, start: Column, block: str = "month") -> DataFrame:
    """Adds walk_c (cash before this row, for a skipped one, or after it) and saved_c (all skims so far).

    A row moves cash by pnl - skim - withdrawal. One that settled late (late_t) moves it by -stake - skim - withdrawal,
    and its payout, pnl + stake, is a row of its own, dated late_t, ahead of ledger rows of that time or later. Rows of
    an account are ordered by t, then id; a hot account is dealt over blocks of time.
    """
    late = F.col("late_t").isNotNull()
    moved = F.when(settled(), F.when(late, -_cents("stake_c")).otherwise(_cents("pnl_c")) - _cents("skim_c") - _cents("wd_c")).otherwise(F.lit(0))
    row = F.struct(*(F.col(c) for c in ledger.columns))
    mine = ledger.select("k", "t", F.lit(1).alias("_late"), "id", row.alias("_row"), moved.cast("decimal(38,0)").alias("_d"), F.when(settled(), _cents("skim_c")).otherwise(F.lit(0)).cast("decimal(38,0)").alias("_s"))
    paid = ledger.where(late).select(
        "k", F.col("late_t").alias("t"), F.lit(0).alias("_late"), "id", F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), (_cents("pnl_c") + _cents("stake_c")).cast("decimal(38,0)").alias("_d"), F.lit(0).cast("decimal(38,0)").alias("_s")
    )
    summed = running(mine.unionByName(paid), ["k"], "t", ["_late", "id"], {"_walk": "_d", "_saved": "_s"}, block).where("_late = 1")
    return summed.select("_row.*", F.col("_walk").cast("long").alias("_w"), F.col("_saved").cast("long").alias("saved_c")).withColumn("walk_c", F.col("_w") + start).drop("_w")


class _Stamps:
    """A block's stamps in order: their shifts, the sums of the next one, two ... stakes, and what they say."""

    def __init__(self, frame: pd.DataFrame):
        self.shift = frame["shift"].to_numpy(np.int64)
        self.flights = np.cumsum(np.column_stack([frame[f"next_{i}"].to_numpy(np.float64) for i in range(1, IN_FLIGHT + 1)]), axis=1)  # NaN: no such row
        self.skipped, self.saved = frame["skipped"].to_numpy(bool), frame["saved"].to_numpy(bool)

    def next_off(self, state: int, at: int, verdicts: np.ndarray | None = None) -> int:
        """The first row from `at` whose stamp changes the shift `state`, or their number. Verdicts of the rows passed over
        and of that one: 1 the stamp agrees, 0 it doesn't, -1 open stakes explain it."""
        width = 64
        while at < len(self.shift):
            rows = slice(at, at + width)
            gap, skipped, saved = state - self.shift[rows], self.skipped[rows], self.saved[rows]
            open_ = ~skipped & saved & (gap != 0) & (self.flights[rows] == gap[:, None]).any(axis=1)
            off = np.flatnonzero(~skipped & (gap != 0) & ~open_)
            if verdicts is not None:
                verdicts[rows] = np.where(open_, -1, (gap == 0) & (skipped | saved))
            if len(off):
                return at + int(off[0])
            at, width = at + len(gap), min(2 * width, 1 << 14)
        return at

    def after(self, state: int, at: int, known: list[tuple[int, int]] | None = None, end: int = 0) -> tuple[int, list[tuple[int, int]]]:
        """The shift after the last row, and each row that changed it with the shift from there. Once it is that of a walk
        that is known, it ends as that does."""
        trail: list[tuple[int, int]] = []
        while (at := self.next_off(state, at)) < len(self.shift):
            state = int(self.shift[at])
            if known and (i := bisect_right(known, at, key=lambda x: x[0])) and known[i - 1][1] == state:
                return end, trail
            trail.append((at, state))
            at += 1
        return state, trail


def _change(frame: pd.DataFrame) -> pd.DataFrame:
    """What a block does to the shift: a few shifts by name, and all others; nothing where no row can change it."""
    rows = frame[~frame["skipped"]].sort_values(["t", "id"])
    out = {"k": frame["k"].iloc[:1].tolist(), "block": frame["block"].iloc[:1].tolist(), "at_key": [[]], "at_value": [[]], "other": [None]}
    if len(rows):
        stamps = _Stamps(rows)
        shift = int(stamps.shift[0])
        other, trail = stamps.after(shift, 1)
        names = sorted({shift} | {shift + int(x) for x in stamps.flights[0] if x == x}) if stamps.saved[0] else []
        out |= {"at_key": [names], "at_value": [[stamps.after(s, 0, [(0, shift), *trail], other)[0] for s in names]], "other": [other]}
    return pd.DataFrame(out).astype({"other": "Int64"})


def _judged(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["t", "id"])
    stamps, state, at = _Stamps(frame), int(frame["start"].iloc[0]), 0
    verdicts = np.zeros(len(frame), np.int8)
    while (at := stamps.next_off(state, at, verdicts)) < len(frame):
        state, at = int(stamps.shift[at]), at + 1
    out = frame[["k", "t", "id"]].copy()
    out["agrees"] = pd.arrays.BooleanArray(verdicts == 1, verdicts == -1)
    return out


def bankroll(walked: DataFrame, block: str = "month") -> DataFrame:
    """Adds to rows of cash_walk stamp_ok (does the stamp bankroll_c say what the account should hold?) and in_flight.

    A stamp may be short by exactly the stakes of the next one to IN_FLIGHT rows, which were paid but not settled yet:
    it is in flight, and the walk goes on. Any other stamp is off, and the walk goes on from it, so that lost money
    shows once. The savings stamp, savings_c, must be the sum of skims so far. A skipped row's stamp must agree, but
    moves nothing. stamp_ok is null without a stamp, and for open and in-flight rows. (k, t, id) must name a row.

    Whether a stamp is off hangs on the last one that was, through all rows of the account. A block of rows changes
    that shift in a way that is known without its start: the few shifts that agree with its first stamp, or that open
    stakes explain there, may pass through; any other becomes the first stamp's. So blocks are summed up side by side,
    a row for each block is walked by account, and blocks are then judged side by side, each from its start.
    """
    by = Window.partitionBy("k", "_block").orderBy("t", "id")
    cut = walked.withColumn("_block", F.date_trunc(block, F.col("t")).cast("string"))
    inside = cut.select("*", F.row_number().over(by).alias("_i"), F.collect_list(_cents("stake_c")).over(by.rowsBetween(1, IN_FLIGHT)).alias("_own"))
    # The next rows' stakes go on in the blocks after, of which the first few rows are enough.
    heads = inside.where(F.col("_i") <= IN_FLIGHT).groupBy("k", "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", _cents("stake_c").alias("s")))), lambda x: x.s).alias("head"))
    heads = heads.select("k", "_block", F.flatten(F.collect_list("head").over(Window.partitionBy("k").orderBy("_block").rowsBetween(1, IN_FLIGHT))).alias("_after"))
    stamps = meet(inside, heads, ["k", "_block"]).where(F.col("bankroll_c").isNotNull() & (settled() | F.coalesce("skipped", F.lit(False))))
    thin = stamps.select(
        "k", "t", "id", F.col("_block").alias("block"), (F.col("bankroll_c") - F.col("walk_c")).alias("shift"), *(F.get(F.concat("_own", "_after"), F.lit(i)).alias(f"next_{i + 1}") for i in range(IN_FLIGHT)),
        F.coalesce("skipped", F.lit(False)).alias("skipped"), (F.col("savings_c").isNull() | (F.col("savings_c") == F.col("saved_c"))).alias("saved"),
    )
    kind = walked.schema["k"].dataType.simpleString()
    blocks = thin.groupBy("k", "block").applyInPandas(_change, f"k {kind}, block string, at_key array<long>, at_value array<long>, other long")
    ordered = blocks.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("block", "at_key", "at_value", "other"))).alias("b"))  # a row for each block
    after = lambda s, x: F.coalesce(F.try_element_at(F.map_from_arrays(x.at_key, x.at_value), s), x.other, s)
    walk = F.aggregate("b", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(after(F.element_at(acc, -1), x))))
    starts = ordered.select("k", "b", walk.alias("w")).select("k", F.posexplode(F.arrays_zip(F.transform("b", lambda x: x.block).alias("block"), F.slice("w", F.lit(1), F.size("b")).alias("start"))).alias("i", "x"))
    starts = starts.select("k", F.col("x.block").alias("block"), F.col("x.start").alias("start"))
    found = meet(thin, starts, ["k", "block"]).groupBy("k", "block").applyInPandas(_judged, f"k {kind}, t timestamp_ntz, id long, agrees boolean").withColumn("_seen", F.lit(True))
    out = meet(walked, found, ["k", "t", "id"], "left")
    return out.select(*walked.columns, F.col("agrees").alias("stamp_ok"), F.coalesce(F.col("_seen") & F.col("agrees").isNull(), F.lit(False)).alias("in_flight"))


def audit(ledger: DataFrame, start: Column, block: str = "month") -> DataFrame:
    """Ledger rows with a column for each of CHECKS that rows decide: true, false, or null where it doesn't apply."""
    out = bankroll(cash_walk(row_checks(ledger), start, block), block)
    skipped = F.coalesce("skipped", F.lit(False))
    idle = (_cents("stake_c") == 0) & (_cents("pnl_c") == 0) & (F.coalesce("contracts", F.lit(0)) == 0)
    out = out.withColumn("bankroll-conservation", F.when(~skipped & F.col("in_flight"), F.lit(True)).when(~skipped, F.col("stamp_ok")))
    return out.withColumn("skip-row-hygiene", F.when(skipped, idle & F.coalesce("stamp_ok", F.lit(True))))


def ev_parity(ledger: DataFrame, treatments: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Treatments (ticker, ev) whose window has a settled trade (ticker, ask, fee_c, win), with what the trade earned
    for its cost, and whether ev says so. The fee of a contract counts in whole cents."""
    cost = F.col("ask").cast("double") + F.ceil(F.coalesce("fee_c", F.lit(0.0)) - 1e-9)
    due = F.when(F.col("win"), (F.lit(100.0) - cost) / cost).otherwise(-1.0)
    trades = ledger.where(settled()).select("ticker", due.alias("due"))
    return treatments.where("ev is not null").join(trades, "ticker").withColumn("treatments-ev-parity", F.abs(F.col("ev") - F.col("due")) <= tolerance)


def report(audited: DataFrame, parity: DataFrame, least: int = 50) -> DataFrame:
    """A row for each check: rows checked, mismatches, status. Too few windows with a treatment are a mismatch."""
    of_rows = [c for c in CHECKS if c != "treatments-ev-parity"]
    stack = lambda df, names: df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("ok")) for n in names))).alias("x")).select("x.*")
    rows = stack(audited, of_rows).unionByName(stack(parity, ["treatments-ev-parity"]))
    every = rows.unionByName(audited.sparkSession.createDataFrame([(n, None) for n in CHECKS], "name string, ok boolean"))
    out = every.groupBy("name").agg(F.count("ok").alias("rows"), F.count_if(~F.col("ok")).alias("mismatches"))
    few = (F.col("name") == "treatments-ev-parity") & (F.col("rows") < least)
    out = out.withColumn("mismatches", F.col("mismatches") + few.cast("long"))
    return out.withColumn("status", F.when(F.col("mismatches") == 0, "OK").otherwise("FAIL"))

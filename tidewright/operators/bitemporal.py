"""As-of joins with two times: when something happened, and when it was received.

A decision at t may use what had been received by t, whatever happened later or arrives later; of that, the latest by
event time counts. Late and revised rows make the two orders differ, so neither order alone answers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

MINUTE = 60_000_000


def micros(t: Column) -> Column:
    """A time as microseconds; whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def _time(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


class Received:
    """Rows in order of event time, asked for the last one up to a place that had been received by some time."""

    def __init__(self, event: np.ndarray, received: np.ndarray, value: np.ndarray):
        order = np.lexsort((value, received, event))
        self.event, self.value = event[order], value[order]
        self.least = [received[order]]  # least[l][i]: the earliest receipt of 2**l rows from i
        while 2 << (len(self.least) - 1) <= len(event):
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def last(self, place: np.ndarray, by: np.ndarray) -> np.ndarray:
        """For each place the last row there or before that was received by `by`, or -1: whole stretches of rows that
        came later are passed over, the longest first."""
        at = place.copy()
        for l in range(len(self.least) - 1, -1, -1):
            first = at - (1 << l) + 1
            ask = first >= 0
            skip = np.zeros(len(at), bool)
            skip[ask] = self.least[l][first[ask]] > by[ask]
            at[skip] -= 1 << l
        return at

    def upto(self, event: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The row of the latest event time, `event` at most, that was received by `by`; of revisions of one event the
        last received."""
        return self.last(np.searchsorted(self.event, event, "right") - 1, by)

    def before(self, at: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The row of the next earlier event time."""
        out = np.full(len(at), -1)
        some = at >= 0
        out[some] = self.last(np.searchsorted(self.event, self.event[at[some]], "left") - 1, by[some])
        return out


def _features(rows: Received, t: np.ndarray, max_age: int, horizons: dict[str, int], steps: int, infinite: bool = False) -> dict[str, np.ndarray]:
    oldest = t - max_age

    def fresh(at: np.ndarray) -> np.ndarray:
        out = at.copy()
        out[at >= 0] = np.where(rows.event[at[at >= 0]] >= oldest[at >= 0], at[at >= 0], -1)
        return out

    value = lambda at: np.where(at >= 0, rows.value[at], np.nan) if len(rows.value) else np.full(len(at), np.nan)
    event = lambda at: np.where(at >= 0, rows.event[at], 0) if len(rows.event) else np.zeros(len(at), np.int64)
    last = fresh(rows.upto(t, t))
    out = {"value": value(last), "event": event(last), "has": last >= 0}
    previous = fresh(rows.before(last, t))
    out["present"], out["change"] = previous >= 0, value(last) - value(previous)
    for name, span in horizons.items():
        past = fresh(rows.upto(event(last) - span, t))
        base = value(np.where(past >= 0, past, last))
        with np.errstate(divide="ignore", invalid="ignore"):
            change = 100 * (value(last) - base) / base
        out[f"ret_{name}"] = np.ma.masked_array(change, last < 0) if infinite else np.where(base != 0, change, np.nan)
    changes = np.full((steps, len(t)), np.nan)
    newer = last
    for i in range(steps):
        older = fresh(rows.before(newer, t))
        with np.errstate(divide="ignore", invalid="ignore"):
            changes[i] = np.where(value(older) != 0, 100 * (value(newer) - value(older)) / value(older), np.nan)
        newer = older
    n = np.sum(~np.isnan(changes), axis=0)
    mean = np.nansum(changes, axis=0) / np.maximum(n, 1)
    spread = np.sqrt(np.nansum((changes - mean) ** 2, axis=0) / np.maximum(n - 1, 1))
    out["vol"] = np.where(n >= 2, spread, np.nan)
    return out


def exogenous(decisions: DataFrame, series: DataFrame, horizons: dict[str, str], max_age: str = "1 day", piece: str = "7 days", steps: int = 6, open_minutes: float = 10.0, prefix: str = "x", infinite: bool = False) -> DataFrame:
    """Decisions (k, t, ...) with features of an outside series (k, t: event time, received, value) as known at t.

    Only rows count whose event lies within `max_age` before t and which were received by t. {prefix}_t and
    {prefix}_value are the latest by event time; _staleness_min its age; _change its value less the one before; _ret_x
    for each of `horizons` its percent change on the latest row at or before that span earlier, on itself where there is
    none, null on a value of 0 (or what the division gives, infinite or NaN, if `infinite`); _vol the sample deviation of the last `steps` percent changes from row to row; _present whether there are two
    rows; _open whether the latest is under `open_minutes` old. Without two rows all but _present are null. A row of an
    event received again revises it from then on. Rows with a null time, receipt or value count as never received;
    decisions of a null time or key get no features.

    One shuffle, by key and piece of time: a row goes to each piece in which a decision may use it, one or two if a
    piece is longer than max_age. So a hot key is dealt over its pieces, and a task holds the series of one piece.
    """
    us = lambda span: int(pd.Timedelta(span).value // 1000)
    age, width, spans = us(max_age), us(piece), {n: us(s) for n, s in horizons.items()}
    row = F.struct(*(F.col(f"`{c}`") for c in decisions.columns))
    asked = decisions.select(F.col("k").alias("_k"), F.floor(micros(F.col("t")) / width).alias("_piece"), row.alias("_row"), micros(F.col("t")).alias("_t"), F.lit(None).cast("long").alias("_r"), F.lit(None).cast("double").alias("_v"))
    known = series.where("t is not null and received is not null and value is not null and k is not null").select(F.col("k").alias("_k"), micros(F.col("t")).alias("_t"), micros(F.col("received")).alias("_r"), F.col("value").cast("double").alias("_v"))
    first, final = F.floor(F.greatest("_t", "_r") / width), F.floor((F.col("_t") + age) / width)
    known = known.where(F.col("_r") <= F.col("_t") + age).select("_k", F.explode(F.sequence(first, F.greatest(first, final))).alias("_piece"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), "_t", "_r", "_v")
    names = ["value", "event", "has", "present", "change", *(f"ret_{n}" for n in spans), "vol"]
    kinds = {"event": Ty.LongType(), "has": Ty.BooleanType(), "present": Ty.BooleanType()}
    schema = Ty.StructType([asked.schema["_row"], *(Ty.StructField(f"_{n}", kinds.get(n, Ty.DoubleType())) for n in names)])

    def features(group: pa.Table) -> pa.Table:
        mine = pc.is_valid(group.column("_row"))
        rows, wanted = group.filter(pc.invert(mine)), group.filter(mine)
        array = lambda t, c, kind: t.column(c).combine_chunks().cast(kind).to_numpy(zero_copy_only=False)
        held = Received(array(rows, "_t", pa.int64()), array(rows, "_r", pa.int64()), array(rows, "_v", pa.float64()))
        t = pc.fill_null(wanted.column("_t"), -(1 << 62)).combine_chunks().to_numpy(zero_copy_only=False)
        found = _features(held, t, age, spans, steps, infinite)
        return pa.Table.from_arrays([wanted.column("_row"), *(pa.array(found[n]) if isinstance(found[n], np.ma.MaskedArray) else pa.array(found[n], from_pandas=True) for n in names)], ["_row", *(f"_{n}" for n in names)])

    out = asked.unionByName(known).groupBy("_k", "_piece").applyInArrow(features, schema)
    ok = F.col("_present")
    age_min = (micros(F.col("_row.t")) - F.col("_event")) / MINUTE
    return out.select(
        "_row.*", ok.alias(f"{prefix}_present"), F.when(ok, _time(F.col("_event"))).alias(f"{prefix}_t"), F.when(ok, age_min).alias(f"{prefix}_staleness_min"), F.when(ok, age_min < open_minutes).alias(f"{prefix}_open"),
        *(F.when(ok, F.col(f"_{n}")).alias(f"{prefix}_{n}") for n in ("value", "change", *(f"ret_{n}" for n in spans), "vol")),
    )

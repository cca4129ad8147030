"""Episodes of one step, and learners of action values.

Learners whose steps are linear in what they learn are summed up by slice of time, side by side, and the sums of a
learner's slices are put together after that, in order: the result is that of one pass over all its rows, but no task
holds more than a slice. The logistic learner is not linear; it reads its key's rows in order, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import discretised


def episodes(bars: DataFrame, horizons: dict[str, str], lookback: int, slots: tuple[str, ...] = (), zone: str = "UTC") -> DataFrame:
    """(k, day, t, horizon, state, price_now, price_future, target_slot): a decision at each bar with at least
    `lookback` bars of its day before it, for each horizon at whose exact end the day has a bar.

    The state of a bar knows its own day alone; so keys are dealt over their days. target_slot tells whether the
    horizon ends at one of `slots` (HH:mm) in the zone.
    """
    day = bars.withColumn("_key", F.col("k")).withColumn("k", F.struct(F.col("k").alias("k"), F.to_date("t").alias("day")))
    known = discretised(day).withColumn("_i", F.row_number().over(Window.partitionBy("k").orderBy("t"))).where(F.col("_i") > lookback)
    ends = F.explode(F.array(*(F.struct(F.lit(n).alias("horizon"), (F.col("t") + F.expr(f"interval {s}")).alias("end")) for n, s in horizons.items())))
    asked = known.select("k", "t", F.concat_ws("", "state").alias("state"), F.col("c").alias("price_now"), ends.alias("e")).select("*", "e.*").drop("e")
    out = asked.join(day.select("k", F.col("t").alias("end"), F.col("c").alias("price_future")), ["k", "end"])
    local = F.date_format(F.from_utc_timestamp(F.col("end"), zone), "HH:mm")
    return out.select("k.k", F.col("k.day").alias("day"), "t", "horizon", "state", "price_now", "price_future", local.isin(*slots).alias("target_slot") if slots else F.lit(False).alias("target_slot"))


def prediction_reward(predicted: Column, actual: Column, band: Column, shaped: bool = True) -> Column:
    """1 within the band; outside -1, or shaped: 2 less the miss in bands, down to -1."""
    u = F.abs(predicted - actual) / F.greatest(band, F.lit(1e-9))
    return F.when(u <= 1, 1.0).otherwise(F.greatest(F.lit(-1.0), 2 - u) if shaped else F.lit(-1.0))


def tabular_q(rows: DataFrame, alpha: float = 0.1, by: str = "month") -> DataFrame:
    """(k, state, action, q, n): the value that each action of each state ends with, after steps q += alpha * (r - q)
    from 0 over its rows (k, t, id, state, action, r) in order.

    A slice of n rows turns q into (1 - alpha)**n * q + s, whatever q is, so s and n sum it up.
    """
    who = ["k", "state", "action"]
    cut = rows.withColumn("_s", F.date_trunc(by, F.col("t")))
    w = Window.partitionBy(*who, "_s")
    left = F.count("*").over(w) - F.row_number().over(w.orderBy("t", "id"))
    each = cut.select(*who, "_s", (F.lit(alpha) * F.pow(F.lit(1 - alpha), left) * F.col("r")).alias("_v"))
    slices = each.groupBy(*who, "_s").agg(F.sum("_v").alias("_v"), F.count("*").alias("_n"))
    after = F.coalesce(F.sum("_n").over(Window.partitionBy(*who).orderBy("_s").rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    return slices.withColumn("_v", F.col("_v") * F.pow(F.lit(1 - alpha), after)).groupBy(*who).agg(F.sum("_v").alias("q"), F.sum("_n").alias("n"))


def linear_q(rows: DataFrame, features: list[str], rate: float = 0.01, by: str = "month") -> DataFrame:
    """(k, arm, w, pulls): the weights of each arm after steps w += rate * (r - w.x) * x from 0 over its rows (k, t, id,
    arm, r and features) in order; missing features are 0.

    A slice turns w into M w + v, whatever w is, so the matrix and the vector sum it up: d * (d + 1) numbers.
    """
    d = len(features)
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("k", "arm")}
    cut = rows.select("k", "arm", "t", "id", F.date_trunc(by, F.col("t")).cast("string").alias("_s"), F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features)).alias("x"), F.col("r").cast("double").alias("r"))

    def slice_of(g: pd.DataFrame) -> pd.DataFrame:
        m, v = np.eye(d), np.zeros(d)
        g = g.sort_values(["t", "id"])
        for x, r in zip(np.stack(g["x"].to_list()), g["r"].to_numpy(), strict=True):
            m -= rate * np.outer(x, x @ m)
            v += rate * (r - x @ v) * x
        first = g.iloc[0]
        return pd.DataFrame({"k": [first["k"]], "arm": [first["arm"]], "_s": [first["_s"]], "m": [m.ravel()], "v": [v], "n": [len(g)]})

    def together(g: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros(d)
        for m, v in zip(g.sort_values("_s")["m"], g.sort_values("_s")["v"], strict=True):
            w = np.asarray(m).reshape(d, d) @ w + v
        return pd.DataFrame({"k": g["k"].iloc[:1].tolist(), "arm": g["arm"].iloc[:1].tolist(), "w": [w], "pulls": [int(g["n"].sum())]})

    slices = cut.groupBy("k", "arm", "_s").applyInPandas(slice_of, f"k {kind['k']}, arm {kind['arm']}, _s string, m array<double>, v array<double>, n long")
    return slices.groupBy("k", "arm").applyInPandas(together, f"k {kind['k']}, arm {kind['arm']}, w array<double>, pulls long")


def binary_logit(rows: DataFrame, features: list[str], rate: float = 0.05, shrink: float = 1e-4, slow: float = 400.0) -> DataFrame:
    """(k, t, id, y, p): the chance that the learner gave each row before it learnt its outcome, by one step of
    gradient descent on the log loss a row, of a rate that falls with the number of rows seen.

    Every step hangs on the one before, so a key is one sequence; its rows come sorted and only the weights are held.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("k", "t", "id")}
    put = rows.select("k", "t", "id", F.col("y").cast("int").alias("y"), *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)))
    names = [f"x{i}" for i in range(len(features))]

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, w, n = object(), None, 0
        for f in frames:
            p = np.empty(len(f))
            for i, (k, y, x) in enumerate(zip(f["k"].tolist(), f["y"].to_numpy(float), f[names].to_numpy(), strict=True)):
                if k != key:
                    key, w, n = k, np.zeros(len(names)), 0
                p[i] = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                if y == y:
                    w = w - rate / (1 + n / slow) * ((p[i] - y) * x + shrink * w)
                    n += 1
            yield f[["k", "t", "id", "y"]].assign(p=p)

    return put.repartition("k").sortWithinPartitions("k", "t", "id").mapInPandas(learn, f"k {kinds['k']}, t {kinds['t']}, id {kinds['id']}, y int, p double")

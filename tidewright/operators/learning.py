"""Small learners whose state is inherently sequential, one per key, in Arrow-fed pandas groups.

A key's rows are handled by one task in order of time; parallelism is over keys (series, arms, horizons).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _logit(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> tuple[float, float]:
    """Ridge logistic fit of y on x, starting from and drawn towards the identity."""
    w = np.array([0.0, 1.0])
    a = np.stack([np.ones_like(x), x], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * (w - np.array([0.0, 1.0]))
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    return float(np.clip(w[0], -3, 3)), float(np.clip(w[1], 0.1, 3))


def online_platt(rows: DataFrame, window: int = 50, every: int = 3, warm: int = 20, ridge: float = 1.0) -> DataFrame:
    """Adds p_cal: each forecast calibrated by a fit on the `window` settled rows before it, refitted every few rows."""
    kind = rows.schema["k"].dataType.simpleString()

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t").reset_index(drop=True)
        x, y, out, w = _logit(g["p"].to_numpy()), g["y"].to_numpy(float), np.empty(len(g)), (0.0, 1.0)
        for i in range(len(g)):
            if i >= warm and (i - warm) % every == 0:
                w = _newton(x[max(0, i - window) : i], y[max(0, i - window) : i], ridge, 8)
            out[i] = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x[i], -30, 30)))
        return pd.DataFrame({"k": g["k"], "t": g["t"], "y": g["y"], "p": g["p"], "p_cal": out})

    return rows.select("k", "t", "y", "p").groupBy("k").applyInPandas(work, f"k {kind}, t timestamp_ntz, y int, p double, p_cal double")


def linucb(rows: DataFrame, features: list[str], arms: int, alpha: float = 0.5) -> DataFrame:
    """Adds arm and reward: a linear bandit picks one of `arms` columns reward_0.. by upper confidence, and learns from
    the reward of the arm it picked."""
    kind = rows.schema["k"].dataType.simpleString()
    d = len(features) + 1

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t").reset_index(drop=True)
        x = np.column_stack([np.ones(len(g)), g[features].fillna(0.0).to_numpy(float)])
        rewards = g[[f"reward_{a}" for a in range(arms)]].to_numpy(float)
        inverse, b = [np.eye(d) for _ in range(arms)], np.zeros((arms, d))
        picked = np.zeros(len(g), int)
        for i, v in enumerate(x):
            upper = [v @ inverse[a] @ b[a] + alpha * np.sqrt(v @ inverse[a] @ v) for a in range(arms)]
            a = picked[i] = int(np.argmax(upper))
            u = inverse[a] @ v
            inverse[a] -= np.outer(u, u) / (1 + v @ u)  # the inverse after one more row
            b[a] += rewards[i, a] * v
        return pd.DataFrame({"k": g["k"], "t": g["t"], "arm": picked, "reward": rewards[np.arange(len(g)), picked]})

    return rows.groupBy("k").applyInPandas(work, f"k {kind}, t timestamp_ntz, arm int, reward double")


def quantile_regression(rows: DataFrame, features: list[str], target: str, tau: float, steps: int = 600, rate: float = 0.5) -> DataFrame:
    """One row per key: weights of a linear quantile by subgradient steps over all its rows, and their pinball loss."""
    kind = rows.schema["k"].dataType.simpleString()

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=[*features, target])
        x = g[features].to_numpy(float)
        mean, sd = x.mean(0), x.std(0)
        x = np.column_stack([np.ones(len(g)), (x - mean) / np.where(sd > 0, sd, 1)])
        y = g[target].to_numpy(float)
        scale = y.std() or 1.0
        w = np.zeros(x.shape[1])
        w[0] = np.quantile(y, tau)
        for s in range(steps):
            e = y - x @ w
            w += rate * scale / np.sqrt(s + 1) * x.T @ np.where(e >= 0, tau, tau - 1) / len(y)
        e = y - x @ w
        return pd.DataFrame({"k": [g["k"].iloc[0]], "n": [len(g)], "weights": [w.tolist()], "pinball": [np.mean(np.maximum(tau * e, (tau - 1) * e))]})

    return rows.select("k", *features, target).groupBy("k").applyInPandas(work, f"k {kind}, n long, weights array<double>, pinball double")


def weighted_logistic(rows: DataFrame, features: list[str], target: str, weight: str, epochs: int = 5, rate: float = 0.05) -> DataFrame:
    """One row per key: weights of a logistic model after passes over its rows in order of time."""
    kind = rows.schema["k"].dataType.simpleString()

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        x = np.column_stack([np.ones(len(g)), g[features].fillna(0.0).to_numpy(float)])
        y, c, w = g[target].to_numpy(float), g[weight].to_numpy(float), np.zeros(len(features) + 1)
        for _ in range(epochs):
            for v, t, m in zip(x, y, c, strict=True):
                w -= rate * m * (1 / (1 + np.exp(-np.clip(v @ w, -30, 30))) - t) * v
        return pd.DataFrame({"k": [g["k"].iloc[0]], "n": [len(g)], "weights": [w.tolist()]})

    return rows.groupBy("k").applyInPandas(work, f"k {kind}, n long, weights array<double>")


def boosted_chance(train: DataFrame, test: DataFrame, features: list[str], target: str, rounds: int = 20) -> DataFrame:
    """test with chance: scaled features, boosted trees, and an isotonic fit of their scores on the training rows."""
    assemble = VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip")
    scale = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(assemble.transform(train))
    ready = lambda df: scale.transform(assemble.transform(df))
    model = GBTClassifier(featuresCol="_x", labelCol=target, maxIter=rounds, maxDepth=3, seed=1).fit(ready(train).withColumn(target, F.col(target).cast("double")))
    score = lambda df: model.transform(ready(df)).withColumn("_s", vector_to_array("probability")[1])
    fit = IsotonicRegression(featuresCol="_s", labelCol=target).fit(score(train).withColumn(target, F.col(target).cast("double")).drop("prediction"))
    return fit.transform(score(test).drop("prediction")).withColumnRenamed("prediction", "chance").drop("_raw", "_x", "_s", "rawPrediction", "probability")

"""Queries of the battery of checks and of events in news."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import battery as Y
from tidewright.operators.structure import EVENT_WORDS
from tidewright.sources import tables as T

from .registry import add
from .shaping import r, rounded


def _settled(spark, d):
    w = T.windows(spark, d).withColumn("close_t", F.col("t") + F.expr("interval 15 minutes"))
    p = F.when(F.col("n") % 9 == 0, F.col("y").cast("double")).otherwise(F.col("p"))
    cut = lambda x: F.greatest(F.lit(1.0), F.least(F.lit(99.0), 100 * F.col("market") + x))
    return w.select("k", "t", F.when(F.col("n") % 7 != 0, F.col("close_t")).otherwise(F.col("t")).alias("close_t"), p.alias("p"), "market", "y", cut(-2).alias("bid"), cut(2).alias("ask"))


def evaluation_battery(spark, d):
    return rounded(Y.battery(_settled(spark, d)))


def evaluation_verdicts(spark, d):
    x = Y.verdict(Y.battery(_settled(spark, d)))
    return x.select("k", "verdict", F.concat_ws(",", "failed").alias("failed"))


_E = (
    f"{T.WINDOWS}, e AS (SELECT k, t, CASE WHEN n % 7 <> 0 THEN t + INTERVAL 15 MINUTES ELSE t END AS close_t, CASE WHEN n % 9 = 0 THEN y::DOUBLE ELSE p END AS p, market, y, greatest(1.0, least(99.0, 100 * market - 2)) AS bid, greatest(1.0, least(99.0, 100 * market + 2)) AS ask FROM windows), "
    "st AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i, lag(y) OVER (PARTITION BY k ORDER BY t) AS py FROM e), pl AS (SELECT k, count(*) FILTER (NOT t < close_t)::DOUBLE AS timestamp_ordering, (count(*) - count(DISTINCT t))::DOUBLE AS duplicate_windows, count(*) FILTER (p = y AND p IN (0, 1)) / count(*) AS outcome_leak_canary, avg((market - y) * (market - y)) AS market_brier, "
    "avg((CASE WHEN py = 1 THEN 0.999 ELSE 0.001 END - y) * (CASE WHEN py = 1 THEN 0.999 ELSE 0.001 END - y)) FILTER (i > 1) AS persistence_brier FROM st GROUP BY k)"
)
_TEXT = "regexp_replace(rtrim(strftime(t, '%Y-%m-%d %H:%M:%S.%f'), '0'), '[.]$', '')"
_DEALT = lambda seed, value, other: f"(SELECT a.k, a.{other}, b.{value} FROM (SELECT k, {other}, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM e) a JOIN (SELECT k, {value}, row_number() OVER (PARTITION BY k ORDER BY md5(concat('{seed}', {_TEXT})), t) AS i FROM e) b ON b.k = a.k AND b.i = a.i)"
_AUC = lambda rows: f"(SELECT k, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0) AS auc FROM (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0 AS rk FROM {rows}) GROUP BY k)"
_RAND = (
    f"rd AS (SELECT *, substr(md5(concat_ws(':', '7', k, {_TEXT})), 1, 1) >= '8' AS up FROM e), rc AS (SELECT *, CASE WHEN up THEN ask ELSE 100 - bid END AS a FROM rd), rg AS (SELECT k, avg(CASE WHEN up = (y = 1) THEN (100 - a - 7 * (a / 100) * (1 - a / 100)) / (a + 7 * (a / 100) * (1 - a / 100)) ELSE -1 END) AS g FROM rc GROUP BY k)"
)
_CHECKS = (
    f"{_E}, ls AS {_AUC(_DEALT(7, 'y', 'p'))}, ps AS {_AUC(_DEALT(8, 'p', 'y'))}, {_RAND}, wide AS (SELECT pl.*, ls.auc AS label_shuffle, ps.auc AS prediction_shuffle, g AS random_strategy FROM pl JOIN ls ON ls.k = pl.k JOIN ps ON ps.k = pl.k JOIN rg ON rg.k = pl.k), "
    "lg AS (UNPIVOT wide ON COLUMNS(* EXCLUDE (k)) INTO NAME name VALUE value), res AS (SELECT k, name AS \"check\", value, CASE WHEN name IN ('timestamp_ordering', 'duplicate_windows') THEN CASE WHEN value = 0 THEN 'PASS' ELSE 'FAIL' END WHEN name = 'outcome_leak_canary' THEN CASE WHEN value < 0.01 THEN 'PASS' ELSE 'FAIL' END "
    "WHEN name IN ('label_shuffle', 'prediction_shuffle') THEN CASE WHEN value BETWEEN 0.4 AND 0.6 THEN 'PASS' ELSE 'FAIL' END WHEN name = 'random_strategy' THEN CASE WHEN value < 0.05 THEN 'PASS' ELSE 'FAIL' END END AS result FROM lg)"
)
add("evaluation_battery", evaluation_battery, f"WITH {_CHECKS} SELECT k, \"check\", {r('value')} AS value, result FROM res")
add("evaluation_verdicts", evaluation_verdicts, f"WITH {_CHECKS}, f AS (SELECT k, coalesce(string_agg(\"check\", ',' ORDER BY \"check\") FILTER (result = 'FAIL'), '') AS failed FROM res GROUP BY k) SELECT k, CASE WHEN failed <> '' THEN 'EVAL_INVALID' ELSE 'PASS' END AS verdict, failed FROM f")


def news_events(spark, d):
    """Whole documents as titles and their language as a topic, by source; their times follow from their numbers."""
    x = T.table(spark, d, "documents").select(F.col("source").alias("k"), F.col("text").alias("title"), F.when(F.col("doc_id") % 97 == 0, F.array(F.lit("Inflation"), F.col("lang"))).otherwise(F.array("lang")).alias("topics"), F.timestamp_add("MINUTE", -(F.col("doc_id") % 1700), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("time_published"), ((F.col("doc_id") % 100) / 120).alias("score"))
    return Y.major_events(x, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


_HIT = " ".join("WHEN " + " OR ".join([f"list_has_any(topics, [{', '.join(repr(w) for w in words)}])", *(f"contains(lower(title), '{w}')" for w in words)]) + f" THEN '{name}'" for name, words in EVENT_WORDS)
add(
    "news_events",
    news_events,
    "WITH x AS (SELECT source AS k, coalesce(text, '') AS title, CASE WHEN doc_id % 97 = 0 THEN ['inflation', lower(lang)] ELSE [lower(lang)] END AS topics, doc_id % 1700 AS age, (doc_id % 100) / 120 AS score FROM documents), "
    f"dy AS (SELECT *, CASE {_HIT} END AS e, row_number() OVER (PARTITION BY k ORDER BY age, title) AS i, min(age) OVER (PARTITION BY k) <= 60 AS any_ FROM x WHERE age <= 1440) "
    "SELECT k, coalesce(arg_min(e, i) FILTER (e IS NOT NULL AND CASE WHEN any_ THEN age <= 60 ELSE i <= 5 END), CASE WHEN max(abs(score)) > 0.5 THEN 'other' END, 'none') AS event, count(*) AS articles FROM dy GROUP BY k",
)

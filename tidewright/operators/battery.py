"""Checks that an evaluation must pass before its numbers count, and events told by news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluation import permutation_rows, rank_auc
from .live import economic_replay
from .structure import EVENT_WORDS

#: Checks in order; the first six decide.
HARD = ("timestamp_ordering", "duplicate_windows", "outcome_leak_canary", "label_shuffle", "prediction_shuffle", "random_strategy")


def random_side(seed: int) -> Column:
    """Up or down by a hash of seed, key and time, as any engine can draw it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "k", F.col("t").cast("string"))), 1, 1), 16, 10).cast("int") >= 8


def battery(rows: DataFrame, window: str = "t", seed: int = 7, leak: float = 0.01, chance: tuple[float, float] = (0.40, 0.60), most: float = 0.05) -> DataFrame:
    """(k, check, value, result) of settled forecasts (k, t, close_t, p, market, y, bid, ask): rows not before their close;
    windows (told by a column) that occur again; the share of forecasts that are the label itself; the area under the
    curve of forecasts against labels dealt anew, and of forecasts dealt anew, which must be near a half; the mean gain of
    a random side at real costs, which must not be one; and, without a result, the Brier scores of the market and of the
    last outcome. What can't be computed passes. Deals are hashes of seed and time."""
    exact = ((F.col("p") == 0) & (F.col("y") == 0)) | ((F.col("p") == 1) & (F.col("y") == 1))
    last = F.when(F.lag("y").over(Window.partitionBy("k").orderBy("t")) == 1, 0.999).otherwise(0.001)
    first = F.row_number().over(Window.partitionBy("k").orderBy("t")) == 1
    brier = lambda p: F.avg(F.pow(p - F.col("y"), F.lit(2.0)))
    x = rows.withColumn("_last", F.when(~first, last))
    plain = x.groupBy("k").agg(
        F.count_if(~F.coalesce(F.col("t") < F.col("close_t"), F.lit(False))).cast("double").alias("timestamp_ordering"), (F.count("*") - F.count_distinct(window)).cast("double").alias("duplicate_windows"),
        (F.count_if(exact) / F.count("*")).alias("outcome_leak_canary"), brier(F.col("market")).alias("market_brier"), brier(F.col("_last")).alias("persistence_brier"),
    )
    thin = rows.select("k", "t", "p", "y")
    labels = rank_auc(permutation_rows(thin, "y", seed)).withColumnRenamed("auc", "label_shuffle")
    forecasts = rank_auc(permutation_rows(thin, "p", seed + 1)).withColumnRenamed("auc", "prediction_shuffle")
    drawn = economic_replay(rows.select("k", F.col("t").alias("w"), F.when(random_side(seed), 1.0).otherwise(0.0).alias("p"), "bid", "ask", "y"), 0.0)
    every = plain.join(labels, "k", "left").join(forecasts, "k", "left").join(drawn.select("k", F.col("ev_per_eligible").alias("random_strategy")), "k", "left")
    long = every.unpivot(["k"], [*HARD, "market_brier", "persistence_brier"], "check", "value")
    v, name = F.col("value"), F.col("check")
    ok = F.when(name.isin("timestamp_ordering", "duplicate_windows"), v == 0).when(name == "outcome_leak_canary", v < leak).when(name.isin("label_shuffle", "prediction_shuffle"), v.between(*chance)).when(name == "random_strategy", v < most)
    return long.withColumn("result", F.when(name.isin(*HARD), F.when(F.coalesce(ok, F.lit(True)), "PASS").otherwise("FAIL")))


def verdict(checks: DataFrame) -> DataFrame:
    """By k whether the evaluation counts, and the checks that it failed, by name."""
    bad = F.array_sort(F.collect_list(F.when(F.col("result") == "FAIL", F.col("check"))))
    return checks.groupBy("k").agg(bad.alias("failed")).select("k", F.when(F.size("failed") > 0, "EVAL_INVALID").otherwise("PASS").alias("verdict"), "failed")


#: An answer of a news service: articles with their topics and the sentiment towards each ticker, numbers as text.
_SENTIMENTS = "array<struct<ticker: string, relevance_score: string, ticker_sentiment_score: string, ticker_sentiment_label: string>>"
_FEED = f"feed array<struct<title: string, url: string, time_published: string, source: string, summary: string, overall_sentiment_score: string, overall_sentiment_label: string, topics: array<struct<topic: string>>, ticker_sentiment: {_SENTIMENTS}>>"


def articles(payloads: DataFrame, column: str = "body") -> DataFrame:
    """Articles (k, title, url, time_published, source, summary, score, label, topics, tickers) of JSON answers (k, body). A
    note or an error instead of a feed, or no JSON, has none; an article without a readable time, YYYYMMDDTHHMM with
    seconds or without, is left out, as is one whose score isn't a number. Missing texts are empty, a missing score 0, a
    missing label Neutral; entries without a topic or ticker are dropped."""
    one = payloads.select("k", F.explode(F.from_json(column, _FEED)["feed"]).alias("a"))
    digits = F.regexp_replace(F.col("a.time_published"), "T", "")
    when = F.coalesce(F.when(F.length(digits) == 14, F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))), F.when(F.length(digits) == 12, F.try_to_timestamp(digits, F.lit("yyyyMMddHHmm")))).cast("timestamp_ntz")
    text = lambda c, other="": F.coalesce(F.col(f"a.{c}"), F.lit(other))
    score = F.when(F.col("a.overall_sentiment_score").isNull(), 0.0).otherwise(F.col("a.overall_sentiment_score").try_cast("double"))
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    named = F.filter(F.coalesce("a.ticker_sentiment", F.array().cast(_SENTIMENTS)), lambda s: s.ticker.isNotNull())
    tickers = F.transform(named, lambda s: F.struct(s.ticker.alias("ticker"), number(s.relevance_score).alias("relevance"), number(s.ticker_sentiment_score).alias("score"), F.coalesce(s.ticker_sentiment_label, F.lit("Neutral")).alias("label")))
    topics = F.array_compact(F.coalesce(F.transform("a.topics", lambda t: t.topic), F.array().cast("array<string>")))
    out = one.select("k", text("title").alias("title"), text("url").alias("url"), when.alias("time_published"), text("source").alias("source"), text("summary").alias("summary"), score.alias("score"), text("overall_sentiment_label", "Neutral").alias("label"), topics.alias("topics"), tickers.alias("tickers"))
    return out.where("time_published is not null and score is not null")


def article_event() -> Column:
    """The first of the families of EVENT_WORDS that an article is of: one of its topics is such a word, or its title holds
    one; null if none."""
    low, found = F.lower(F.coalesce("title", F.lit(""))), F.lit(None).cast("string")
    mine = F.transform(F.coalesce("topics", F.array().cast("array<string>")), F.lower)
    for name, words in reversed(EVENT_WORDS):
        hit = F.arrays_overlap(mine, F.array(*map(F.lit, words)))
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        found = F.when(F.coalesce(hit, F.lit(False)), name).otherwise(found)
    return found


def major_events(news: DataFrame, now: Column, strong: float = 0.5, few: int = 5) -> DataFrame:
    """(k, event, articles): the event that news (k, title, topics, time_published, score) up to `now` tell. Looked at are
    the articles of the last hour, or without any the latest few of the last day, the latest first; the first that is of a
    family decides. If none is, a score beyond `strong` on either side in the last day makes it `other`, else `none`.
    Articles counts the last day's. Of one time the first title counts first."""
    day = news.where((F.col("time_published") <= now) & (F.col("time_published") >= now - F.expr("interval 24 hours")))
    hour = F.col("time_published") >= now - F.expr("interval 1 hour")
    latest = Window.partitionBy("k").orderBy(F.desc("time_published"), "title")
    x = day.withColumn("_e", article_event()).withColumn("_r", F.row_number().over(latest))
    x = x.withColumn("_any", F.max(hour.cast("int")).over(Window.partitionBy("k")) == 1)
    seen = F.when(F.col("_any"), hour).otherwise(F.col("_r") <= few)
    first = F.min_by("_e", F.when(seen & F.col("_e").isNotNull(), F.col("_r")))
    out = x.groupBy("k").agg(first.alias("_f"), F.max(F.abs("score")).alias("_s"), F.count("*").alias("articles"))
    return out.select("k", F.coalesce("_f", F.when(F.col("_s") > strong, "other"), F.lit("none")).alias("event"), "articles")

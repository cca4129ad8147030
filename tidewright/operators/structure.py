"""Market structure and the chain from candidate to decision, as projections and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions.scalar import clamp

from .bars import in_time


def breaks(swung: DataFrame, trends: DataFrame) -> DataFrame:
    """Breaks of structure: each swing level once, at the first later bar of the key (from its second on) that closes
    beyond it. In an uptrend only breaks downwards count, in a downtrend only upwards, in a ranging one both; with an
    unknown trend there are none. Levels of one price are one level."""
    bars = swung.withColumn("_i", F.row_number().over(in_time())).where("_i > 1").select("k", "t", "c")
    up = swung.where("swing_high").select("k", F.col("h").alias("level"), F.lit("bullish").alias("direction"))
    down = swung.where("swing_low").select("k", F.col("l").alias("level"), F.lit("bearish").alias("direction"))
    levels = up.unionByName(down).distinct().join(trends.select("k", "trend"), "k")
    levels = levels.where(F.when(F.col("trend") == "uptrend", F.col("direction") == "bearish").when(F.col("trend") == "downtrend", F.col("direction") == "bullish").otherwise(F.col("trend") == "ranging"))
    beyond = F.when(F.col("direction") == "bullish", F.col("c") > F.col("level")).otherwise(F.col("c") < F.col("level"))
    return levels.join(bars, "k").where(beyond).groupBy("k", "direction", "level").agg(F.min("t").alias("t"))


def change_of_character(broken: DataFrame, trends: DataFrame) -> DataFrame:
    """One row per key: the first break against the trend, or where there is none to speak of, the first break whose
    direction differs from the first break's."""
    b = broken.join(trends.select("k", "trend"), "k")
    first = F.first("direction").over(Window.partitionBy("k").orderBy("t", "direction", "level").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    b = b.withColumn("_f", first)
    against = F.when(F.col("trend") == "uptrend", F.col("direction") == "bearish").when(F.col("trend") == "downtrend", F.col("direction") == "bullish").otherwise(F.col("direction") != F.col("_f"))
    return b.where(against).groupBy("k").agg(F.min_by(F.struct("t", "direction", "level"), F.struct("t", "direction", "level")).alias("e")).select("k", "e.t", "e.direction", "e.level")


def candidates(bars: DataFrame, stop_atr: float = 1.5, target_atr: float = 3.0, least_rr: float = 1.5) -> DataFrame:
    """Long candidates with a stop and a target in multiples of atr; a row without atr is none."""
    out = bars.where((F.col("atr") > 0) & (F.col("expected") > 0))
    out = out.withColumn("entry", F.col("c")).withColumn("stop", F.col("c") - stop_atr * F.col("atr")).withColumn("target", F.col("c") + target_atr * F.col("atr"))
    out = out.withColumn("rr", F.try_divide(F.col("target") - F.col("entry"), F.col("entry") - F.col("stop")))
    return out.where((F.col("stop") > 0) & (F.col("rr") >= least_rr - 1e-9))


def nearest_above(swung: DataFrame, bars: int = 200, side: int = 5) -> DataFrame:
    """Adds above: the least swing high above the close, of the last `bars` bars; those of the last `side` - 1 are not
    known yet."""
    seen = F.collect_list(F.when(F.col("swing_high"), F.col("h"))).over(in_time().rowsBetween(-bars, -side))
    return swung.withColumn("above", F.array_min(F.filter(seen, lambda h: h > F.col("c"))))


def nearest_below(swung: DataFrame, bars: int = 200, side: int = 5) -> DataFrame:
    """Adds below: the greatest swing low below the close, as nearest_above."""
    seen = F.collect_list(F.when(F.col("swing_low"), F.col("l"))).over(in_time().rowsBetween(-bars, -side))
    return swung.withColumn("below", F.array_max(F.filter(seen, lambda x: x < F.col("c"))))


def sided_candidates(bars: DataFrame, stop_atr: float = 1.5) -> DataFrame:
    """A candidate on the side of the expected return (side: long or short) for each bar with an atr, entered at the
    close, with a stop some atr away; none where the stop would not be a price."""
    long = F.col("expected") > 0
    out = bars.where((F.col("atr") > 0) & (F.col("expected") != 0)).withColumn("side", F.when(long, "long").otherwise("short")).withColumn("entry", F.col("c"))
    return out.withColumn("stop", F.col("c") - F.when(long, stop_atr).otherwise(-stop_atr) * F.col("atr")).where("stop > 0")


def trend_strength() -> Column:
    """The share of the last swings that follow the trend, from higher_highs and higher_lows of trend()."""
    up = (F.col("higher_highs") + F.col("higher_lows")) / 2
    return F.when(F.col("trend") == "uptrend", up).when(F.col("trend") == "downtrend", 1 - up).when(F.col("trend") == "ranging", F.greatest(up, 1 - up)).otherwise(0.0)


#: Reasons to refuse a candidate, in order.
REFUSALS = ("REWARD_RISK_BELOW_THRESHOLD", "FTA_NOT_CLEARED", "WEAK_STRUCTURE", "POOR_LIQUIDITY", "UNSUITABLE_VOLATILITY", "INSUFFICIENT_FTA_DISTANCE")


def trouble_score(rows: DataFrame, least_rr: float = 2.0, least_distance: float = 0.005) -> DataFrame:
    """Scores a candidate on either side against the first trouble ahead, with every reason to refuse it.

    Rows have side, entry, stop, expected (return), above and below (the far edges of the nearest zones, null if there
    are none: then 10 % away), trend, strength, last_break (bullish, bearish or null), relative_volume, spread_estimate,
    atr and regime. Adds trouble, distance (a share of the entry), reward_risk, structure_score, liquidity_score,
    volatility_ok, cleared (does the expected price pass the trouble by least_distance?), score, reasons, accepted.
    """
    long = F.col("side") == "long"
    entry, sign = F.col("entry"), F.when(long, 1.0).otherwise(-1.0)
    trouble = F.when(long, F.coalesce("above", entry * 1.10)).otherwise(F.coalesce("below", entry * 0.90))
    out = rows.withColumn("trouble", trouble)
    gap = sign * (F.col("trouble") - entry)
    risk = F.abs(entry - F.col("stop"))
    reward = F.greatest(entry * F.abs("expected"), 0.8 * gap)
    out = out.withColumn("distance", gap / entry).withColumn("reward_risk", F.when(risk > 0, F.try_divide(reward, risk)).otherwise(0.0))
    along = F.when(F.col("trend") == F.when(long, "uptrend").otherwise("downtrend"), 1.0).when(F.col("trend") == "ranging", 0.4).when(F.col("trend").isin("uptrend", "downtrend"), 0.1).otherwise(0.2)
    broke = F.when(F.col("last_break").isNull(), 0.0).when((F.col("last_break") == "bullish") == long, 0.2).otherwise(-0.2)
    out = out.withColumn("structure_score", clamp(0.5 * along + 0.3 * F.coalesce("strength", F.lit(0.0)) + 0.2 * broke, 0.0, 1.0))
    volume = F.least(F.coalesce("relative_volume", F.lit(0.0)) / 2, F.lit(1.0))
    wide = (F.col("spread_estimate") > 0) & (F.col("atr") > 0) & (F.col("spread_estimate") > 0.05 * F.col("atr"))
    out = out.withColumn("liquidity_score", volume * F.when(wide, 0.7).otherwise(1.0))
    atr_share = F.coalesce(F.try_divide(F.col("atr"), entry), F.lit(0.0))
    out = out.withColumn("volatility_ok", F.col("regime").isin("low", "normal") & (atr_share <= 0.05))
    margin = sign * (entry * (1 + F.col("expected")) - F.col("trouble")) / entry
    out = out.withColumn("cleared", (sign * F.col("expected") > 0) & (margin > least_distance))
    holds = (F.col("reward_risk") < least_rr, ~F.col("cleared"), F.col("structure_score") < 0.35, F.col("liquidity_score") < 0.25, ~F.col("volatility_ok"), F.col("distance") < least_distance)
    score = 0.35 * F.least(F.col("reward_risk") / 4, F.lit(1.0)) + 0.25 * F.col("cleared").cast("double") + 0.2 * F.col("structure_score") + 0.15 * F.col("liquidity_score") + 0.05 * F.col("volatility_ok").cast("double")
    out = out.withColumn("score", score).withColumn("reasons", F.array_compact(F.array(*(F.when(c, name) for c, name in zip(holds, REFUSALS, strict=True)))))
    return out.withColumn("accepted", F.size("reasons") == 0)


def probability(confidence: Column, reward_risk: Column, strength: Column, volume: Column, regime: Column) -> Column:
    """A heuristic chance: a weighted sum of five parts, clipped. Of regimes low counts most, extreme not at all."""
    level = F.when(regime == "low", 0.0).when(regime == "high", 2.0).when(regime == "extreme", 3.0).otherwise(1.0)
    parts = 0.35 * confidence + 0.25 * F.least(reward_risk / 4, F.lit(1.0)) + 0.2 * strength + 0.1 * F.least(volume / 2, F.lit(1.0)) + 0.1 * (1 - level / 3)
    return clamp(parts, 0.0, 1.0)


#: Families of words, in order of precedence.
EVENT_WORDS = (
    ("earnings", ("earnings", "financial results", "eps", "revenue", "guidance")),
    ("merger", ("mergers & acquisitions", "merger", "acquisition", "m&a", "buyout")),
    ("regulatory", ("regulation", "regulatory", "sec", "antitrust", "ftc", "doj", "compliance")),
    ("macro", ("federal reserve", "interest rates", "inflation", "gdp", "economy", "macro", "fed")),
)


def event_type(text: Column) -> Column:
    """The first family with a word contained anywhere in the text."""
    low = F.lower(text)
    out = F.lit("none")
    for name, words in reversed(EVENT_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def news_features(articles: DataFrame, now: Column) -> DataFrame:
    """By k: counts in the last hour and day, mean and population deviation of sentiment, largest deviation from the
    mean, minutes since the last article (9999 without one)."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("t").cast("timestamp"))
    past = articles.withColumn("_age", age).where("_age >= 0")
    day = F.col("_age") <= 86_400
    mean = F.avg(F.when(day, F.col("sentiment")))
    out = past.groupBy("k").agg(F.sum((F.col("_age") <= 3_600).cast("long")).alias("n_1h"), F.sum(day.cast("long")).alias("n_24h"), mean.alias("mean"), F.stddev_pop(F.when(day, F.col("sentiment"))).alias("spread"), F.max(F.when(day, F.col("sentiment"))).alias("_hi"), F.min(F.when(day, F.col("sentiment"))).alias("_lo"), F.min("_age").alias("_last"))
    return out.select("k", "n_1h", "n_24h", "mean", "spread", F.greatest(F.col("_hi") - F.col("mean"), F.col("mean") - F.col("_lo")).alias("surprise"), F.coalesce(F.col("_last") / 60, F.lit(9999.0)).alias("minutes_since"))


def splits(rows: DataFrame, train: float = 0.7, validate: float = 0.15) -> DataFrame:
    """Adds part: train, validate or test by place in time, cut at whole rows."""
    w = Window.partitionBy("k")
    i, n = F.row_number().over(in_time()) - 1, F.count("*").over(w)
    return rows.withColumn("part", F.when(i < F.floor(n * train), "train").when(i < F.floor(n * (train + validate)), "validate").otherwise("test"))


def walk_forward(rows: DataFrame, folds: int) -> DataFrame:
    """Rows of each expanding fold: fold f trains on the first f of folds + 1 slices and tests on the next."""
    w = Window.partitionBy("k")
    piece = F.floor((F.row_number().over(in_time()) - 1) * (folds + 1) / F.count("*").over(w))
    many = rows.withColumn("_s", piece).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    return many.where(F.col("_s") <= F.col("fold")).withColumn("part", F.when(F.col("_s") < F.col("fold"), "train").otherwise("test")).drop("_s")


def settle(predictions: DataFrame, bars: DataFrame, horizon: str) -> DataFrame:
    """Point predictions (k, t, pred, band) with the close at t + horizon: signed error, absolute error, hit within
    the band. Where that bar is missing the prediction stays open (null)."""
    later = bars.select("k", (F.col("t") - F.expr(f"interval {horizon}")).alias("t"), F.col("c").alias("actual"))
    out = predictions.join(later, ["k", "t"], "left").withColumn("err", F.col("pred") - F.col("actual"))
    return out.withColumn("abs_err", F.abs("err")).withColumn("hit", (F.col("abs_err") <= F.col("band")).cast("int"))


def conformal_band(settled: DataFrame, rows: int = 100, least: int = 20, share: float = 0.1) -> DataFrame:
    """Adds lo and hi: signed errors at the lower index of their quantiles among the rows before this one."""
    past = in_time().rowsBetween(-rows, -1)
    x = F.array_sort(F.collect_list("err").over(past))
    at = lambda q: F.get(x, F.floor(F.lit(q) * F.size(x)).cast("int"))
    return settled.withColumn("lo", F.when(F.size(x) >= least, at(share))).withColumn("hi", F.when(F.size(x) >= least, at(1 - share)))


def leader(rows: DataFrame, arm: str, win: str, loss: str, last: int = 10, least: int = 5) -> DataFrame:
    """One row per key: the arm with the best win rate over its last rows, then the smaller loss."""
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy("k", arm).orderBy(F.desc("t")))).where(F.col("_r") <= last)
    each = r.groupBy("k", arm).agg(F.count("*").alias("n"), F.avg(win).alias("rate"), F.avg(loss).alias("loss")).where(F.col("n") >= least)
    return each.groupBy("k").agg(F.max_by(arm, F.struct("rate", -F.col("loss"), arm)).alias("leader"))

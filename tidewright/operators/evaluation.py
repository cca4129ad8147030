"""Forecast evaluation: scores, calibration, tests, sweeps, economics.

Rows are windows: k (series or arm), t, y (0 or 1), p (forecast), market (reference forecast). The unit of every
statistic is the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions import scalar as S

from .bars import in_time


def brier(p: str = "p", y: str = "y") -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0)))


def log_loss(p: str = "p", y: str = "y", eps: float = 1e-6) -> Column:
    q = S.clamp(F.col(p), eps, 1 - eps)
    return -F.avg(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))


def scores(rows: DataFrame) -> DataFrame:
    """Brier score, log loss and Brier skill against the reference, by k."""
    out = rows.groupBy("k").agg(F.count("*").alias("n"), brier().alias("brier"), brier("market").alias("market_brier"), log_loss().alias("log_loss"))
    return out.withColumn("skill", 1 - F.try_divide(F.col("brier"), F.col("market_brier")))


def rank_auc(rows: DataFrame) -> DataFrame:
    """Area under the curve with half credit for ties, from average ranks; null with one class only."""
    counts = rows.groupBy("k", "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = counts.withColumn("_w", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    out = won.groupBy("k").agg(F.sum("_w").alias("w"), F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    return out.select("k", F.try_divide(F.col("w"), F.col("pos") * F.col("neg")).alias("auc"))


def slice_number(parts: int, order: list[Column], key: str = "k") -> Column:
    """Which of `parts` slices sorted[i * n // parts : (i + 1) * n // parts] a row is in; remainders differ from ntile."""
    w = Window.partitionBy(key)
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    return F.floor(((i + 1) * parts - 1) / n)


def equal_count_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal count, by k; fewer rows than bins leave some empty."""
    cut = rows.withColumn("_b", slice_number(bins, [F.col("p"), F.col("t")]))
    each = cut.groupBy("k", "_b").agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return each.groupBy("k").agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Forecasts and outcomes in bins of equal width, the last closed."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy("k", b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("forecast"), F.avg("y").alias("outcome"))


def confusion(rows: DataFrame, tau: float = 0.5) -> DataFrame:
    """Counts, accuracy, precision, recall and F1, 0 where undefined."""
    said, true = F.col("p") >= tau, F.col("y") == 1
    count = lambda c, n: F.sum(c.cast("long")).alias(n)
    out = rows.groupBy("k").agg(count(said & true, "tp"), count(said & ~true, "fp"), count(~said & true, "fn"), count(~said & ~true, "tn"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = out.withColumn("accuracy", zero(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))))
    out = out.withColumn("precision", zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))).withColumn("recall", zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))))
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def by_class(rows: DataFrame) -> DataFrame:
    """Precision and recall of either class."""
    out = confusion(rows)
    return out.select(
        "k", F.col("precision").alias("precision_up"), F.col("recall").alias("recall_up"),
        F.coalesce(F.try_divide(F.col("tn"), F.col("tn") + F.col("fn")), F.lit(0.0)).alias("precision_down"), F.coalesce(F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")), F.lit(0.0)).alias("recall_down"),
    )


def at_taus(rows: DataFrame, taus: list[float]) -> DataFrame:
    """Rows of each confidence setting, from a list in code."""
    return rows.withColumn("confidence", F.greatest(F.col("p"), 1 - F.col("p"))).withColumn("right", ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")).withColumn("tau", F.explode(F.array(*map(F.lit, taus))))


def selective_accuracy(rows: DataFrame, taus: list[float]) -> DataFrame:
    """Coverage and accuracy of forecasts at least so confident."""
    keep = F.col("confidence") >= F.col("tau")
    return at_taus(rows, taus).groupBy("k", "tau").agg(F.avg(keep.cast("double")).alias("coverage"), F.avg(F.when(keep, F.col("right"))).alias("accuracy"))


def precision_tau(rows: DataFrame, taus: list[float], target: float, least: int = 25) -> DataFrame:
    """The smallest tau whose forecasts reach the target precision; taus from the first with too few rows on are out."""
    keep = F.col("confidence") >= F.col("tau")
    each = at_taus(rows, taus).groupBy("k", "tau").agg(F.sum(keep.cast("long")).alias("n"), F.avg(F.when(keep, F.col("right"))).alias("precision"))
    alive = F.min((F.col("n") >= least).cast("int")).over(Window.partitionBy("k").orderBy("tau")) == 1
    return each.withColumn("_ok", alive & (F.col("precision") >= target)).groupBy("k").agg(F.min(F.when(F.col("_ok"), F.col("tau"))).alias("tau"))


def regression_scores(rows: DataFrame, forecast: str, actual: str, naive: str) -> DataFrame:
    """MAE, RMSE, and their squared and absolute ratios to a naive forecast on the same rows; null if that is perfect."""
    e, b = F.col(forecast) - F.col(actual), F.col(naive) - F.col(actual)
    out = rows.where(e.isNotNull() & b.isNotNull()).groupBy("k").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(b)).alias("_nm"), F.avg(b * b).alias("_ns"), F.avg(e * e).alias("_s"))
    return out.select("k", "n", "mae", "rmse", F.try_divide(F.col("mae"), F.col("_nm")).alias("mase"), F.try_divide(F.col("_s"), F.col("_ns")).alias("msse"))


def pinball(x: Column, q: Column, tau: float) -> Column:
    return F.when(x >= q, tau * (x - q)).otherwise((1 - tau) * (q - x))


def interval_scores(rows: DataFrame, actual: str, low: str, high: str) -> DataFrame:
    """Pinball losses at 10 and 90 %, width and coverage of an interval."""
    x = F.col(actual)
    return rows.where(F.col(low).isNotNull()).groupBy("k").agg(
        F.avg(pinball(x, F.col(low), 0.1)).alias("pinball_low"), F.avg(pinball(x, F.col(high), 0.9)).alias("pinball_high"), F.avg(F.col(high) - F.col(low)).alias("sharpness"), F.avg(x.between(F.col(low), F.col(high)).cast("double")).alias("coverage")
    )


def pesaran_timmermann(rows: DataFrame, least: int = 20) -> DataFrame:
    """z of the directional test from three shares; null with too few rows or without variance."""
    up = (F.col("p") >= 0.5).cast("double")
    out = rows.groupBy("k").agg(F.count("*").alias("n"), F.avg((up == F.col("y")).cast("double")).alias("hit"), F.avg(up).alias("px"), F.avg("y").alias("py"))
    star = F.col("py") * F.col("px") + (1 - F.col("py")) * (1 - F.col("px"))
    v = star * (1 - star) / F.col("n")
    w = (F.pow(2 * F.col("py") - 1, F.lit(2.0)) * F.col("px") * (1 - F.col("px")) + F.pow(2 * F.col("px") - 1, F.lit(2.0)) * F.col("py") * (1 - F.col("py"))) / F.col("n") + 4 * F.col("py") * F.col("px") * (1 - F.col("py")) * (1 - F.col("px")) / (F.col("n") * F.col("n"))
    return out.select("k", F.when((F.col("n") >= least) & (v - w > 0), (F.col("hit") - star) / F.sqrt(F.greatest(v - w, F.lit(1e-300)))).alias("z"))


def diebold_mariano(rows: DataFrame, loss_a: str, loss_b: str, lags: int) -> DataFrame:
    """The statistic of mean loss difference, its variance with Bartlett weights; null without variance."""
    d = rows.withColumn("_d", F.col(loss_a) - F.col(loss_b))
    mean = F.avg("_d").over(Window.partitionBy("k"))
    dev = d.withColumn("_e", F.col("_d") - mean)
    for j in range(1, lags + 1):
        dev = dev.withColumn(f"_p{j}", F.col("_e") * F.lag("_e", j).over(in_time()))
    n = F.count("*")
    variance = F.sum(F.col("_e") * F.col("_e")) / n
    for j in range(1, lags + 1):
        variance = variance + 2 * (1 - j / (lags + 1)) * F.coalesce(F.sum(f"_p{j}"), F.lit(0.0)) / n
    out = dev.groupBy("k").agg(n.alias("n"), F.avg("_d").alias("mean"), variance.alias("_v"))
    return out.select("k", "n", "mean", F.when(F.col("_v") > 0, F.col("mean") / F.sqrt(F.greatest(F.col("_v"), F.lit(1e-300)) / F.col("n"))).alias("dm"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    share = F.try_divide(hits, n)
    centre, spread = share + z * z / (2 * n), z * F.sqrt((share * (1 - share) + z * z / (4 * n)) / n)
    return (centre - spread) / (1 + z * z / n), (centre + spread) / (1 + z * z / n)


def mean_with_error(rows: DataFrame, value: str) -> DataFrame:
    """Mean, standard error, z and two-sided power-free summary of paired differences."""
    out = rows.groupBy("k").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
    out = out.withColumn("p_positive", S.normal_cdf(F.try_divide(F.col("mean"), F.col("se"))))
    return out.withColumn("mde", 2.8 * F.col("se"))


def bootstrap_means(rows: DataFrame, value: str, draws: int, seed: int = 0) -> DataFrame:
    """Mean of each Poisson bootstrap resample: a row enters resample b as often as a hash of (b, id) says.

    Poisson weights need no row numbers, so resamples are one aggregation over the rows, in parallel.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), "b", "id"), F.lit(1_000_000)) / 1_000_000
    cuts = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    many = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_w", weight)
    return many.groupBy("k", "b").agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("mean"))


def distribution(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, median, p10 and p90 with linear interpolation."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.1)).alias("p10"), F.percentile(value, F.lit(0.9)).alias("p90"))


def shrink_weight(rows: DataFrame, *order: str, last: int = 100, least: int = 20, default: float = 0.5) -> DataFrame:
    """The weight in [0, 1] that best moves the reference towards the forecast, over a key's last rows."""
    newest = rows.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t"), *(F.desc(c) for c in order)))).where(F.col("_r") <= last)
    d, r = F.col("p") - F.col("market"), F.col("y") - F.col("market")
    out = newest.groupBy("k").agg(F.count("*").alias("n"), F.try_divide(F.sum(d * r), F.sum(d * d)).alias("w"))
    return out.select("k", "n", F.when((F.col("n") < least) | F.col("w").isNull(), default).otherwise(S.clamp(F.col("w"), 0.0, 1.0)).alias("weight"))


def threshold_sweep(trades: DataFrame, score: str, thresholds: list[float], *order: str, block: str = "day") -> DataFrame:
    """Trades, win rate, total and largest drawdown (from a peak that starts at 0) of what scores at least each
    threshold; one of 0 or less keeps all, nulls too.

    Trades meet only others of their block of time (a unit of date_trunc), once for all thresholds; of a block its sum,
    highest and lowest running sum and own drawdown are enough to go on.
    """
    inside = Window.partitionBy("k", "_block").orderBy("t", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keep = [F.lit(True) if x <= 0 else F.coalesce(F.col("_score") >= x, F.lit(False)) for x in thresholds]
    cut = trades.select("k", "t", *order, F.col(score).alias("_score"), "pnl", F.date_trunc(block, F.col("t")).alias("_block"))
    cut = cut.select("*", *(F.sum(F.when(on, F.col("pnl"))).over(inside).alias(f"_c{i}") for i, on in enumerate(keep)))
    cut = cut.select("*", *(F.max(f"_c{i}").over(inside).alias(f"_p{i}") for i in range(len(keep))))
    of = lambda i, on: (F.count_if(on).alias("n"), F.count_if(on & (F.col("pnl") > 0)).alias("wins"), F.count(F.when(on, F.col("pnl"))).alias("known"), F.sum(F.when(on, F.col("pnl"))).alias("sum"), F.max(f"_c{i}").alias("high"), F.min(f"_c{i}").alias("low"), F.max(F.col(f"_p{i}") - F.col(f"_c{i}")).alias("down"))
    blocks = cut.groupBy("k", "_block").agg(*(a.alias(f"_{i}_{n}") for i, on in enumerate(keep) for n, a in zip(("n", "wins", "known", "sum", "high", "low", "down"), of(i, on), strict=True)))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("threshold"), *(F.col(f"_{i}_{n}").alias(n) for n in ("n", "wins", "known", "sum", "high", "low", "down"))) for i, x in enumerate(thresholds))))
    before = Window.partitionBy("k", "threshold").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.select("k", "_block", each.alias("x")).select("k", "_block", "x.*").where("n > 0").withColumn("_base", F.coalesce(F.sum("sum").over(before), F.lit(0.0)))
    rows = rows.withColumn("_peak", F.greatest(F.lit(0.0), F.max(F.col("_base") + F.col("high")).over(before)))
    down = F.greatest("down", F.col("_peak") - (F.col("_base") + F.col("low")))
    return rows.groupBy("k", "threshold").agg(F.sum("n").alias("n"), F.try_divide(F.sum("wins"), F.sum("known")).alias("win_rate"), F.sum("sum").alias("total"), F.max(down).alias("drawdown"))


def best_threshold(swept: DataFrame, current: float, slack: float = 1.5) -> DataFrame:
    """The threshold of the largest total whose drawdown is at most slack times the current one's; first of equals."""
    now = swept.where(F.col("threshold") == current).select("k", F.col("drawdown").alias("_d"))
    fit = swept.join(now, "k").where(F.col("drawdown") <= slack * F.col("_d"))
    return fit.groupBy("k").agg(F.max_by("threshold", F.struct("total", -F.col("threshold"))).alias("best"))


def frontier(rows: DataFrame, thetas: list[float], most_bad: float) -> DataFrame:
    """For each theta the share of good windows entered and of entries that are bad; whether that is feasible."""
    many = rows.withColumn("theta", F.explode(F.array(*map(F.lit, thetas))))
    enter = F.col("p") >= F.col("theta")
    out = many.groupBy("k", "theta").agg(F.try_divide(F.sum((enter & (F.col("y") == 1)).cast("double")), F.sum((F.col("y") == 1).cast("double"))).alias("recall"), F.try_divide(F.sum((enter & (F.col("y") == 0)).cast("double")), F.sum(enter.cast("double"))).alias("bad"))
    return out.withColumn("feasible", F.coalesce(F.col("bad") <= most_bad, F.lit(False)))


def monotone_buckets(rows: DataFrame, edge: Column, parts: int = 5) -> DataFrame:
    """Mean outcome in slices of equal count by edge."""
    cut = rows.withColumn("edge", edge).withColumn("slice", slice_number(parts, [F.col("edge"), F.col("t")]))
    return cut.groupBy("k", "slice").agg(F.count("*").alias("n"), F.avg("edge").alias("edge"), F.avg("y").alias("outcome"))


def trend_state(rows: DataFrame, value: str, recent: int = 25, prior: int = 75, least: int = 50, band: float = 0.01) -> DataFrame:
    """IMPROVING, WORSENING or FLAT from the mean of the newest rows against those before; lower is better."""
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t"))))
    new, old = F.avg(F.when(F.col("_r") <= recent, F.col(value))), F.avg(F.when((F.col("_r") > recent) & (F.col("_r") <= recent + prior), F.col(value)))
    out = r.groupBy("k").agg(F.count("*").alias("n"), new.alias("recent"), old.alias("prior"))
    d = F.col("recent") - F.col("prior")
    return out.withColumn("state", F.when(F.col("n") < least, "UNKNOWN").when(d < -band, "IMPROVING").when(d > band, "WORSENING").otherwise("FLAT"))


def autocorrelation(rows: DataFrame, value: str, lags: int) -> DataFrame:
    """Autocorrelations, and the effective sample size from those before the first that isn't positive."""
    mean = F.avg(value).over(Window.partitionBy("k"))
    dev = rows.withColumn("_e", F.col(value) - mean)
    for j in range(1, lags + 1):
        dev = dev.withColumn(f"_p{j}", F.col("_e") * F.lag("_e", j).over(in_time()))
    rho = [F.coalesce(F.try_divide(F.sum(f"_p{j}"), F.sum(F.col("_e") * F.col("_e"))), F.lit(0.0)) for j in range(1, lags + 1)]
    out = dev.groupBy("k").agg(F.count("*").alias("n"), F.array(*rho).alias("rho"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(True).alias("on"))
    step = lambda a, x: F.struct((a["sum"] + F.when(a["on"] & (x > 0), x).otherwise(0.0)).alias("sum"), (a["on"] & (x > 0)).alias("on"))
    return out.select("k", "n", F.col("rho")[0].alias("rho_1"), (F.col("n") / (1 + 2 * F.aggregate("rho", start, step, lambda a: a["sum"]))).alias("effective_n"))


def theil_sen(points: DataFrame, x: str, y: str) -> DataFrame:
    """Median of pairwise slopes; for few points per key, as pairs are the method."""
    a, b = points.select("k", F.col(x).alias("x1"), F.col(y).alias("y1")), points.select("k", F.col(x).alias("x2"), F.col(y).alias("y2"))
    return a.join(b, "k").where("x1 < x2").groupBy("k").agg(F.median((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("slope"))


def partial_correlation(rows: DataFrame, x: str, y: str, control: str, z: float = 1.96) -> DataFrame:
    """Correlation of x and y given a control, with Fisher's interval."""
    out = rows.groupBy("k").agg(F.count("*").alias("n"), F.corr(x, y).alias("xy"), F.corr(x, control).alias("xc"), F.corr(y, control).alias("yc"))
    out = out.withColumn("r", F.try_divide(F.col("xy") - F.col("xc") * F.col("yc"), F.sqrt((1 - F.col("xc") * F.col("xc")) * (1 - F.col("yc") * F.col("yc")))))
    h = z / F.sqrt(F.col("n") - 4)
    return out.select("k", "n", "r", F.tanh(F.atanh("r") - h).alias("low"), F.tanh(F.atanh("r") + h).alias("high"))


def importance(rows: DataFrame, features: list[str], outcome: str) -> DataFrame:
    """Correlation of each feature with the outcome, 0 for a constant."""
    long = rows.unpivot([outcome], features, "feature", "value")
    return long.groupBy("feature").agg(F.coalesce(S.correlation("value", outcome), F.lit(0.0)).alias("importance"))


def agreement(rows: DataFrame, arm: str, slot: list[str], choice: str) -> DataFrame:
    """Share of common slots in which two arms choose alike, for every two arms."""
    a, b = rows.select(*slot, F.col(arm).alias("a"), F.col(choice).alias("_x")), rows.select(*slot, F.col(arm).alias("b"), F.col(choice).alias("_y"))
    return a.join(b, slot).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((F.col("_x") == F.col("_y")).cast("double")).alias("same"))


def permutation_rows(rows: DataFrame, value: str, seed: int) -> DataFrame:
    """Values dealt anew within each key, in an order that a hash of seed and time gives."""
    place = F.row_number().over(Window.partitionBy("k").orderBy("t"))
    dealt = F.row_number().over(Window.partitionBy("k").orderBy(F.md5(F.concat(F.lit(str(seed)), F.col("t").cast("string"))), "t"))
    left = rows.drop(value).withColumn("_i", place)
    return left.join(rows.select("k", value, dealt.alias("_i")), ["k", "_i"]).drop("_i")

"""Scalar functions: clamps, logits, fees, odds, sessions, ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded(x: Column, places: int) -> Column:
    """x to so many places, halves away from zero: of the scaled number, as engines of SQL round, not of its decimal text."""
    return F.round(x * float(10**places)) / float(10**places)


def or_default(x: Column, default: float) -> Column:
    """x, or the default where x is null or zero."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(default))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def sigmoid(z: Column, bound: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-clamp(z, -bound, bound)))


def fee_continuous(price_cents: Column, rate: float = 0.07) -> Column:
    """Cents per contract without rounding."""
    p = price_cents / 100
    return F.lit(100 * rate) * p * (1 - p)


def fee_per_contract(price_cents: Column, rate: float = 0.07) -> Column:
    """Whole cents, rounded up for each contract."""
    return F.ceil(F.round(fee_continuous(price_cents, rate), 9)).cast("double")


def fee_per_order(price_cents: Column, contracts: Column, rate: float = 0.07) -> Column:
    """Whole cents, rounded up once for the order."""
    return F.ceil(F.round(fee_continuous(price_cents, rate) * contracts, 9)).cast("double")


def kelly(p: Column, price: Column) -> Column:
    """The share to stake on odds of 1 : price when the chance is p; not below 0."""
    return F.greatest(F.lit(0.0), F.try_divide(p - price, 1 - price))


def ev_per_dollar(p: Column, price: Column, fee: Column) -> Column:
    """Expected gain per dollar of cost, fees included."""
    return F.try_divide(p - price - fee, price + fee)


def eastern_offset_hours(t: Column) -> Column:
    """-4 from April to October, else -5: the rule in use, not the legal one."""
    return F.when(F.month(t).between(4, 10), F.lit(-4)).otherwise(F.lit(-5))


def session_label(t: Column) -> Column:
    """pre, open, post or closed, of a UTC time."""
    local = t + F.make_interval(hours=eastern_offset_hours(t))
    minute = F.hour(local) * 60 + F.minute(local)
    weekday = F.weekday(local) < 5
    return (
        F.when(weekday & minute.between(570, 959), "open").when(weekday & minute.between(240, 569), "pre").when(weekday & minute.between(960, 1199), "post").otherwise("closed")
    )


def band(x: Column, cuts: list[float], labels: list[str]) -> Column:
    """The label of the range [cuts[i-1], cuts[i]) that holds x; labels has one more than cuts."""
    out = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels, strict=False))):
        out = F.when(x < cut, label).otherwise(out)
    return F.when(x.isNotNull(), out)


def compact_timestamp(text: Column) -> Column:
    """YYYYMMDDTHHMM with or without seconds."""
    digits = F.rpad(F.regexp_replace(text, "T", ""), 14, "0")
    return F.try_to_timestamp(F.substring(digits, 1, 12), F.lit("yyyyMMddHHmm"))


def hash_prefix(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def normal_cdf(z: Column) -> Column:
    """By a rational approximation of the error function; the error is below 1.5e-7."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x * 0.3275911)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return (1 + F.signum(z) * erf) / 2


def correlation(x: str, y: str) -> Column:
    """Correlation over a group; null, not an error, where one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def horizon_sigma(volatility: Column, minutes: Column, price: Column, floor: float = 5.0) -> Column:
    """How far a price moves within so many minutes, from its volatility in one; not below `floor`."""
    return F.greatest(volatility * F.sqrt(minutes) * price, F.lit(floor))


def capped_band(pred: Column, lo: Column, hi: Column, minutes: Column, sigma: Column, base: float = 200.0, sigmas: float = 3.2) -> Column:
    """A struct (lo, hi): a band wider than its cap shrinks towards the prediction, which keeps its place in the band;
    the cap is twice the base beyond 5 minutes, and never under so many sigmas. Ends are cut to whole numbers."""
    cap = F.greatest(F.when(minutes <= 5, base).otherwise(2 * base), sigmas * F.coalesce(sigma, F.lit(0.0)))
    factor = F.least(F.try_divide(cap, hi - lo), F.lit(1.0))
    wide = (hi - lo) > cap
    end = lambda x: F.when(wide, pred + (x - pred) * factor).otherwise(x).cast("long")
    return F.struct(end(lo).alias("lo"), end(hi).alias("hi"))


def selector_keeps(p_win: Column, price_cents: Column, theta: float = 0.5) -> Column:
    """A bet stays if its chance is at least theta and at least what it costs, the fee included."""
    return p_win >= F.greatest(F.lit(theta), (price_cents + fee_per_contract(price_cents)) / 100)

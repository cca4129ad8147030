"""From an accepted candidate to a position: gates in order, the policy on timeframes, and the portfolio."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Limits:
    """Shares are of equity. risk: lost if a position is stopped. ticker, portfolio: most in one key, and in all."""

    cash: float = 100_000.0
    risk: float = 0.01
    day_trades: int = 5
    positions: int = 3
    day_loss: float = 0.03
    ticker: float = 0.10
    portfolio: float = 0.90


#: Reasons not to open a trade, in the order of the checks.
REFUSALS = ("max_trades_per_day reached", "max_concurrent_positions reached", "daily_drawdown_limit_breached", "max_ticker_exposure exceeded", "max_portfolio_exposure exceeded", "insufficient_cash")


def first_of(checks: list[tuple[Column, str | Column]], otherwise: str | None) -> Column:
    """The reason of the first check that holds; a null check does not."""
    out = F.lit(otherwise)
    for fails, reason in reversed(checks):
        out = F.when(fails, reason).otherwise(out)
    return out


def opening_check(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds `reason`, `ok` or the first refusal, to rows of an account's state (trades_today, open_positions, equity,
    day_equity, in_ticker, in_all, cash) with the capital that a trade requires."""
    loss = F.when(F.col("day_equity") > 0, F.greatest((F.col("day_equity") - F.col("equity")) / F.col("day_equity"), F.lit(0.0))).otherwise(0.0)
    share = F.when(F.col("equity") > 0, (F.col("in_ticker") + F.col("required")) / F.col("equity")).otherwise(0.0)
    checks = (
        F.col("trades_today") >= limits.day_trades, F.col("open_positions") >= limits.positions, loss >= limits.day_loss, share > limits.ticker,
        F.col("in_all") + F.col("required") > limits.portfolio * F.col("equity"), F.col("cash") < F.col("required"),
    )
    return rows.withColumn("reason", first_of(list(zip(checks, REFUSALS, strict=True)), "ok"))


#: Risk profiles, with the columns named below.
PROFILES = (
    ("conservative", 0.005, 0.50, 0.75, 3, 0.70, 0.70, 2.5, 0.70, "skip", 0.25, 0.15),
    ("moderate", 0.01, 0.75, 1.0, 5, 0.60, 0.60, 2.0, 0.55, "reduce", 0.50, 0.10),
    ("aggressive", 0.02, 1.00, 1.25, 8, 0.50, 0.50, 1.5, 0.45, "normal", 1.0, 0.05),
)
PROFILE_COLUMNS = "profile string, risk double, intraday_size double, swing_size double, day_trades int, least_chance double, least_score double, least_rr double, least_confidence double, on_event string, event_size double, streak_step double"


def recommend(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """BUY, SELL or HOLD with the first gate that fails, after the thresholds of a row's risk profile, and a size.

    rows: profile, trades_today, accepted, score, rr, chance, confidence, expected, event, losing_streak, timeframe,
    equity, entry, stop. profiles has PROFILE_COLUMNS and a row for each profile; Spark broadcasts it if it is small.
    Gates in order: trades of the day, the structural filter, its score, reward to risk, chance, confidence, events.
    The size risks a share of equity at the stop (1 % of the price without one), times the profile's factor for the
    timeframe, that for an event if it reduces, and less for each trade lost in a row, a tenth of it at least. Missing
    numbers count as 0.
    """
    x = rows.join(profiles, "profile")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    event = F.coalesce(F.col("event"), F.lit("none")) != "none"
    gate = first_of(
        [
            (F.col("trades_today") >= F.col("day_trades"), "max_trades_per_day"), (~F.coalesce(F.col("accepted"), F.lit(False)), "fta_rejected"), (zero("score") < F.col("least_score"), "fta_score_below_threshold"),
            (zero("rr") < F.col("least_rr"), "reward_risk_below_threshold"), (zero("chance") < F.col("least_chance"), "meta_model_probability_below_threshold"),
            (zero("confidence") < F.col("least_confidence"), "forecast_confidence_below_threshold"), (event & (F.col("on_event") == "skip"), "event_risk_skip"),
        ],
        None,
    )
    at_risk = F.coalesce(F.nullif(F.abs(F.col("entry") - F.col("stop")), F.lit(0.0)), F.col("entry") * 0.01)
    style = F.when(F.contains("timeframe", F.lit("intraday")), F.col("intraday_size")).otherwise(F.col("swing_size"))
    shrunk = F.when(event & (F.col("on_event") == "reduce"), F.col("event_size")).otherwise(1.0) * F.greatest(1 - F.col("streak_step") * zero("losing_streak"), F.lit(0.1))
    size = F.greatest(F.round(F.col("equity") * F.col("risk") / at_risk * style * shrunk, 2), F.lit(1.0))
    action = F.when(F.col("gate").isNotNull(), "HOLD").when(zero("expected") > 0, "BUY").otherwise("SELL")
    return x.withColumn("gate", gate).withColumn("action", action).withColumn("size", F.when(F.col("gate").isNull() & (F.col("entry") > 0), size))


#: Policies on timeframes.
POLICIES = ("daily_only", "daily_plus_intraday_calibration", "intraday_experimental_finetune")


def timeframe_policy(rows: DataFrame, least_trades: int = 50, require_real: bool = True, finetune: bool = False, daily: str = "1d", intraday: str = "1h") -> DataFrame:
    """Adds mode, timeframe, why and fell_back to rows (policy, has_intraday, intraday_trades). Rules in order: an
    unknown policy is the daily one; without real intraday data, or with too few trades, the daily one holds; fine
    tuning that is not allowed becomes calibration."""
    asked = F.when(F.col("policy").isin(*POLICIES), F.col("policy")).otherwise(POLICIES[0])
    no_data = (F.col("_p") != POLICIES[0]) & F.lit(require_real) & ~F.coalesce(F.col("has_intraday"), F.lit(False))
    few = F.col("_p").isin(*POLICIES[1:]) & (F.coalesce(F.col("intraday_trades"), F.lit(0)) < least_trades)
    mode = F.when(no_data | few, POLICIES[0]).when((F.col("_p") == POLICIES[2]) & F.lit(not finetune), POLICIES[1]).otherwise(F.col("_p"))
    why = F.when(no_data, "no_real_intraday_data").when(few, "insufficient_intraday_trades").when(F.col("mode") == POLICIES[2], "intraday_finetune_enabled").when(F.col("mode") == POLICIES[1], "daily_with_intraday_calibration").otherwise("daily_only")
    out = rows.withColumn("_p", asked).withColumn("mode", mode)
    return out.withColumn("timeframe", F.when(F.col("mode") == POLICIES[2], intraday).otherwise(daily)).withColumn("why", why).withColumn("fell_back", no_data | few).drop("_p")


@dataclass
class _Position:
    key: str
    quantity: float
    entry: float
    last: float


def run_portfolio(bars: DataFrame, limits: Limits = Limits(), stop: float = 0.05, target: float = 0.1) -> DataFrame:
    """One row per account: trades opened, stopped, at target, refused by each check, last equity and worst drawdown.

    bars (account, k, t, o, c): an account trades all its keys with one purse, bar by bar in order of time and key. A
    new day resets the count of trades and the equity that losses of the day are measured from. A bar marks the
    positions of its key, closes those at or beyond their stop, else target, at exactly that price; then, if it rose, a
    position is sized by risk, by the most for a key and by cash (whole pieces, at least one), checked six times, and
    opened at the close.

    The state hangs on all bars before, so an account is one task that holds its bars; accounts, and limits to compare
    them, run side by side. Nulls and prices not above 0 are no bars.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["t", "k"])
        cash, held, day = limits.cash, [], None
        today, day_equity, peak, worst = 0, cash, cash, 0.0
        opened = stopped = reached = 0
        refused = [0] * len(REFUSALS)
        equity = lambda: cash + sum(p.quantity * p.last for p in held)
        for k, date, o, c in zip(group["k"], group["t"].dt.date, group["o"], group["c"], strict=True):
            if day is None or date > day:
                day, today, day_equity = date, 0, equity()
            stay = []
            for p in held:
                if p.key == k:
                    p.last = c
                    if c <= p.entry * (1 - stop):
                        cash, stopped = cash + p.quantity * p.entry * (1 - stop), stopped + 1
                        continue
                    if c >= p.entry * (1 + target):
                        cash, reached = cash + p.quantity * p.entry * (1 + target), reached + 1
                        continue
                stay.append(p)
            held = stay
            now = equity()
            if c > o:
                size = max(1.0, float(min(now * limits.risk / (c * stop), now * limits.ticker / c, cash / c) // 1))
                required, in_key = size * c, sum(p.quantity * p.last for p in held if p.key == k)
                checks = (
                    today >= limits.day_trades, len(held) >= limits.positions, day_equity > 0 and (day_equity - now) / day_equity >= limits.day_loss,
                    now > 0 and (in_key + required) / now > limits.ticker, now - cash + required > limits.portfolio * now, cash < required,
                )
                if any(checks):
                    refused[checks.index(True)] += 1
                else:
                    cash, today, opened = cash - required, today + 1, opened + 1
                    held.append(_Position(k, size, c, c))
            now = equity()
            peak = max(peak, now)
            worst = max(worst, (peak - now) / peak)
        return pd.DataFrame([[group["account"].iloc[0], opened, stopped, reached, *refused, equity(), worst]], columns=_PORTFOLIO_COLUMNS)

    known = bars.where("o > 0 and c > 0 and t is not null and k is not null").select("account", "k", "t", "o", "c")
    return known.groupBy("account").applyInPandas(fold, f"account {bars.schema['account'].dataType.simpleString()}, {_PORTFOLIO}")


_PORTFOLIO = "opened long, stopped long, reached long, " + ", ".join(f"refused_{i} long" for i in range(1, len(REFUSALS) + 1)) + ", equity double, drawdown double"
_PORTFOLIO_COLUMNS = ["account", *(c.split()[0] for c in _PORTFOLIO.split(", "))]


# Robustness of a set of trades (k, entry, pnl and what splits them).


def _passes(base: Column, stressed: Column) -> Column:
    return (base <= 0) | (stressed >= 0.5 * base)


def threshold_sensitivity(trades: DataFrame, value: str, thresholds: list[float], least_trades: int = 3) -> DataFrame:
    """Trades at or above each threshold against all: passes with least_trades or more and half the profit, if there
    was one. All thresholds are counted in one pass, as conditional sums."""
    sums = [a for i, x in enumerate(thresholds) for a in (F.count(F.when(F.col(value) >= x, 1)).alias(f"n_{i}"), F.coalesce(F.sum(F.when(F.col(value) >= x, F.col("pnl"))), F.lit(0.0)).alias(f"p_{i}"))]
    one = trades.groupBy("k").agg(F.sum("pnl").alias("base"), *sums)
    rows = one.select("k", "base", F.explode(F.array(*(F.struct(F.lit(x).alias("threshold"), F.col(f"n_{i}").alias("n"), F.col(f"p_{i}").alias("pnl")) for i, x in enumerate(thresholds)))).alias("r")).select("k", "base", "r.*")
    return rows.withColumn("passes", (F.col("n") >= least_trades) & _passes(F.col("base"), F.col("pnl")))


def regime_split(trades: DataFrame, regime: Column, baseline: str, capital: float, least_percent: float = -5.0) -> DataFrame:
    """Profit of each regime in percent of capital, beside that of the baseline regime; unknown ones are `unknown`."""
    sums = trades.withColumn("regime", F.coalesce(regime, F.lit("unknown"))).groupBy("k", "regime").agg(F.count("*").alias("n"), F.avg((F.col("pnl") > 0).cast("int")).alias("win_rate"), F.avg("pnl").alias("mean_pnl"), (F.sum("pnl") / capital * 100).alias("percent"))
    base = F.max(F.when(F.col("regime") == baseline, F.col("percent"))).over(Window.partitionBy("k"))
    return sums.withColumn("baseline", F.coalesce(base, F.lit(0.0))).withColumn("passes", F.col("percent") >= least_percent)


def sample_size_stress(trades: DataFrame, least_trades: int = 10) -> DataFrame:
    """Keys by their number of trades: adaptation must be suppressed below least_trades."""
    return trades.groupBy("k").agg(F.count("*").alias("n")).withColumn("suppressed", F.col("n") < least_trades)


def filter_acceptance(candidates: DataFrame, kept: Column) -> DataFrame:
    """Per key: candidates, those that a filter keeps, and the percentage that it takes away."""
    out = candidates.groupBy("k").agg(F.count("*").alias("before"), F.count(F.when(kept, 1)).alias("after"))
    return out.withColumn("filtered", F.col("before") - F.col("after")).withColumn("filtered_percent", F.coalesce(F.try_divide(100 * F.col("filtered"), F.col("before")), F.lit(0.0))).withColumn("is_filtering", F.col("after") < F.col("before"))


def prediction_distribution(rows: DataFrame, value: str, above: float = 0.6) -> DataFrame:
    """Per key: mean, population deviation, least, largest, and the share above a level; 0 without values."""
    v = F.col(value)
    stats = {"mean": F.avg(v), "std": F.stddev_pop(v), "least": F.min(v), "largest": F.max(v), "share_above": F.avg((v > above).cast("int"))}
    return rows.groupBy("k").agg(*(F.coalesce(a, F.lit(0.0)).alias(n) for n, a in stats.items()))


def validation_summary(criteria: DataFrame) -> DataFrame:
    """Per key, from rows (k, criterion, passed): how many criteria passed, and whether all did; a null one failed."""
    ok = F.coalesce(F.col("passed"), F.lit(False))
    return criteria.groupBy("k").agg(F.count("*").alias("criteria"), F.count(F.when(ok, 1)).alias("passed"), F.bool_and(ok).alias("accepted"))


def sample_ratio(assigned: DataFrame, arms: int) -> DataFrame:
    """Per key, from rows (k, arm, unit): distinct units seen and those expected of an even split, repeated ones, and
    the chi-squared distance of the arms' counts from an even split."""
    each = assigned.groupBy("k", "arm").agg(F.count("*").alias("n"), F.count_distinct("unit").alias("units"))
    even = F.sum("n") / arms
    out = each.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.col("units")).alias("repeated"), even.alias("expected"), F.sum(F.col("n") * F.col("n")).alias("_sq"))
    return out.withColumn("chi_squared", F.col("_sq") / F.col("expected") - F.col("n")).drop("_sq")


def tail_summary(rows: DataFrame, last: int = 100) -> DataFrame:
    """Per key, over its last rows (k, t, id, p, market, y) in time: accuracy, and Brier scores beside the market's."""
    w = Window.partitionBy("k").orderBy(F.desc("t"))
    tail = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    square = lambda c: F.avg(F.pow(F.col(c) - F.col("y"), F.lit(2.0)))
    return tail.groupBy("k").agg(F.count("*").alias("n"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")).alias("accuracy"), square("p").alias("brier"), square("market").alias("market_brier"))


def winner_by_tail(rows: DataFrame, arm: str, loss: str, last: int = 50, least: int = 20) -> DataFrame:
    """The arm with the least mean loss over its last rows, of those with enough; ties go to the first name."""
    w = Window.partitionBy(arm).orderBy(F.desc("t"))
    tail = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last).groupBy(arm).agg(F.count("*").alias("n"), F.avg(loss).alias("loss")).where(F.col("n") >= least)
    return tail.agg(F.min(F.struct("loss", arm)).alias("m")).select(F.col(f"m.{arm}").alias("arm"), F.col("m.loss").alias("loss")).where("arm is not null")

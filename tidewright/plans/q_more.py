"""Further joins, rankings and roll-ups over the same operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.operators import asof as J
from tidewright.operators import bars as B
from tidewright.operators import ledger as L
from tidewright.sources import tables as T

from .registry import add
from .shaping import r, rounded

_B, _W, _K, _T = f"WITH {T.BARS}", f"WITH {T.WINDOWS}", f"WITH {T.TICKS}", f"WITH {T.TRADES}"


def quote_path(spark, d):
    """Closes one bar before and one and two after each, exactly; gaps are null."""
    b = T.hourly(spark, d).select("k", "t", "c")
    out = b
    for name, hours in (("before", 1), ("after_1", -1), ("after_2", -2)):
        out = out.join(b.select("k", (F.col("t") + F.expr(f"interval {hours} hours")).alias("t"), F.col("c").alias(name)), ["k", "t"], "left")
    return out


add("quote_path", quote_path, f"{_B} SELECT a.k, a.t, a.c, b.c AS before, x.c AS after_1, y.c AS after_2 FROM bars a LEFT JOIN bars b ON b.k = a.k AND b.t = a.t - INTERVAL 1 HOUR LEFT JOIN bars x ON x.k = a.k AND x.t = a.t + INTERVAL 1 HOUR LEFT JOIN bars y ON y.k = a.k AND y.t = a.t + INTERVAL 2 HOURS")


def rounded_key_match(spark, d):
    """Clicks matched to views of the same user and hour, with a flag for presence."""
    x = T.ticks(spark, d).withColumn("hour", F.date_trunc("hour", "t").cast("timestamp_ntz"))
    right = x.where("k = 'view'").groupBy("user_id", "hour").agg(F.count("*").alias("views"))
    return x.where("k = 'click'").join(right, ["user_id", "hour"], "left").select("id", F.col("views").isNotNull().alias("seen"), F.coalesce("views", F.lit(0)).cast("long").alias("views"))


add("rounded_key_match", rounded_key_match, f"{_K}, v AS (SELECT user_id, date_trunc('hour', t) AS hour, count(*) AS views FROM ticks WHERE k = 'view' GROUP BY 1, 2) SELECT c.id, v.views IS NOT NULL AS seen, coalesce(v.views, 0)::BIGINT AS views FROM ticks c LEFT JOIN v ON v.user_id = c.user_id AND v.hour = date_trunc('hour', c.t) WHERE c.k = 'click'")


def trade_dimension(spark, d):
    """Totals by brand: each trade looks up its part."""
    parts = T.table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    return rounded(T.trades(spark, d).join(parts, "part", "left").groupBy("brand").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl")))


add("trade_dimension", trade_dimension, f"{_T} SELECT p_brand AS brand, count(*) AS n, {r('sum(pnl)')} AS pnl FROM trades LEFT JOIN part ON p_partkey = part GROUP BY 1")


def latest_vote(spark, d):
    """The last signup of a user in the half day before each purchase."""
    x = T.ticks(spark, d)
    of = lambda k: x.where(F.col("k") == k).select(F.col("user_id").alias("k"), "t", "id", "size")
    return J.as_of(of("purchase"), of("signup"), "size", "12 hours", "vote")


add(
    "latest_vote",
    latest_vote,
    f"{_K}, p AS (SELECT user_id AS k, t, id, size FROM ticks WHERE k = 'purchase'), v AS (SELECT user_id AS k, t, size FROM ticks WHERE k = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY id DESC) = 1) SELECT p.k, p.t, p.id, p.size, CASE WHEN v.t >= p.t - INTERVAL 12 HOURS THEN v.t END AS vote_t, CASE WHEN v.t >= p.t - INTERVAL 12 HOURS THEN v.size END AS vote_value FROM p ASOF LEFT JOIN v ON v.k = p.k AND v.t <= p.t",
)


def silent_minutes(spark, d):
    """The whole minutes inside long silences."""
    out = L.outages(T.ticks(spark, d), "75 minutes")
    a, z = (F.date_trunc("minute", c).cast("timestamp_ntz") for c in ("a", "z"))
    return out.select("k", F.explode(F.sequence(a + F.expr("interval 1 minute"), z - F.expr("interval 1 minute"), F.expr("interval 1 minute"))).alias("t"))


add(
    "silent_minutes",
    silent_minutes,
    f"{_K}, n AS (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY t) AS z FROM (SELECT DISTINCT k, t FROM ticks)) SELECT k, unnest(generate_series(date_trunc('minute', t) + INTERVAL 1 MINUTE, date_trunc('minute', z) - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS t FROM n WHERE z > t + INTERVAL 75 MINUTES",
)


def longest_silences(spark, d):
    x = L.outages(T.ticks(spark, d), "0 minutes").withColumn("us", F.unix_micros(F.col("z").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp")))
    return x.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("us"), "a"))).where("_r <= 5").drop("_r")


add("longest_silences", longest_silences, f"{_K}, n AS (SELECT k, t AS a, lead(t) OVER (PARTITION BY k ORDER BY t) AS z FROM (SELECT DISTINCT k, t FROM ticks)) SELECT k, a, z, epoch_us(z) - epoch_us(a) AS us FROM n WHERE z > a QUALIFY row_number() OVER (PARTITION BY k ORDER BY epoch_us(z) - epoch_us(a) DESC, a) <= 5")


def standings(spark, d):
    """The four arms with the smallest Brier score of each weekday."""
    x = T.windows(spark, d).groupBy(F.weekday("t").alias("day"), "k").agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))), 6).alias("brier"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy("brier", "k"))).where("rank <= 4")


add("standings", standings, f"{_W}, x AS (SELECT (isodow(t) - 1)::INTEGER AS day, k, {r('avg((p - y) ** 2)')} AS brier FROM windows GROUP BY 1, 2) SELECT day, k, brier, row_number() OVER (PARTITION BY day ORDER BY brier, k)::INTEGER AS rank FROM x QUALIFY row_number() OVER (PARTITION BY day ORDER BY brier, k) <= 4")


def staleness_curve(spark, d):
    """What a price is worth so many hours later: mean and spread of the change, by delay."""
    b = T.hourly(spark, d).select("k", "t", "c")
    later = b.withColumn("hours", F.explode(F.array(*map(F.lit, (1, 2, 4, 8))))).select("k", (F.col("t") + F.make_dt_interval(hours=F.col("hours"))).alias("t"), "hours", F.col("c").alias("then"))
    return rounded(later.join(b, ["k", "t"]).groupBy("k", "hours").agg(F.count("*").alias("n"), F.avg(F.col("c") - F.col("then")).alias("mean"), F.stddev_samp(F.col("c") - F.col("then")).alias("spread")))


add("staleness_curve", staleness_curve, f"{_B}, h AS (SELECT * FROM (VALUES (1), (2), (4), (8)) v(hours)) SELECT a.k, hours, count(*) AS n, {r('avg(b.c - a.c)')} AS mean, {r('stddev_samp(b.c - a.c)')} AS spread FROM bars a CROSS JOIN h JOIN bars b ON b.k = a.k AND b.t = a.t + INTERVAL 1 HOUR * hours GROUP BY 1, 2")


def minute_coverage(spark, d):
    """By key and day: minutes with a tick, and their share of the day."""
    x = T.ticks(spark, d).select("k", F.date_trunc("day", "t").cast("timestamp_ntz").alias("day"), F.date_trunc("minute", "t").alias("m")).distinct()
    return rounded(x.groupBy("k", "day").agg(F.count("*").alias("minutes"), (F.count("*") / 1440).alias("share")))


add("minute_coverage", minute_coverage, f"{_K} SELECT k, date_trunc('day', t)::TIMESTAMP AS day, count(DISTINCT date_trunc('minute', t)) AS minutes, {r('count(DISTINCT date_trunc(' + chr(39) + 'minute' + chr(39) + ', t)) / 1440')} AS share FROM ticks GROUP BY 1, 2")


def trader_lines(spark, d):
    """One line for each supplier: trades, win rate, staked, gain and gain per unit staked."""
    x = T.trades(spark, d).groupBy("supp").agg(F.count("*").alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.sum("entry").alias("staked"), F.sum("pnl").alias("pnl"), F.max("t").alias("last_t"))
    return rounded(x.withColumn("per_unit", F.try_divide(F.col("pnl"), F.col("staked"))))


add("trader_lines", trader_lines, f"{_T} SELECT supp, count(*) AS n, {r('avg((pnl > 0)::INTEGER)')} AS win_rate, {r('sum(entry)')} AS staked, {r('sum(pnl)')} AS pnl, max(t) AS last_t, {r('sum(pnl) / nullif(sum(entry), 0)')} AS per_unit FROM trades GROUP BY 1")


def policy_values(spark, d):
    """The value of each policy on each window as a map, null where it stands down; here one row per policy."""
    x = T.windows(spark, d)
    gain = F.col("y") - F.col("market")
    policies = {"always": gain, "edge": F.when(F.col("p") > F.col("market"), gain), "cheap": F.when(F.col("market") < 0.45, gain), "against": F.when(F.col("p") < F.col("market"), -gain)}
    m = x.select("k", F.create_map(*(c for n, v in policies.items() for c in (F.lit(n), v))).alias("m"))
    return rounded(m.select("k", F.explode("m").alias("policy", "value")).groupBy("k", "policy").agg(F.count("*").alias("n"), F.count("value").alias("taken"), F.avg("value").alias("mean")))


add(
    "policy_values",
    policy_values,
    f"{_W}, p AS (SELECT k, unnest(['always', 'edge', 'cheap', 'against']) AS policy, unnest([y - market, CASE WHEN p > market THEN y - market END, CASE WHEN market < 0.45 THEN y - market END, CASE WHEN p < market THEN market - y END]) AS v FROM windows) SELECT k, policy, count(*) AS n, count(v) AS taken, {r('avg(v)')} AS mean FROM p GROUP BY 1, 2",
)


def execution_ledger(spark, d):
    """Purchases with the age of the quote they saw and the move of the nearest quote an hour later."""
    x = T.ticks(spark, d)
    of = lambda k: x.where(F.col("k") == k).select(F.col("user_id").alias("k"), "t", "id", "px")
    seen = J.as_of(of("purchase"), of("view"), "px", "1 day")
    age = (F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col("q_t").cast("timestamp"))) / 1e6
    after = J.as_of_forward(seen.withColumn("q_age", age), of("view"), "px", "1 day")
    return rounded(after.where("q_t is not null").select("id", "px", F.round("q_age", 3).alias("q_age"), (F.col("px") - F.col("q_value")).alias("slippage"), (F.col("n_value") - F.col("q_value")).alias("markout")))


add(
    "execution_ledger",
    execution_ledger,
    f"{_K}, l AS (SELECT user_id AS k, t, id, px FROM ticks WHERE k = 'purchase'), q AS (SELECT user_id AS k, t, id, px FROM ticks WHERE k = 'view'), b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY id DESC) = 1), f AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY id) = 1), "
    "s AS (SELECT l.*, b.t AS qt, b.px AS qv FROM l ASOF LEFT JOIN b ON b.k = l.k AND b.t <= l.t), n AS (SELECT s.*, f.t AS nt, f.px AS nv FROM s ASOF LEFT JOIN f ON f.k = s.k AND f.t >= s.t) "
    f"SELECT id, {r('px')} AS px, {r('(epoch_us(t) - epoch_us(qt)) / 1e6', 3)} AS q_age, {r('px - qv')} AS slippage, {r('CASE WHEN nt <= t + INTERVAL 1 DAY THEN nv - qv END')} AS markout FROM n WHERE qt >= t - INTERVAL 1 DAY",
)


def bars_of_bars_agree(spark, d):
    """Four-hour bars straight from ticks and through hourly ones, where both are complete: no row differs."""
    direct, through = B.resample(T.ticks(spark, d), "4 hours"), B.coarser(T.hourly(spark, d), "4 hours")
    both = direct.join(through.select("k", "t", F.col("o").alias("o2"), F.col("c").alias("c2")), ["k", "t"])
    return both.groupBy("k").agg(F.count("*").alias("n"), F.sum(((F.col("o") != F.col("o2")) | (F.col("c") != F.col("c2"))).cast("long")).alias("differ"))


add("bars_of_bars_agree", bars_of_bars_agree, f"{_B}, {T.bars_sql('direct', '4 hours')}, b AS (SELECT k, time_bucket(INTERVAL '4 hours', t) AS x FROM bars GROUP BY 1, 2), c AS (SELECT k, x FROM b QUALIFY x < max(x) OVER (PARTITION BY k)) SELECT d.k, count(*) AS n, 0::BIGINT AS differ FROM direct d JOIN c ON c.k = d.k AND c.x = d.t GROUP BY 1")

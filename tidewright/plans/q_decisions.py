"""Queries of decisions, fills, settlement and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.operators import decisions as D
from tidewright.sources import tables as T

from .q_bars import _last
from .registry import add
from .shaping import r, rounded

_B, _W, _K, _T = f"WITH {T.BARS}", f"WITH {T.WINDOWS}", f"WITH {T.TICKS}", f"WITH {T.TRADES}"


def last_ticks(spark, d):
    return D.tail(T.ticks(spark, d).select("k", "t", "id", "px"), 25, "id")


add("last_ticks", last_ticks, f"{_K} SELECT k, t, id, px FROM ticks QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC, id DESC) <= 25")


def thinned_ticks(spark, d):
    return D.thinned(T.ticks(spark, d).select("k", "t", "id", "px"), 100, "id")


add("thinned_ticks", thinned_ticks, f"{_K}, i AS (SELECT k, t, id, px, row_number() OVER (PARTITION BY k ORDER BY t, id) - 1 AS i, greatest(ceil(count(*) OVER (PARTITION BY k) / 100.0)::BIGINT, 1) AS s FROM ticks) SELECT k, t, id, px FROM i WHERE i % s = 0")


def loss_tags(spark, d):
    x = T.windows(spark, d).where("y = 0")
    every, first = D.tags((F.col("p") >= 0.6, "OVERCONFIDENT"), (F.col("p") > F.col("market"), "AGAINST_MARKET"), (F.col("n") <= 1, "THIN"), (F.abs(F.col("final") - F.col("strike")) < 5, "KNIFE_EDGE"))
    return x.groupBy(F.concat_ws("|", every).alias("tags"), F.coalesce(first, F.lit("none")).alias("first")).agg(F.count("*").alias("n"))


add(
    "loss_tags",
    loss_tags,
    f"{_W}, g AS (SELECT concat_ws('|', CASE WHEN p >= 0.6 THEN 'OVERCONFIDENT' END, CASE WHEN p > market THEN 'AGAINST_MARKET' END, CASE WHEN n <= 1 THEN 'THIN' END, CASE WHEN abs(final - strike) < 5 THEN 'KNIFE_EDGE' END) AS tags FROM windows WHERE y = 0) SELECT tags, CASE WHEN tags = '' THEN 'none' ELSE split_part(tags, '|', 1) END AS first, count(*) AS n FROM g GROUP BY 1, 2",
)


def call_alignment(spark, d):
    x = T.windows(spark, d)
    call, market = (F.col("p") >= 0.52).cast("int"), (F.col("market") >= 0.5).cast("int")
    return x.groupBy("k", D.alignment(call, market, F.col("y")).alias("kind")).agg(F.count("*").alias("n"))


add(
    "call_alignment",
    call_alignment,
    f"{_W}, a AS (SELECT k, y, (p >= 0.52)::INTEGER AS c, (market >= 0.5)::INTEGER AS m FROM windows) SELECT k, CASE WHEN c = y AND m = y THEN 'both_right' WHEN c = y THEN 'alone_right' WHEN m = y THEN 'alone_wrong' ELSE 'both_wrong' END AS kind, count(*) AS n FROM a GROUP BY 1, 2",
)


def daily_edge(spark, d):
    return rounded(D.daily(T.windows(spark, d)))


add("daily_edge", daily_edge, f"{_W} SELECT date_trunc('day', t)::TIMESTAMP AS day, count(*) AS n, {r('avg(y)')} AS win_rate, {r('avg(market)')} AS break_even, {r('avg(y) - avg(market)')} AS edge FROM windows GROUP BY 1")


def one_decision_per_window(spark, d):
    x = T.ticks(spark, d).withColumn("w", F.window("t", "15 minutes")["end"])
    x = x.withColumn("left", (F.unix_micros(F.col("w").cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))))
    return D.one_decision(x, ["k", "w"], "left", 12 * 60e6).select("k", "w", "id", "left")


add(
    "one_decision_per_window",
    one_decision_per_window,
    f"{_K}, x AS (SELECT k, id, time_bucket(INTERVAL '15 minutes', t) + INTERVAL 15 MINUTES AS w, (epoch_us(time_bucket(INTERVAL '15 minutes', t) + INTERVAL 15 MINUTES) - epoch_us(t)) AS l FROM ticks) SELECT k, w, id, l AS left FROM x WHERE l <= 12 * 60e6 QUALIFY row_number() OVER (PARTITION BY k, w ORDER BY l DESC, id) = 1",
)


def direction_paper_pnl(spark, d):
    return rounded(D.direction_pnl(T.hourly(spark, d)), 4)


add(
    "direction_paper_pnl",
    direction_paper_pnl,
    f"{_B}, x AS (SELECT k, t, sign(c - lag(c) OVER w) * (lead(c) OVER w / c - 1) * 10000 AS b FROM bars WINDOW w AS (PARTITION BY k ORDER BY t)), h AS (SELECT k, b, row_number() OVER (PARTITION BY k ORDER BY t) <= count(*) OVER (PARTITION BY k) // 2 AS h FROM x WHERE b IS NOT NULL) SELECT k, count(*) AS n, {r('sum(b)', 4)} AS bps, {r('avg(b) FILTER (NOT h) - avg(b) FILTER (h)', 4)} AS improvement FROM h GROUP BY k",
)


_WAIT = "avg(epoch(date_trunc('second', filled)) - epoch(date_trunc('second', t0)))"


def limit_fill_curve(spark, d):
    x = T.ticks(spark, d)
    return rounded(D.fill_curve(x, x, [0.0, 2.0, 5.0, 10.0], "2 hours"))


add(
    "limit_fill_curve",
    limit_fill_curve,
    f"{_K}, o AS (SELECT k, t AS t0, id, px, distance FROM ticks, (VALUES (0.0::DOUBLE), (2.0), (5.0), (10.0)) v(distance)), f AS (SELECT o.k, o.id, o.distance, o.t0, min(q.t) AS filled FROM o LEFT JOIN ticks q ON q.k = o.k AND q.t > o.t0 AND q.t <= o.t0 + INTERVAL 2 HOURS AND q.px <= o.px - o.distance GROUP BY ALL) "
    f"SELECT k, distance, count(*) AS n, {r('avg((filled IS NOT NULL)::INTEGER)')} AS filled, {r(_WAIT)} AS wait_s FROM f GROUP BY 1, 2",
)


def missingness_parity(spark, d):
    return rounded(D.missingness(T.windows(spark, d), F.col("n") > 1, "strike"))


add("missingness_parity", missingness_parity, f"{_W} SELECT n > 1 AS kept, count(*) AS n, list_sort(list(strike))[count(*) // 2 + 1] AS median, {r('avg(y)')} AS up FROM windows GROUP BY 1")


def consensus_vote(spark, d):
    x = T.windows(spark, d).select(F.col("k").alias("arm"), "t", F.col("p").alias("vote"), F.round(F.abs(F.col("p") - F.col("y")), 6).alias("loss"))
    return rounded(D.consensus(x, "arm", "vote", "loss", 3))


add(
    "consensus_vote",
    consensus_vote,
    f"{_W}, v AS (SELECT k AS arm, t, p AS vote, avg(round(abs(p - y), 6)) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l FROM windows), w AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY l DESC NULLS LAST, arm DESC) AS i, max(l) OVER (PARTITION BY t) AS m FROM v) SELECT t, count(*) AS voters, {r('list_sort(list(vote))[(count(*) - 1) // 2 + 1]')} AS consensus FROM w WHERE m IS NULL OR i > 1 GROUP BY t",
)


def agreed_median(spark, d):
    x = T.hourly(spark, d).withColumn("d", F.round(F.col("c") - F.col("o"), 2))
    return D.agreed_median(x, "d").select("k", "t", "agreed")


add(
    "agreed_median",
    agreed_median,
    f"{_B}, m AS (SELECT k, t, median(round(c - o, 2)) {_last(30)} AS a, median(round(c - o, 2)) {_last(10)} AS b FROM bars) SELECT k, t, CASE WHEN sign(a) * sign(b) > 0 THEN trunc(CASE WHEN abs(a) <= abs(b) THEN a ELSE b END)::BIGINT ELSE 0 END AS agreed FROM m",
)


def price_histogram(spark, d):
    return D.histogram(T.ticks(spark, d), "px", 0.0, 100.0, 20)


add("price_histogram", price_histogram, f"{_K} SELECT k, greatest(0, least(19, floor(px / 100 * 20)))::INTEGER AS bin, count(*) AS n FROM ticks GROUP BY 1, 2")


def episode_scores(spark, d):
    return rounded(D.episode_score(T.windows(spark, d), "strike", "final"))


add(
    "episode_scores",
    episode_scores,
    f"{_W} SELECT k, count(*) AS n, {r('avg((trunc(strike) = trunc(final))::INTEGER)')} AS exact, {r('avg((abs(strike - final) <= 1)::INTEGER)')} AS within_1, {r('avg((abs(strike - final) <= 10)::INTEGER)')} AS within_10, {r('avg((abs(strike - final) <= 50)::INTEGER)')} AS within_50, {r('avg(abs(strike - final))')} AS mae, {r('sqrt(avg((strike - final) ** 2))')} AS rmse FROM windows GROUP BY k",
)


def shaped_rewards(spark, d):
    x = T.windows(spark, d).withColumn("reward", D.shaped_reward(F.abs(F.col("final") - F.col("strike")), F.lit(20.0), (F.col("p") >= 0.5) == (F.col("y") == 1)))
    return rounded(x.groupBy("k").agg(F.avg("reward").alias("reward"), F.min("reward").alias("least"), F.max("reward").alias("most")))


_U = "abs(final - strike) / 20"
_REWARD = f"(greatest(-1.0, CASE WHEN {_U} <= 1 THEN 1 - {_U} / 2 ELSE (2 - {_U}) / 2 END) + CASE WHEN (p >= 0.5) = (y = 1) THEN 0.1 ELSE 0.0 END)"
add("shaped_rewards", shaped_rewards, f"{_W} SELECT k, {r(f'avg({_REWARD})')} AS reward, {r(f'min({_REWARD})')} AS least, {r(f'max({_REWARD})')} AS most FROM windows GROUP BY k")


def stakes(spark, d):
    x = T.ticks(spark, d)
    return x.select("id", D.stake(F.lit(50_000.0), F.col("px"), F.lit(2.0), 0.05, F.col("size")).alias("contracts"))


add("stakes", stakes, f"{_K} SELECT id, greatest(0, floor(least(50000.0 * 0.05 / (px + 2), size)))::BIGINT AS contracts FROM ticks")


def binary_settlement(spark, d):
    b = T.hourly(spark, d)
    calls = b.select("k", (F.col("t") + F.expr("interval 3 hours")).alias("close_t"), F.col("c").alias("strike"), F.round(F.col("v") / 200, 6).alias("p"))
    return rounded(D.settle_binary(calls, b, "1 hour").drop("final"))


add(
    "binary_settlement",
    binary_settlement,
    f"{_B}, x AS (SELECT a.k, a.t + INTERVAL 3 HOURS AS close_t, a.c AS strike, round(a.v / 200, 6) AS p, (b.c >= a.c)::INTEGER AS actual FROM bars a LEFT JOIN bars b ON a.k = b.k AND b.t = a.t + INTERVAL 2 HOURS) SELECT k, close_t, strike, {r('p')} AS p, actual, ((p >= 0.5)::INTEGER = actual)::INTEGER AS hit, {r('(p - actual) ** 2')} AS brier FROM x",
)


def zombie_orders(spark, d):
    """Open orders past a date without a line item."""
    opened = T.table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t"))
    closed = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return D.zombies(opened, closed, ["id"], F.lit("2000-01-01").cast("timestamp_ntz"))


add("zombie_orders", zombie_orders, "SELECT o_orderkey AS id, o_orderdate AS t FROM orders o WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '2000-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")


def reason_ablation(spark, d):
    """Mean gain of each line status against status F, by flag."""
    x = T.trades(spark, d).groupBy("k", "reason").agg(F.avg("pnl").alias("mean"))
    return rounded(D.ablation(x, "reason", "F", "mean", 20.0))


add(
    "reason_ablation",
    reason_ablation,
    f"{_T}, m AS (SELECT k, reason, avg(pnl) AS mean FROM trades GROUP BY 1, 2), j AS (SELECT a.k, a.reason, a.mean, a.mean - b.mean AS dl FROM m a JOIN m b ON a.k = b.k AND b.reason = 'F' WHERE a.reason <> 'F') SELECT k, reason, {r('mean')} AS mean, {r('dl')} AS delta, CASE WHEN dl > 20 THEN 'positive' WHEN dl < -20 THEN 'negative' ELSE 'neutral' END AS label FROM j",
)


def recommended_setting(spark, d):
    return rounded(D.snapped_median(T.ticks(spark, d), "px", [10.0, 20.0, 30.0, 40.0, 60.0]))


add("recommended_setting", recommended_setting, f"{_K}, m AS (SELECT median(px) AS m FROM ticks) SELECT {r('m')} AS median, (SELECT a FROM (VALUES (10.0::DOUBLE), (20.0), (30.0), (40.0), (60.0)) v(a) ORDER BY abs(a - m), a LIMIT 1) AS snapped FROM m")


def readiness_verdict(spark, d):
    """Over keys of trades, with the deepest fall of a purse of ten million from its peak, by days."""
    x = T.trades(spark, d)
    days = x.groupBy("k", "t").agg(F.sum("pnl").alias("pnl"))
    so_far = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    purse = days.withColumn("purse", 10_000_000.0 + F.sum("pnl").over(so_far)).withColumn("peak", F.greatest(F.max("purse").over(so_far), F.lit(10_000_000.0)))
    falls = purse.groupBy("k").agg(F.max((F.col("peak") - F.col("purse")) / F.col("peak")).alias("drawdown"))
    wins = x.groupBy("k").agg(F.count("*").alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))
    return rounded(D.verdict(wins.join(falls, "k")))


add(
    "readiness_verdict",
    readiness_verdict,
    f"{_T}, d AS (SELECT k, t, sum(pnl) AS pnl FROM trades GROUP BY 1, 2), e AS (SELECT k, t, 10000000.0::DOUBLE + sum(pnl) OVER (PARTITION BY k ORDER BY t) AS purse FROM d), f AS (SELECT k, greatest(max(purse) OVER (PARTITION BY k ORDER BY t), 10000000.0) AS peak, purse FROM e), "
    "x AS (SELECT k, count(*) AS n, avg((pnl > 0)::INTEGER) AS w FROM trades GROUP BY k), v AS (SELECT count(*) AS traded, avg((w > 0.4)::INTEGER) AS good, bool_and(fall < 0.2) AS calm FROM x JOIN (SELECT k, max((peak - purse) / peak) AS fall FROM f GROUP BY 1) USING (k)) "
    f"SELECT traded, {r('good')} AS good, calm, CASE WHEN traded = 0 THEN 'FAILS' WHEN traded >= 3 AND good >= 0.5 AND calm THEN 'READY' WHEN NOT calm THEN 'NEEDS_RISK' ELSE 'NEEDS_EDGE' END AS verdict FROM v",
)

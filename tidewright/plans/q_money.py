"""Queries of the money audit and of spans over all sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.operators import intervals as I
from tidewright.operators import money as M
from tidewright.sources import tables as T

from .registry import add
from .shaping import r, rounded

START = 100_000


def _book(spark, d):
    """Orders as an account's trades (an account for each nation): contracts, prices and outcomes from the order's
    numbers, stamps from a running sum, and defects in some rows of each kind, told by the order's number."""
    o = T.table(spark, d, "orders").join(T.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("k")), "o_custkey")
    i = F.col("o_orderkey").cast("long")
    mod = lambda m, x: i % m == x
    o = o.select("k", F.col("o_orderdate").cast("timestamp_ntz").alias("t"), i.alias("id"), "o_custkey", F.floor("o_totalprice").cast("long").alias("price"))
    i = F.col("id")
    o = o.withColumn("skipped", mod(17, 3)).withColumn("open", ~F.col("skipped") & mod(29, 4))
    ask = (F.lit(1) + F.col("price") % 98).cast("decimal(8,4)") + F.when(mod(7, 0), F.lit(0.25)).otherwise(F.lit(0)).cast("decimal(8,4)")
    o = o.withColumn("ask", ask.cast("decimal(8,4)")).withColumn("contracts", F.when(F.col("skipped"), F.lit(0)).otherwise(1 + F.col("o_custkey") % 20).cast("long"))
    fee = F.when(mod(5, 1), M.contract_fee(F.col("contracts"), F.col("ask"))).otherwise(M.order_fee(F.col("contracts"), F.col("ask")))
    stake = F.floor(F.col("contracts") * F.col("ask")).cast("long") + fee + F.when(mod(211, 5), 3).otherwise(0)
    o = o.withColumn("stake_c", F.when(F.col("skipped"), F.when(mod(13, 1), F.lit(5)).otherwise(0)).otherwise(stake).cast("long"))
    o = o.withColumn("actual", F.when(~F.col("skipped") & ~F.col("open"), (F.col("price") % 2).cast("int"))).withColumn("side", F.when(mod(2, 0), "yes").otherwise("no"))
    won = (F.col("actual") == 1) == (F.col("side") == "yes")
    o = o.withColumn("win", F.when(mod(227, 11), ~won).otherwise(won))
    pnl = F.when(F.col("win"), 100 * F.col("contracts") - F.col("stake_c")).otherwise(-F.col("stake_c")) + F.when(mod(223, 7), 1).otherwise(0)
    o = o.withColumn("pnl_c", F.when(F.col("win").isNotNull(), pnl).cast("long"))
    o = o.withColumn("skim_c", F.when(mod(6, 2), 7).otherwise(0).cast("long")).withColumn("wd_c", F.when(mod(10, 2), 11).cast("long"))
    o = o.withColumn("late_t", F.when(F.col("win").isNotNull() & mod(19, 2), F.col("t") + F.expr("interval 40 days"))).withColumn("ticker", i.cast("string"))
    walked = M.cash_walk(o, F.lit(START).cast("long"), "year")
    nxt = F.lead("stake_c", 1, 0).over(Window.partitionBy("k").orderBy("t", "id"))
    stamp = F.col("walk_c") - F.when(mod(23, 9) & ~F.col("skipped"), nxt).otherwise(0) + F.when(mod(229, 13), 777).otherwise(0)
    out = walked.withColumn("bankroll_c", F.when(~mod(11, 0), stamp)).withColumn("savings_c", F.when(mod(3, 0), F.col("saved_c") + F.when(mod(51, 9), 1).otherwise(0)))
    return out.drop("walk_c", "saved_c", "open", "price", "o_custkey")


def money_audit(spark, d):
    """Each ledger row's verdicts."""
    return M.audit(_book(spark, d), F.lit(START).cast("long"), "year").select("k", "id", "walk_c", *(F.col(f"`{c}`").alias(c.replace("-", "_")) for c in M.CHECKS if c != "treatments-ev-parity"))


_LATE = "late_t IS NOT NULL"
_MOVED = f"CASE WHEN win IS NULL THEN 0 WHEN {_LATE} THEN -stake_c - skim_c - coalesce(wd_c, 0) ELSE pnl_c - skim_c - coalesce(wd_c, 0) END"
_FEE = "ceil(contracts * ask * (100 - ask) * 7 / 10000.0)"
_OLD = "contracts * ceil(ask * (100 - ask) * 7 / 10000.0)"
#: Halves and quarters are exact in floating point, and so are these sums of cents.
BOOK = f"""o1 AS (SELECT c_nationkey::VARCHAR AS k, o_orderdate::TIMESTAMP AS t, o_orderkey::BIGINT AS id, o_custkey, floor(o_totalprice)::BIGINT AS price, o_orderkey % 17 = 3 AS skipped FROM orders JOIN customer ON c_custkey = o_custkey),
o2 AS (SELECT *, NOT skipped AND id % 29 = 4 AS open, (1 + price % 98 + CASE WHEN id % 7 = 0 THEN 0.25 ELSE 0 END)::DOUBLE AS ask, CASE WHEN skipped THEN 0 ELSE 1 + o_custkey % 20 END::BIGINT AS contracts, CASE WHEN id % 2 = 0 THEN 'yes' ELSE 'no' END AS side FROM o1),
o3 AS (SELECT *, CASE WHEN skipped THEN CASE WHEN id % 13 = 1 THEN 5 ELSE 0 END ELSE floor(contracts * ask) + CASE WHEN id % 5 = 1 THEN {_OLD} ELSE {_FEE} END + CASE WHEN id % 211 = 5 THEN 3 ELSE 0 END END::BIGINT AS stake_c, CASE WHEN NOT skipped AND NOT open THEN price % 2 END AS actual FROM o2),
o4 AS (SELECT *, CASE WHEN id % 227 = 11 THEN NOT ((actual = 1) = (side = 'yes')) ELSE (actual = 1) = (side = 'yes') END AS win FROM o3),
o5 AS (SELECT *, CASE WHEN win IS NOT NULL THEN CASE WHEN win THEN 100 * contracts ELSE 0 END - stake_c + CASE WHEN id % 223 = 7 THEN 1 ELSE 0 END END AS pnl_c, CASE WHEN id % 6 = 2 THEN 7 ELSE 0 END AS skim_c, CASE WHEN id % 10 = 2 THEN 11 END AS wd_c, CASE WHEN win IS NOT NULL AND id % 19 = 2 THEN t + INTERVAL 40 DAYS END AS late_t FROM o4),
moves AS (SELECT k, t, 1 AS s, id, {_MOVED} AS d, CASE WHEN win IS NULL THEN 0 ELSE skim_c END AS v FROM o5 UNION ALL SELECT k, late_t, 0, id, pnl_c + stake_c, 0 FROM o5 WHERE {_LATE}),
walked AS (SELECT *, ({START} + sum(d) OVER w)::BIGINT AS walk_c, (sum(v) OVER w)::BIGINT AS saved_c FROM moves WINDOW w AS (PARTITION BY k ORDER BY t, s, id ROWS UNBOUNDED PRECEDING)),
book AS (SELECT o.*, walk_c, saved_c, coalesce(lead(stake_c, 1) OVER w, 0) AS n1, coalesce(lead(stake_c, 2) OVER w, 0) AS n2, coalesce(lead(stake_c, 3) OVER w, 0) AS n3, coalesce(lead(stake_c, 4) OVER w, 0) AS n4 FROM o5 o JOIN walked x ON x.k = o.k AND x.id = o.id AND x.s = 1 WINDOW w AS (PARTITION BY o.k ORDER BY o.t, o.id)),
stamped AS (SELECT *, CASE WHEN id % 11 <> 0 THEN CASE WHEN id % 23 = 9 AND NOT skipped THEN -n1 ELSE 0 END + CASE WHEN id % 229 = 13 THEN 777 ELSE 0 END END AS shift, NOT (id % 3 = 0 AND id % 51 = 9) AS saved FROM book)"""
_STEP = """CASE WHEN s.skipped THEN f.shift WHEN NOT s.saved THEN s.shift WHEN f.shift - s.shift IN (0, s.n1, s.n1 + s.n2, s.n1 + s.n2 + s.n3, s.n1 + s.n2 + s.n3 + s.n4) THEN f.shift ELSE s.shift END"""
_OK = """CASE WHEN s.skipped THEN s.shift = f.shift ELSE s.saved AND f.shift - s.shift IN (0, s.n1, s.n1 + s.n2, s.n1 + s.n2 + s.n3, s.n1 + s.n2 + s.n3 + s.n4) END"""
AUDIT = f"""{BOOK},
rowed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, id) AS i FROM stamped WHERE shift IS NOT NULL AND (skipped OR win IS NOT NULL)),
fold AS (SELECT k, 0::BIGINT AS i, 0::BIGINT AS id, 0::BIGINT AS shift, NULL::BOOLEAN AS ok FROM (SELECT DISTINCT k FROM rowed) UNION ALL SELECT s.k, s.i, s.id, ({_STEP})::BIGINT, {_OK} FROM fold f JOIN rowed s ON s.k = f.k AND s.i = f.i + 1),
fees AS (SELECT b.*, f.ok, stake_c - contracts * ask AS implied, {_FEE} AS now_, {_OLD} AS old_, CASE WHEN ask = floor(ask) THEN 0 ELSE 1 END AS slack FROM stamped b LEFT JOIN fold f ON f.k = b.k AND f.id = b.id AND f.i > 0),
audited AS (SELECT *, CASE WHEN abs(implied - now_) <= slack THEN now_ WHEN abs(implied - old_) <= slack THEN old_ ELSE implied END AS taken FROM fees)"""
add(
    "money_audit",
    money_audit,
    f"""WITH RECURSIVE {AUDIT} SELECT k, id, walk_c, CASE WHEN win IS NOT NULL THEN abs(implied - now_) <= slack OR abs(implied - old_) <= slack END AS fee_parity, CASE WHEN win IS NOT NULL THEN abs(stake_c - contracts * ask - taken) <= 1 END AS stake_parity,
CASE WHEN win IS NOT NULL THEN pnl_c = CASE WHEN win THEN 100 * contracts ELSE 0 END - stake_c END AS pnl_parity, CASE WHEN win IS NOT NULL THEN win = CASE WHEN side = 'yes' THEN actual = 1 ELSE actual = 0 END END AS win_flag_consistency,
CASE WHEN NOT skipped THEN ok END AS bankroll_conservation, CASE WHEN skipped THEN stake_c = 0 AND coalesce(ok, true) END AS skip_row_hygiene FROM audited""",
)


def _claims(book):
    """What a report says of every third order's value for its cost; some of it wrong."""
    cost = F.col("ask").cast("double") + 2
    due = F.when(F.col("win"), (F.lit(100.0) - cost) / cost).otherwise(-1.0)
    said = due + F.when(F.col("id") % 201 == 9, 0.01).otherwise(0.0)
    return book.where("id % 3 = 0 and win is not null").select("ticker", said.alias("ev"))


def money_reconciliation(spark, d):
    """The seven checks over all accounts."""
    book = _book(spark, d).withColumn("fee_c", F.lit(1.4))
    return M.report(M.audit(book, F.lit(START).cast("long"), "year"), M.ev_parity(book, _claims(book)))


_EACH = [
    ("fee-parity", "win IS NOT NULL", "abs(implied - now_) <= slack OR abs(implied - old_) <= slack"), ("stake-parity", "win IS NOT NULL", "abs(stake_c - contracts * ask - taken) <= 1"), ("pnl-parity", "win IS NOT NULL", "pnl_c = CASE WHEN win THEN 100 * contracts ELSE 0 END - stake_c"),
    ("win-flag-consistency", "win IS NOT NULL", "win = CASE WHEN side = 'yes' THEN actual = 1 ELSE actual = 0 END"), ("bankroll-conservation", "NOT skipped AND ok IS NOT NULL", "ok"), ("skip-row-hygiene", "skipped", "stake_c = 0 AND coalesce(ok, true)"), ("treatments-ev-parity", "id % 3 = 0 AND win IS NOT NULL", "id % 201 <> 9"),
]
add(
    "money_reconciliation",
    money_reconciliation,
    f"WITH RECURSIVE {AUDIT}, each AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, count(*) FILTER (NOT ({ok})) AS bad FROM audited WHERE {of}" for n, of, ok in _EACH) + ") SELECT name, rows, bad + (name = 'treatments-ev-parity' AND rows < 50)::BIGINT AS mismatches, CASE WHEN bad + (name = 'treatments-ev-parity' AND rows < 50)::BIGINT = 0 THEN 'OK' ELSE 'FAIL' END AS status FROM each",
)

_QUIET = 15


def silences_in_all_sources(spark, d):
    """Spans of over 15 minutes in which no kind of event occurs."""
    return I.silences_in_all(T.ticks(spark, d), _QUIET)


_MINUTES = f"{T.TICKS}, have AS (SELECT DISTINCT k, date_trunc('minute', t) AS m FROM ticks)"
_SILENT = f"{_MINUTES}, u AS (SELECT DISTINCT m FROM have), n AS (SELECT m, lead(m) OVER (ORDER BY m) AS z FROM u), silent AS (SELECT m + INTERVAL 1 MINUTE AS a, z FROM n WHERE z > m + INTERVAL {_QUIET} MINUTES)"
add("silences_in_all_sources", silences_in_all_sources, f"WITH {_SILENT} SELECT a, z FROM silent")


def coverage_net_of_outages(spark, d):
    x = T.ticks(spark, d)
    return rounded(I.coverage_net_of(x, I.silences_in_all(x, _QUIET)))


_OUT = f"{_SILENT}, out_m AS (SELECT unnest(generate_series(a, z - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS m FROM silent), span AS (SELECT date_diff('minute', min(m), max(m)) + 1 AS n FROM have), om AS (SELECT count(*) AS n, count(DISTINCT time_bucket(INTERVAL 5 MINUTES, m)) AS b FROM out_m)"
add(
    "coverage_net_of_outages",
    coverage_net_of_outages,
    f"WITH {_OUT} SELECT k, count(*) AS minutes, {r('count(*) / greatest(1, any_value(span.n) - any_value(om.n))')} AS minute_presence, {r('count(DISTINCT time_bucket(INTERVAL 5 MINUTES, m)) / greatest(1, ceil(any_value(span.n) / 5) - any_value(om.b))')} AS bucket_presence FROM have, span, om GROUP BY k",
)


def gaps_net_of_outages(spark, d):
    """A source's gaps of over an hour, less the minutes of silence of all sources in them."""
    x = T.ticks(spark, d)
    return I.gaps_net_of(x, I.silences_in_all(x, _QUIET), 60)


add(
    "gaps_net_of_outages",
    gaps_net_of_outages,
    f"WITH {_SILENT}, g AS (SELECT k, lag(m) OVER (PARTITION BY k ORDER BY m) AS a, m AS z FROM have), h AS (SELECT g.k, g.a, g.z, date_diff('minute', g.a, g.z) - coalesce(sum(date_diff('minute', s.a, s.z)), 0)::BIGINT AS hole FROM g LEFT JOIN silent s ON s.a > g.a AND s.z <= g.z WHERE g.a IS NOT NULL GROUP BY 1, 2, 3) SELECT * FROM h WHERE hole > 60",
)


def reference_prices(spark, d):
    """By minute the upper median over sources of their last price."""
    return I.reference_price(T.ticks(spark, d))


add("reference_prices", reference_prices, f"WITH {T.TICKS}, l AS (SELECT k, date_trunc('minute', t) AS t, last(px ORDER BY ts, id) AS px FROM (SELECT k, t AS ts, date_trunc('minute', t) AS t, px, id FROM ticks) GROUP BY 1, 2) SELECT t, list_sort(list(px))[count(*) // 2 + 1] AS price, count(*) AS sources FROM l GROUP BY 1")


def sources_overlap(spark, d):
    """Spans in which at least three kinds of event have one within half an hour before."""
    x = T.ticks(spark, d).select("k", F.col("t").alias("a"), (F.col("t") + F.expr("interval 30 minutes")).alias("z"))
    return I.in_all(x, [], "k", 3)


_U = f"{T.TICKS}, p AS (SELECT DISTINCT k, t AS a, t + INTERVAL 30 MINUTES AS z FROM ticks), f AS (SELECT *, coalesce(a > max(z) OVER (PARTITION BY k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INTEGER AS f FROM p), g AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM f), u AS (SELECT k, min(a) AS a, max(z) AS z FROM g GROUP BY k, g)"
add(
    "sources_overlap",
    sources_overlap,
    f"WITH {_U}, e AS (SELECT t, sum(d) AS d FROM (SELECT a AS t, 1 AS d FROM u UNION ALL SELECT z, -1 FROM u) GROUP BY 1), c AS (SELECT t, sum(d) OVER (ORDER BY t) AS n FROM e), b AS (SELECT t, n >= 3 AS on_, lag(n >= 3, 1, false) OVER (ORDER BY t) AS was FROM c), x AS (SELECT t, on_, lead(t) OVER (ORDER BY t) AS z FROM b WHERE on_ <> was) SELECT t AS a, z FROM x WHERE on_",
)

"""The money audit against a plain fold over each account's rows."""

from __future__ import annotations

import datetime as dt
import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

SCHEMA = "k string, t timestamp_ntz, id long, ticker string, side string, ask decimal(8,4), contracts long, stake_c long, pnl_c long, skim_c long, wd_c long, win boolean, actual int, skipped boolean, late_t timestamp_ntz, bankroll_c long, savings_c long, fee_c double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def ledger(seed, accounts=3, n=120):
    """Correct ledgers with some rows settled late, skipped, open or in flight."""
    r = random.Random(seed)
    rows = []
    for a in range(accounts):
        mine, t = [], dt.datetime(2024, 1, 1)
        for i in range(n):
            t += dt.timedelta(hours=r.randint(0, 60))
            skipped, contracts, ask = r.random() < 0.1, r.randint(1, 30), Fraction(r.randint(4, 390), 4) if r.random() < 0.2 else Fraction(r.randint(1, 98))
            fee = math.ceil(7 * contracts * ask * (100 - ask) / 10000) if r.random() < 0.8 else contracts * math.ceil(7 * ask * (100 - ask) / 10000)
            stake, actual, side = int(contracts * ask) + fee, r.randint(0, 1), r.choice(["yes", "no"])
            win = (actual == 1) == (side == "yes")
            row = dict(k=f"a{a}", t=t, id=a * 1000 + i, ticker=f"w{a}-{i}", side=side, ask=ask, contracts=contracts, stake_c=stake, pnl_c=100 * contracts - stake if win else -stake, skim_c=r.choice([0, 0, 0, 7]), wd_c=r.choice([0, None, 11]), win=win, actual=actual, skipped=skipped or None, late_t=None, bankroll_c=None, savings_c=None, fee_c=1.0)
            if skipped:
                row |= dict(contracts=0, stake_c=0, pnl_c=0, skim_c=0, wd_c=0, win=None, actual=None)
            elif r.random() < 0.05:
                row |= dict(win=None, actual=None, pnl_c=None)
            elif r.random() < 0.1:
                row["late_t"] = t + dt.timedelta(days=r.randint(1, 50))
            mine.append(row)
        stamp(mine, r)
        rows += mine
    return rows


def walk(mine):
    """(row, cash that it should show, savings) in order."""
    cash, saved, late = 100_000, 0, sorted((x["late_t"], (x["pnl_c"] or 0) + (x["stake_c"] or 0)) for x in mine if x["late_t"])
    for x in sorted(mine, key=lambda x: (x["t"], x["id"])):
        while late and late[0][0] <= x["t"]:
            cash += late.pop(0)[1]
        if not x["skipped"] and x["win"] is not None:
            cash += (-x["stake_c"] if x["late_t"] else x["pnl_c"]) - (x["skim_c"] or 0) - (x["wd_c"] or 0)
            saved += x["skim_c"] or 0
        yield x, cash, saved


def stamp(mine, r):
    order = [x for x, _, _ in walk(mine)]
    for i, (x, cash, saved) in enumerate(walk(mine)):
        if r.random() < 0.9:
            short = sum(y["stake_c"] or 0 for y in order[i + 1 : i + 1 + r.randint(1, 4)]) if r.random() < 0.15 and not x["skipped"] else 0
            x["bankroll_c"], x["savings_c"] = cash - short, r.choice([saved, None])


def brute(rows):
    """Verdicts on stamps, by one pass over each account."""
    out = {}
    for k in {x["k"] for x in rows}:
        mine = [x for x in rows if x["k"] == k]
        order, shift = [x for x, _, _ in walk(mine)], 0
        for i, (x, cash, saved) in enumerate(walk(mine)):
            if x["bankroll_c"] is None or not (x["skipped"] or x["win"] is not None):
                continue
            off = x["bankroll_c"] - cash
            if x["skipped"]:
                out[x["id"]] = off == shift
                continue
            acc, flying = 0, False
            for y in order[i + 1 : i + 5]:
                acc += y["stake_c"] or 0
                flying |= acc == shift - off
            good = (off == shift or flying) and x["savings_c"] in (None, saved)
            out[x["id"]] = good
            shift = shift if good else off
    return out


def frame(spark, rows):
    import decimal

    return spark.createDataFrame([tuple(decimal.Decimal(x[c].numerator) / x[c].denominator if c == "ask" else x[c] for c in NAMES) for x in rows], SCHEMA).repartition(5)


def audited(spark, rows):
    from tidewright.operators import money

    return money.audit(frame(spark, rows), F.lit(100_000).cast("long"))


def faults(spark, rows):
    from tidewright.operators import money

    out = audited(spark, rows).collect()
    return sorted((c, x.id) for x in out for c in money.CHECKS if c in x.asDict() and x[c] is False)


def test_fees(spark):
    from tidewright.operators import money

    got = spark.createDataFrame([(1, 50), (10, 50), (7, 30), (3, 80)], "c long, a int").select(money.order_fee(F.col("c"), F.col("a")), money.contract_fee(F.col("c"), F.col("a")))
    assert [tuple(x) for x in got.collect()] == [(2, 2), (18, 20), (11, 14), (4, 6)]


def test_sound_ledgers_have_no_fault(spark):
    assert faults(spark, ledger(1)) == []


def test_each_planted_defect_is_found_and_only_that(spark):
    def planted(change, pick=lambda x: not x["skipped"] and x["win"] is not None and x["late_t"] is None and x["ask"].denominator == 1):
        rows = ledger(2)
        x = [y for y in rows if pick(y)][40 % sum(map(pick, rows))]
        change(x)
        for y in rows:  # the walk follows what the row says
            y["bankroll_c"] = y["savings_c"] = None
        r = random.Random(9)
        for k in {y["k"] for y in rows}:
            stamp([y for y in rows if y["k"] == k], r)
        return faults(spark, rows), x["id"]

    def fee(x):
        x["stake_c"] += 3
        x["pnl_c"] -= 3

    found, i = planted(fee)
    assert found == [("fee-parity", i)]
    found, i = planted(lambda x: x.update(pnl_c=x["pnl_c"] + 1))
    assert found == [("pnl-parity", i)]
    found, i = planted(lambda x: x.update(actual=1 - x["actual"]))
    assert found == [("win-flag-consistency", i)]
    found, i = planted(lambda x: x.update(contracts=2), lambda x: x["skipped"] is True)
    assert found == [("skip-row-hygiene", i)]
    rows = ledger(3)
    lost = [x for x, cash, _ in walk([y for y in rows if y["k"] == "a1"]) if x["win"] is not None and x["bankroll_c"] == cash][30]
    for x in rows:  # money that goes missing once shows once
        if x["k"] == "a1" and x["bankroll_c"] is not None and (x["t"], x["id"]) >= (lost["t"], lost["id"]):
            x["bankroll_c"] -= 1
    found = faults(spark, rows)
    assert len(found) == 1 and found[0][0] == "bankroll-conservation"
    assert found == [("bankroll-conservation", i) for i, ok in brute(rows).items() if not ok]


def test_stamps_match_a_plain_fold(spark):
    for seed in (4, 5):
        r, rows = random.Random(seed), ledger(seed, accounts=4, n=150)
        for x in rows:
            if x["bankroll_c"] is not None and r.random() < 0.2:
                x["bankroll_c"] += r.choice([1, -1, 500, -500])
            if x["savings_c"] is not None and r.random() < 0.03:
                x["savings_c"] += 1
        want = brute(rows)
        for block in ("month", "day"):
            from tidewright.operators import money

            out = money.audit(frame(spark, rows), F.lit(100_000).cast("long"), block).collect()
            got = {x.id: x["skip-row-hygiene"] if x.skipped else x["bankroll-conservation"] for x in out if x.bankroll_c is not None and (x.skipped or x.win is not None)}
            assert len(out) == len(rows) and got == want
        assert 20 < sum(not v for v in want.values())


def test_report(spark):
    from tidewright.operators import money

    rows = ledger(6, accounts=1, n=90)
    book = frame(spark, rows)
    due = {x["ticker"]: (100.0 - (float(x["ask"]) + 1)) / (float(x["ask"]) + 1) if x["win"] else -1.0 for x in rows if x["win"] is not None}
    said = spark.createDataFrame([(k, v + (0.1 if i == 3 else 0)) for i, (k, v) in enumerate(due.items())] + [("unknown", 1.0), ("w0-1", None)], "ticker string, ev double")
    got = {x.name: (x.rows, x.mismatches, x.status) for x in money.report(audited(spark, rows), money.ev_parity(book, said)).collect()}
    assert set(got) == set(money.CHECKS) and got["treatments-ev-parity"] == (len(due), 1, "FAIL") and got["pnl-parity"] == (len(due), 0, "OK")
    few = money.report(audited(spark, rows), money.ev_parity(book, said.limit(0)))
    assert few.where("name = 'treatments-ev-parity'").first().mismatches == 1
    assert money.report(audited(spark, []), money.ev_parity(frame(spark, []), said.limit(0))).count() == 7

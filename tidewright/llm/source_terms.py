"""How the sources of a language diverge in their terms, by sort-based streaming.

Tasks count terms of their documents first, so that a term of any frequency is a row for each task and source. Rows
are then dealt by (lang, term, source) and by (lang, term), sorted in that order, and scanned once: each run of equal
keys gives document frequencies and counts, and what a run adds to pairs of sources is summed inside the task. So no
pair is a row for each term, and no task holds more than one run and its sums.

All numbers are whole; probabilities are in units of 1 / SCALE, rounded down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import dropped, looked_up, written
from .textkit import LOWER, slices, word_hashes, word_spans

SCALE = 1_000_000_000
#: Entries that a task counts before it hands them on, and rows that are worked on at once.
HELD_ENTRIES, BLOCK = 2_000_000, 1 << 20

#: True for the bytes of terms `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`: letters and all beyond ASCII.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[0x41:0x5B] = TERM_BYTES[0x61:0x7B] = TERM_BYTES[0x80:] = True

PARTIAL = "lang string, term string, source string, docs long, uses long"


def _run_starts(keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of the values over each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = _run_starts(keys)
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to PARTIAL: each term's documents and uses by language and source, within a task."""
    groups: dict[tuple[str, str], int] = {}
    names: dict[int, bytes] = {}
    held: list[tuple[np.ndarray, ...]] = []

    def handed_on() -> Iterator[pa.RecordBatch]:
        group, term, docs, uses = (np.concatenate(x) for x in zip(*held, strict=True))
        known, place = np.unique(term, return_inverse=True)
        key, docs, uses = _summed(group * len(known) + place, docs, uses)
        words = pa.array([names[h] for h in known.tolist()], pa.binary()).cast(pa.string())
        pairs = list(groups)
        for k in range(0, len(key), 65_536):
            part = key[k : k + 65_536]
            g = part // len(known)
            lang, source = (pa.array([x[i] for x in pairs], pa.string()).take(pa.array(g)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([lang, words.take(pa.array(part % len(known))), source, pa.array(docs[k : k + 65_536]), pa.array(uses[k : k + 65_536])], ["lang", "term", "source", "docs", "uses"])
        held.clear()
        names.clear()

    entries = 0
    for rows, raw, at in slices(batches, "text"):
        raw = LOWER[raw]
        starts, stops, first = word_spans(raw, at, TERM_BYTES)
        if not len(starts):
            continue
        of_row = np.array([groups.setdefault(x, len(groups)) for x in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), strict=True)], np.int64)
        known, one, place = np.unique(word_hashes(raw, starts, stops, TERM_BYTES), return_index=True, return_inverse=True)
        for h, a, b in zip(known.tolist(), starts[one].tolist(), stops[one].tolist(), strict=True):
            if h not in names:
                names[h] = raw[a:b].tobytes()
        row = np.repeat(np.arange(len(at) - 1), np.diff(first))
        key, uses = _summed(row * len(known) + place, np.ones(len(row), np.int64))
        key, docs, uses = _summed(of_row[key // len(known)] * len(known) + key % len(known), np.ones(len(key), np.int64), uses)
        held.append((key // len(known), known[key % len(known)], docs, uses))
        entries += len(key)
        if entries > HELD_ENTRIES:
            yield from handed_on()
            entries = 0
    if held:
        yield from handed_on()


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a run of equal keys begins in sorted rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = table.column(k).combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole runs, and where each run begins; the last run of a batch waits for the next."""
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if waiting and any(waiting[-1].column(k)[-1].as_py() != rows.column(k)[0].as_py() for k in keys):
            table = pa.concat_tables(waiting)
            yield table, _changes(table, keys)
            waiting = []
        last = int(_changes(rows, keys)[-1])
        if last:
            table = pa.concat_tables([*waiting, rows.slice(0, last)])
            yield table, _changes(table, keys)
            waiting = []
        waiting.append(rows.slice(last))
    if waiting:
        table = pa.concat_tables(waiting)
        yield table, _changes(table, keys)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def sum_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted PARTIAL to one row for each (lang, term, source); a run is a row for each task that counted."""
    for table, at in whole_runs(batches, ["lang", "term", "source"]):
        out = table.take(pa.array(at)).select(["lang", "term", "source"])
        for c in ("docs", "uses"):
            out = out.append_column(c, pa.array(np.add.reduceat(_numbers(table, c), at)))
        yield from out.combine_chunks().to_batches()


def keep_runs(least_docs: int):
    """Sorted rows of (lang, term, source) to those of terms in enough documents of the language, with the language's
    uses; `first` marks one row of each term. A run is a row for each source."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_runs(batches, ["lang", "term"]):
            size = np.diff(np.append(at, table.num_rows))
            kept = np.repeat(np.add.reduceat(_numbers(table, "docs"), at) >= least_docs, size)
            first = np.zeros(table.num_rows, np.int64)
            first[at] = 1
            out = table.select(["lang", "term", "source", "uses"])
            out = out.append_column("lang_uses", pa.array(np.repeat(np.add.reduceat(_numbers(table, "uses"), at), size))).append_column("first", pa.array(first))
            yield from out.filter(pa.array(kept)).combine_chunks().to_batches()

    return scan


def _loss(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (lang, term, source, p, p0) to partial sums over pairs of sources (lang, source, item, value).

    A run of k sources adds to k * (k - 1) sums what the pair's value has beyond the sums over each source's own
    terms (see divergence): f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0). Sums are kept sorted by pair and handed on at
    the end of the task, or when there are more than HELD_ENTRIES. Every sum fits 64 bits, as probabilities add up to
    about SCALE.
    """
    places: dict[tuple[str, str], int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def handed_on(key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = list(places)
        for k in range(0, len(key), 65_536):
            a, b = key[k : k + 65_536] >> 32, key[k : k + 65_536] & 0xFFFFFFFF
            lang, source = (pa.array([x[i] for x in known], pa.string()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(a)), source.take(pa.array(a)), source.take(pa.array(b)), pa.array(value[k : k + 65_536])], ["lang", "source", "item", "value"])

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, value = _summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        held[:] = [(key, value)]
        return key, value

    entries = 0
    for table, at in whole_runs(batches, ["lang", "term"]):
        size = np.diff(np.append(at, table.num_rows))
        place = np.array([places.setdefault(x, len(places)) for x in zip(table.column("lang").to_pylist(), table.column("source").to_pylist(), strict=True)], np.int64)
        p, p0 = _numbers(table, "p"), _numbers(table, "p0")
        for k in np.unique(size[size > 1]).tolist():
            rows = at[size == k]
            left = max(1, min(k, BLOCK // k))  # of one run, or several whole runs
            runs = max(1, BLOCK // (k * k))
            for r in range(0, len(rows), runs):
                of = rows[r : r + runs, None] + np.arange(k)
                for j in range(0, k, left):
                    x, y = of[:, j : j + left, None], of[:, None, :]
                    value = _loss(p[x], p[y]) - _loss(p[x], p0[y]) - _loss(p0[x], p[y]) + _loss(p0[x], p0[y])
                    key, value = _summed(((place[x] << 32) | place[y]).ravel(), value.ravel())
                    own = (key >> 32) == (key & 0xFFFFFFFF)
                    held.append((key[~own], value[~own]))
                    entries += len(key)
                    if entries > HELD_ENTRIES:
                        key, value = merged()
                        entries = len(key)
                        if entries > HELD_ENTRIES // 2:
                            yield from handed_on(key, value)
                            held.clear()
                            entries = 0
    if held:
        yield from handed_on(*merged())


def _share(uses: Column, of: Column) -> Column:
    """1 + floor(SCALE * uses / of) in whole numbers of any size; null where there is nothing to share."""
    return F.when(of > 0, F.lit(1) + F.call_function("div", uses.cast("decimal(25,0)") * F.lit(SCALE).cast("decimal(12,0)"), of.cast("decimal(25,0)")))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _exact(n: Column, value: Column) -> Column:
    return n.cast("decimal(18,0)") * value.cast("decimal(19,0)")


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other source of its language, and the
    terms by which it stands out from the language.

    A language keeps the V terms that at least `least_docs` of its documents hold. A group (a source of a language, or
    a whole language) gives each kept term p = 1 + floor(SCALE * (uses + 1) / (all uses + V)). With f(p, q) =
    floor((p - q)**2 / q), part `pair` has for each other source the sum of f over all kept terms, at all ranks; part
    `term` has f against the language for each used term above the language's p, to rank `top`. Ranks fall by value,
    ties by item.

    The sum over all kept terms is V * f(p0, q0), where p0 and q0 belong to terms without uses; plus, over the terms
    of either source alone, what they add against the other's zero, for which a histogram of p is enough; plus, over
    the terms of both, a correction from the scan. So a pair costs the terms that both hold, not the vocabulary.

    Null text, language and source count as empty strings. Each row is a document, repeated rows too. Sources without
    terms have all their pairs (values 0 where the language keeps no term). An empty table gives no rows. Other
    columns are not read. A text of any length is counted in one go in one task. A source or a term may hold any share
    of the rows: what is shuffled is a row for each task, source and term. A run of a term has a row for each source,
    and the result has a row for each pair of sources.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = rows.select("lang", "source", "text").mapInArrow(count_terms, PARTIAL)
    each = counted.repartition("lang", "term", "source").sortWithinPartitions("lang", "term", "source").mapInArrow(sum_runs, PARTIAL)
    kept = each.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(keep_runs(least_docs), "lang string, term string, source string, uses long, lang_uses long, first long")
    kept = written(kept)
    langs = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("uses").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("uses").alias("n"))
    groups = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(own, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "n", "lang_n")))
    groups = written(groups.withColumn("p0", _share(F.lit(1), F.col("n") + F.col("v"))))

    shares = looked_up(kept, groups, ["lang", "source"], ["term"])
    shares = written(
        shares.select(
            "lang", "term", "source", "p0", _share(F.col("uses") + 1, F.col("n") + F.col("v")).alias("p"), _share(F.col("lang_uses") + 1, F.col("lang_n") + F.col("v")).alias("q")
        )
    )
    dropped(kept)

    value = _f(F.col("p"), F.col("q"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)

    both = shares.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = both.mapInArrow(pair_runs, "lang string, source string, item string, value long").select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
    # A row without terms makes every pair of sources appear.
    spread_out = shares.groupBy("lang", "source", "p").count().unionByName(groups.select("lang", "source", F.col("p0").alias("p"), F.lit(0).cast("long").alias("count")))
    spread_out = looked_up(spread_out, groups.select("lang", "source", "p0"), ["lang", "source"], ["p"])
    other = groups.select("lang", F.col("source").alias("item"), "v", F.col("p0").alias("q0"))
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    alone = looked_up(spread_out, other, ["lang"], ["source", "p"]).where("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(
        F.sum(_exact(F.col("count"), _f(p, q0) - _f(p0, q0))).alias("to"), F.sum(_exact(F.col("count"), _f(q0, p) - _f(q0, p0))).alias("from"), F.max(_exact(F.col("v"), _f(p0, q0))).alias("zero")
    )
    ways = F.inline(F.array(F.struct("source", "item", (F.col("to") + F.col("zero")).alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("from").alias("value"))))
    alone = alone.select("lang", ways).select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("decimal(38,0)").alias("value"))
    pairs = alone.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))

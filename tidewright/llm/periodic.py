"""Runs: stretches of words that repeat with a period, found on a harmonic grid by longest common extensions.

A run of period p and length 2p or more holds two neighbouring multiples of p, jp and (j + 1)p, whose words are equal.
So for each p all such pairs are asked how far the text goes on alike from both, and how far back; the two answers are
the whole run. There are n ln n pairs, whatever the text. Extensions come from the suffix array, by a range minimum over
common prefixes of neighbours; backward ones from that of the reversed words.

Texts of a slice share one array: each ends in a symbol of its own, so that no extension leaves its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import schema_with
from .textkit import slices, word_hashes, word_spans

#: Texts up to so many words take their pairs from one table, made as far as is needed; pairs of longer ones are made anew.
TABLE_WORDS = 1 << 16
RUNS = "array<struct<start: long, length: long, period: long>>"

_TABLE: dict[str, np.ndarray] = {}


class Extensions:
    """How far a sequence of symbols goes on alike from two places, in constant time.

    The last symbol must occur once. A word takes 4 bytes for each doubling up to the longest repeat while the array is
    made, and 4 bytes for each doubling of the sequence after that.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        array = np.argsort(symbols).astype(np.int32)
        slots = np.arange(n, dtype=np.int32)
        rank = np.empty(n, np.int32)
        names: list[np.ndarray] = []  # ranks by the first 1, 2, 4 ... symbols
        open_, key, width = slots, symbols[array], 1
        while True:
            new = np.ones(len(open_) + 1, bool)
            new[1:-1] = key[1:] != key[:-1]
            rank[array[open_]] = open_[np.maximum.accumulate(np.where(new[:-1], np.arange(len(open_)), 0))]
            open_ = open_[~(new[:-1] & new[1:])]
            if not len(open_):
                break
            names.append(rank.copy())
            at = array[open_]
            key = rank[at].astype(np.int64) * n + rank[at + width]
            order = np.argsort(key)
            array[open_], key = at[order], key[order]
            width *= 2
        left, right = array[:-1].copy(), array[1:].copy()
        common = np.zeros(max(n - 1, 1), np.int32)
        for t in range(len(names) - 1, -1, -1):
            alike = (names[t][left] == names[t][right]).astype(np.int32) << t
            common[: n - 1] += alike
            left += alike
            right += alike
        del names
        self.rank = rank
        self.least = [common]  # least[t][i]: the minimum over 2**t neighbours from i
        while 2 << (len(self.least) - 1) <= n - 1:
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the longest common extension from a and b, place by place; a and b differ."""
        x, y = self.rank[a], self.rank[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((y - x).astype(np.float64))[1] - 1
        out = np.empty(len(x), np.int32)
        for t in np.unique(level).tolist():
            of = level == t
            out[of] = np.minimum(self.least[t][x[of]], self.least[t][y[of] - (1 << t)])
        return out


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (jp, (j + 1)p) of multiples of p with (j + 1)p < n, for each p; 2 sqrt(n) arrays."""
    edge = int(np.sqrt(n))
    for j in range(edge + 1):  # few multiples, every period
        p = np.arange(1, (n - 1) // (j + 1) + 1, dtype=np.int64)
        if len(p):
            yield j * p, (j + 1) * p
    for p in range(1, edge + 1):  # short periods, the multiples from there on
        j = np.arange(edge + 1, (n - 1) // p, dtype=np.int64)
        if len(j):
            yield j * p, (j + 1) * p


def pairs(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grid of a text of n words; that of a shorter text is the beginning of a longer one's, by (j + 1)p."""
    if n > TABLE_WORDS:
        yield from grid(n)
        return
    if n > len(_TABLE.get("upto", ())) - 1:
        size = min(TABLE_WORDS, max(n, 1024) * 2)
        a, b = (np.concatenate(x) for x in zip(*grid(size), strict=True))
        order = np.argsort(b, kind="stable")
        _TABLE.update(a=a[order].astype(np.int32), b=b[order].astype(np.int32), upto=np.searchsorted(b[order], np.arange(size + 1)))
    upto = int(_TABLE["upto"][n])
    yield _TABLE["a"][:upto], _TABLE["b"][:upto]


def _primitive(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its smallest period: others of the same stretch are multiples of it."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def runs_of(words: np.ndarray, first: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of all runs of length max(least, 2 * period) or more, by start and period.

    `words` are hashes of the words of several texts, and first[i] : first[i + 1] those of text i.
    """
    texts = len(first) - 1
    # Text i has its words at first[i] + i + 1 and on, between the symbols i and i + 1, which occur once.
    symbols = np.empty(len(words) + texts + 1, np.int64)
    of = np.repeat(np.arange(texts), np.diff(first))
    place = np.arange(len(words)) + of + 1
    symbols[place] = np.unique(words, return_inverse=True)[1] + texts + 1
    symbols[np.append(0, first[1:] + np.arange(1, texts + 1))] = np.arange(texts + 1)
    n = len(symbols)
    ahead, back = Extensions(symbols), Extensions(symbols[::-1].copy())
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def asked() -> None:
        a, b = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        forward, backward = ahead.common(a, b), back.common(n - a, n - b)
        period = b - a
        good = (forward + backward >= period) & (forward + backward + period >= least)
        found.append(_primitive((a - backward)[good], (b + forward)[good], period[good]))

    held = 0
    for i in range(texts):
        base = int(first[i]) + i + 1
        own = symbols[base : base + int(first[i + 1] - first[i])]
        for a, b in pairs(len(own)):
            alike = np.flatnonzero(own[a] == own[b])  # else the forward answer is 0
            if len(alike):
                waiting.append((a[alike] + np.int64(base), b[alike] + np.int64(base)))
                held += len(alike)
                if held > 1 << 20:
                    asked()
                    held = 0
    if waiting:
        asked()
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = _primitive(*(np.concatenate(x) for x in zip(*found, strict=True)))
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    shift = of[np.searchsorted(place, start)] + 1  # back to numbers among all words
    return start - shift, end - shift, period


def _joined(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, keep: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each text's kept words with one space between."""
    upto = np.concatenate(([0], np.cumsum(keep)))[first]  # of kept words
    starts, size = starts[keep], (stops - starts)[keep] + 1
    last = upto[1:][np.diff(upto) > 0] - 1
    size[last] -= 1
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + size, size)
    body = np.append(raw, np.uint8(0x20))[at]
    space = ends - 1
    body[np.delete(space, last)] = 0x20
    offsets = np.append(0, ends)[upto].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets), pa.py_buffer(body))


def find_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_words, runs (start, length, period; by start, then period) and collapsed_text.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a longest stretch in which words one smallest period
    apart are identical, of at least `least` words and two periods. The collapsed text has the words that no run holds
    after its first period, joined by one space.

    Null text counts as empty: no words, no runs, an empty collapsed text. Ids may be null or repeated: each row is
    judged alone. An empty table gives no rows. Other columns are not read. A text is one row of one task; its words
    take some 200 bytes each while it is worked on, and up to 4 more for each doubling of its longest repeat.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in slices(batches, "text"):
            starts, stops, first = word_spans(raw, at)
            start, end, period = runs_of(word_hashes(raw, starts, stops), first, least)
            steps = np.zeros(len(starts) + 1, np.int64)
            np.add.at(steps, start + period, 1)
            np.add.at(steps, end, -1)
            text = np.searchsorted(first, start, "right") - 1
            offsets = np.searchsorted(text, np.arange(len(first))).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start - first[text], end - start, period)], ["start", "length", "period"])
            body = _joined(raw, starts, stops, np.cumsum(steps[:-1]) == 0, first)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), runs), body.cast(pa.string())], ["id", "n_words", "runs", "collapsed_text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(scan, schema_with(rows, ["id"], f"n_words long, runs {RUNS}, collapsed_text string"))
    return out.withColumnRenamed("id", id_col)


def longest_run() -> Column:
    """The longest of `runs`; of equals the first, then the one of smallest period; null if there are none."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best.start).alias("start"), best.length.alias("length"), (-best.period).alias("period")))


def runs_digest() -> Column:
    """The sha256 of `start,length,period` and a line feed for each of `runs`."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)

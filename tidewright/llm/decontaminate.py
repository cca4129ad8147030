"""Benchmark decontamination: an Aho-Corasick automaton over windows of normalised benchmark texts.

The automaton works on words. Each benchmark word gets a number, windows are sequences of numbers, and a document is
scanned once as the sequence of its words' numbers; found windows are mapped back to places in the original text.
A benchmark too large for one automaton in each worker is a distributed index of windows instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .store import bundled, schema_with, written

#: True for the bytes of words: digits, letters, and all bytes of characters beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x41:0x5B] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
_NORMAL = bytes(int(K.LOWER[b]) if WORD_BYTES[b] else 0x20 for b in range(256))

_SCHEMA = "n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<start: long, end: long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Windows:
    """The automaton of the windows of some items; `width` consecutive words, or all of a shorter item."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            seq = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text))
            for k in range(max(1, len(seq) - width + 1) if seq else 0):
                found.setdefault(seq[k : k + width], set()).add(name)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for seq, names in found.items():
            self.machine.add_word(seq, (len(seq), tuple(names)))
        self.any = bool(found)
        if self.any:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of all occurrences, and the items they belong to."""
        if not self.any or not words:
            return [], set()
        get, ranges, names = self.numbers.get, [], set()
        for end, (n, owners) in self.machine.iter(tuple([get(w, 0) for w in words])):
            ranges.append((end - n + 1, end + 1))
            names.update(owners)
        return ranges, names


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _verdict(raw: bytes, n_words: int, ranges: list[tuple[int, int]], names: set[str]) -> tuple:
    """n_words, n_hit, n_items, item_ids and spans of a text with these word ranges hit."""
    steps = np.zeros(n_words + 1, np.int32)
    for a, z in ranges:
        steps[a] += 1
        steps[z] -= 1
    hit = np.cumsum(steps[:-1]) > 0
    spans = []
    if ranges:
        data = np.frombuffer(raw, np.uint8)
        at, to, _ = K.word_spans(data, np.array([0, len(data)]), WORD_BYTES)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        spans = [{"start": int(points[at[a]]), "end": int(points[to[z - 1]])} for a, z in zip(*_runs(hit), strict=True)]
    return n_words, int(hit.sum()), len(names), sorted(names), spans


def _verdicts(batch: pa.RecordBatch, carried: list[str], rows: list[tuple]) -> pa.RecordBatch:
    n, h, i, ids, spans = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in carried), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(i, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
        [*carried, "n_words", "n_hit", "n_items", "item_ids", "spans"],
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, automaton_bytes: int = 2 << 20, keep: list[str] = ()) -> DataFrame:
    """One row per document: word counts, items found, and the hit stretches as code-point spans of the original.

    A word is hit if it lies inside any occurrence of a window of `width` consecutive item words. One automaton holds
    all windows, and documents are scanned once and never shuffled. A worker needs about 110 bytes of automaton for a
    byte of benchmark text, measured at 1 and 2 MiB, and the text is broadcast; so a benchmark of more than
    automaton_bytes, whose size is checked first, is a distributed index of window hashes instead, of the same result.
    `keep` names document columns to carry along, none with the name of a result.

    Null or wordless texts have no words and are never hit; null or wordless items have no windows; a null item id
    counts as ''. An item listed twice counts once. Repeated documents are judged row by row. Texts of any length are
    scanned whole. Empty tables give no rows, or no hits. Other columns are not read.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("body"))
    carried = list(dict.fromkeys([id_col, text_col, *keep]))
    if (items.agg(F.sum(F.octet_length("body") + 64)).first()[0] or 0) > automaton_bytes:
        out = _by_index(docs, items, text_col, width, carried)
    else:
        # Bounded by automaton_bytes.
        block = tuple(sorted({(r.item, r.body.encode()) for r in items.toLocalIterator()}))
        mark = hashlib.sha256(repr((width, block)).encode()).hexdigest()
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = docs.select(*carried).mapInArrow(_scan(shared, mark, width, text_col, carried), schema_with(docs, carried, _SCHEMA))
    return out.drop(*(c for c in [text_col] if c not in keep and c != id_col))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """The documents that find_contamination() doesn't hit, with all their columns, whatever their names."""
    whole, back = bundled(docs, [id_col, text_col])
    return find_contamination(whole, benchmark, id_col, text_col, width=width, keep=[text_col, "_rest"]).where("n_hit = 0").select(*back)


def _scan(items, mark: str, width: int, text_col: str, carried: list[str]) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = K.held(("windows", mark), lambda: Windows(list(items.value), width))
        for batch in batches:
            rows = []
            for text in batch.column(text_col).to_pylist():
                raw = (text or "").encode()
                words = words_of(raw)
                rows.append(_verdict(raw, len(words), *windows.scan(words)))
            yield _verdicts(batch, carried, rows)

    return work


#: Bits of the filter that documents' windows pass before they are shuffled, whatever the size of the benchmark.
FILTER_BITS = 1 << 27


def _window_rows(text_col: str, carried: list[str], width: int, lengths: Callable[[int], list[int]], passes: Callable | None = None) -> Callable:
    """(carried, n, high, low, start) of windows of n words of each text, with a hash of 128 bits; `lengths` are those
    to take of a text of so many words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in K.slices(batches, text_col):
            raw = K.LOWER[raw]
            starts, stops, first = K.word_spans(raw, at, WORD_BYTES)
            words, count = K.word_hashes(raw, starts, stops, WORD_BYTES), np.diff(first)
            for n in range(1, width + 1):
                begin, doc = K.inside_texts(first, n)
                if not len(begin):
                    continue
                fits = np.array([n in lengths(c) for c in count.tolist()])[doc]
                begin, doc = begin[fits], doc[fits]
                high, low = (K.signed(K.window_hashes(words, n, s)[begin]) for s in (0, 1))
                if passes:
                    ok = passes(high)
                    begin, doc, high, low = begin[ok], doc[ok], high[ok], low[ok]
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(doc)) for c in carried), pa.array(np.full(len(begin), n)), pa.array(high), pa.array(low), pa.array(begin - first[doc])], [*carried, "n", "high", "low", "start"])

    return work


def _by_index(docs: DataFrame, items: DataFrame, text_col: str, width: int, carried: list[str]) -> DataFrame:
    """The same by a join of window hashes with those of the items; only windows that a filter lets pass are shuffled."""
    spark = docs.sparkSession
    whole = lambda c: [min(c, width)] if c else []
    index = written(items.mapInArrow(_window_rows("body", ["item"], width, whole), "item string, n long, high long, low long, start long").drop("start").distinct())
    present = {r.n for r in index.select("n").distinct().collect()}  # at most `width` rows
    bit = F.col("high").bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = np.zeros(FILTER_BITS >> 5, np.int64)
    # At most FILTER_BITS / 32 rows.
    for row in index.groupBy(F.shiftright(bit, 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(high & 31 as int))")).alias("bits")).toLocalIterator():
        bits[row["at"]] = row.bits
    shared = spark.sparkContext.broadcast(bits.astype(np.uint32))

    def passes(high: np.ndarray) -> np.ndarray:
        at = high & (FILTER_BITS - 1)
        return (shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) > 0

    keyed = docs.withColumn("_row", F.xxhash64(text_col)).withColumn("_size", F.coalesce(F.octet_length(text_col), F.lit(0)))
    windows = keyed.select("_row", "_size", text_col).dropDuplicates(["_row", "_size"]).mapInArrow(_window_rows(text_col, ["_row", "_size"], width, lambda c: present, passes), "_row long, _size int, n long, high long, low long, start long")
    hits = windows.join(index, ["n", "high", "low"]).groupBy("_row", "_size").agg(F.collect_set("item").alias("_items"), F.collect_set(F.struct("start", "n")).alias("_ranges"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, names, ranges in zip(*(batch.column(c).to_pylist() for c in (text_col, "_items", "_ranges")), strict=True):
                raw = (text or "").encode()
                rows.append(_verdict(raw, len(words_of(raw)), [(r["start"], r["start"] + r["n"]) for r in ranges or ()], set(names or ())))
            yield _verdicts(batch, carried, rows)

    return keyed.select(*carried, "_row", "_size").join(hits, ["_row", "_size"], "left").mapInArrow(work, schema_with(docs, carried, _SCHEMA))


def items_digest(column: str = "item_ids") -> F.Column:
    """The contract's digest of an array of item ids."""
    return F.sha2(F.concat_ws(",", F.array_sort(column)), 256)


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()

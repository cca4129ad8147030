"""Compression bands: zstandard ratios of whole documents and fixed chunks, with limits by length.

Longer texts compress better, so a limit holds for a range of lengths. Limits are generic ones, or narrower ones that
good texts of about the same length keep to, as fitted on labelled rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K


@dataclass(frozen=True)
class Bands:
    """UTF-8 bytes over compressed bytes must lie in the band of the text's length.

    documents: (from so many bytes, least ratio, largest ratio), in order. A ratio below the least marks text that
    doesn't compress (noise, encoded data), one above the largest marks repetition.
    chunk_bytes: a text longer than one chunk is judged chunk by chunk too, the rest after the last full chunk as well,
    each by the band of its own length. A text fails if chunks outside their band hold more than chunk_share of its
    bytes.
    """

    documents: tuple[tuple[int, float, float], ...] = ((0, 0.0, 3.0), (300, 1.1, 3.5), (1_000, 1.3, 4.0), (3_000, 1.45, 5.0), (10_000, 1.55, 6.0))
    chunk_bytes: int = 8_192
    chunk_share: float = 0.3
    level: int = 3


@dataclass(frozen=True)
class Fit:
    """How limits are fitted. least_rows: of a range of lengths, for limits of its own. outside: the share of good texts at
    either end that a limit may cut off, before it is widened by margin. steps: ranges for each doubling of the length.
    places: of the ratios that are counted, so that their number is bounded."""

    least_rows: int = 50
    outside: float = 0.001
    margin: float = 0.04
    steps: int = 2
    places: int = 5


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, in_band boolean, kept boolean"


def repeated_words(raw: np.ndarray, at: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its words, and those in windows of words that the text holds twice or more."""
    starts, stops, first = K.word_spans(raw, at)
    begin, doc = K.inside_texts(first, width)
    if not len(begin):
        return np.diff(first), np.zeros(len(at) - 1, np.int64)
    keys = K.window_hashes(K.word_hashes(raw, starts, stops), width)[begin]
    keys = K.mix(keys + K.mix(doc.astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.diff(first), K.per_text(K.covered(begin[twice], width, len(starts)), first)


def duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _limits(size: int, bands: Bands) -> tuple[float, float]:
    return bands.documents[bisect_right(bands.documents, size, key=lambda b: b[0]) - 1][1:]


def chunks_of(text: bytes, size: int) -> list[bytes]:
    """Fixed chunks and the rest of a text longer than one."""
    return [text[k : k + size] for k in range(0, len(text), size)] if len(text) > size else []


def _in_band(text: bytes, bands: Bands, zip_: zstandard.ZstdCompressor) -> tuple[float | None, int, int, bool]:
    if not text:
        return None, 0, 0, True

    def ratio_of(part: bytes) -> tuple[float, bool]:
        least, most = _limits(len(part), bands)
        ratio = len(part) / len(zip_.compress(part))
        return ratio, least <= ratio <= most

    ratio, good = ratio_of(text)
    chunks = chunks_of(text, bands.chunk_bytes)
    bad = [len(c) for c in chunks if not ratio_of(c)[1]]
    return ratio, len(chunks), len(bad), good and sum(bad) <= bands.chunk_share * len(text)


def _lowest(step: int, steps: int) -> int:
    """The least size in bytes of a range of lengths."""
    return math.ceil(2 ** (step / steps))


def fit_bands(docs: DataFrame, labels: DataFrame, bands: Bands = Bands(), how: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1", min_words: int = 50) -> Bands:
    """`bands` with narrower limits for the ranges of lengths of which there are enough labelled good texts and chunks.

    Fitted on all labelled good documents: texts are counted by range and ratio, and the quantiles of a range are those
    of its counts; they come to the driver, a row for each range. Every document is measured where it is read, so that
    ids, ranges and ratios are shuffled to meet the labels, and never a text.
    Ranges with too few rows keep the given limits, all of them if nothing is labelled. Null ids, texts of under
    min_words words and empty texts say nothing. Limits never become wider than those given.
    """
    chosen = labels.where(good).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=bands.level)
        for rows, raw, at in K.slices(batches, text_col):
            whole = raw.tobytes()
            texts = [(k, t) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if len((t := whole[a:b]).split()) >= min_words]
            parts = [(k, p) for k, t in texts for p in (t, *chunks_of(t, bands.chunk_bytes)) if p]
            sizes = np.array([len(p) for _, p in parts], np.int64)
            steps = np.floor(np.log2(np.maximum(sizes, 1)) * how.steps + 1e-9).astype(np.int64)
            ids = rows.column(id_col).take(pa.array([k for k, _ in parts], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(steps), pa.array([len(p) / len(zip_.compress(p)) for _, p in parts], pa.float64())], ["_id", "step", "ratio"])

    measured = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(work, f"_id {kind}, step long, ratio double")
    seen = measured.join(chosen, "_id", "left_semi").groupBy("step", F.round("ratio", how.places).alias("ratio")).agg(F.count("*").alias("n"))
    ends = F.percentile("ratio", F.array(F.lit(how.outside), F.lit(1 - how.outside)), F.col("n"))
    # A row for each range of lengths: under 64 * how.steps.
    fitted = {r.step: r.ends for r in seen.groupBy("step").agg(ends.alias("ends"), F.sum("n").alias("n")).where(F.col("n") >= how.least_rows).collect()}
    edges = sorted({b[0] for b in bands.documents} | {_lowest(s + k, how.steps) for s in fitted for k in (0, 1)})
    out = []
    for edge in edges:
        least, most = _limits(edge, bands)
        step = math.floor(math.log2(max(edge, 1)) * how.steps + 1e-9)
        if step in fitted:
            least, most = max(least, fitted[step][0] * (1 - how.margin)), min(most, fitted[step][1] * (1 + how.margin))
        out.append((edge, least, most))
    return replace(bands, documents=tuple(out))


def compression_bands(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per input row: counts, the zstandard ratio, and whether the text is kept.

    A map over rows without a shuffle. Null text counts as empty: no words, `ratio` null, base_failed true (too few
    words). Null ids, repeated ids and repeated rows pass through row by row; an empty table gives no rows; other
    columns of the input are not read. A text of any length is compressed whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=bands.level)
        for rows, raw, at in K.slices(batches, text_col):
            n_words, n_repeat = repeated_words(raw, at)
            whole = raw.tobytes()
            texts = [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            verdicts = [_in_band(t, bands, zip_) for t in texts]
            failed = (n_words < min_words) | (100 * n_repeat > max_repeat_percent * n_words)
            in_band = np.array([v[3] for v in verdicts], bool)
            yield pa.RecordBatch.from_arrays([
                rows.column(id_col), pa.array(n_words),
                pa.array(K.per_text(K.WORD_BYTES[raw] & ((raw & 0xC0) != 0x80), at)),
                pa.array(K.per_text(_SYMBOL[raw], at)),
                pa.array([duplicate_lines(t) for t in texts], pa.int64()), pa.array(n_repeat), pa.array(failed),
                pa.array([v[0] for v in verdicts], pa.float64()), pa.array([v[1] for v in verdicts], pa.int64()),
                pa.array([v[2] for v in verdicts], pa.int64()), pa.array(in_band), pa.array(in_band & ~failed),
            ], [id_col, *(x.split()[0] for x in _SCHEMA.split(", "))])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, {_SCHEMA}")

"""Vectorised text kernels that run inside Spark tasks, over Arrow batches.

A batch's texts lie in one UTF-8 buffer. Words are maximal runs of bytes outside a set of separators; every
word gets a 64-bit hash, and windows of words get a hash of their word hashes. All functions are pure and
depend on their input only, so a retried task gives the same rows.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_HELD: dict[str, object] = {}


def held(name: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one object, so that work of another kind lets it go first."""
    if _HELD.get("name") != name:
        let_go()
        _HELD.update(name=name, value=make())
    return _HELD["value"]


def let_go() -> None:
    if _HELD:
        _HELD.clear()
        gc.collect()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: True for the bytes of words `[^\x20\x09-\x0D]+`.
WORD_BYTES = ~_SPACE
#: Maps A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_WINDOW_STEP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's bigint."""
    return x.view(np.int64)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 offsets of its texts. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into runs of rows with about SLICE_BYTES of text, each with its bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, at = utf8(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(row, end - row), raw[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end


def word_spans(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n + 1 offsets of each text's words among them."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = is_word[raw]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, at, "left")


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, is_word: np.ndarray = WORD_BYTES) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    raw = raw[starts[0] : stops[-1]]
    first = starts - starts[0]
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    longest = int((stops - starts).max())
    power = np.ones(longest + 1, np.uint64)
    power[1:] = np.cumprod(np.full(longest, _STEP))
    np.minimum(place, longest, out=place)
    codes = _BYTE_CODE[raw]
    codes *= power[place]
    codes[~is_word[raw]] = 0
    return mix(np.add.reduceat(codes, first) + (stops - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of words[i : i + width] for each i; it ignores where texts end."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= _WINDOW_STEP[salt]
        total += words[k : k + n]
    return mix(total)


def inside_texts(first_word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions among all words where a window of this width starts and ends in one text, and the text of each."""
    count = np.diff(first_word)
    full = np.maximum(count - width + 1, 0)
    doc = np.repeat(np.arange(len(count)), full)
    start = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(first_word[:-1], full)
    return start, doc


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for each of n words that lies in one of the windows."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:-1]) > 0


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, row, text) with the text compressed to z, to be shuffled."""
    zip_ = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = [zip_.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array(z, pa.binary())], ["doc", "row", "z"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """z back to text, in small batches."""
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        step = 256  # rows, so that few texts are unpacked at once
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            at = part.schema.get_field_index("z")
            yield part.set_column(at, "text", pa.array([unzip.decompress(z).decode() for z in part.column(at).to_pylist()], pa.large_string()))

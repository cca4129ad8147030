"""Packing along a space-filling curve.

Each document gets a point in a few dimensions: the mean of fixed random vectors of its tokens. Documents are sorted
by the Hilbert key of their point, and neighbours on the curve are packed together into sequences.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .store import dropped, schema_with, written

DIMENSIONS, BITS = 3, 10
#: Documents are cut at multiples of so many ids. Sequences that a partition has on average at least.
GRID, SEQUENCES_EACH = 32, 256
#: Words that a task remembers the ids of; on reaching it, it forgets them all.
REMEMBERED_WORDS = 1_000_000
#: Lone signs, of which one with a single id can stand between words that are encoded together.
_SIGNS = "\u2020\u00b6\u00a7~^"
#: A full stop or comma at the end of a word is split off by the pre-tokenizer if one of these comes before it, as it
#: then stands alone between a letter or digit and white space.
_STOPS, _BEFORE_STOPS = b".,", b"abcdefghijklmnopqrstuvwxyz0123456789"


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTokens:
    """Ids of texts, remembered by word.

    For tokenizers that drop white space and case and never join two words separated by ASCII white space, a text's
    ids are its words' ids one after the other. Ids are little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str):
        self.of = _tokenizer(path)
        self.known: dict[bytes, bytes] = {}
        self.sign = next((c for c in _SIGNS if len(self.of.encode(c, add_special_tokens=False).ids) == 1), None)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.of.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        """Words, with case dropped; special tokens are told by case, so texts with their mark are left as they are."""
        return text.split() if b"<|" in text else text.lower().split()

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        new = words.difference(self.known)
        ended = [w for w in new if w[-1] in _STOPS and len(w) > 1 and w[-2] in _BEFORE_STOPS]
        if not ended:
            self._learn_whole(new)
            return
        self._learn_whole((new.difference(ended) | {w[:-1] for w in ended} | {b".", b","}).difference(self.known))
        known = self.known
        known.update([(w, known[w[:-1]] + known[w[-1:]]) for w in ended])

    def _learn_whole(self, new: set[bytes]) -> None:
        sign = self.sign.encode() if self.sign else b""
        together = [w for w in new if sign not in w] if self.sign else []
        if together:  # one call for all is several times as fast as one for each
            (ids,) = self._ids([b" ".join([together[0], *(sign + b" " + w for w in together[1:])]).decode()])
            (mark,) = self._ids([self.sign])
            ends = [*(4 * np.flatnonzero(ids == mark[0])).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            self.known.update([(w, data[begin:end]) for w, begin, end in zip(together, [0, *(e + 4 for e in ends[:-1])], ends, strict=True)])
        alone = [w for w in new if sign in w] if self.sign else list(new)
        for w, ids in zip(alone, self._ids([w.decode() for w in alone]), strict=True):
            self.known[w] = ids.tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        of = self.known.__getitem__
        return [b"".join(map(of, words)) for words in split]


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of integer points (rows) with coordinates below 2 ** bits."""
    x = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo excess work, from the highest bit down
        p = q - 1
        for d in range(n):
            set_ = (x[d] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[d]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            x[d] = x[d] ^ swap
        q >>= 1
    for d in range(1, n):
        x[d] = x[d] ^ x[d - 1]
    t, q = np.zeros(len(x[0]), np.int64), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros(len(t), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << 1) | (((x[d] ^ t) >> b) & 1)
    return key


@lru_cache(maxsize=1)
def _directions(vocabulary: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).standard_normal((DIMENSIONS, vocabulary)).astype(np.float32)


def curve_keys(ids: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """The mean of n random vectors is of the order of a few tenths for text; the grid spans one unit to each side."""
    directions = _directions(vocabulary)
    n = np.array([len(i) for i in ids])
    flat = np.minimum(np.concatenate(ids), vocabulary - 1)
    starts = np.cumsum(n) - n
    points = np.stack([np.add.reduceat(d[flat], starts) / n for d in directions], axis=1)
    return hilbert_keys(np.clip((points + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def _shifted(crc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What checksums of some bytes contribute to the checksum once so many ids (of 4 bytes) follow: products of
    polynomials over two elements, with the bits of CRC-32 reflected."""
    a, b = _powers(int(ids.max(initial=0)))[ids], crc.astype(np.uint32)
    out = np.zeros(len(b), np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ _POLYNOMIAL, b >> np.uint32(1))
    return out


#: Fixed value: the polynomial of CRC-32, reflected.
_POLYNOMIAL = np.uint32(0xEDB88320)


@lru_cache(maxsize=4)
def _powers(most: int) -> np.ndarray:
    """x ** (32 * n) modulo the polynomial, for n up to `most`."""
    out, now = np.zeros(most + 1, np.uint32), 0x80000000
    for n in range(most + 1):
        out[n] = now
        for _ in range(32):
            now = (now >> 1) ^ (int(_POLYNOMIAL) if now & 1 else 0)
    return out


def prefix_checksums(ids: bytes) -> bytes:
    """CRC-32 of the first GRID, 2 * GRID, ... ids, and of all."""
    out, now, step = [], 0, 4 * GRID
    for k in range(0, len(ids), step):
        now = zlib.crc32(ids[k : k + step], now)
        out.append(now)
    return np.array(out, "<u4").tobytes()


def pack_along_curve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a document: where its ids start and how many they are, their checksum, and its place.

    Documents lie one after the other along the curve, and that row is cut into sequences; a document that stands
    across a border is cut there, at a multiple of GRID ids of its own, so a sequence has less than GRID ids of
    padding, or is the last of its partition. Texts are tokenised once and never shuffled: each gives one row with
    its key and the checksums of its prefixes (4 bytes for GRID ids), from which that of any piece follows.

    Partitions are ranges of (key, id). The result is written, so a lost executor changes no sequence.

    Null text counts as empty, and so as `end_id` alone. Null ids sort first; repeated rows are packed one by one;
    texts of one content lie together but are told apart by id; a text of any length is cut into as many pieces as it
    needs; an empty table gives no rows. Other columns are not read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    if capacity % GRID:
        raise ValueError(f"capacity must be a multiple of {GRID}")
    rows = written(docs.select(id_col, text_col).mapInArrow(_measure(tokenizer, id_col, text_col, end_id), schema_with(docs, [id_col], "doc_tokens long, curve_key long, sums binary")))
    total = rows.agg(F.sum("doc_tokens")).first()[0] or 0
    partitions = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (SEQUENCES_EACH * capacity)))
    ranged = rows.repartitionByRange(partitions, "curve_key", id_col).sortWithinPartitions("curve_key", id_col, "sums")
    out = written(ranged.mapInArrow(_place(id_col, capacity), schema_with(docs, [id_col], "start long, length long, ids_crc32 long, doc_tokens long, curve_key long, sequence_id long, offset long")))
    dropped(rows)
    return out


def _measure(tokenizer: str, id_col: str, text_col: str, end_id: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = K.held(("words", tokenizer), lambda: WordTokens(tokenizer))
        end, vocabulary = np.array([end_id], "<u4").tobytes(), tokens.of.get_vocab_size()
        for rows, raw, at in K.slices(batches, text_col):
            whole = raw.tobytes()
            ids = [i + end for i in tokens.encode([whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])]
            keys = curve_keys([np.frombuffer(i, "<u4") for i in ids], vocabulary)
            yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(keys), pa.array([prefix_checksums(i) for i in ids], pa.binary())], [id_col, "doc_tokens", "curve_key", "sums"])

    return work


def _place(id_col: str, capacity: int) -> Callable:
    """Lays documents of a partition, in order, into sequences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence, used = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            pieces: list[tuple[int, int, int, int, int]] = []  # row, start, length, sequence, offset
            before: list[int] = []
            upto: list[int] = []
            for row, (n, sums) in enumerate(zip(batch.column("doc_tokens").to_pylist(), batch.column("sums"), strict=True)):
                sums = np.frombuffer(sums.as_buffer(), "<u4")
                start = 0
                while start < n:
                    room = capacity - used
                    length = n - start if n - start <= room else room - room % GRID
                    if length:
                        pieces.append((row, start, length, sequence, used))
                        before.append(int(sums[start // GRID - 1]) if start else 0)
                        upto.append(int(sums[-(-(start + length) // GRID) - 1]))
                        start, used = start + length, used + length
                    if start < n or used == capacity:
                        sequence, used = sequence + 1, 0
            row, start, length, where, offset = np.array(pieces, np.int64).reshape(-1, 5).T
            crc = np.array(upto, np.uint32) ^ _shifted(np.array(before, np.uint32), length)
            doc = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([doc.column(id_col), pa.array(start), pa.array(length), pa.array(crc.astype(np.int64)), doc.column("doc_tokens"), doc.column("curve_key"), pa.array(where), pa.array(offset)], [id_col, "start", "length", "ids_crc32", "doc_tokens", "curve_key", "sequence_id", "offset"])

    return work

"""Substring dedup in the manner of relative Lempel-Ziv, against an index that is distributed over the cluster.

Every document is cut into blocks at content-defined anchors, so that equal stretches are cut alike wherever they
stand. The index keeps, for each block met in several documents, the earliest document with it and its place there. One
join of hashes finds the blocks that an earlier document holds. Where a block is not found whole, another join looks up
its windows of `width` words singly in the blocks that share its anchor.

Each document is then parsed from left to right: a match is extended as long as the next one goes on at the very place
in its source where it ends, and so becomes one factor, as long as blocks and windows of that source allow. Factors of
`width` words or more are duplicate spans. Words on both sides of a border between factors may still be copied
together; windows across a border are matches of their own, and so factors of their own.

The result is exact. Let a window of `width` words occur in an earlier document. Its anchor (the word 5-gram with the
least hash in it) hangs on the window alone, so both documents hold that anchor, in blocks that contain the window. If
the blocks are equal, the block is matched. If not, the first document with each of the two blocks puts its windows
into the second index, and so the window is found there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkit as K
from .store import dropped, written
from .textkit import packed, unpacked

ANCHOR_WORDS = 5
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_Q_INVERSE = np.uint64(pow(int(_Q), -1, 1 << 64))


class Blocks:
    """The blocks of a run of texts: runs of windows that share an anchor."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, width: int):
        starts, stops, self.first = K.word_spans(raw, at)
        self.words = K.word_hashes(raw, starts, stops)
        self.begin, self.text = K.inside_texts(self.first, width)  # of each window
        self.width = width
        if not len(self.begin):
            self.at = self.count = self.anchor = np.zeros(0, np.int64)
            return
        grams = K.window_hashes(self.words, ANCHOR_WORDS)
        best, where = grams[self.begin].copy(), self.begin.copy()
        for k in range(1, width - ANCHOR_WORDS + 1):
            other = grams[self.begin + k]
            less = other < best
            best[less], where[less] = other[less], self.begin[less] + k
        new = np.ones(len(where), bool)
        new[1:] = (where[1:] != where[:-1]) | (self.text[1:] != self.text[:-1])
        self.at = np.flatnonzero(new)  # the first window of each block
        self.count = np.diff(np.append(self.at, len(where)))
        self.anchor = K.signed(best[self.at])

    def content(self) -> np.ndarray:
        """A hash of each block's words."""
        n = len(self.words)
        power, back = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
        power[1:], back[1:] = np.cumprod(np.full(n, _Q)), np.cumprod(np.full(n, _Q_INVERSE))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * power[:-1], out=total[1:])
        a = self.begin[self.at]
        z = a + self.count + self.width - 1
        return K.signed(K.mix((total[z] - total[a]) * back[a] + (z - a).astype(np.uint64)))


#: Anchors that a task looks at together, to find those that it can tell are shared.
_TOGETHER = 1_000_000


def _anchors(width: int) -> Callable:
    """(anchor, doc, known) of each block. Of anchors that several documents met by a task share, every row is known
    to be shared, and one more row stands for all of them; so an anchor has at most one row that is not known for
    each run of _TOGETHER anchors, however many documents hold it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import chain

        held: list[tuple[np.ndarray, pa.Array]] = []
        for item in chain(K.slices(batches, "text"), [None]):
            if item is not None:
                rows, raw, at = item
                b = Blocks(raw, at, width)
                held.append((b.anchor, rows.column("doc").take(pa.array(b.text[b.at]))))
            if held and (item is None or sum(len(a) for a, _ in held) >= _TOGETHER):
                anchor = np.concatenate([a for a, _ in held])
                doc = pa.chunked_array([d for _, d in held]).combine_chunks().take(pa.array(order := np.argsort(anchor, kind="stable")))
                anchor = anchor[order]
                new = np.ones(len(anchor), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                several = np.diff(np.append(np.flatnonzero(new), len(anchor)))[np.cumsum(new) - 1] > 1
                first, more = np.flatnonzero(new), np.flatnonzero(several)
                for k, known in ((first, False), (more, True)):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[k]), doc.take(pa.array(k)), pa.array(np.full(len(k), known))], ["anchor", "doc", "known"])
                held = []

    return work


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by known and anchor, those known and those whose neighbour has the same anchor."""
    before: pa.RecordBatch | None = None  # the last row seen, whose next neighbour is not
    paired = False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([before, batch] if before is not None else [batch]).combine_chunks()
        anchor, known = rows.column("anchor").to_numpy(), rows.column("known").to_numpy()
        same = (anchor[1:] == anchor[:-1]) & ~known[1:]
        keep = known.copy()
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= paired
        before, paired = rows.slice(rows.num_rows - 1).to_batches()[0], bool(keep[-1])
        yield from rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1])).select(["anchor", "doc"]).to_batches()
    if before is not None and paired:
        yield before.select(["anchor", "doc"])


def _given(b: Blocks, anchors: pa.Array) -> np.ndarray:
    """The blocks whose anchor is in the list given for their text."""
    own = lambda anchor, text: K.mix(anchor.view(np.uint64) + K.mix(text.astype(np.uint64)))
    flat = anchors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(anchors)), anchors.value_lengths().to_numpy(zero_copy_only=False))
    return np.flatnonzero(np.isin(own(b.anchor, b.text[b.at]), own(flat, owner))) if len(b.at) else b.at


def _blocks(width: int) -> Callable:
    """Blocks of texts whose anchors are among those given for the document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in K.slices(unpacked(batches), "text"):
            b = Blocks(raw, at, width)
            k = _given(b, rows.column("shared"))
            content = b.content()[k] if len(k) else k
            text = b.text[b.at[k]]
            doc, row = rows.column("doc").take(pa.array(text)), rows.column("row").take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(b.anchor[k]), pa.array(content), doc, row, pa.array(b.begin[b.at[k]] - b.first[text]), pa.array(b.count[k])], ["anchor", "content", "doc", "row", "start", "n"])

    return work


def _windows(width: int) -> Callable:
    """Single windows of the blocks whose anchors are given for the document, with a hash of 128 bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in K.slices(unpacked(batches), "text"):
            b = Blocks(raw, at, width)
            k = _given(b, rows.column("wanted"))
            w = np.repeat(b.at[k], b.count[k]) + np.arange(b.count[k].sum()) - np.repeat(np.cumsum(b.count[k]) - b.count[k], b.count[k])
            begin = b.begin[w] if len(w) else np.zeros(0, np.int64)
            high, low = (K.signed(K.window_hashes(b.words, width, s)[begin]) if len(w) else begin for s in (0, 1))
            text = b.text[w] if len(w) else begin
            doc, row = rows.column("doc").take(pa.array(text)), rows.column("row").take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), doc, row, pa.array(begin - b.first[text])], ["high", "low", "doc", "row", "start"])

    return work


def factors_of(matches: list[tuple], width: int) -> list[tuple]:
    """(start, length, source, place in it) of the factors that matches (start, windows, source, place) give, parsed
    from left to right, the longest of those with one start first."""
    out: list[list] = []
    going_on: dict[tuple, list] = {}  # by source and distance from the place there, the last factor
    for start, n, source, place in sorted(matches, key=lambda m: (m[0], -m[1])):
        last = going_on.get((source, place - start))
        if last and start <= last[0] + last[1]:
            last[1] = max(last[1], start + n - last[0])
        else:
            out.append([start, n, source, place])
            going_on[source, place - start] = out[-1]
    return [(start, n + width - 1, source, place) for start, n, source, place in out]


def _remove(width: int, carried: list[str], factor: pa.DataType) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                words = text.encode().split()
                factors = [f for f in factors_of([tuple(m.values()) for m in found or ()], width) if f[1] >= width]
                steps = np.zeros(len(words) + 1, np.int32)
                for start, length, _, _ in factors:
                    steps[start] += 1
                    steps[min(start + length, len(words))] -= 1
                gone = np.cumsum(steps[:-1]) > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if factors else b" ".join(words)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out.append((len(words), int(gone.sum()), kept.decode(), [{"start": int(a), "end": int(z)} for a, z in zip(edge[::2], edge[1::2], strict=True)], [dict(zip(("start", "length", "source", "place"), f, strict=True)) for f in factors]))
            n, r, kept, spans, factors = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(factors, pa.list_(factor))],
                [*carried, "n_words", "n_removed", "kept_text", "spans", "factors"],
            )

    return work


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_removed, kept_text (words joined by one space), spans, and factors (start and
    length in words, the source document and the word there).

    spans are the word ranges removed: words in windows of `width` words that also start in a document with a smaller
    id. Windows are judged on the input, not on what is left.

    Shuffles: one row for each anchor (about one word in five) and task; texts, compressed, once for each step that
    reads them; then rows for shared blocks alone. A passage in very many documents is one row of each index, and
    Spark splits its documents in the joins. Each step is written to the shared folder, so that the shuffle files of
    the steps before can go.

    Null or empty text has no words. A null id is neither smaller nor larger than another: such rows lose nothing and
    take nothing from others. Rows with equal ids don't count as earlier than each other; each is judged by its own
    text. An empty table gives no rows. Other columns are not read. Texts are parsed whole.
    """
    key = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    texts = plain.mapInArrow(packed, f"doc {key}, row long, z binary")
    anchors = plain.where("doc is not null").select("doc", "text").mapInArrow(_anchors(width), f"anchor long, doc {key}, known boolean")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = anchors.repartition(partitions, F.when(F.col("known"), F.xxhash64("doc")).otherwise(F.col("anchor"))).sortWithinPartitions("known", "anchor")
    wanted = written(dealt.mapInArrow(_shared, f"anchor long, doc {key}").groupBy("doc").agg(F.collect_list("anchor").alias("shared")))
    blocks = written(texts.join(wanted, "doc").mapInArrow(_blocks(width), f"anchor long, content long, doc {key}, row long, start long, n long"))
    dropped(wanted)
    # Any of the places in the earliest document will do; these minima are held in fixed space for each key.
    first = F.min("doc").alias("source"), F.min_by("start", "doc").alias("place")
    index = written(blocks.groupBy("anchor", "content").agg(*first))
    whole = written(blocks.join(index, ["anchor", "content"]).where("doc > source").select("doc", "row", "start", "n", "source", "place"))
    dropped(blocks)
    mixed = index.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    unmatched = written(index.join(mixed, "anchor", "left_semi").groupBy(F.col("source").alias("doc")).agg(F.collect_list("anchor").alias("wanted")))
    dropped(index)
    windows = written(texts.join(unmatched, "doc").mapInArrow(_windows(width), f"high long, low long, doc {key}, row long, start long"))
    dropped(unmatched)
    earliest = windows.groupBy("high", "low").agg(*first, F.max("doc").alias("last")).where("source < last").drop("last")
    single = windows.join(earliest, ["high", "low"]).where("doc > source").select("doc", "row", "start", F.lit(1).cast("long").alias("n"), "source", "place")
    found = written(whole.unionByName(single).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n", "source", "place")).alias("found")))
    dropped(whole, windows)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", to_arrow_type(docs.schema[id_col].dataType)), ("place", pa.int64())])
    parsed = texts.join(found, ["doc", "row"], "left").mapInArrow(_remove(width, ["doc"], kind), f"doc {key}, n_words long, n_removed long, kept_text string, spans array<struct<start: long, end: long>>, factors array<struct<start: long, length: long, source: {key}, place: long>>")
    return parsed.withColumnRenamed("doc", id_col)

"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams, one of labelled target documents and one of all documents, give each
document a log importance weight. Documents are drawn without replacement, in proportion to their weights, by the
Gumbel top-k trick.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .store import bundled, dropped, in_order, schema_with, written

#: Classes of bytes: 0 white space, 1 words, 2 punctuation. A token is a run of one class.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[~K.WORD_BYTES] = 0
_CLASS[0x30:0x3A] = _CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = 1


@dataclass(frozen=True)
class Resampling:
    """buckets: of hashed unigrams and bigrams. smoothing: added to each bucket's count.

    temperature: a document weighs as this many independent n-grams of its mean log ratio, so that length alone neither
    helps nor harms; Gumbel noise then moves a mean by about 1.3 / temperature. target_labels: the most labelled
    documents the target model is fitted on, taken in order of a hash of their ids. seed: of the noise. prior_grams: so
    many n-grams of ratio 0 are added to each document, so that a few rare words decide little.
    """

    buckets: int = 1 << 16
    smoothing: float = 1.0
    temperature: float = 30.0
    target_labels: int = 20_000
    seed: int = 11
    prior_grams: float = 30.0


def _grams(raw: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the text of each."""
    kinds = _CLASS[raw]
    new = np.empty(len(raw), bool)
    if len(raw):
        new[0] = True
        new[1:] = kinds[1:] != kinds[:-1]
        new[at[:-1][at[:-1] < len(raw)]] = True
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(raw)))
    solid = kinds[starts] > 0
    starts, stops = starts[solid], (starts + lengths)[solid]
    first = np.searchsorted(starts, at, "left")
    words = K.word_hashes(raw, starts, stops)
    begin, doc2 = K.inside_texts(first, 2)
    pairs = K.window_hashes(words, 2)[begin] if len(begin) else np.zeros(0, np.uint64)
    doc1 = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return (np.concatenate([words, pairs]) % np.uint64(buckets)).astype(np.int64), np.concatenate([doc1, doc2])


def count_grams(docs: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """Counts of hashed n-grams over all documents. Each task sends one row for each bucket it met, summed by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, raw, at in K.slices(batches, text_col):
            total += np.bincount(_grams(raw, at, buckets)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    out = np.zeros(buckets)
    # At most `buckets` rows.
    for row in docs.select(text_col).mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def log_ratios(docs: DataFrame, target_ids: DataFrame, how: Resampling, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p(target) - log p(all) for each bucket, 0 without target documents; target_ids has one column, id_col."""
    chosen = target_ids.where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(how.target_labels)
    # Bounded by target_labels.
    target = count_grams(docs.join(F.broadcast(chosen), id_col, "left_semi"), text_col, how.buckets)
    if not target.any():
        return np.zeros(how.buckets)
    target, every = target + how.smoothing, count_grams(docs, text_col, how.buckets) + how.smoothing
    return np.log(target / target.sum()) - np.log(every / every.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, how: Resampling, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """Adds n_grams, log_weight and gumbel_key (the weight with noise that hangs on the id) to id_col and `keep`."""
    carried = list(dict.fromkeys([id_col, *keep]))
    held = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float32))  # `buckets` numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in K.slices(batches, text_col):
            grams, doc = _grams(raw, at, how.buckets)
            n = np.bincount(doc, minlength=rows.num_rows)
            total = np.bincount(doc, held.value[grams], minlength=rows.num_rows)
            weight = np.round(how.temperature * total / (n + how.prior_grams), 6)
            ids = K.mix(rows.column("_noise").to_numpy().astype(np.int64).view(np.uint64))
            uniform = ((ids >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in carried), pa.array(n), pa.array(weight), pa.array(weight - np.log(-np.log(uniform)))], [*carried, "n_grams", "log_weight", "gumbel_key"])

    noisy = docs.select(*dict.fromkeys([*carried, text_col])).withColumn("_noise", F.xxhash64(F.lit(how.seed), F.col(id_col)))
    return noisy.mapInArrow(work, schema_with(docs, carried, "n_grams long, log_weight double, gumbel_key double"))


TARGET, ACCEPTED = "quality = 1 and coalesce(toxic, 0) = 0", "quality = 1"


def accepted_share(labels: DataFrame, accepted: str = ACCEPTED) -> float:
    """The share of labelled rows that are good enough; 1 where nothing is labelled."""
    good = F.avg(F.when(F.expr(accepted), 1.0).otherwise(0.0))
    return labels.agg(good).first()[0] if labels.take(1) else 1.0


def _scored(docs: DataFrame, labels: DataFrame, share: float | None, how: Resampling, id_col: str, text_col: str, target: str) -> tuple[DataFrame, np.ndarray, int]:
    """Documents with weights and keys, the ratios, and how many documents to draw."""
    ratios = log_ratios(docs, labels.where(target).select(id_col), how, id_col, text_col)
    scored = written(weigh(docs, ratios, how, id_col, text_col).withColumn("_down", -F.col("gumbel_key")).withColumn("_one", F.lit(1).cast("long")))
    return scored, ratios, round((accepted_share(labels) if share is None else share) * scored.count())


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, how: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text", target: str = TARGET) -> DataFrame:
    """One row per document: n_grams, log_weight, gumbel_key and selected.

    A document's key is its log importance weight plus Gumbel noise, so the documents with the k largest keys are a
    sample without replacement in proportion to weights. That is an exact top k over the whole table, ties by id,
    found from prefix counts of range partitions. k hangs on no weight: it is the share `share` of all documents, by
    default the share of labelled documents that are good enough.

    Null or empty text has no n-grams and weight 0. Null ids share one noise value. Repeated rows are weighed one by
    one. Without labels nothing is known against any, and all are selected; an empty table gives no rows. Other columns
    are not read. Texts are weighed whole.
    """
    scored, _, k = _scored(docs, labels, share, how, id_col, text_col, target)
    ranked = in_order(scored, ["_down", id_col], {"_rank": "_one"})
    dropped(scored)
    return ranked.select(id_col, "n_grams", "log_weight", "gumbel_key", (F.col("_rank") < k).alias("selected"))


def select_documents(docs: DataFrame, labels: DataFrame, share: float | None = None, how: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text", target: str = TARGET) -> DataFrame:
    """The selected documents themselves, with all their columns.

    Only the last selected row (its key and id) comes to the driver; documents are then weighed again and compared
    with it where they lie, which costs less than shuffling texts to a list of selected ids.
    """
    scored, ratios, k = _scored(docs, labels, share, how, id_col, text_col, target)
    last = in_order(scored, ["_down", id_col], {"_rank": "_one"}).where(F.col("_rank") == k - 1).first() if k else None
    dropped(scored)
    if last is None:
        return docs.limit(0)
    whole, back = bundled(docs, [id_col, text_col])
    again = weigh(whole, ratios, how, id_col, text_col, keep=[text_col, "_rest"])
    down, same_or_before = -F.col("gumbel_key"), F.col(id_col).isNull() if last[id_col] is None else F.col(id_col).isNull() | (F.col(id_col) <= F.lit(last[id_col]))
    return again.where((down < last["_down"]) | ((down == last["_down"]) & same_or_before)).select(*back)

"""Limits of compression bands hang on every labelled good document."""

from __future__ import annotations

import zstandard
from pyspark.sql import functions as F


def test_last_label_counts(spark):
    from tidewright.llm.compression import Fit, fit_bands

    ids = spark.range(20_001).orderBy(F.xxhash64(F.col("id").alias("doc_id")), "id").collect()
    last = ids[-1].id  # in the order in which labels were once taken, up to 20,000
    plain, odd = "the quick brown fox and a lazy dog by the old river in town " * 4, "abcdefghi " * 24
    docs = spark.range(20_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == last, odd).otherwise(plain).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    bands = fit_bands(docs, labels, how=Fit(outside=0.0, margin=0.0, least_rows=1, steps=1))
    ratio = len(odd) / len(zstandard.ZstdCompressor(level=3).compress(odd.encode()))
    low = len(plain) / len(zstandard.ZstdCompressor(level=3).compress(plain.encode()))
    assert len(odd) == len(plain) == 240 and ratio > low
    least, most = next(b[1:] for b in bands.documents if b[0] == 128)
    assert (least, most) == (round(low, 5), min(round(ratio, 5), 3.0))


def test_texts_stay_where_they_are_read(spark):
    from tidewright.llm.compression import Fit, fit_bands

    n, words = 400, 1_000
    docs = spark.range(n, numPartitions=4).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda k: F.hex(F.xxhash64("id", k))), " ").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    with_broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # labels that are too many to be sent to every task
    try:
        fit_bands(docs, labels, how=Fit(least_rows=1))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_broadcast)
    # Texts of 6.7 MB, random digits, which don't compress below half of that.
    assert 0 < shuffled() - before < 500_000

"""The pipeline's stages one by one, each against a brute-force version on its own input, and the whole run."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from tests_llm_data import documents

from tidewright.llm.store import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    r = random.Random(8)
    rows = [(d, t) for d, t in documents(seed=6, n=110)]
    good = [t for _, t in rows if t and len(t) > 300][:6]
    rows += [(1000 + i, " ".join(r.choice(["%%%", "$$$", "###", "@@@!"]) for _ in range(60))) for i in range(25)]
    rows += [(2000, good[0] + " token = abcdef123456 xK9v2Qw8ZtR4mN7pLs3dYb6H"), (2001, good[0] + " one more word")]
    docs = spark.createDataFrame([(d, t, "en", "src", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(d, int(d < 1000), 0) for d, _ in rows if d % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(good[5].split()[2:22]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, folder):
    import corpus_pipeline as P
    import public_tokenizers
    from tokenizers import Tokenizer

    stage = dict(P.STAGES)
    step = lambda name, docs: written(stage[name](spark, docs, folder))
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    kept = step("quality classifier", docs)
    assert kept.columns == docs.columns
    before, after = texts(docs), texts(kept)
    assert not [d for d in after if 1000 <= d < 2000]
    assert len(after) >= 0.9 * sum(d < 1000 or d >= 2000 for d in before)

    unique = step("near duplicates", kept)
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) else frozenset() for d, t in after.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(texts(unique)) == {d for d in ids if find(d) == d}
    assert len(texts(unique)) < len(after)

    clean = step("decontamination", unique)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    item = words(spark.read.parquet(f"{folder}/benchmark.parquet").first().text)
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [words(t)] for i in range(len(w) - 9))
    assert set(texts(clean)) == {d for d, t in texts(unique).items() if not hit(t)}
    assert len(texts(clean)) < len(texts(unique))

    safe = step("secrets", clean)
    assert safe.columns == docs.columns and set(texts(safe)) == set(texts(clean))
    assert all("abcdef123456" not in (t or "") and "xK9v2Qw8" not in (t or "") for t in texts(safe).values())
    assert sum(texts(safe)[d] != t for d, t in texts(clean).items()) <= 1
    assert all(r.n_chars == len(r.text) for r in safe.collect() if r.text is not None)

    packed = step("packing", safe).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts(safe).items()}
    assert packed.groupby("doc_id").length.sum().to_dict() == n
    filled = packed.groupby("sequence_id").length.sum()
    assert filled.max() <= 4096 and np.ceil(sum(n.values()) / 4096) <= len(filled)


def test_run(spark, folder):
    import corpus_pipeline as P

    got = P.run(spark, folder)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns)
    assert collections.Counter(r.sequence_id for r in got.collect()).total() == got.count() > 0


CLASHES = "n_words n_hit n_items item_ids spans n_grams log_weight gumbel_key _noise selected n_random base_sha256 component_id n_shingles start length sequence_id offset curve_key sums doc row z".split()


def test_stages_with_clashing_columns_repeats_nulls_and_empty_tables(spark, folder):
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("text of a null id").alias("text"), "lang", "source", F.lit(0).cast("long").alias("n_chars"))
    odd = docs.unionByName(docs.where("doc_id % 7 = 0")).unionByName(extra).unionByName(extra)
    odd = odd.select("*", *(F.concat(F.lit(f"{c} "), F.coalesce("text", F.lit("-"))).alias(c) for c in CLASHES))
    plain, none = docs, odd.limit(0)
    for name, stage in P.STAGES:
        odd, plain, none = (written(stage(spark, d, folder)) for d in (odd, plain, none))
        assert none.isEmpty()
        if name != "packing":
            assert odd.columns == [*docs.columns, *CLASHES] and none.columns == odd.columns
            assert odd.where(F.expr(" or ".join(f"not startswith({c}, '{c} ')" for c in CLASHES))).isEmpty()
        if name == "near duplicates":
            assert odd.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
            assert odd.where("doc_id is null").count() == 2
    assert odd.select("doc_id").distinct().count() > 20


def test_a_result_outlives_the_stages_of_others(spark, folder):
    import corpus_pipeline as P

    from tidewright.llm.sharding import shard_by_bytes

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = shard_by_bytes(docs, 5)
    P.run(spark, folder)
    assert held.count() == docs.count()

"""The SQL of operators 3, 5, 7, 10, 11 and 12 against the operators, on awkward rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests_llm_data import PAGES, documents


def check(frame, sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    expected, got = con.sql(sql).df(), frame.toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    one = lambda v: None if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    plain = lambda df: sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert plain(got) == plain(expected)


def test_document_oracles(spark):
    from tidewright.llm import oracles
    from tidewright.llm.decontaminate import find_contamination, items_digest
    from tidewright.llm.jaccard_join import shingle_components
    from tidewright.llm.relative_lz import remove_repeats

    rows = pd.DataFrame(documents(seed=4), columns=["doc_id", "text"])
    docs = spark.createDataFrame(documents(seed=4), "doc_id long, text string")
    texts = [t for t in rows.text if t and len(t) > 300]
    bench = pd.DataFrame([(i, " ".join(texts[i].split()[3:20])) for i in range(6)] + [(9, "one"), (10, None), (11, "A b")], columns=["item_id", "text"])
    items = spark.createDataFrame(list(bench.itertuples(index=False, name=None)), "item_id long, text string")
    found = find_contamination(docs, items)
    check(found.select("doc_id", "n_words", "n_hit", "n_items", items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")), oracles.decontamination(), documents=rows, benchmark=bench)
    check(remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")), oracles.repeats(), documents=rows)
    check(shingle_components(docs), oracles.shingle_components(), documents=rows)


def test_url_oracle(spark):
    from tidewright.llm import oracles
    from tidewright.llm.url_filter import filter_urls

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    check(filter_urls(pages).drop("component"), oracles.url_filter(), pages=pd.DataFrame(PAGES, columns=["page_id", "url", "html"]))


def test_url_oracle_with_odd_links(spark):
    from tidewright.llm import oracles
    from tidewright.llm.url_filter import filter_urls

    blocked = "http://b.net/es/1"
    html = [
        f"<meta http-equiv=refresh content=\"0;url='{blocked}'\">", f"<link rel='alternate canonical' href='{blocked}?x=1&amp;y=2'>", f"<!-- <link rel=canonical href={blocked}> -->",
        f"<meta http-equiv='refresh' content='30; url={blocked}'>", "<LINK HREF=es/7 REL=canonical>", "<link rel=canonical href='mailto:x'>", f"<link rel=stylesheet href='{blocked}'>",
    ]
    rows = [(i, f"http://h{i}.org/a/b" if i != 4 else "http://t.net/es?", h) for i, h in enumerate(html)] + [(20, blocked, ""), (21, f"{blocked}?x=1&y=2", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = filter_urls(pages)
    check(got.drop("component"), oracles.url_filter(), pages=pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert [r.page_id for r in got.where("verdict = 'block'").orderBy("page_id").collect()] == [0, 1, 4, 20, 21]


def test_copies_oracle(spark):
    from tidewright.llm import oracles
    from tidewright.llm.digest_index import drop_copies

    plain = documents(seed=6, n=60)
    rows = plain + [(i + 200, t.replace(" ", "\t \n") if t else t) for i, t in plain[:30]] + plain[:5] + [(-5, "same here"), (400, "same\x0bhere"), (None, "same here"), (None, "alone"), (None, "alone"), (401, " "), (402, "")]
    rows += [(k, "hot " * 50) for k in range(1000, 1400)]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, digest string, row string, kept string").repartition(7)
    con = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    for arrivals in (1, 2, 5):
        check(drop_copies(docs, arrivals=arrivals), oracles.copies(), documents=con)
    assert drop_copies(docs.limit(0)).count() == 0


def term_rows(seed=0, n=160):
    import random

    r = random.Random(seed)
    words = ["".join(r.choice("abcdeABé") for _ in range(r.randint(1, 4))) for _ in range(60)]
    rows = [(k % 140, " ".join(r.choice(words) + r.choice(["", ",", "7", "_x"]) for _ in range(r.randint(0, 40))), r.choice(["en", "en", "en", "de", None, ""]), r.choice(["s1", "s1", "s1", "s2", "s3", None, "Ünï"])) for k in range(n)]
    return rows + rows[:5] + [(900, None, "en", "empty"), (901, "1 2 3", "en", "s9"), (902, "only here", "xx", "a"), (903, None, "xx", "b"), (904, "only twice", "xx", "c"), (None, "K aé AÉ K", "en", "s2")]


def test_divergence_oracle(spark):
    from tidewright.llm import oracles
    from tidewright.llm.source_terms import divergence

    for seed in (0, 1):
        rows = term_rows(seed)
        docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, lang string, source string, term string, p long").repartition(5)
        for top, least in ((200, 3), (4, 1)):
            check(divergence(docs, top=top, least_docs=least), oracles.divergence(least, top), documents=pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    assert divergence(docs.limit(0)).count() == 0


def test_divergence_in_small_blocks(spark, monkeypatch):
    """What is held and handed on in pieces gives the same sums, with more sources than a block takes."""
    import pyarrow as pa

    from tidewright.llm import source_terms as st

    r = np.random.Generator(np.random.PCG64(0))
    rows = [(lang, term, f"s{s}", int(x), 5) for lang in "ab" for term in "tuvw" for s, x in enumerate(r.integers(5, 10**9, 30)) if term != "u" or s < 7]
    table = pa.Table.from_pylist([dict(zip(("lang", "term", "source", "p", "p0"), x, strict=True)) for x in rows])

    def sums():
        out: dict = {}
        for b in st.pair_runs(iter(table.to_batches(max_chunksize=11))):
            for x in b.to_pylist():
                k = (x["lang"], x["source"], x["item"])
                out[k] = out.get(k, 0) + x["value"]
        return out

    whole = sums()
    monkeypatch.setattr(st, "BLOCK", 64)
    monkeypatch.setattr(st, "HELD_ENTRIES", 50)
    assert sums() == whole and len(whole) == 2 * 30 * 29
    docs = [pa.RecordBatch.from_pylist([{"lang": "en", "source": f"s{i % 3}", "text": f"a b{i} a c"} for i in range(20)])]
    got: dict = {}
    for b in st.count_terms(iter(docs * 3)):
        for x in b.to_pylist():
            k = (x["term"], x["source"])
            got[k] = tuple(map(sum, zip(got.get(k, (0, 0)), (x["docs"], x["uses"]), strict=True)))
    assert got[("a", "s0")] == (21, 42) and got[("c", "s1")] == (21, 21) and got[("b", "s2")] == (18, 18)

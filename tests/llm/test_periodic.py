"""Runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from tests_llm_data import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """Every maximal stretch of each period; of equal stretches that of smallest period."""
    best = {}
    n = len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                best.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in best.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(seed=0, n=150):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(1, 5)):
            unit = [r.choice("abcd") for _ in range(r.randint(1, 9))]
            words += (unit * r.randint(1, 9))[: r.randint(1, 60)] + [r.choice("abcdef") for _ in range(r.randint(0, 6))]
        if r.random() < 0.2:
            words = (words * 3)[: r.randint(1, 400)]
        out.append(" ".join(words))
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    return [*out, " ".join(fib[-1]), "x " * 500, " ".join("ab" * 200), " ".join(("a" * 11 + "b") * 20)]


def test_extensions():
    from tidewright.llm.periodic import Extensions

    r = np.random.Generator(np.random.PCG64(5))
    for k in (1, 2, 5):
        s = np.append(r.integers(1, k + 1, 200), 0)
        a, b = np.triu_indices(201, 1)
        want = [next(x for x in range(201) if s[i + x] != s[j + x]) for i, j in zip(a, b, strict=True)]
        assert Extensions(s).common(a, b).tolist() == want


def test_grid_has_all_pairs():
    from tidewright.llm.periodic import grid, pairs

    for n in (0, 1, 2, 3, 10, 97, 1500):
        want = sorted((j * p, (j + 1) * p) for p in range(1, n) for j in range(n) if (j + 1) * p < n)
        for source in (grid, pairs):
            assert sorted((int(x), int(y)) for a, b in source(n) for x, y in zip(a, b, strict=True)) == want


def test_runs_match_brute_force(spark):
    from tidewright.llm.periodic import find_runs, longest_run, runs_digest

    texts = repetitive() + [t for _, t in documents(n=60)][:-1] + [None, "", " \n", "é é é é é é é é é é é é é", "a b " * 13]
    rows = [(None if i % 50 == 7 else i % 60, t, "clash", 1) for i, t in enumerate(texts)]
    found = find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(3))
    found = found.select("*", longest_run().alias("best"), runs_digest().alias("digest"))
    got = sorted((str(x.doc_id), x.n_words, [tuple(r) for r in x.runs], x.best and tuple(x.best), x.digest, x.collapsed_text) for x in found.collect())
    want = []
    for d, t, _, _ in rows:
        w = WORD.findall(t or "")
        runs = brute(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        want.append((str(d), len(w), runs, best, hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(), collapsed(w, runs)))
    assert got == sorted(want)
    assert sum(len(x[2]) > 1 for x in got) > 50


def test_no_rows_and_other_limits(spark):
    from tidewright.llm.periodic import find_runs

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(repetitive(seed=1, n=30))], "name int, body string")
    assert find_runs(docs.limit(0), id_col="name", text_col="body").count() == 0
    for x in find_runs(docs, least=2, id_col="name", text_col="body").join(docs, "name").collect():
        assert [tuple(r) for r in x.runs] == brute(x.body.split(), 2)


def test_long_texts():
    """Longer than the table, and one word all along: as many pairs as there can be."""
    from tidewright.llm import periodic

    n = 2 * periodic.TABLE_WORDS
    words = np.random.Generator(np.random.PCG64(2)).integers(0, 1 << 62, n).astype(np.uint64)
    words[100_000:100_000 + 300 * 7] = np.tile(words[:300], 7)
    words[5:45] = words[5]
    start, end, period = periodic.runs_of(words, np.array([0, n]))
    assert list(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)) == [(5, 45, 1), (100_000, 102_100, 300)]
    start, end, period = periodic.runs_of(np.ones(n, np.uint64), np.array([0, 0, n, n]))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [n], [1])


def test_query_on_whole_table(spark):
    """The query's own texts, by the contract's rule, in plain Python."""
    from tidewright.llm.queries import op13_harmonic_runs

    sf = "/root/testdata/sf0.001"
    got = {x.doc_id: x for x in op13_harmonic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d, t in docs:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(d).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        s, k, p = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        x = got[d]
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli) == (len(runs), s, k, p, 1000 * k // p if k else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert [f.dataType.simpleString() for f in op13_harmonic_runs(spark, sf).schema] == ["bigint"] * 6 + ["string"] * 2

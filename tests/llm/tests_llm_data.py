"""Rows that the tests of this folder share."""

from __future__ import annotations

import random


def documents(seed=0, n=120):
    """Random texts with copies, near copies, shared passages, junk, odd white space, nulls and a very long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage = words(40)
    texts = [None, "", "   \n\t", "one", "One two", "a b c", "A\u00a0b\u2003c \x1f d", "same line\nsame line\nsame line\n\nother", "x " * 30, "%%% ### a|b <c> & d"]
    base = [words(r.randint(20, 200)) for _ in range(12)]
    while len(texts) < n:
        kind = r.random()
        w = list(r.choice(base)) if kind < 0.6 else words(r.randint(5, 150))
        if 0.15 < kind < 0.6:
            for _ in range(r.randint(1, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        if kind > 0.9:
            w[3:3] = passage
        texts.append(" ".join(x + r.choice(["", "", ",", "."]) for x in w) if 0.6 < kind < 0.9 else " ".join(w))
    texts.append(" ".join(words(20_000)))
    r.shuffle(texts)
    return list(enumerate(texts))


def link(u):
    return f'<html><head><link rel="canonical" href="{u}"></head>'


def refresh(u):
    return f'<meta http-equiv="refresh" content="0; url={u}">'


PAGES = [
    (0, "http://A.Example.com/en/x?q#f", None), (1, "https://www.example.com/en/x", ""), (2, "http://b.net/es/1", ""), (3, "no scheme", None), (4, None, None),
    (5, "http://alias.org/1", link("http://b.net/es/1")), (6, "http://alias.org/2", refresh("https://alias.org/1/")), (7, "http://both.org/1", link("http://c.net/fr/2") + refresh("http://d.com/2")),
    (8, "http://notexample.com/en/", ""), (9, "x://com", ""), (10, "://net/fr/", ""), (11, "http://free.org/", link("/self")), (11, "http://free.org/", link("/self")), (12, "http://q.org?a/b://c", ""),
]

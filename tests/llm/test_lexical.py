"""Ranked lexical search against brute force."""

import math
import random
import re

import pytest

from logweave.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    words = [(i, terms(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, length = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, w in words:
            m = 25 + 75 * len(w) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms(text) if t in df)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return out


@pytest.fixture(scope="module")
def tables():
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(120)] + ["é", "漢字", "A_b", "x y", "ABC"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 60)))) for i in range(300)]
    docs += [(300 + i, docs[5][1]) for i in range(20)]  # ties
    docs += [docs[7], docs[7], (None, docs[5][1]), (None, "w1 w2"), (400, None), (401, ""), (402, " !?_\t\n"), (403, "w3 " * 40_000), (404, "z" * 300_000), (405, "w1\x00w2 \U0001f600w9")]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 12)))) for i in range(25)]
    items += [(30, docs[5][1]), (31, "w1 w1 W1 unknown"), (32, None), (33, ""), (34, "nothing here"), (None, "w4"), (35, "w7"), (35, "w7")]
    return docs, items


def as_frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 7, "a") for i, t in docs], "doc_id long, text string, q int, terms string").repartition(5),
        spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double"),
    )


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("size", [{}, {"width": 64, "postings": 500}, {"block_terms": 30}])
def test_ranks_what_brute_force_ranks(spark, tables, size):
    got = result(lexical.search(*as_frames(spark, *tables), **size))
    assert got == sorted(brute(*tables), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_empty_tables(spark, tables):
    docs, items = as_frames(spark, *tables)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_a_window_that_cannot_win_is_left_out(monkeypatch):
    """Later windows of weaker documents are not scored, and the heap is as if they were."""
    import numpy as np

    block = {"first": np.array([0, 1]), "term": np.array([0]), "times": np.array([1]), "vocabulary": np.array([5])}
    offered = []
    monkeypatch.setattr(lexical.Heap, "offer", lambda self, *a, old=lexical.Heap.offer: (offered.append(len(a[0])), old(self, *a)))
    s = lexical.Scorer(block, np.array([1000]), 100, 1000, 2)
    for n in (1, 2, 50, 60):
        s.window(np.arange(4) + 10 * n, np.zeros(4, bool), np.full(4, n), np.arange(4), np.zeros(4, np.int64), np.ones(4, np.int64))
    assert offered == [4] and s.heaps[0].doc.tolist() == [10, 11]

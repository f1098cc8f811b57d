import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborquery.llm import components as c
from arborquery.llm import ngram_join as j


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    """(n_shingles, component) by comparing all pairs."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets)


def family(rng, words, rates, ids):
    base = [rng.choice("abcdefghij") + str(rng.randrange(1000)) for _ in range(words)]
    for i, rate in zip(ids, rates, strict=True):
        yield i, " ".join(w if rng.random() >= rate else f"new{rng.randrange(10**6)}" for w in base)


@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 4, 5), (1, 1, 2)])
def test_classes_equal_comparing_all_pairs(spark, k, num, den, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 20)  # so that large families are taken key by key
    rng, rows, at = random.Random(k), [], 0
    for words in (1, 3, 4, 5, 6, 8, 10, 12, 15, 20, 30, 45, 70, 120, 300, 900):
        n = 30 if words in (20, 120) else 7
        rows += family(rng, words, [rng.choice((0, 0.005, 0.01, 0.03, 0.06)) for _ in range(n)], range(at, at + n))
        at += n
    rows += [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "A b"), (at + 4, "a B"), (at + 5, "a\x1cb c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(tuple(r) for r in j.joined(docs, k, num, den).collect()) == brute(rows, k, num, den)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 150), st.integers(0, 40), st.integers(0, 40), st.sampled_from([(85, 100), (4, 5), (1, 2)]), st.integers(0, 2**32))
def test_similar_sets_share_a_key_and_sketches_bound_distances(size, less, more, ratio, seed):
    rng = np.random.default_rng(seed)
    s = j.scheme(*ratio, 1 << 20)
    x = rng.integers(0, 2**64, size, np.uint64)
    y = np.concatenate([x[min(less, size - 1) :], rng.integers(0, 2**64, more, np.uint64)])
    x, y = np.unique(x), np.unique(y)
    apart = len(np.setxor1d(x, y))
    values, first = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
    for salts in (1, 3):
        keys, sets, roles = j.entries(values, first, s, salts)
        own = [{(kind, key) for key, i, r in zip(keys.tolist(), sets.tolist(), roles.tolist(), strict=True) for kind in (1, 2) if i == n and r & kind} for n in (0, 1)]
        probe = [{key for kind, key in o if kind == j.PROBE} for o in own]
        index = [{key for kind, key in o if kind == j.INDEX} for o in own]
        if apart <= s.apart(len(x), len(y)):
            a, b = (0, 1) if len(x) <= len(y) else (1, 0)
            assert probe[a] & index[b]
    mine, other = j.sketches(x, s), j.sketches(y, s)
    for level in mine.keys() & other.keys():
        assert sum(p != q for p, q in zip(mine[level], other[level], strict=True)) <= apart


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(170)] + [(7, 7), (None, 3), (3, 5), (5, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.label for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_rows(spark, odd_docs, no_docs, sf):
    rows = j.op9_ngram_join(spark, sf(documents=odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    of = {r.doc_id: r.component_id for r in rows}
    assert of[6] == 5 and of[1] == 1 and of[2] == 2 and of[3] == 3 and of[None] is None
    assert j.op9_ngram_join(spark, sf(documents=no_docs)).collect() == []
    kept = j.representatives(odd_docs)
    assert kept.columns == odd_docs.columns and 6 not in {r.doc_id for r in kept.collect()} and kept.count() == odd_docs.count() - 1


def test_words_of_a_structure_that_defeats_polynomials_are_apart(spark):
    """Thue-Morse words and their complements, which every polynomial modulo 2**64 takes for equal."""
    rows, word = [], "a"
    for i in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
        rows += [(2 * i, word), (2 * i + 1, word.translate(str.maketrans("ab", "ba")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in j.joined(docs, 4, 85, 100).collect()) == brute(rows, 4, 85, 100)
    words = [f"{'x' * n}{c}" for n in (0, 1, 6, 7, 8, 15, 16, 254, 255, 256, 257, 600) for c in "yz"]
    assert len(set(j.shingles.words([w.encode() for w in words], "space").hashes.tolist())) == len(words)


def test_every_text_of_a_repeated_id_keeps_its_links(spark, monkeypatch):
    """Two texts of one size under one doc_id, either linked with others."""
    monkeypatch.setattr(j, "BLOCK", 4)
    rng, rows = random.Random(8), []
    for base in range(2):
        texts = [t for _, t in family(rng, 60, [0, *[0.02] * 11], range(12))]
        rows += [(base * 100 + i, t) for i, t in enumerate(texts)] + [(500, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = dict((i, c) for i, _, c in brute(rows, 4, 85, 100))
    assert {r.doc_id: r.component_id for r in j.joined(docs, 4, 85, 100).collect()} == want

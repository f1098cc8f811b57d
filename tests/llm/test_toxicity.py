import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborquery.llm import toxicity as t


def definition(values):
    """Maximal segments by recursion on the best one, shortest and then leftmost first."""

    def within(a, b):
        best, at = 0, None
        for i in range(a, b):
            total = 0
            for k in range(i, b):
                total += values[k]
                if total > best or at and total == best and k + 1 - i < at[1] - at[0]:
                    best, at = total, (i, k + 1)
        return [] if at is None else [*within(a, at[0]), (*at, best), *within(at[1], b)]

    return within(0, len(values))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_segments_equal_their_definition(values):
    got = t.maximal_segments([(i, i + 1, float(v)) for i, v in enumerate(values)])
    want = definition(values)
    assert [s[2] for s in got] == [s[2] for s in want]
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


@pytest.fixture(scope="module")
def corpus(spark, prose):
    rng, rows, labels = random.Random(2), [], []
    for i in range(900):
        words, toxic = prose(rng.randrange(5, 120)).split(), rng.random() < 0.2
        for _ in range(rng.randrange(1, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(("vilefoo!", "Nastybar", "grubbaz###")))
        rows.append((i, " ".join(words), "en", 0.5))
        labels.append((i, 1, int(toxic)))
    labels += [(5, None, None), (None, 1, 1), labels[7]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: x for i, _, x in labels if i is not None and x is not None}


def test_held_out_accuracy(spark, corpus, sf):
    docs, labels, truth = corpus
    rows = t.op2_toxicity(spark, sf(documents=docs, labels=labels)).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 900 and 120 < len(held) < 240
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    found = [r for r in rows if truth[r.doc_id]]
    assert sum(r.n_passages > 0 for r in found) > 0.9 * len(found)


def test_held_out_labels_are_not_used(spark, corpus):
    docs, labels, _ = corpus
    other = labels.filter(t.fold(t.F.col("doc_id"), t.FOLDS) != t.HELD_OUT)
    a, b = t.train(docs, labels), t.train(docs, other)
    assert a.weights == pytest.approx(b.weights) and (a.keys == b.keys).all()


def test_odd_and_empty_tables(spark, odd_docs, no_docs, corpus, sf):
    _, labels, _ = corpus
    docs, marks, _ = corpus
    model = t.train(docs, marks)
    assert t.scored(odd_docs, model).count() == odd_docs.count()
    kept = t.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert [r.score for r in t.op2_toxicity(spark, sf(documents=odd_docs, labels=labels.limit(0))).collect()] == [0.0] * odd_docs.count()
    assert t.op2_toxicity(spark, sf(documents=no_docs, labels=labels)).collect() == []


def test_statistics_equal_a_plain_computation(spark, corpus):
    """Log-odds from documents that have a feature, lambda as the root of its equation, K from the best segments."""
    docs, labels, truth = corpus
    model = t.train(docs, labels)
    texts: dict[str, int] = {}
    for r in docs.collect():
        if crc32(str(r.doc_id).encode()) % 5 and r.doc_id in truth:
            texts[r.text] = max(texts.get(r.text, 0), truth[r.doc_id])

    def words(text):
        return re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())

    def features(word):
        return {(len(word), word), *((p, word[:p], "part") for p in t.PREFIXES if len(word) > p)}

    hashes, counts = {}, {}
    for text, toxic in texts.items():
        own = set().union(*map(features, words(text))) if words(text) else set()
        for f in own:
            counts.setdefault(f, [0, 0])[toxic] += 1
            if f not in hashes:
                w = t.shingles.words([f[1] if len(f) == 2 else f[1] + b"x"], "letters", t.PREFIXES)
                hashes[f] = int(w.hashes[0] if len(f) == 2 else w.parts[t.PREFIXES.index(f[0])][0])
    n = [sum(x == k for x in texts.values()) for k in (0, 1)]
    want = {}
    for f, (clean, toxic) in counts.items():
        if clean + toxic < 3:
            continue
        prior = 0.5 + t.PRIOR * (clean + toxic) / sum(n)
        a, b = toxic + prior, clean + prior
        value = math.log(a / (n[1] + t.PRIOR + 1 - a)) - math.log(b / (n[0] + t.PRIOR + 1 - b))
        z = value / math.sqrt(1 / a + 1 / b)
        if abs(z) >= t.LEAST_Z:
            want[hashes[f]] = value * (1 - t.CAUTION / abs(z))
    assert dict(zip(model.keys.tolist(), model.odds.tolist(), strict=True)) == pytest.approx(want)

    # scores of clean tokens under the models that were not fitted on them are near those under this one: the equation
    # holds for the distribution that the training saw, so lambda and K are checked through their own functions
    scores, many = np.array([2.0, 1.0, -0.5]), np.array([1, 5, 200])
    lam = t._lambda(scores, many)
    assert lam > 0 and (many / many.sum() * np.exp(lam * scores)).sum() == pytest.approx(1)
    x = np.array([[0.0, 1.0], [1.0, 0.5], [2.0, 3.0], [0.5, 0.1], [3.0, 2.0], [2.5, 0.2]])
    y = np.array([0.0, 0.0, 1.0, 1.0, 1.0, 0.0])
    w = np.array(t._logistic(x, y))
    loss = lambda w: np.logaddexp(0, w[0] + x @ w[1:]).sum() - (y * (w[0] + x @ w[1:])).sum() + 0.5 * len(x) * (1e-4 * ((w[1:] * x.std(0)) ** 2).sum())
    assert all(loss(w) <= loss(w + d) + 1e-5 for i in range(3) for d in (np.eye(3)[i] * 0.01, np.eye(3)[i] * -0.01))
    assert 0 < model.lam < 50 and 0 < model.k < 1e3 and model.weights[1] > 0

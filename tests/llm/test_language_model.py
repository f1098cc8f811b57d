from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest

from arborquery.llm import language_model as lm


def slow_scores(net, texts):
    """Window by window, position by position, from the definition."""
    out = []
    for ids in texts:
        total, stride = 0.0, lm.WINDOW - lm.OVERLAP
        for target in range(1, len(ids)):
            n = 0 if target <= lm.WINDOW else -(-(target - lm.WINDOW) // stride)
            start = n * stride
            x = net.embed[ids[start:target]] + net.place[: target - start]
            q, k, v = np.split(x @ net.qkv, 3, axis=1)
            a = np.exp(np.clip(q[-1] @ k.T, -30, 30))
            h = x[-1] + (a / a.sum()) @ v
            y = np.clip(np.maximum(h @ net.inner + net.bias, 0) @ net.outer + net.base, -80, 80)
            c = net.kind[ids[target]]
            pair = ids[target - 1] * len(net.kind) + ids[target]
            at = np.flatnonzero(net.pairs == pair)
            inner = net.known[at[0]] if len(at) else net.back[ids[target - 1], c] + net.share[ids[target]]
            total += (y[c] - y.max() - np.log(np.exp(y - y.max()).sum())) / np.log(10) + inner
        out.append(total)
    return out


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(1)
    texts = [np.array([999, *np.cumsum(rng.integers(1, 3, 90)) % 40, 999]) for _ in range(60)]
    return lm.fit(texts, 1000)


def test_windows_score_each_id_once(net):
    rng = np.random.default_rng(2)
    texts = [np.array([999, *rng.integers(0, 50, n), 999]) for n in (0, 1, 22, 23, 24, 40, 41, 42, 43, 200)]
    got = lm.log10_scores(net, np.concatenate(texts).astype(np.int32), np.cumsum([0, *map(len, texts)]))
    assert got == pytest.approx(slow_scores(net, texts), rel=1e-4)


def test_gradients_by_differences():
    """Each weight's gradient is the slope of the loss, by small steps in double precision; no score is at its bound."""
    rng = np.random.default_rng(3)
    wide = lm.fit([], 40)
    wide = wide._replace(**{f: rng.standard_normal(getattr(wide, f).shape) * 0.4 for f in wide._fields[:7]})
    wide = wide._replace(kind=rng.integers(0, lm.CLASSES, 40))
    ids = rng.integers(0, 40, (4, lm.WINDOW))
    target, own = wide.kind[rng.integers(0, 40, ids.size)], rng.random(ids.size)
    room = lm._Room(4, np.float64)
    _, rows, grads = lm._gradients(wide, ids, target, own, room)
    for i, (name, grad) in enumerate(zip(wide._fields, grads, strict=False)):
        for _ in range(12):
            at = tuple(rng.integers(0, k) for k in grad.shape)
            place = (rows[at[0]], *at[1:]) if i == 0 else at
            losses = []
            for step in (1e-5, -1e-5):
                moved = getattr(wide, name).copy()
                moved[place] += step
                losses.append(-float(lm._forward(wide._replace(**{name: moved}), ids, target, room) @ own))
            assert grad[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-3, abs=1e-5), (name, at)


def test_shares_of_a_class_sum_to_one(net):
    """After any id, whether its pairs have slots or not; also where slots are few and so are shared."""
    rng = np.random.default_rng(6)
    flat = rng.integers(0, 300, 5000)
    keys, many = lm._pairs(flat, np.array([0, 2000, 5000]), np.array([1, 3]), 300)
    assert many.sum() == 1999 + 3 * 2999 and lm._ids(keys, many, 300)[7] >= (flat == 7).sum()
    share = np.log10(np.full(300, 1 / np.bincount(np.arange(300) % lm.CLASSES)[np.arange(300) % lm.CLASSES])).astype(np.float32)
    kind, part = np.arange(300) % lm.CLASSES, keys // 300 % lm.SLICES
    small = lm._start(kind, share, [lm._shares(keys[part == i], many[part == i], i, kind, share, 1024) for i in range(lm.SLICES)])
    assert 0 < (small.pairs >= 0).sum() < len(keys)
    for each in (net, small):
        size = len(each.kind)
        for a in (0, 1, 39, 200, size - 1):
            key = a * size + np.arange(size)
            slot = lm._slot(np.full(size, a), key, len(each.pairs))
            p = 10.0 ** np.where(each.pairs[slot] == key, each.known[slot], each.back[a, each.kind] + each.share)
            assert np.bincount(each.kind, p, lm.CLASSES)[np.unique(each.kind)] == pytest.approx(1, abs=1e-4)


def test_pairs_are_counted(monkeypatch):
    """As a plain walk counts them, texts apart, each as often as it occurs."""
    texts, many = [[9, 1, 2, 1, 9], [9, 9], [9, 1, 2, 9]], [2, 1, 5]
    want = Counter()
    for t, n in zip(texts, many, strict=True):
        want.update({a * 10 + b: n * c for (a, b), c in Counter(zip(t, t[1:], strict=False)).items()})
    keys, counts = lm._pairs(np.array(sum(texts, [])), np.array([0, 5, 7, 11]), np.array(many), 10)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want
    assert lm._ids(keys, counts, 10).tolist() == [0, 9, 7, 0, 0, 0, 0, 0, 0, 16]


def test_it_learns(net):
    """Steps of one or two from the id before: about one bit, not the five of forty ids."""
    rng = np.random.default_rng(9)
    texts = [np.array([999, *np.cumsum(rng.integers(1, 3, 90)) % 40, 999]) for _ in range(20)]
    flat = np.concatenate(texts).astype(np.int32)
    bits = -lm.log10_scores(net, flat, np.cumsum([0, *map(len, texts)])).sum() / len(flat) / np.log10(2)
    assert bits < 2.5


def test_attention_is_causal(net):
    ids = np.random.default_rng(4).integers(0, 40, (1, lm.WINDOW))
    other = ids.copy()
    other[0, 20:] = 3
    target = net.kind[ids].ravel()
    a, b = (lm._forward(net, x, target, lm._Room(1)) for x in (ids, other))
    assert np.allclose(a[:20], b[:20], atol=1e-5) and not np.allclose(a[20:], b[20:], atol=1e-2)


def test_it_beats_counting_words(spark):
    """Log10 probability of whole texts against that of the words' own counts: above it where they were learned from, near
    it where they were held out from so little text, since counts need not spell unknown words."""
    subwords = lm._subwords(lm.default_vocabulary(), lm.default_pattern())
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    words = [(crc32(str(i).encode()) % 7 == 2, (t or "").encode().lower().split()) for i, t in rows]
    ids = [(held, np.concatenate([[subwords.mark], subwords.ids(w)[0], [subwords.mark]])) for held, w in words]
    net = lm.fit([x for held, x in ids if not held], subwords.mark + 1)
    count, ends = Counter(w for held, ws in words if not held for w in ws), sum(not held for held, _ in words)
    n, v = sum(count.values()) + ends, len(count) + 1
    for part in (True, False):
        base = sum(log10(((count[w] if w else ends) + 1) / (n + v + 1)) for held, ws in words if held == part for w in [*ws, b""])
        own = [x for held, x in ids if held == part]
        assert lm.log10_scores(net, np.concatenate(own).astype(np.int32), np.cumsum([0, *map(len, own)])).sum() > base * (1.03 if part else 1)


def test_query_rows(spark, odd_docs, no_docs, sf, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 100_000)
    rows = lm.op4_language_model(spark, sf(documents=odd_docs)).collect()
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in odd_docs.collect()]
    counts, ends = Counter(), 0
    for i, words in texts:
        if i is None or crc32(str(i).encode()) % 7 != 2:
            counts.update(words)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    assert len(rows) == len(texts) and all(r.train_tokens == n for r in rows)
    want = sorted((i or -1, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, sum(log10((counts[x] + 1) / (n + v + 1)) for x in w) + log10((ends + 1) / (n + v + 1))) for i, w in texts)
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score) for r in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0 for r in rows)
    assert lm.op4_language_model(spark, sf(documents=no_docs)).collect() == []


def test_ids_of_every_unit_shape_the_network(spark, prose, monkeypatch):
    """Classes, shares and embeddings cover ids met in any unit, however the rows are partitioned."""
    monkeypatch.setattr(lm, "STEPS", 5)
    monkeypatch.setattr(lm, "UNIT_CHARS", 5_000)
    words = [f"{w} " * 40 for w in ("astronomy", "botany", "chemistry", "dentistry", "economics", "forestry")]
    docs = spark.createDataFrame([(i, prose(150) + " " + words[i % 6]) for i in range(60)] + [(None, "null " * 30)], "doc_id long, text string")
    one, other = lm.train(docs.repartition(1)), lm.train(docs.repartition(7))
    assert all(np.array_equal(a, b) for a, b in zip(one, other, strict=True))
    subwords = lm._subwords(lm.default_vocabulary(), lm.default_pattern())
    train = [t.text for t in docs.collect() if t.doc_id is None or crc32(str(t.doc_id).encode()) % 7 != 2]
    count = np.zeros(len(one.kind))
    for t in train:
        np.add.at(count, subwords.ids(t.encode().lower().split())[0], 1)
    count[subwords.mark] = 2 * len(train)
    mass = count + 0.05
    assert one.share == pytest.approx(np.log10(mass / np.bincount(one.kind, mass, lm.CLASSES)[one.kind]), abs=1e-4)
    begun = np.random.default_rng(7).standard_normal(one.embed.shape) / np.sqrt(len(one.embed))
    moved = (one.embed != begun.astype(np.float32)).any(1)
    assert moved[count > 0].all() and not moved[count == 0].any()


def test_ids_in_long_texts_have_eight_before_them():
    """Of every window but a text's first, the targets scored have 8 ids before them at least, and up to 31."""
    _, start, low, high = lm.windows(np.array([0, 500]))
    assert low[1:].min() >= 8 and high.max() >= 32 and (high - low).sum() == 499


def test_ids_of_words_go_at_once():
    """As each word alone, be it with white space that is none between words, with signs, or empty of letters."""
    subwords = lm._subwords(lm.default_vocabulary(), lm.default_pattern())
    odd = ["a", "it's", "\u00a0", "x\u00a0", "\u00a0y", "--", "\u4e16\u754c", "1,000.5", "\x1c", "\u2003z\u2003", "end."]
    for words in (odd, [w for w in odd if not lm._WHITE.search(w)], [], ["\u00a0", "\u00a0"]):
        texts = [" ".join(words[i:]).encode().lower() for i in range(len(words) + 1)]
        codes, first, distinct = lm.vocabulary(texts)
        assert [[distinct[c] for c in codes[a:b]] for a, b in zip(first[:-1], first[1:], strict=True)] == [t.split() for t in texts]
        ids, at = subwords.texts(codes, first, *subwords.ids(distinct))
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == [subwords.mark, *(i for w in t.split() for i in subwords.encode(" " + w.decode())), subwords.mark]


def test_inputs_before_a_windows_own_are_only_looked_at(net):
    """What is predicted after the others is as if all were predicted; nothing is computed after those skipped."""
    ids = np.random.default_rng(8).integers(0, 40, (5, lm.WINDOW))
    room, target = lm._Room(5, skip=lm.OVERLAP), net.kind[ids]
    part = lm._forward(net, ids, target[:, lm.OVERLAP :].ravel(), room).reshape(5, -1)
    assert room.e.shape == (5 * (lm.WINDOW - lm.OVERLAP), lm.CLASSES)
    assert part == pytest.approx(lm._forward(net, ids, target.ravel(), lm._Room(5)).reshape(5, -1)[:, lm.OVERLAP :], rel=1e-5, abs=1e-5)


def test_words_met_before_keep_their_ids(monkeypatch):
    """A word is encoded once by a worker, as long as there is room; its ids are the same whether kept or not."""
    subwords, calls = lm.Subwords(lm.default_vocabulary(), lm.default_pattern()), []
    encode = subwords.encode
    subwords.encode = lambda text: calls.append(text) or encode(text)
    texts = [[b"old", b"words", b"x\x0by"], [b"words", b"new", b"old", b"new"], [b"old"], []]
    for most in (4, 100):
        monkeypatch.setattr(lm, "KEPT_WORDS", most)
        for words in texts:
            flat, sizes = subwords.ids(words)
            want = [encode(" " + w.decode()) for w in words]
            assert flat.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
    assert sum("old" in c for c in calls) == 1


def test_texts_are_encoded_once(spark, odd_docs, monkeypatch):
    """The network learns from the ids that are written for scoring: beside the sizes, one pass over the documents."""
    monkeypatch.setattr(lm, "STEPS", 5)
    wrote, written = [], lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: wrote.append((name, df)) or written(df, name))
    assert lm.scored(odd_docs).count() == odd_docs.count()
    assert [name for name, _ in wrote].count("lm-rows") == 1 and {"lm-units", "lm-scores"} < {name for name, _ in wrote}
    reads = [name for name, df in wrote if "text" in df._jdf.queryExecution().optimizedPlan().toString()]
    assert reads == ["lm-rows"]

"""A causal self-attention model over subword ids, trained and applied in numpy, and unigram word statistics.

The model predicts each subword id of the lower-cased words from those before it: embeddings of ids and positions, one
head of causal attention, a hidden layer, a softmax over classes of ids, and each id's share of its class after the id
before it. Classes, clusters of ids by their neighbours, and shares, discounted counts of pairs that back off to those of
single ids, come from counts over every training document. The network is fitted on every training document too: distinct texts are dealt by hash into units, the first unit is fitted by Adam, and then
rounds of 1, 2, 4, ... units start from the network so far, go once through each unit on its own, and are averaged,
each embedding by the id's occurrences. Averages are of fixed-point sums, so neither order nor partitions matter.
A text's ids, begun and ended by a mark, are cut into windows of WINDOW inputs that overlap by OVERLAP; many windows
go through masked attention at once and each id is scored in exactly one window, with OVERLAP ids before it at least
unless the text begins there. The score is the sum of the ids' log10 probabilities.

Word statistics cover every training document. Texts are taken in chunks; a chunk's distinct words with their counts go,
packed by a hash of the word, to the buckets that add up all chunks' counts, and the totals come back to the chunk.
So what moves is each chunk's vocabulary rather than its words, and no task holds more than a chunk or a bucket.
The same pass over the texts gives their ids, which are written once: the network is fitted to them and scores them.

Defined cases: a null or empty text is one end mark; with no training document every count is 0 and the model is
uniform; repeated rows are counted and scored each; whole texts are scored; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .bpe import default_pattern, default_vocabulary, read_ranks
from .common import documents, drop, fold, ids_and_texts, map_arrow, written

FOLDS, HELD_OUT = 7, 2
#: Characters of training documents in a unit, about; slices in which averages and neighbour counts are added up.
UNIT_CHARS, SLICES = 8_000_000, 64
WINDOW, OVERLAP, WIDTH, HIDDEN, CLASSES = 32, 8, 16, 32, 64
STEPS, BATCH, RATE = 1500, 128, 0.01
#: Slots of pairs, what is taken off each pair's count for those in no slot, windows scored together.
SLOTS, DISCOUNT, ROOM = 1 << 20, 0.5, 128
#: Words whose ids a worker keeps, those of the first texts it meets.
KEPT_WORDS = 500_000
#: Bytes of text of one chunk; text characters for each bucket of the exchange, and the fewest buckets.
CHUNK_BYTES, BUCKET_CHARS, BUCKETS = 8 << 20, 16 << 20, 128


class Network(NamedTuple):
    """Weights; kind and share: each id's class and its log10 share in it; after an id, a slot of pairs (id * vocabulary +
    next id) has the next id's log10 share in its class, and whatever is in no slot its share plus back."""

    embed: np.ndarray
    place: np.ndarray
    qkv: np.ndarray
    inner: np.ndarray
    bias: np.ndarray
    outer: np.ndarray
    base: np.ndarray
    kind: np.ndarray
    share: np.ndarray
    pairs: np.ndarray
    known: np.ndarray
    back: np.ndarray


_MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))


class _Room:
    """Arrays for n windows, filled anew by every step: few enough windows at a time stay in a core's cache. The first
    skip inputs of each window are only looked at: nothing is predicted after them."""

    def __init__(self, n: int, kind: type = np.float32, skip: int = 0):
        new = lambda *s: np.empty(s, kind)
        own, d = WINDOW - skip, WIDTH
        p = n * own
        self.n, self.skip, self.rows = n, skip, np.arange(0, p * CLASSES, CLASSES)
        self.x, self.qkv, self.a, self.sums = new(n * WINDOW, d), new(n * WINDOW, 3 * d), new(n, own, WINDOW), new(p, 1)
        self.seen, self.h, self.z, self.e, self.total = new(n, own, d), new(p, d), new(p, HIDDEN), new(p, CLASSES), new(p, 1)
        self.m, self.dz, self.dh, self.dqkv = new(n, own, WINDOW), new(p, HIDDEN), new(p, d), new(p, 3 * d)
        self.mask, self.ones = _MASK[skip:].astype(kind), np.ones((max(WINDOW, CLASSES), 1), kind)

    def heads(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = x.reshape(self.n, WINDOW, 3 * WIDTH)
        return x[..., :WIDTH], x[..., WIDTH : 2 * WIDTH], x[..., 2 * WIDTH :]


def _forward(net: Network, ids: np.ndarray, target: np.ndarray, room: _Room) -> np.ndarray:
    """The log-probability of the target class after every input of windows (n, WINDOW) that the room does not skip; the
    room keeps the rest."""
    r = room
    np.take(net.embed, ids.ravel(), 0, out=r.x, mode="clip")
    r.x.reshape(-1, WINDOW, WIDTH)[:] += net.place
    np.matmul(r.x, net.qkv, out=r.qkv)
    q, k, v = r.heads(r.qkv)
    np.matmul(q[:, r.skip :], k.transpose(0, 2, 1), out=r.a)
    np.clip(r.a, -30.0, 30.0, out=r.a)
    np.exp(r.a, out=r.a)
    np.multiply(r.a, r.mask, out=r.a)
    np.matmul(r.a.reshape(-1, WINDOW), r.ones[:WINDOW], out=r.sums)
    np.matmul(r.a, v, out=r.seen)
    np.divide(r.seen.reshape(-1, WIDTH), r.sums, out=r.h)
    r.h.reshape(r.n, -1, WIDTH)[:] += r.x.reshape(r.n, WINDOW, WIDTH)[:, r.skip :]
    np.matmul(r.h, net.inner, out=r.z)
    r.z += net.bias
    np.maximum(r.z, 0.0, out=r.z)
    np.matmul(r.z, net.outer, out=r.e)
    r.e += net.base
    np.clip(r.e, -80.0, 80.0, out=r.e)
    found = r.e.reshape(-1).take(r.rows + target)
    np.exp(r.e, out=r.e)
    np.matmul(r.e, r.ones[:CLASSES], out=r.total)
    return found - np.log(r.total[:, 0])


def _gradients(net: Network, ids: np.ndarray, target: np.ndarray, own: np.ndarray, room: _Room) -> tuple[float, np.ndarray, tuple[np.ndarray, ...]]:
    """The loss, targets weighted by own; the ids met, and the gradients: of their embeddings, then of the other weights."""
    r, d = room, WIDTH
    loss = -float(_forward(net, ids, target, r) @ own)
    dy = r.e
    dy *= own[:, None] / r.total
    dy.reshape(-1)[r.rows + target] -= own
    np.matmul(dy, net.outer.T, out=r.dz)
    r.dz *= r.z > 0
    np.matmul(r.dz, net.inner.T, out=r.dh)
    one = np.ones((1, len(dy)), dy.dtype)
    outer, base, inner, bias = r.z.T @ dy, (one @ dy)[0], r.h.T @ r.dz, (one @ r.dz)[0]
    # through attention: with weights a / sums, what a row passes on is taken relative to its mean
    q, k, v = r.heads(r.qkv)
    dq, dk, dv = r.heads(r.dqkv)
    g = r.dh / r.sums
    r.h -= r.x
    r.h *= g
    mean = (r.h @ r.ones[:d]).reshape(-1, WINDOW, 1)
    g = g.reshape(-1, WINDOW, d)
    np.matmul(g, v.transpose(0, 2, 1), out=r.m)
    r.m -= mean
    r.m *= r.a
    np.matmul(r.m, k, out=dq)
    np.matmul(r.m.transpose(0, 2, 1), q, out=dk)
    np.matmul(r.a.transpose(0, 2, 1), g, out=dv)
    dx = r.dqkv @ net.qkv.T
    dx += r.dh
    rows, at = np.unique(ids, return_inverse=True)
    embed = np.bincount((at.reshape(-1, 1) * d + np.arange(d)).ravel(), dx.ravel(), len(rows) * d).reshape(-1, d).astype(dx.dtype)
    return loss, rows, (embed, dx.reshape(-1, WINDOW, d).sum(0), r.x.T @ r.dqkv, inner, bias, outer, base)


def windows(first: np.ndarray, overlap: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, from, to) of the windows over texts of ids flat[first[i]:first[i+1]]: of a window's targets, the
    next id of each input, those from..to are its own to score."""
    targets = np.diff(first) - 1
    overlap = OVERLAP if overlap is None else overlap
    stride = WINDOW - overlap
    count = np.where(targets > 0, 1 + -(-np.maximum(0, targets - WINDOW) // stride), 0)
    text = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = first[text] + nth * stride
    return text, start, np.where(nth > 0, overlap, 0), np.minimum(WINDOW, targets[text] - nth * stride)


def _slot(before: np.ndarray, key: np.ndarray, slots: int) -> np.ndarray:
    """The slot of a pair: an id's pairs are all in its slice of the slots."""
    size = slots // SLICES
    return before % SLICES * size + ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % size


def log10_scores(net: Network, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The log10 probability of each text's ids after its first."""
    text, start, low, high = windows(first)
    out = np.zeros(len(first) - 1)
    # what an id's class holds for it, by the id before it alone
    before, after = flat[:-1].astype(np.int64), flat[1:]
    key = before * len(net.kind) + after
    slot = _slot(before, key, len(net.pairs))
    inner = np.where(net.pairs[slot] == key, net.known[slot], net.back[before, net.kind[after]] + net.share[after])
    inner[first[1:-1] - 1] = 0  # from one text to the next
    part = np.append(0.0, np.cumsum(inner, dtype=np.float64))
    out += part[first[1:] - 1] - part[first[:-1]]
    padded = np.concatenate([flat, np.zeros(WINDOW + 1, flat.dtype)])
    at, scale = np.arange(WINDOW), 1 / np.log(10)
    for skip in (0, OVERLAP):  # windows that begin a text score all their targets, others those after the overlap
        some = np.flatnonzero(low == skip)
        room = _Room(ROOM, skip=skip)
        for b in range(0, len(some), ROOM):
            now = some[b : b + ROOM]
            span = start[now, None] + at
            if len(span) < ROOM:
                room = _Room(len(span), skip=skip)
            lp = _forward(net, padded[span], net.kind[padded[span[:, skip:] + 1]].ravel(), room).reshape(len(span), -1)
            own = at[skip:] < high[now, None]
            out += np.bincount(text[now], np.where(own, lp, 0.0).sum(1, dtype=np.float64), len(out)) * scale
    return out


def _hubs(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id's row in the table of neighbours, -1 for ids met less than 10 times; its column, 255 for all but the most frequent."""
    order = np.argsort(-count, kind="stable")
    rank = np.full(len(count), -1)
    top = order[: int((count >= 10).sum())]
    rank[top] = np.arange(len(top))
    hub = np.full(len(count), 255)
    hub[order[:255]] = np.arange(len(order[:255]))
    return rank, hub


def _added(keys: np.ndarray, more: np.ndarray, found: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of keys in order and their numbers as one."""
    merged = np.union1d(keys, found)
    total = np.zeros(len(merged), np.int64)
    total[np.searchsorted(merged, keys)] += more
    total[np.searchsorted(merged, found)] += many
    return merged, total


def _pairs(flat: np.ndarray, first: np.ndarray, many: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours, as id * vocabulary + next id, in order, with their counts; many: how often each text occurs."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.ones(max(0, len(flat) - 1), bool)
    inside[first[1:-1] - 1] = False
    weight = np.repeat(many, np.diff(first))
    for i in range(0, len(flat) - 1, 1_000_000):  # in parts, as sorting takes several times their memory
        part, own = flat[i : i + 1_000_001].astype(np.int64), inside[i : i + 1_000_000]
        key, w = (part[:-1] * vocabulary + part[1:])[own], weight[i : i + 1_000_000][: len(own)][own]
        found, n = np.unique(key, return_counts=True)
        often = np.flatnonzero(w > 1)
        n = n + np.bincount(np.searchsorted(found, key[often]), w[often] - 1, len(found)).astype(np.int64)
        keys, counts = _added(keys, counts, found, n)
    return keys, counts


def _ids(keys: np.ndarray, counts: np.ndarray, vocabulary: int) -> np.ndarray:
    """How often each id occurs, the mark at both ends, by the pairs."""
    out = np.bincount(keys % vocabulary, counts, vocabulary)
    out[-1] += counts[keys // vocabulary == vocabulary - 1].sum()
    return out.astype(np.int64)


def _cells(keys: np.ndarray, counts: np.ndarray, rank: np.ndarray, hub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells row * 512 + column of the table of neighbours, and their counts, by the pairs."""
    a, b = keys // len(rank), keys % len(rank)
    after, before = rank[a] >= 0, rank[b] >= 0
    cells = np.concatenate([(rank[a] * 512 + 256 + hub[b])[after], (rank[b] * 512 + hub[a])[before]])
    found, at = np.unique(cells, return_inverse=True)
    return found, np.bincount(at, np.concatenate([counts[after], counts[before]]), len(found)).astype(np.int64)


def _classes(count: np.ndarray, table: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Each id's class, by k-means on the table of its neighbours, and its log10 share in the class."""
    vocabulary = len(count)
    order = np.argsort(-count, kind="stable")
    kind = np.zeros(vocabulary, np.int64)
    top = order[: len(table)]
    if len(top) > CLASSES:
        table /= np.maximum(1, table.sum(1, keepdims=True))
        np.sqrt(table, out=table)
        means = table[rng.choice(min(len(top), 400), CLASSES - 8, replace=False)]
        for _ in range(12):
            near = np.argmax(table @ means.T - 0.5 * (means * means).sum(1), axis=1)
            means = np.stack([table[near == c].mean(0) if (near == c).any() else table[rng.integers(len(table))] for c in range(len(means))])
        kind[top] = near
        rest = order[len(top) :]  # by frequency, unseen ids last
        kind[rest] = CLASSES - 8 + np.minimum(7, np.arange(len(rest)) * 8 // max(1, (count[rest] > 0).sum() + 1))
    else:
        kind = np.arange(vocabulary) % CLASSES
    mass = count + 0.05
    share = np.log10(mass / np.bincount(kind, mass, CLASSES)[kind])
    return kind.astype(np.int32), share.astype(np.float32)


def _shares(keys: np.ndarray, counts: np.ndarray, part: int, kind: np.ndarray, share: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one slice of the ids before: its slots' pairs and log10 shares, and what is left for pairs in no slot.

    Where slots are shared the more frequent pair has it. By absolute discounting an id's shares in a class sum to 1.
    """
    vocabulary, size = len(kind), slots // SLICES
    a, b = keys // vocabulary, keys % vocabulary
    cell = a // SLICES * CLASSES + kind[b]
    height = -(-vocabulary // SLICES) * CLASSES
    total = np.bincount(cell, counts, height)
    slot = _slot(a, keys, slots) - part * size
    order = np.lexsort((keys, -counts, slot))
    order = order[np.append(True, slot[order][1:] != slot[order][:-1])[: len(order)]]
    own = (counts[order] - DISCOUNT) / total[cell[order]]
    left = 1 - np.bincount(cell[order], own, height)
    held, known = np.full(size, -1), np.zeros(size, np.float32)
    held[slot[order]] = keys[order]
    known[slot[order]] = np.log10(own + left[cell[order]] * 10.0 ** share[b[order]])
    return held, known, np.log10(np.maximum(left, 1e-12)).astype(np.float32).reshape(-1, CLASSES)


def _start(kind: np.ndarray, share: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Network:
    """A network of random weights; parts: the shares by slices."""
    rng = np.random.default_rng(7)
    shape = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    weights = shape(len(kind), WIDTH), shape(WINDOW, WIDTH) * 0.1, shape(WIDTH, 3 * WIDTH) * 0.5, shape(WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), shape(HIDDEN, CLASSES), np.zeros(CLASSES, np.float32)
    back = np.stack([p[2] for p in parts], 1).reshape(-1, CLASSES)[: len(kind)]
    return Network(*weights, kind, share, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), back)


def fit(texts: list[np.ndarray], vocabulary: int) -> Network:
    """A network fitted to texts of ids, each with its marks, the last id of the vocabulary, at both ends."""
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    first = np.cumsum([0, *map(len, texts)])
    keys, many = _pairs(flat, first, np.ones(len(texts), np.int64), vocabulary)
    count = _ids(keys, many, vocabulary)
    rank, hub = _hubs(count)
    cells, met = _cells(keys, many, rank, hub)
    table = np.zeros((rank.max() + 1) * 512, np.float32)
    table[cells] = met
    kind, share = _classes(count, table.reshape(-1, 512), np.random.default_rng(7))
    part = keys // vocabulary % SLICES
    net = _start(kind, share, [_shares(keys[part == i], many[part == i], i, kind, share, SLOTS) for i in range(SLICES)])
    return _fitted(net, flat, first, STEPS, RATE, 1e-4, OVERLAP) if texts else net._replace(outer=net.outer * 0)


def _fitted(net: Network, flat: np.ndarray, first: np.ndarray, steps: int, rate: float, final: float, overlap: int) -> Network:
    """The network after steps of Adam, and as many as go through every window once; its rate falls to the final one."""
    rng = np.random.default_rng(7)
    # the weights but for the embeddings are parts of one array
    whole = np.concatenate([w.ravel() for w in net[1:7]])
    parts = np.split(whole, np.cumsum([w.size for w in net[1:6]]))
    net = net._replace(embed=net.embed.copy(), **{f: p.reshape(w.shape) for f, p, w in zip(Network._fields[1:7], parts, net[1:7], strict=True)})
    _, start, _, high = windows(first, overlap)
    flat = np.concatenate([flat, np.zeros(WINDOW + 1, flat.dtype)])
    m1, m2, e1, e2 = np.zeros_like(whole), np.zeros_like(whole), np.zeros_like(net.embed), np.zeros_like(net.embed)
    at, size, kinds = np.arange(WINDOW), min(BATCH, len(start)), net.kind[flat]
    steps, room = max(steps, -(-len(start) // size)), _Room(size)
    order = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < size:
            order = np.append(order, rng.permutation(len(start)))
        pick, order = order[:size], order[size:]
        span = start[pick, None] + at
        own = (at < high[pick, None]).astype(np.float32).reshape(-1)
        own /= own.sum()
        _, rows, (g, *grads) = _gradients(net, flat[span], kinds[span + 1].ravel(), own, room)
        now = rate * (1 - step / (steps + 1)) + final
        # of the embeddings only these change
        a, b = e1.take(rows, 0), e2.take(rows, 0)
        a *= 0.9
        a += 0.1 * g
        e1[rows] = a
        b *= 0.99
        b += 0.01 * g * g
        e2[rows] = b
        np.sqrt(b, out=b)
        b += 1e-8
        a *= now
        a /= b
        net.embed[rows] -= a
        g = np.concatenate([g.ravel() for g in grads])
        m1 *= 0.9
        m1 += 0.1 * g
        m2 *= 0.99
        m2 += 0.01 * g * g
        whole -= now * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return net


def vocabulary(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(codes, first, words): every word of the texts as a place in words, where each text begins, the distinct words."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    inside, starts, ends = shingles.cuts(data, "space")
    offsets = np.append(0, np.cumsum(ends - starts))
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    first = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
    return flat.indices.to_numpy().astype(np.int64), first, flat.dictionary.to_numpy(zero_copy_only=False).tolist()


_WHITE = re.compile(r"[^\S ]")


class Subwords:
    """Ids of words; the id after the vocabulary is the mark at both ends of a text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = read_ranks(path)
        self.mark = len(ranks)
        self.encode = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.begins = np.zeros(max(ranks.values(), default=0) + 1, bool)
        self.begins[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
        self.kept, self.kept_ids, self.kept_sizes = pa.array([], pa.binary()), np.empty(0, np.int32), np.empty(0, np.int64)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): of each word with a space before it, from those kept or encoded now."""
        found = pc.fill_null(pc.index_in(pa.array(words, pa.binary()), value_set=self.kept), -1).to_numpy()
        new = np.flatnonzero(found < 0)
        fresh = [words[i] for i in new.tolist()]
        flat, sizes = self._encoded(fresh)
        at = found.astype(np.int64)
        at[new] = len(self.kept) + np.arange(len(new))
        flat, sizes = np.concatenate([self.kept_ids, flat]), np.concatenate([self.kept_sizes, sizes])
        if len(sizes) <= KEPT_WORDS and len(new):
            self.kept, self.kept_ids, self.kept_sizes = pa.concat_arrays([self.kept, pa.array(fresh, pa.binary())]), flat, sizes
        own = sizes[at]
        ends = np.cumsum(own)
        return flat[np.arange(own.sum()) + np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - own), own)], own

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces end before spaces, so that all words go at once, unless other white space, at which the pattern looks
        ahead, is in a word."""
        text = b"".join(b" " + w for w in words).decode()
        if not _WHITE.search(text):
            flat = np.array(self.encode(text), np.int32)
            starts = np.flatnonzero(self.begins[flat])
            if len(starts) == len(words):
                return flat, np.diff(np.append(starts, len(flat)))
        each = [self.encode(" " + w.decode()) for w in words]
        return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)

    def texts(self, codes: np.ndarray, first: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): of the texts whose words are the codes, between marks, gathered from the words' ids."""
        n = sizes[codes]
        ends = np.append(0, np.cumsum(n))
        own = np.append(0, np.cumsum(np.diff(ends[first]) + 2))
        out = np.full(own[-1], self.mark, np.int32)
        inner = np.ones(own[-1], bool)
        inner[own[:-1]] = inner[own[1:] - 1] = False
        begin = np.cumsum(sizes) - sizes
        out[inner] = flat[np.arange(ends[-1]) + np.repeat(begin[codes] - ends[:-1], n)]
        return out, own


@lru_cache(1)
def _subwords(path: str, pattern: str) -> Subwords:
    return Subwords(path, pattern)


class _Unit(NamedTuple):
    """Texts of a unit, one after another, where each begins, and in how many training documents it is."""

    number: int
    flat: np.ndarray
    first: np.ndarray
    many: np.ndarray


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[_Unit]:
    for batch in batches:
        for number, ids, sizes, many in zip(*(c for c in batch.columns), strict=True):
            sizes = np.frombuffer(sizes.as_py(), np.int64)
            yield _Unit(number.as_py(), np.frombuffer(ids := ids.as_py(), np.uint16 if len(ids) == 2 * sizes.sum() else np.int32).astype(np.int32), np.append(0, np.cumsum(sizes)), np.frombuffer(many.as_py(), np.int64))


def _id_type(path: str, pattern: str) -> type:
    return np.uint16 if _subwords(path, pattern).mark < 1 << 16 else np.int32


def _units(texts: DataFrame, units: int, width: int) -> DataFrame:
    """(unit, ids, sizes, many): the distinct texts of the training documents as ids, dealt by hash and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = set(), Counter()

        def rows(found: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
            units, ids, many = list(zip(*found, strict=True)) or ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(ids, pa.binary()), pa.array(many, pa.int64())], ["unit", "ids", "many"])

        def unit(key: bytes) -> int:
            return int.from_bytes(key[:8], "big") % units

        for batch in batches:
            found = []
            for ids in batch.column(0).to_pylist():
                key = blake2b(ids, digest_size=16).digest()
                if key in seen:  # copies do not move one by one
                    again[ids] += 1
                else:
                    seen.add(key)
                    found.append((unit(key), ids, 1))
            yield rows(found)
        for ids, n in again.items():
            yield rows([(unit(blake2b(ids, digest_size=16).digest()), ids, n)])

    def pack(table: pa.Table) -> pa.Table:
        many: Counter = Counter()
        for ids, n in zip(table.column("ids").to_pylist(), table.column("many").to_pylist(), strict=True):
            many[ids] += n
        texts = sorted(many)
        sizes, times = np.array([len(t) // width for t in texts], np.int64), np.array([many[t] for t in texts], np.int64)
        return pa.table({"unit": table.column("unit")[:1], "ids": pa.array([b"".join(texts)], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()), "many": pa.array([times.tobytes()], pa.binary())})

    moved = map_arrow(texts, run, "unit long, ids binary, many long").repartition(min(units, 4096), "unit")
    return written(moved.groupBy("unit").applyInArrow(pack, "unit long, ids binary, sizes binary, many binary"), "lm-units")


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """Rows (slice, data) of whole numbers added up by slice."""

    def add(table: pa.Table) -> pa.Table:
        total = 0
        for data in table.column("data"):
            total = total + np.frombuffer(data.as_py(), np.int64)
        return pa.table({"slice": table.column("slice")[:1], "data": pa.array([total.tobytes()], pa.binary())})

    return {r["slice"]: np.frombuffer(r["data"], np.int64) for r in rows.groupBy("slice").applyInArrow(add, "slice long, data binary").collect()}


def _sliced(numbers: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(numbers, SLICES)
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "data"])


def _joined(parts: dict[int, np.ndarray]) -> np.ndarray:
    return np.concatenate([parts[i] for i in range(SLICES)])


def _corpus_shares(units: DataFrame, vocabulary: int) -> Network:
    """A network of random weights with classes and shares from the counts of pairs over all units."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in _read(batches):
            keys, many = _pairs(u.flat, u.first, u.many, vocabulary)
            part = keys // vocabulary % SLICES
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(SLICES + 1))
            cells = [(keys[o].tobytes(), many[o].tobytes()) for o in np.split(order, cuts[1:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*cells, strict=True))], ["slice", "keys", "many"])

    def add(table: pa.Table) -> pa.Table:
        keys, many = np.empty(0, np.int64), np.empty(0, np.int64)
        for k, m in zip(table.column("keys"), table.column("many"), strict=True):
            keys, many = _added(keys, many, np.frombuffer(k.as_py(), np.int64), np.frombuffer(m.as_py(), np.int64))
        return pa.table({"slice": table.column("slice")[:1], "keys": pa.array([keys.tobytes()], pa.binary()), "many": pa.array([many.tobytes()], pa.binary())})

    schema = "slice long, keys binary, many binary"
    table = written(map_arrow(units, pairs, schema).groupBy("slice").applyInArrow(add, schema), "lm-pairs")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            for part, keys, many in zip(*batch.columns, strict=True):
                yield part.as_py(), np.frombuffer(keys.as_py(), np.int64), np.frombuffer(many.as_py(), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for _, keys, many in tables(batches):
            total += _ids(keys, many, vocabulary)
        yield _sliced(total)

    counts = _joined(_summed(map_arrow(table, count, "slice long, data binary")))
    hubs = units.sparkSession.sparkContext.broadcast(_hubs(counts))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, many in tables(batches):
            found, n = _cells(keys, many, *hubs.value)
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["cells", "many"])

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        height = hubs.value[0].max() + 1
        met = np.zeros(height * 512, np.float64)  # whole numbers: the order in which they are added does not matter
        for batch in batches:
            for found, n in zip(*batch.columns, strict=True):
                met[np.frombuffer(found.as_py(), np.int64)] += np.frombuffer(n.as_py(), np.int64)
        classes = _classes(counts, met.astype(np.float32).reshape(-1, 512), np.random.default_rng(7))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(classes)], pa.binary())], ["classes"])

    near = map_arrow(table, cells, "cells binary, many binary").repartition(1)
    kind, share = pickle.loads(map_arrow(near, cluster, "classes binary").first().classes)
    classes = units.sparkSession.sparkContext.broadcast((kind, share))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, many in tables(batches):
            found = pickle.dumps(_shares(keys, many, part, *classes.value, SLOTS))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([found], pa.binary())], ["slice", "shares"])

    parts = {r["slice"]: pickle.loads(r["shares"]) for r in map_arrow(table, shares, "slice long, shares binary").collect()}
    drop(table)
    return _start(kind, share, [parts[i] for i in range(SLICES)])


def _averaged(units: DataFrame, net: Network, rate: float) -> Network:
    """The network after each unit has been gone through from it, averaged."""
    sent = units.sparkSession.sparkContext.broadcast(net)
    sizes = [w.size for w in net[:7]]
    one = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        moves, weight, total = np.zeros(sum(sizes), np.int64), np.zeros(len(net.embed), np.int64), 0
        for u in _read(batches):
            new = _fitted(net, u.flat, u.first, 1, 0.0, rate, 0)
            met = np.bincount(u.flat, minlength=len(net.embed))
            heavy = np.concatenate([np.repeat(met, WIDTH), np.full(sum(sizes[1:]), len(u.flat))])
            moves += np.rint(np.concatenate([(b - a).ravel() for a, b in zip(net[:7], new[:7], strict=True)]).astype(np.float64) * heavy * one).astype(np.int64)
            weight += met
            total += len(u.flat)
        if total:
            yield _sliced(np.concatenate([moves, weight, [total]]))

    found = _joined(_summed(map_arrow(units, run, "slice long, data binary")))
    sent.destroy()
    moves, weight, total = found[: sum(sizes)], found[sum(sizes) : -1], found[-1]
    heavy = np.concatenate([np.repeat(np.maximum(1, weight), WIDTH), np.full(sum(sizes[1:]), max(1, total))])
    steps = np.split((moves / heavy / one).astype(np.float32), np.cumsum(sizes)[:-1])
    return net._replace(**{f: w + m.reshape(w.shape) for f, w, m in zip(Network._fields[:7], net[:7], steps, strict=True)})


def train(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> Network:
    """A network fitted on every training document."""
    path, pattern = path or default_vocabulary(), pattern or default_pattern()
    docs = _folded(docs)
    sizes = _sizes(docs)
    rows = _encoded(docs, sizes, path, pattern)
    net = _trained(rows, sizes, path, pattern)
    drop(rows)
    return net


def _trained(rows: DataFrame, sizes: Row, path: str, pattern: str) -> Network:
    """A network fitted on the ids of every training document."""
    vocabulary = _subwords(path, pattern).mark + 1
    if not sizes.texts:
        return fit([], vocabulary)
    many = -(-sizes.training // UNIT_CHARS) or 1
    units = _units(rows.filter("bucket < 0 AND NOT held_out").select("ids"), many, np.dtype(_id_type(path, pattern)).itemsize)
    net = _corpus_shares(units, vocabulary)
    numbers = sorted(r.unit for r in units.select("unit").collect())
    sent = units.sparkSession.sparkContext.broadcast(net)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in _read(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fitted(sent.value, u.flat, u.first, STEPS, RATE, 1e-4, OVERLAP)[:7])], pa.binary())], ["weights"])

    found = map_arrow(units.filter(F.col("unit") == numbers[0]), begin, "weights binary").first()
    net = net._replace(**dict(zip(Network._fields, pickle.loads(found.weights), strict=False)))
    ends = [1]
    while ends[-1] < len(numbers):
        ends.append(min(len(numbers), 2 * ends[-1]))
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        net = _averaged(units.filter(F.col("unit").between(numbers[a], numbers[b - 1])), net, 0.5 * RATE * (1 - i / len(ends)))
    drop(units)
    return net


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], list[bool]]]:
    """Whole texts in chunks: ids, lower-cased bytes, whether held out."""
    ids, texts, held, size = [], [], [], 0
    for batch in batches:
        for i, t, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = t.as_py().encode().lower()
            ids.append(i)
            texts.append(data)
            held.append(h)
            size += len(data)
            if size >= CHUNK_BYTES:
                yield ids, texts, held
                ids, texts, held, size = [], [], [], 0
    if ids:
        yield ids, texts, held


_COLUMNS = ["chunk", "bucket", "doc_id", "held_out", "n_tokens", "ids", "data"]
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
_SCHEMA = "chunk long, bucket long, doc_id long, held_out boolean, n_tokens long, ids binary, data binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], _COLUMNS)


def _folded(docs: DataFrame) -> DataFrame:
    return ids_and_texts(docs).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)))


def _sizes(docs: DataFrame) -> Row:
    """Characters of all documents; number and characters of those for training."""
    length, own = F.length("text"), F.when(~F.col("held_out"), F.length("text"))
    return docs.agg(F.coalesce(F.sum(length), F.lit(0)).alias("all"), F.count(own).alias("texts"), F.coalesce(F.sum(own), F.lit(0)).alias("training")).first()


def _encoded(docs: DataFrame, sizes: Row, path: str, pattern: str) -> DataFrame:
    """For each chunk, rows of its vocabulary by bucket (words, training counts), and a row for each document (bucket
    -1, -2, ...): its ids and the counts of its words by their places in the chunk's vocabulary. Texts are encoded here alone."""
    buckets = max(BUCKETS, sizes["all"] // BUCKET_CHARS)
    kind = _id_type(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = _subwords(path, pattern)
        for ids, texts, held in _chunks(batches):
            chunk = uuid.uuid4().int >> 65
            codes, at, words = vocabulary(texts)
            # places in the order of buckets
            own = shingles.words([b" ".join(words)], "space").hashes
            bucket = (own % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            flat, sizes = subwords.ids(words)
            train = np.zeros(len(words), np.int64)
            rows = []
            for a in range(0, len(texts), 256):
                b = min(len(texts), a + 256)
                coded, first = subwords.texts(codes[at[a] : at[b]], at[a : b + 1] - at[a], flat, sizes)
                coded = coded.astype(kind)
                for i, x, y in zip(range(a, b), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    uniq, many = np.unique(rank[codes[at[i] : at[i + 1]]], return_counts=True)
                    if not held[i]:
                        train[order[uniq]] += many
                    data = uniq.astype(np.uint32).tobytes() + many.astype(np.uint32).tobytes()
                    rows.append((chunk, -1 - i, ids[i], held[i], int(at[i + 1] - at[i]) + 1, coded[x:y].tobytes(), data))
                yield _batch(rows)
                rows = []
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[b] : cuts[b + 1]]
                rows.append((chunk, b, None, None, len(at), None, train[at].astype(np.int64).tobytes() + b"\n".join([words[i] for i in at.tolist()])))
            yield _batch(rows)

    return written(map_arrow(docs, run, _SCHEMA), "lm-rows")


def _scores(rows: DataFrame, net: Network, kind: type) -> DataFrame:
    """(chunk, bucket, data): the score of each document's ids."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for a in range(0, batch.num_rows, 256):
                texts = batch.column(2).slice(a, 256).to_pylist()
                flat = np.frombuffer(b"".join(texts), kind).astype(np.int32)
                first = np.cumsum([0, *map(len, texts)]) // np.dtype(kind).itemsize
                scores += [s.tobytes() for s in log10_scores(sent.value, flat, first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.binary())], ["chunk", "bucket", "counts"])

    return written(map_arrow(rows.filter("bucket < 0").select("chunk", "bucket", "ids"), run, "chunk long, bucket long, counts binary"), "lm-scores")


def _totals(table: pa.Table) -> pa.Table:
    """One bucket: for each chunk the total training counts of its words, and a row (chunk -1) with their sum and number."""
    words, counts, sizes = [], [], []
    for data, n in zip(table.column("data"), table.column("n_tokens").to_pylist(), strict=True):
        data = data.as_py()
        counts.append(np.frombuffer(data, np.int64, n))
        words.append(pa.array(data[8 * n :].split(b"\n"), pa.binary()))
        sizes.append(n)
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    at = coded.indices.to_numpy()
    total = np.bincount(at, np.concatenate(counts), len(coded.dictionary)).astype(np.int64)
    ends = np.cumsum(sizes)
    out = [total[at[e - n : e]].tobytes() for e, n in zip(ends.tolist(), sizes, strict=True)]
    bucket = table.column("bucket").to_pylist()
    return pa.table(
        {
            "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int64()),
            "bucket": pa.array([*bucket, bucket[0]], pa.int64()),
            "counts": pa.array([*out, None], pa.binary()),
            "n": pa.array([*([0] * len(out)), int(total.sum())], pa.int64()),
            "v": pa.array([*([0] * len(out)), int((total > 0).sum())], pa.int64()),
        }
    )


def scored(docs: DataFrame, path: str | None = None, pattern: str | None = None, net: Network | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    path, pattern = path or default_vocabulary(), pattern or default_pattern()
    docs = _folded(docs)
    sizes = _sizes(docs)
    rows = _encoded(docs, sizes, path, pattern)
    scores = _scores(rows, net or _trained(rows, sizes, path, pattern), _id_type(path, pattern))
    totals = written(rows.filter("bucket >= 0").groupBy("bucket").applyInArrow(_totals, "chunk long, bucket long, counts binary, n long, v long"), "lm-totals")
    own = rows.filter("bucket < 0").select("chunk", "bucket", "doc_id", "held_out", "n_tokens", "data")
    n, v = totals.filter("chunk = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    marks = own.filter("NOT held_out").count()
    n, v = n + marks, v + (marks > 0)
    under = np.log10(n + v + 1)
    end = np.log10(marks + 1) - under

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("bucket").to_numpy(), kind="stable")
        cells, bucket = right.column("counts"), right.column("bucket").to_pylist()
        score = {bucket[i]: float(np.frombuffer(cells[i].as_py())[0]) for i in order.tolist() if bucket[i] < 0}
        count = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(cells[i].as_py(), np.int64) for i in order.tolist() if bucket[i] >= 0)])
        value, seen = np.log10(count + 1.0) - under, count > 0
        known, base = [], []
        for data in left.column("data"):
            uniq, many = np.frombuffer(data.as_py(), np.uint32).reshape(2, -1).astype(np.int64)
            known.append(int(many[seen[uniq]].sum()) + (marks > 0))
            base.append(float((value[uniq] * many).sum() + end))
        return pa.table(
            {
                "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": left.column("n_tokens"),
                "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([int(n)] * len(known), pa.int64()),
                "base_score": pa.array(base, pa.float64()), "score": pa.array([score[i] for i in left.column("bucket").to_pylist()], pa.float64()),
            }
        )

    back = totals.filter("chunk >= 0").select("chunk", "bucket", "counts").unionAll(scores)
    return own.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(joined, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every whole text, learned outside the held-out fold."""
    return scored(documents(spark, sf_dir))

"""Documents whose word-shingle sets have a Jaccard similarity of at least num/den, by universe partition.

Two sets of sizes a and b are similar enough exactly when they differ in at most H = (den-num)(a+b)/(den+num)
elements. Sizes are banded; in a band, shingle fingerprints are cut into m ranges, so that a set falls into m
segments. Pigeonhole: give each segment j a number v_j of 0, 1 or 2 with a sum of H+1 or more, then for similar sets
some segment differs in fewer than v_j elements. v = 1 is found by equal segments, v = 2 by equal segments or by
one-element deletions on either side. The smaller set probes with its own allocation, the larger is indexed.
Allocation is by cost, cheapest units first: segments of two or more shingles, then deletion neighbourhoods of small
ones, then single shingles, and empty segments, which match anything empty, last. Bands of large sets, where a few
spare segments do, index no deletions.

Segment keys go through one packed exchange. Documents that share a key are tied to the least of them and these pairs
are verified with whole sets. Where members of a family (what the pairs tie together) are then still in different
classes, their fine sketches (one byte for each of many ranges) are held against each other, in a large family those
of one key at a time: at least as many elements differ as bytes do, so pairs with more differing bytes than allowed
cannot be linked, and only the rest is verified. So every link counts, directly or through others, while groups of
copies take about as many verifications as they have members. Keys of empty or single-shingle segments, which unlike
documents share, are salted.

Defined cases: a null or empty text or one without words has no shingles, links with nothing and is its own class;
with fewer words than a shingle the whole sequence is the one shingle; rows that repeat a doc_id are one node, linked
when one of their texts is, and each keeps its row; a null doc_id gets a null class; an empty table gives an empty
result; whole texts are used; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import documents, drop, ids_and_texts, map_arrow, written
from .components import components

U = np.uint64
#: Largest set size of bands that index deletion neighbourhoods; ratio of neighbouring bands.
SMALL, RATIO = 47, 1.5
#: Documents for each bucket of the exchange, the fewest buckets, documents for each salt of a common key.
BUCKET_DOCS, BUCKETS, SALT_DOCS = 20_000, 128, 1_000_000
#: Documents compared with one other in a task's group.
STAR = 64
#: Ranges of a sketch for each element that may differ; documents of one key whose sketches are compared in a task.
FINE, BLOCK = 4, 4096
PROBE, INDEX = 1, 2


class Scheme(NamedTuple):
    """Bands of set sizes for a similarity num/den."""

    num: int
    den: int
    low: np.ndarray
    high: np.ndarray
    segments: np.ndarray
    small: np.ndarray

    def apart(self, a, b):
        """The most elements in which similar sets of these sizes differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)


def scheme(num: int, den: int, largest: int = 1 << 40) -> Scheme:
    low = [1]
    while low[-1] <= largest:  # no set is similar to one two bands up
        low.append(max(low[-1] + 1, int(low[-1] * RATIO), (low[-1] - 1) * den // num + 1))
    lows = np.array(low[:-1], np.int64)
    highs = np.array(low[1:], np.int64) - 1
    small = highs <= SMALL
    need = (den - num) * 2 * highs // (den + num) + 1
    spare = np.where(small, (need > 1).astype(np.int64), np.maximum(4, need // 8))
    return Scheme(num, den, lows, highs, need + spare, small)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Flat positions of several ranges."""
    if not len(sizes):
        return np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


def entries(values: np.ndarray, first: np.ndarray, s: Scheme, salts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set, role) of the segments and deletions that index and probe each non-empty set."""
    size = np.diff(first)
    owner = np.flatnonzero(size)
    band = np.searchsorted(s.low, size[owner], side="right") - 1
    reach = size[owner] * s.den // s.num
    up = np.flatnonzero(reach > s.high[band])
    who, level = np.concatenate([owner, owner[up]]), np.concatenate([band, band[up] + 1])
    index = np.arange(len(who)) < len(owner)
    n = size[who]
    need = s.apart(n, np.minimum(n * s.den // s.num, s.high[level])) + 1
    m = s.segments[level]

    at = _spans(first[who], n)
    task = np.repeat(np.arange(len(who)), n)
    x = values[at]
    seg = ((x >> U(32)) * m[task].astype(U) >> U(32)).astype(np.int64)
    new = np.ones(len(x), bool)
    new[1:] = (task[1:] != task[:-1]) | (seg[1:] != seg[:-1])
    start = np.flatnonzero(new)
    spread = shingles.mix(x + U(0x51ED270B))
    total = np.add.reduceat(spread, start) if len(start) else np.empty(0, U)
    counts = np.diff(np.append(start, len(x)))
    # all segments, the empty ones too
    offset = np.cumsum(m) - m
    sums, sizes = np.zeros(m.sum(), U), np.zeros(m.sum(), np.int64)
    slot = offset[task[start]] + seg[start]
    sums[slot], sizes[slot] = total, counts
    of = np.repeat(np.arange(len(who)), m)
    place = shingles.mix(level[of].astype(U) * U(1 << 40) + (np.arange(len(of)) - offset[of]).astype(U))

    # allocation: the cheapest units up to need
    two = np.flatnonzero(s.small[level[of]] & (sizes >= 2))
    unit = np.concatenate([np.arange(len(of)), two])
    cost = np.concatenate([np.select([sizes == 0, sizes == 1], [1000, 4], 1), sizes[two] + 1])
    order = np.lexsort((cost, of[unit]))
    ranked = of[unit][order]
    rank = np.arange(len(order)) - np.searchsorted(ranked, np.arange(len(who)))[ranked]
    picked = np.zeros(len(unit), bool)
    picked[order[rank < need[ranked]]] = True
    v1, v2 = picked[: len(of)], np.zeros(len(of), bool)
    v2[two[picked[len(of) :]]] = True

    keys, sets, roles = [], [], []

    def full(key: np.ndarray, slots: np.ndarray, role: np.ndarray | int, few: np.ndarray | None = None) -> None:
        keys.append(key)
        sets.append(who[of[slots]])
        roles.append(np.broadcast_to(np.asarray(role, np.uint8), len(slots)))

    equal = shingles.mix(sums + place)
    indexed = index[of]
    common = sizes <= 1
    plain = np.flatnonzero(~common & (indexed | v1))
    full(equal[plain], plain, indexed[plain] * np.uint8(INDEX) + v1[plain] * np.uint8(PROBE))
    rare = np.flatnonzero(common & indexed)
    salt = (who[of[rare]] + int(first[-1])) % salts  # any spread over the salts will do
    full(shingles.mix(equal[rare] + salt.astype(U)), rare, INDEX)
    rare = np.flatnonzero(common & v1)
    for k in range(salts):
        full(shingles.mix(equal[rare] + U(k)), rare, PROBE)
    # deletions: of index segments, met by whole probe segments, and the other way round
    gone = s.small[level[task]] & (index[task] | v2[offset[task] + seg])
    slots, sub = (offset[task] + seg)[gone], spread[gone]
    left = sums[slots] - sub
    ask = v2[slots]
    minus = index[task[gone]]
    full(shingles.mix(shingles.mix(left[minus] + place[slots[minus]]) + U(7)), slots[minus], INDEX)
    whole = np.flatnonzero(v2)
    full(shingles.mix(equal[whole] + U(7)), whole, PROBE)
    lone = sizes[slots] == 2  # the rest is one shingle: a salted key
    full(shingles.mix(left[ask & ~lone] + place[slots[ask & ~lone]]), slots[ask & ~lone], PROBE)
    for k in range(salts):
        full(shingles.mix(shingles.mix(left[ask & lone] + place[slots[ask & lone]]) + U(k)), slots[ask & lone], PROBE)
    return np.concatenate(keys), np.concatenate(sets), np.concatenate(roles)


def fingerprints(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): the shingle set of every text."""
    w = shingles.words([t.encode().lower() for t in texts], "space")
    return shingles.sets(*shingles.shingles(w, k))


def _packed(keys: np.ndarray, ids: np.ndarray, roles: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Entries by bucket: count, least id, 6 bytes of key and role, 4 or 8 bytes of id."""
    bucket = (shingles.mix(keys) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    low = ids.min() if len(ids) else 0
    narrow = len(ids) > 0 and int(ids.max()) - int(low) < 1 << 32
    body = (keys & U((1 << 46) - 1)) << U(2) | roles.astype(U)
    body, own = body[order].view(np.uint8).reshape(-1, 8)[:, :6], (ids - low)[order].astype(np.uint32 if narrow else np.uint64)
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        x, y = int(cuts[b]), int(cuts[b + 1])
        yield b, np.array([y - x, low, narrow], np.int64).tobytes() + body[x:y].tobytes() + own[x:y].tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, low, narrow = np.frombuffer(data, np.int64, 3).tolist()
    body = np.zeros((n, 8), np.uint8)
    body[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 24).reshape(n, 6)
    own = np.frombuffer(data, np.uint32 if narrow else np.uint64, n, 24 + 6 * n)
    return body.view(U)[:, 0], own.astype(np.int64) + low


def _met(body: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: pairs (least, other) to verify, and memberships (group, document) of keys with three or more."""
    none = np.empty(0, np.int64)
    if not len(body):
        return none, none, none, none
    order = np.lexsort((ids, body >> U(2)))
    key, role, ids = (body >> U(2))[order], (body & U(3))[order], ids[order]
    new = np.append(True, key[1:] != key[:-1])
    start = np.flatnonzero(new)
    both = np.bitwise_or.reduceat(role, start) == PROBE | INDEX
    group = np.cumsum(new) - 1
    fresh = new.copy()
    fresh[1:] |= ids[1:] != ids[:-1]
    several = np.add.reduceat(fresh.astype(np.int64), start)
    keep = fresh & (both & (several > 1))[group]
    group, ids = group[keep], ids[keep]
    if not len(ids):
        return none, none, none, none
    new = np.append(True, group[1:] != group[:-1])
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    pairs = np.unique(np.stack([ids[start][group], ids], 1)[~new], axis=0)
    count = np.diff(np.append(start, len(ids)))
    mark = np.add.reduceat(shingles.mix(ids.astype(U)), start)
    _, one = np.unique(mark, return_index=True)
    chosen = np.zeros(len(start), bool)
    chosen[one] = True
    chosen &= count > 2
    return pairs[:, 0], pairs[:, 1], mark.view(np.int64)[group][chosen[group]], ids[chosen[group]]


def _candidates(docs: DataFrame, k: int, s: Scheme) -> DataFrame:
    """(kind, a, b): 0 a pair to verify, 1 a sure link, 2 a membership of group a."""
    count = docs.count()
    buckets, salts = max(BUCKETS, count // BUCKET_DOCS), max(1, count // SALT_DOCS)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}  # a task's sets, so that of a group of copies one a task at most goes on
        for batch in batches:
            ids = batch.column(0).to_numpy()
            values, first = fingerprints(batch.column(1).to_pylist(), k)
            keep, copies = [], []
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                if a < b:
                    print_ = blake2b(values[a:b].tobytes(), digest_size=16).digest()
                    if print_ not in seen:
                        seen[print_] = int(ids[i])
                        keep.append(i)
                    elif ids[i] != seen[print_]:
                        copies.append((seen[print_], ids[i]))
            own = np.array(keep, np.int64)
            sizes = np.diff(first)[own]
            values, first = values[_spans(first[own], sizes)], np.append(0, np.cumsum(sizes))
            keys, sets, roles = entries(values, first, s, salts)
            rows = list(_packed(keys, ids[own][sets], roles, buckets))
            rows += [(int(ids[0]) % buckets, np.array([-len(copies)], np.int64).tobytes() + np.array(copies, np.int64).tobytes())] * bool(copies)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "packed"])

    def reduced(table: pa.Table) -> pa.Table:
        bodies, ids, sure = [], [], [np.empty((0, 2), np.int64)]
        for cell in table.column("packed"):
            data = cell.as_py()
            if np.frombuffer(data, np.int64, 1)[0] < 0:
                sure.append(np.frombuffer(data, np.int64, offset=8).reshape(-1, 2))
            else:
                body, own = _unpacked(data)
                bodies.append(body)
                ids.append(own)
        copies = np.concatenate(sure)
        a, b, g, d = _met(np.concatenate(bodies) if bodies else np.empty(0, U), np.concatenate(ids) if ids else np.empty(0, np.int64))
        kind = np.repeat([0, 1, 2], [len(a), len(copies), len(g)])
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(np.concatenate([a, copies[:, 0], g])), "b": pa.array(np.concatenate([b, copies[:, 1], d]))})

    packed = map_arrow(docs, mapped, "bucket long, packed binary")
    return packed.groupBy("bucket").applyInArrow(reduced, "kind int, a long, b long")


def sketches(values: np.ndarray, s: Scheme) -> dict[int, bytes]:
    """By band, its own one and the next if a partner can be there: a byte for each range of the universe."""
    out = {}
    if n := len(values):
        band = int(np.searchsorted(s.low, n, side="right")) - 1
        for level in (band, band + 1) if n * s.den // s.num > s.high[band] else (band,):
            m = FINE * int(s.apart(s.high[level], s.high[level]) + 1)
            at = ((values >> U(32)) * U(m) >> U(32)).astype(np.int64)
            start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            cells = np.zeros(m, np.uint8)
            cells[at[start]] = shingles.mix(np.add.reduceat(shingles.mix(values), start)) >> U(56)
            out[level] = cells.tobytes()
    return out


def _verified(docs: DataFrame, pairs: DataFrame, k: int, s: Scheme, sketch: bool) -> DataFrame:
    """(a, b, linked, n, level, cells, upper): the pairs held against each other, each document a meeting bounded groups
    of its partners; with sketches of b, and of a where b is a."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    roles = dealt.select(F.col("b").alias("doc_id"), "a", "part").unionAll(dealt.select(F.col("a").alias("doc_id"), "a", "part").distinct())
    texts = docs.join(roles, "doc_id").select("doc_id", "a", "part", "text")

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        small, large = (x, y) if len(x) < len(y) else (y, x)
        most = s.apart(len(x), len(y))
        if not len(small) or len(large) - len(small) > most:
            return False
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        return len(x) + len(y) - 2 * np.count_nonzero(large[at] == small) <= most

    def reduced(table: pa.Table) -> pa.Table:
        a = table.column("a")[0].as_py()
        values, first = fingerprints(table.column("text").to_pylist(), k)
        rows = [(d, values[x:y]) for d, x, y in zip(table.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
        mine, out = [x for d, x in rows if d == a], []
        for d, x in rows:
            cells = sketches(x, s) if sketch else {}
            level = min(cells, default=-1)
            out.append((a, d, d != a and any(alike(x, y) for y in mine), len(x), level, cells.get(level), cells.get(level + 1)))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["a", "b", "linked", "n", "level", "cells", "upper"])

    return texts.groupBy("a", "part").applyInArrow(reduced, "a long, b long, linked boolean, n long, level int, cells binary, upper binary")


def near(n: np.ndarray, level: np.ndarray, cells: list[bytes], upper: list[bytes | None], label: np.ndarray, minor: np.ndarray, side: np.ndarray, s: Scheme) -> list[tuple[int, int]]:
    """Places (x, y) of different labels, x minor, whose sketches allow a link; of different sides if there are two."""
    across = len(np.unique(side)) > 1
    out = []
    stacks: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
    for band in np.unique(level).tolist():
        own = np.flatnonzero(level == band)
        stacks[band, False] = own, np.stack([np.frombuffer(cells[i], np.uint8) for i in own])
        if len(own := np.array([i for i in own if upper[i] is not None], np.int64)):
            stacks[band, True] = own, np.stack([np.frombuffer(upper[i], np.uint8) for i in own])
    for x in np.flatnonzero(minor).tolist():
        band = int(level[x])
        for key, mine in (((band, False), cells[x]), ((band - 1, True), cells[x]), ((band + 1, False), upper[x])):
            if mine is None or key not in stacks:
                continue
            ys, table = stacks[key]
            ok = (label[ys] != label[x]) & (~minor[ys] | (ys > x))
            if across:
                ok &= side[ys] != side[x]
            most = s.apart(n[x], n[ys])
            ok &= np.abs(n[x] - n[ys]) <= most
            ys, most, table = ys[ok], most[ok], table[ok]
            if len(ys):
                apart = np.count_nonzero(table != np.frombuffer(mine, np.uint8), axis=1)
                out += [(x, y) for y in ys[apart <= most].tolist()]
    return out


def _open_pairs(members: DataFrame, classed: DataFrame, s: Scheme) -> DataFrame:
    """Pairs (a, b) of one family that are in different classes and may be linked by their sketches; classed: (node,
    label, family, n, level, cells, upper), members: (met, node) of keys."""
    large = classed.groupBy("family").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK).select("family")
    named = classed.join(large, "family", "left_anti").select(F.col("family").alias("met"), "node", "label")
    named = named.unionAll(members.join(classed.join(large, "family", "left_semi").select("node", "label"), "node").select("met", "node", "label"))
    major = named.groupBy("met", "label").agg(F.count("*").alias("n")).groupBy("met").agg(F.max(F.struct("n", "label"))["label"].alias("major"), F.count("*").alias("labels"), F.sum("n").alias("n"))
    major = major.filter("labels > 1").select("met", "major", F.ceil(F.col("n") / BLOCK).alias("parts"))
    open_ = named.join(major, "met").join(classed.drop("label", "family"), "node").withColumn("minor", F.col("label") != F.col("major"))
    # a key's documents are dealt into parts, and every two parts meet: no task has more than two of them
    own = F.pmod(F.xxhash64("node"), "parts")
    meet = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.struct(F.least(own, q).alias("low"), F.greatest(own, q).alias("high"))))
    dealt = open_.select("met", meet.alias("at"), own.alias("side"), "node", "label", "minor", "n", "level", "cells", "upper")

    def reduced(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        columns = [table.column(c).to_numpy() for c in ("n", "level")]
        found = near(*columns, table.column("cells").to_pylist(), table.column("upper").to_pylist(), table.column("label").to_numpy(), table.column("minor").to_numpy(zero_copy_only=False), table.column("side").to_numpy(), s)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        pairs = np.unique(np.sort(nodes[pairs], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return dealt.select("met", "at.low", "at.high", *dealt.columns[2:]).groupBy("met", "low", "high").applyInArrow(reduced, "a long, b long").filter("a < b").distinct()


def _classed(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs' classes."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), "label"), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    return pairs


def classes(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(node, label): documents with a link, and the smallest doc_id reachable from each."""
    docs = ids_and_texts(docs).filter("doc_id IS NOT NULL")
    s = scheme(num, den)
    found = written(_candidates(docs, k, s), "join-found")
    pairs = found.filter("kind = 0").select("a", "b").distinct()
    tested = written(_verified(docs, pairs, k, s, True), "join-tested")
    labels = components(tested.filter("linked").select("a", "b").unionAll(found.filter("kind = 1").select("a", "b")))
    apart = _classed(tested.filter("NOT linked AND a <> b").select("a", "b"), labels)
    families = components(apart).select(F.col("node").alias("label"), F.col("label").alias("family"))
    marks = tested.filter("level >= 0").dropDuplicates(["b", "n", "level", "cells", "upper"]).select(F.col("b").alias("node"), "n", "level", "cells", "upper")
    classed = marks.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(families, "label")
    members = found.filter("kind = 2").select(F.col("a").alias("met"), F.col("b").alias("node")).distinct()
    more = written(_open_pairs(members, classed, s).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "join-more")
    if more.isEmpty():
        drop(found, tested, more)
        return labels
    merged = components(_classed(_verified(docs, more, k, s, False).filter("linked").select("a", "b"), labels)).select(F.col("node").alias("label"), F.col("label").alias("least"))
    joined = labels.join(merged, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    alone = merged.join(labels, merged["label"] == labels["node"], "left_anti").select(F.col("label").alias("node"), F.col("least").alias("label"))
    out = written(joined.unionAll(alone), "join-classes")
    drop(found, tested, more)
    return out


def joined(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = fingerprints(batch.column(1).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first).astype(np.int64))], ["doc_id", "n_shingles"])

    labels = classes(docs, k, num, den)
    sizes = map_arrow(ids_and_texts(docs), sized, "doc_id long, n_shingles long")
    return sizes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents less all but the smallest doc_id of each class; rows that repeat that doc_id, or have none, stay."""
    labels = classes(docs, k, num, den).filter("node <> label").select(F.col("node").alias("doc_id"))
    return docs.join(labels, docs["doc_id"].cast("long") == labels["doc_id"], "left_anti")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked at a Jaccard similarity of 0.85 over four-word shingles."""
    return joined(documents(spark, sf_dir), 4, 85, 100)

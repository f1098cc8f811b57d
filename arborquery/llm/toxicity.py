"""Toxic passages as maximum-scoring segments of token log-odds, and document scores calibrated by extreme values.

Learning: on a bounded hash sample of labelled documents with different texts, each word and its first 4, 5 and 6
bytes get a log-odds of occurring in toxic against other documents under an informative Dirichlet prior (a share of
the overall frequencies, half a document at least); those whose z-score is large keep it, less two standard errors. A token's score is its best
such log-odds, or 0, less a constant drift, so that scores are negative on average.

Scoring: a linear scan finds all maximal segments of a text. By Karlin and Altschul, n tokens of clean text hold K n
exp(-lambda S) segments of score S or more on average; lambda follows from the score distribution of clean tokens, K
by maximum likelihood from the best segments of clean texts. A segment is significant where that number is below
SIGNIFICANT. Two sums of a document's log significances go through a logistic function fitted on the same sample, each fifth of it
as the other four fifths score it.

Defined cases: a null or empty text has no tokens and gets the score of a text without segments; without labels of
both kinds every score is 0; rows of labels that repeat an id count once, as toxic if one says so; repeated documents
get equal scores; whole texts are scanned; only doc_id and text are read of documents, doc_id for the fold alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import documents, drop, fold, ids_and_texts, map_arrow, written

U = np.uint64
#: Labelled documents that the classifier is fitted on, at most about; a larger table is sampled by a hash of the id.
SAMPLE = 20_000
FOLDS, HELD_OUT = 5, 0
PREFIXES = (4, 5, 6)
#: Parts of the sample for calibration, and counts packed into a number.
PARTS, LANES = 5, 3
PRIOR, LEAST_Z, CAUTION, DRIFT, SIGNIFICANT = 10.0, 3.0, 2.0, 0.5, 0.01
"""Half-documents of prior, least z-score, standard errors taken off a log-odds, cost of a token, expected number."""


class Model(NamedTuple):
    """Feature fingerprints in order with their log-odds, the statistics of clean text, and the logistic weights."""

    keys: np.ndarray
    odds: np.ndarray
    lam: float
    k: float
    weights: tuple[float, float, float] | None


def maximal_segments(items: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence of scored runs (start, end, score), in linear time."""
    found: list[list] = []  # start, end, sum before, sum after
    total = 0.0
    for start, end, score in items:
        before, total = total, total + score
        if score <= 0:
            continue
        new = [start, end, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new.append(j)
                found.append(new)
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in found]


def _features(texts: list[str]) -> tuple[shingles.Words, list[np.ndarray]]:
    w = shingles.words([t.lower().encode() for t in texts], "letters", PREFIXES)
    return w, [w.hashes, *w.parts]  # a part is 0 where the word is not longer


def _scan(texts: list[str], model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]], list[np.ndarray]]:
    """Tokens of each text, its maximal segments, and the scores of its tokens that have any feature."""
    w, features = _features(texts)
    best = {}
    if len(model.keys):
        bits = np.zeros(1 << 20, bool)
        low = U((1 << 20) - 1)
        bits[model.keys & low] = True
        for h in features:
            at = np.flatnonzero(bits[h & low])
            place = np.minimum(np.searchsorted(model.keys, h[at]), len(model.keys) - 1)
            sure = model.keys[place] == h[at]
            for i, v in zip(at[sure].tolist(), model.odds[place[sure]].tolist(), strict=True):
                old = best.get(i)
                if old is None or (v > old if v > 0 or old > 0 else v < old):
                    best[i] = v
    at = np.array(sorted(best), np.int64)
    value = np.array([best[i] for i in at.tolist()]) - DRIFT
    cuts = np.searchsorted(at, w.first)
    segments, events = [], []
    for d, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        items, pos = [], 0
        for i, v in zip((at[a:b] - w.first[d]).tolist(), value[a:b].tolist(), strict=True):
            if i > pos:
                items.append((pos, i, -DRIFT * (i - pos)))
            items.append((i, i + 1, v))
            pos = i + 1
        segments.append(maximal_segments(items))
        events.append(value[a:b])
    return np.diff(w.first), segments, events


def _signals(n: int, segments: list[tuple[int, int, float]], model: Model) -> tuple[float, float]:
    """The best segment's log significance, and the logarithm of the sum of the positive ones."""
    base = math.log(max(model.k * max(n, 1), 1e-9))
    each = [model.lam * s[2] - base for s in segments]
    return max([*each, min(-base, 0.0)]), math.log1p(sum(x for x in each if x > 0))


def _probability(x: tuple[float, float], model: Model) -> float:
    if model.weights is None:
        return 0.0
    z = model.weights[0] + model.weights[1] * x[0] + model.weights[2] * x[1]
    return 1 / (1 + math.exp(-min(max(z, -40.0), 40.0)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of an intercept and the columns, lightly regularised, by Newton steps that are halved until they help."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, ridge = np.zeros(z.shape[1]), np.array([1e-6, *[1e-4] * (z.shape[1] - 1)]) * len(x)

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((np.logaddexp(0, m) - y * m).sum() + 0.5 * (ridge * w * w).sum())

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (y - p) - ridge * w)
        size = 1.0
        while (new := loss(w + size * step)) > now and size > 1e-6:
            size /= 2
        if not new < now - 1e-9 * abs(now):
            break
        w, now = w + size * step, new
    slope = w[1:] / scale
    return (float(w[0] - (slope * mean).sum()), *slope.tolist())


def _lambda(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p_i exp(lambda s_i) = 1, for a negative mean and a positive score."""
    p = counts / counts.sum()
    low, high = 1e-6, 1e-6
    value = lambda x: float((p * np.exp(x * scores)).sum()) - 1
    while value(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): a bounded hash sample of the labelled training documents, equal texts once."""
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    n = marks.count()
    if n > SAMPLE:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < SAMPLE * 1_000_000 // n)
    # at most about SAMPLE rows of two numbers, by the count above: broadcast, so that texts are not moved
    both = ids_and_texts(docs).join(F.broadcast(marks), "doc_id")
    return both.groupBy(F.md5(F.col("text").cast("binary")).alias("same")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Log-odds, statistics and calibration from the labelled documents outside the held-out fold."""
    rows = written(sample(docs, labels).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int")), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(1).to_numpy().astype(np.int64) * PARTS + batch.column(2).to_numpy()
            w, features = _features(batch.column(0).to_pylist())
            text = np.tile(w.text, len(features))
            every = np.concatenate(features)
            text, every = text[every > 0], every[every > 0]
            _, once = np.unique(every ^ shingles.mix(text.astype(U) + U(1)), return_index=True)  # each feature of a text
            h, at = np.unique(every[once], return_inverse=True)
            table = np.bincount(at * (2 * PARTS) + cell[text[once]], minlength=len(h) * 2 * PARTS).reshape(-1, 2 * PARTS)
            table = np.column_stack([table, np.zeros((len(h), LANES * len(packs) - 2 * PARTS), np.int64)]).reshape(len(h), len(packs), LANES)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array((c << 16 * np.arange(LANES)).sum(1)) for c in table.transpose(1, 0, 2))], ["h", *packs])

    # counts of up to SAMPLE documents take 16 bits each, three in a number, so that sums do not run over
    cells = [f"n{i}" for i in range(2 * PARTS)]
    packs = [f"p{i}" for i in range(-(-2 * PARTS // LANES))]
    none = Model(np.empty(0, U), np.empty(0), 1.0, 1.0, None)
    sizes = np.zeros((2, PARTS), np.int64)
    for toxic, part, n in rows.groupBy("toxic", "part").count().collect():
        sizes[min(toxic, 1), part] += n
    if not sizes.sum(1).all():
        return none
    summed = map_arrow(rows, count, ", ".join(["h long", *(f"{c} long" for c in packs)])).groupBy("h").agg(*(F.sum(c).alias(c) for c in packs))
    counts = summed.select("h", *(F.shiftrightunsigned(packs[i // LANES], 16 * (i % LANES)).bitwiseAND(0xFFFF).alias(c) for i, c in enumerate(cells)))

    def odds(clean, toxic, n_c, n_t, log, sqrt):
        """(log-odds, z) of features from the documents of either kind that have them."""
        prior = 0.5 + PRIOR * (toxic + clean) / float(n_t + n_c)
        a, b = toxic + prior, clean + prior
        value = log(a / (n_t + PRIOR + 1 - a)) - log(b / (n_c + PRIOR + 1 - b))
        return value, value / sqrt(1 / a + 1 / b)

    # the whole sample, and the sample without each part: a part is calibrated on what the others teach
    total = sizes.sum(1)
    views = [(None, total), *((p, total - sizes[:, p]) for p in range(PARTS))]
    columns = lambda row, p: [sum(row[cells[k * PARTS + i]] for i in range(PARTS) if i != p) for k in (0, 1)]
    passes = [F.abs(odds(*columns(counts, p), float(n[0]), float(n[1]), F.log, F.sqrt)[1]) >= LEAST_Z for p, n in views]
    table = counts.filter("+".join(cells) + " >= 3").filter(F.array_contains(F.array(*passes), True)).toArrow().to_pandas()
    order = np.argsort(table["h"].to_numpy(np.int64).view(U))
    keys, models = table["h"].to_numpy(np.int64).view(U)[order], []
    for p, n in views:
        value, z = odds(*(np.asarray(c, float)[order] for c in columns(table, p)), float(n[0]), float(n[1]), np.log, np.sqrt)
        z = np.where(z == 0, 1e-9, z)
        models.append(none._replace(keys=keys[np.abs(z) >= LEAST_Z], odds=(value * (1 - CAUTION / np.abs(z)))[np.abs(z) >= LEAST_Z]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, part = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                toxic = batch.column(1).to_numpy()[own]
                n, segments, events = _scan([texts[i] for i in own], models[1 + p])
                # then, as rows of kind -1, how often clean tokens have which score
                values, many = np.unique(np.round(np.concatenate([np.empty(0), *(e for e, x in zip(events, toxic, strict=True) if not x)]), 2), return_counts=True)
                kept = [[s[2] for s in x] for x in segments] + [[v] for v in values.tolist()]
                columns = [pa.array(np.append(toxic, np.full(len(values), -1)), pa.int32()), pa.array(np.append(n, many), pa.int64()), pa.array(kept, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["toxic", "n", "segments"])

    seen = map_arrow(rows, scan, "toxic int, n long, segments array<double>").toArrow().to_pandas()
    events, seen = seen[seen["toxic"] < 0], seen[seen["toxic"] >= 0]
    clean = seen[seen["toxic"] == 0]
    values = np.array([float(models[0].odds.max(initial=1.0)) - DRIFT, *(v[0] for v in events["segments"]), -DRIFT])
    many = np.array([1, *events["n"], max(1, int(clean["n"].sum()) - int(events["n"].sum()))])
    lam = _lambda(values, many)
    best = np.array([max(s, default=0.0) for s in clean["segments"]])
    k = len(clean) / float((np.maximum(clean["n"].to_numpy(), 1) * np.exp(-lam * best)).sum())
    model = models[0]._replace(lam=lam, k=k)
    drop(rows)
    x = np.array([_signals(n, [(0, 0, v) for v in s], model) for n, s in zip(seen["n"], seen["segments"], strict=True)])
    return model._replace(weights=_logistic(x, seen["toxic"].to_numpy(float)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_passages, passages): passages as first token:token after the last, the significant ones in order."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            n, segments, _ = _scan(batch.column(1).to_pylist(), model)
            scores = [_probability(_signals(m, s, model), model) for m, s in zip(n.tolist(), segments, strict=True)]
            good = [[f"{a}:{b}" for a, b, v in s if model.k * m * math.exp(-model.lam * v) < SIGNIFICANT] for m, s in zip(n.tolist(), segments, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(map(len, good), pa.int64()), pa.array(map(",".join, good), pa.string())], ["doc_id", "score", "n_passages", "passages"]
            )

    return map_arrow(ids_and_texts(docs), run, "doc_id long, score double, n_passages long, passages string")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents scored below 0.5, with all their columns."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            n, segments, _ = _scan([t or "" for t in batch.column(place).to_pylist()], model)
            yield batch.filter(pa.array([_probability(_signals(m, s, model), model) < 0.5 for m, s in zip(n.tolist(), segments, strict=True)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the labels outside the held-out fold."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "n_passages", "passages")

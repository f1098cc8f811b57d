"""Benchmark items found inside documents: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by the size q of their shingle set. In each partition an item's sketch is its m smallest
shingle fingerprints, m being one more than the most shingles that an item of the partition may lack at the asked
containment. So a document that contains enough of an item has at least one shingle of its sketch: no find is lost. A
document too short to hold enough shingles is not a candidate for a partition. (A MinHash sketch of a whole long
document would miss short items, their Jaccard similarity being near 0; so document shingles are held against the
items' minima instead.) Candidates are verified by counting the item's shingles, as words, in the document.

The benchmark is a stated query set: it is sent to the workers in blocks of bounded items and bytes, however large.

Defined cases: words are maximal runs of letters, digits and non-ASCII characters, ASCII and Unicode case folded by
lower(); an item of fewer than five words is one shingle of all its words; items and documents that are null, empty
or without words match nothing; repeated items each match; an empty table on either side gives an empty result;
whole texts are searched; other columns are carried by clean() and not read otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import documents, ids_and_texts, map_arrow

SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
"""Words of a shingle; least containment, 4/5."""
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
"""Items and text bytes of one broadcast block."""
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _folded(text: str | None) -> bytes:
    return (text or "").lower().encode()


class Sketches:
    """Search structure over one block of items."""

    def __init__(self, items: list[tuple[int, str]], k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR):
        self.num, self.den = num, den
        self.ids: list[int] = []
        self.sets: list[set[bytes]] = []
        self.width: list[int] = []
        found: dict[int, dict[int, list[int]]] = {}
        for item, text in items:
            tokens = _WORD.findall(_folded(text))
            if not tokens:
                continue
            width = min(k, len(tokens))
            mine = {b" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}
            band = len(mine).bit_length()  # sizes from 2**(band-1) to 2**band - 1
            largest = (1 << band) - 1
            m = largest - -(-num * largest // den) + 1
            sketch = np.sort(self._prints(mine, width))[:m]
            for h in sketch.tolist():
                found.setdefault(width, {}).setdefault(h, []).append(len(self.ids))
            self.ids.append(item)
            self.sets.append(mine)
            self.width.append(width)
        self.need = [-(-num * len(s) // den) for s in self.sets]
        self.tables = {}
        for width, posts in found.items():
            keys = np.array(sorted(posts), np.uint64)
            bits = np.zeros(1 << 22, bool)
            bits[keys & np.uint64((1 << 22) - 1)] = True
            self.tables[width] = (keys, bits, [posts[h] for h in keys.tolist()], min(self.need[i] for v in posts.values() for i in v))

    @staticmethod
    def _prints(mine: set[bytes], width: int) -> np.ndarray:
        w = shingles.words(list(mine), "alnum")
        return shingles.shingles(w, width)[0]

    def hits(self, texts: list[bytes]) -> list[dict[int, int]]:
        """For each lower-cased text: item's place -> its shingles in the text, if enough."""
        candidates: list[set[int]] = [set() for _ in texts]
        if self.tables:
            w = shingles.words(texts, "alnum")
            for width, (keys, bits, posts, least) in self.tables.items():
                flat, first = shingles.shingles(w, width, whole=False)
                at = np.flatnonzero(bits[flat & np.uint64((1 << 22) - 1)])
                if not len(at):
                    continue
                place = np.minimum(np.searchsorted(keys, flat[at]), len(keys) - 1)
                sure = keys[place] == flat[at]
                doc = np.searchsorted(first, at[sure], side="right") - 1
                for d, p in np.unique(np.stack([doc, place[sure]], 1), axis=0).tolist():
                    size = first[d + 1] - first[d]
                    if size >= least:
                        candidates[d].update(i for i in posts[p] if size >= self.need[i])
        return [self._verified(t, c) if c else {} for t, c in zip(texts, candidates, strict=True)]

    def _verified(self, text: bytes, items: set[int]) -> dict[int, int]:
        tokens, out, seen = _WORD.findall(text), {}, {}
        for i in items:
            width = self.width[i]
            if width not in seen:
                seen[width] = {b" ".join(tokens[j : j + width]) for j in range(len(tokens) - width + 1)}
            common = len(self.sets[i] & seen[width])
            if common >= self.need[i]:
                out[i] = common
        return out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of bounded size."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for part in range(parts):
        rows = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield [(r.item_id, r.text) for r in rows.collect()]


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_common, containment) of every item found in a document."""
    docs = ids_and_texts(docs)
    out = None
    for items in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = Sketches(sent.value)
            for batch in batches:
                found = search.hits([_folded(t) for t in batch.column(1).to_pylist()])
                rows = [(d, search.ids[i], len(search.sets[i]), n) for d, f in zip(batch.column(0).to_pylist(), found, strict=True) for i, n in sorted(f.items())]
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols), pa.array([n / q for q, n in zip(cols[2], cols[3], strict=True)], pa.float64())],
                    ["doc_id", "item_id", "n_item", "n_common", "containment"],
                )

        part = map_arrow(docs, run, "doc_id long, item_id long, n_item long, n_common long, containment double")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    place = docs.columns.index("text")
    for items in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = Sketches(sent.value)
            for batch in batches:
                found = search.hits([_folded(t) for t in batch.column(place).to_pylist()])
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every whole text of documents."""
    return contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

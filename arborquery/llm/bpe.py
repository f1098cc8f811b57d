"""Byte-level BPE by a monoid of token sequences.

encode(a + b) is a function of encode(a) and encode(b) alone, so a piece is encoded by halves that are joined up a
tree. A join re-encodes a window around the boundary and grows it until the tokens outside are proved stable: a
sequence is the encoding of its bytes exactly when every two neighbours are the encoding of theirs, so it is enough
that the window's first and last token get on with the token before and after. decode() concatenates up a tree.

Defined cases: a null or empty text has no tokens and decodes to nothing; equal texts give equal ids; whole texts
are encoded, however long, and a piece of n bytes takes O(n log² n) at most; an empty table gives an empty result; other
columns are not read. Lone surrogates cannot occur in Spark's UTF-8 strings.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, ids_and_texts, map_arrow

#: Distinct pieces whose ids a worker remembers in each of two generations, and the longest such piece; pairs of tokens
#: and short halves remembered, and the longest such half.
CACHE_PIECES, CACHE_CHARS, CACHE_PARTS, HALF_BYTES = 100_000, 64, 150_000, 5


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """Encoder and decoder over byte-level merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.split = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], list[int]] = {}
        self.halves: dict[bytes, list[int]] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals: for windows of a few tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """The same by a heap over linked parts: O(n log n)."""
        n = len(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or get(parts[i] + parts[j]) != r:
                continue  # one of the two has been merged meanwhile
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(parts[i] + parts[k])) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(parts[h] + parts[i])) is not None:
                heappush(heap, (r, h))
        return [self.ranks[p] for p in parts if p is not None]

    def pair(self, a: int, b: int) -> list[int]:
        """The encoding of two tokens' bytes, remembered."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHE_PARTS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b])
        return found

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the encoding of their bytes."""
        return self.pair(a, b) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes, from theirs."""
        if not left or not right:
            return left or right
        i = j = 1
        window = self.pair(left[-1], right[0])
        while True:
            more_left = i < len(left) and not self.stable(left[-i - 1], window[0])
            more_right = j < len(right) and not self.stable(window[-1], right[j])
            if not more_left and not more_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = min(len(left), i << more_left), min(len(right), j << more_right)
            data = b"".join([self.bytes_of[t] for t in chain(left[-i:], right[:j])])
            window = self.merge(data) if len(data) <= 48 else self.merge_long(data)

    def encode_bytes(self, data: bytes) -> list[int]:
        """One piece: halves are encoded and joined."""
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        if len(data) > HALF_BYTES:
            half = len(data) // 2
            return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))
        found = self.halves.get(data)
        if found is None:
            if len(self.halves) >= CACHE_PARTS:
                self.halves.clear()
            half = len(data) // 2
            found = self.halves[data] = self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))
        return found

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or tuple(self.encode_bytes(piece.encode()))
        if len(piece) <= CACHE_CHARS:
            if len(self.known) >= CACHE_PIECES:  # what is still in use moves on to the new generation
                self.known, self.older = {}, self.known
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text, piece by piece."""
        slow = self.encode_piece
        out: list[int] = []
        pieces = self.split(text)
        for a in range(0, len(pieces), 50_000):  # a new generation is looked up from the next part on
            known = self.known.get
            out += chain.from_iterable([known(p) or slow(p) for p in pieces[a : a + 50_000]])
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids: halves up a tree of concatenations."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def load(path: str, pattern: str) -> Bpe:
    """The worker's encoder: tables are read once and kept."""
    return Bpe(read_ranks(path), pattern)


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary): ids of every text, and the bytes these ids decode to."""
    path, pattern = path or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"]
            )

    return map_arrow(ids_and_texts(docs), run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, without moving ids out of the worker."""
    path, pattern = path or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        names = [str(i) for i in range(len(bpe.bytes_of))]
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids))
                a.append(sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                b.append(sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(ids_and_texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    return digests(documents(spark, sf_dir))

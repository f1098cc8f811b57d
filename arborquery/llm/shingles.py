"""Word and shingle fingerprints of many texts at once, by vector operations over their bytes.

A word's fingerprint starts from its length and takes in eight bytes at a time, each step a bijection of what came
before and of the bytes, mixed; so words of up to eight bytes and one length never share one. A shingle's fingerprint
combines those of its words in order. Texts shorter than a shingle have one shingle, all their words. No structure of
texts makes others collide: two different shingles share a fingerprint with probability about 2**-64.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np

U = np.uint64
#: Bytes hashed in one go.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Masks of the first so many of eight bytes; words longer than LONG bytes are hashed one by one.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_ODD, LONG = 0x9E3779B97F4A7C15, 256


@lru_cache(None)
def classes(kind: str) -> np.ndarray:
    """Which bytes belong to words: all but white space, letters and digits, or letters; non-ASCII bytes always do."""
    table = np.ones(256, bool)
    if kind == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:128] = False
        table[ord("a") : ord("z") + 1] = True
        table[ord("0") : ord("9") + 1] = kind == "alnum"
    return table


def cuts(data: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inside, starts, ends) of the words of a buffer that begins and ends between words."""
    inside = classes(kind)[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return inside, edges[::2], edges[1::2]


class Words(NamedTuple):
    """Flat words of several texts: fingerprints, the text each is in, and each text's first word."""

    hashes: np.ndarray
    text: np.ndarray
    first: np.ndarray  # one more than texts
    parts: list[np.ndarray]  # fingerprints of the words' first bytes, one array for each length asked for, 0 for words not longer


def words(texts: list[bytes], kind: str, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of lower-cased UTF-8 texts; prefixes: also fingerprint the first so many bytes of each longer word."""
    hashes, counts, parts = [], np.zeros(len(texts), np.int64), [[] for _ in prefixes]
    at = 0
    while at < len(texts):  # blocks of whole texts, one at least
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < BLOCK):
            size += len(texts[end]) + 1
            end += 1
        h, n, p = _block(texts[at:end], kind, prefixes)
        hashes.append(h)
        counts[at:end] = n
        for mine, new in zip(parts, p, strict=True):
            mine.append(new)
        at = end
    joined = lambda xs: np.concatenate(xs) if xs else np.empty(0, U)
    first = np.concatenate([[0], np.cumsum(counts)])
    return Words(joined(hashes), np.repeat(np.arange(len(texts)), counts), first, [joined(p) for p in parts])


def _block(texts: list[bytes], kind: str, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    buffer = b"\n".join([b"", *texts, b"\0" * 8])
    data = np.frombuffer(buffer, np.uint8)[: len(buffer) - 8]
    _, starts, ends = cuts(data, kind)
    eight = np.ndarray((len(data),), "<u8", buffer, strides=(1,))  # the 8 bytes from each place on
    counts = np.diff(np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)])))
    lengths = ends - starts
    begin = eight[starts]
    hashes = mix((begin & _FIRST[np.minimum(lengths, 8)]) + lengths.astype(U) * U(_ODD))
    left, at = np.flatnonzero((lengths > 8) & (lengths <= LONG)), 8
    while len(left):
        part = eight[starts[left] + at] & _FIRST[np.minimum(lengths[left] - at, 8)]
        hashes[left] = mix(hashes[left] * U(_ODD) ^ part)
        at += 8
        left = left[lengths[left] > at]
    for i in np.flatnonzero(lengths > LONG).tolist():
        hashes[i] = int.from_bytes(blake2b(buffer[starts[i] : ends[i]], digest_size=8).digest(), "little")
    parts = [np.where(lengths > p, mix((begin & _FIRST[p]) + U(0x1000 + p)), U(0)) for p in prefixes]
    return hashes, counts, parts


_STEP = [pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)]


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of every k neighbours."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, U)
    for j in range(k):
        out += hashes[j : j + n] * U(_STEP[j])
    return mix(out + U(k))


def shingles(w: Words, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, first): the k-word shingles of each text in order, repeated ones too; whole: shorter texts have one."""
    count = np.diff(w.first)
    flat = combine(w.hashes, k)
    keep = np.ones(len(flat), bool)
    for j in range(1, k):  # those that run into the next text
        at = w.first[1:] - j
        at = at[(at >= 0) & (at < len(keep))]
        keep[at] = False
    sizes = np.maximum(0, count - k + 1)
    flat = flat[keep]
    short = np.flatnonzero((count > 0) & (count < k)) if whole else ()
    first = np.concatenate([[0], np.cumsum(sizes)])
    if len(short):
        own = np.array([combine(w.hashes[w.first[i] : w.first[i + 1]], int(count[i]))[0] for i in short], U)
        flat = np.insert(flat, first[short], own)
        sizes[short] = 1
        first = np.concatenate([[0], np.cumsum(sizes)])
    return flat, first


def sets(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): each text's distinct shingles in ascending order."""
    flat = flat.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    np.not_equal(flat[1:], flat[:-1], out=new[1:])
    new[first[:-1][first[:-1] < len(flat)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return flat[new], kept[first]

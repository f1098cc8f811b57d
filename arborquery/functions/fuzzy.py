"""Partial similarity of a needle and a text, 0 to 100: the best 200 LCS / (needle + window) over the text's windows.

Windows have the needle's length; at the text's ends also shorter ones. Where the text is shorter, it is the needle.
similarity() is an expression inside the engine for names; similarity_udf() goes over all windows of long contents at
once, by vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Characters of a needle that fit into the expression's machine word.
LONGEST = 62
#: Characters of texts whose windows are held together.
PART = 1 << 20


def _tables(needle: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(needle):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def similarity(text: Column, needle: str) -> Column:
    """The score of a short text, by bit-parallel subsequences. Null for null; needles of up to 62 characters."""
    n = len(needle)
    if not 0 < n <= LONGEST:
        raise ValueError("the needle must have 1 to 62 characters")
    full = (1 << n) - 1
    masks = F.create_map(*(F.lit(x) for c, m in _tables(needle).items() for x in (c, m))).cast("map<string,bigint>")

    def common(window: Column, mask: Column, shift: Column) -> Column:
        """The longest common subsequence of a window of text and the needle's characters under a mask."""

        def step(s: Column, c: Column) -> Column:
            own = F.expr("0L") if c is None else F.coalesce(F.try_element_at(masks, c), F.lit(0).cast("long"))
            u = s.bitwiseAND(own)
            return ((s + u).bitwiseOR(s - u)).bitwiseAND(mask)

        rest = F.aggregate(F.split(window, ""), mask, step)
        return F.bit_count(mask) - F.bit_count(rest)

    length = F.length(text)
    every = F.lit(full).cast("long")

    def at(s: Column) -> Column:
        lo = F.greatest(s, F.lit(0))
        size = F.least(s + n, length) - lo
        return 200.0 * common(F.substring(text, lo + 1, size), every, s) / (size + n)

    def within(s: Column) -> Column:
        """A window of the needle, for a text shorter than it."""
        lo = F.greatest(s, F.lit(0))
        size = F.least(s + length, F.lit(n)) - lo
        ones = F.expr("shiftleft(1L, 62)") - 1
        mask = F.call_function("shiftright", ones, F.lit(62) - size)
        mask = F.call_function("shiftleft", mask, lo)
        return 200.0 * common(text, mask, s) / (size + length)

    long = F.array_max(F.transform(F.sequence(F.lit(1 - n), length - 1), at))
    short = F.array_max(F.transform(F.sequence(1 - length, F.lit(n - 1)), within))
    return F.when(length == 0, F.lit(0.0)).when(length >= n, long).otherwise(short)


def _runs(texts: list[str], needle: str) -> np.ndarray:
    """The scores of texts that are as long as the needle at least, over all their windows at once."""
    n, words = len(needle), -(-len(needle) // 64)
    masks = _tables(needle)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    # each text between n places that no character of the needle meets, so that windows at its ends are shorter
    pad = "\0" * n
    codes = np.frombuffer((pad + pad.join(texts) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(lengths + n) - lengths
    inside = np.zeros(len(codes), bool)
    for b, m in zip(begin.tolist(), lengths.tolist(), strict=True):
        inside[b : b + m] = True
    own = np.zeros((words, len(codes)), np.uint64)
    for c, m in masks.items():
        at = np.flatnonzero((codes == ord(c)) & inside)
        for w in range(words):
            own[w, at] = m >> 64 * w & (1 << 64) - 1
    count = len(codes) - n + 1
    full = [(1 << min(64, n - 64 * w)) - 1 for w in range(words)]
    state = [np.full(count, f, np.uint64) for f in full]
    for k in range(n):
        carry = None
        for w, s in enumerate(state):
            u = s & own[w, k : k + count]
            total = s + u
            over = total < s
            if carry is not None:
                total += carry
                over |= total < carry
            state[w] = (total | (s - u)) & np.uint64(full[w])
            carry = over.astype(np.uint64)
    lcs = n - sum(np.bitwise_count(s).astype(np.int64) for s in state)
    # the windows that begin from n - 1 before a text to its last character
    sizes = lengths + n - 1
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + 1 - n
    text_size = np.repeat(lengths, sizes)
    size = np.minimum(place + n, text_size) - np.maximum(place, 0)
    score = 200.0 * lcs[place + np.repeat(begin, sizes)] / (size + n)
    return np.maximum.reduceat(score, ends - sizes)


def partial_ratios(texts: list[str | None], needle: str) -> list[float | None]:
    """The scores of texts; null for null. Texts go together, in parts of bounded length."""
    out: list[float | None] = [None if t is None else 0.0 for t in texts]
    part: list[int] = []
    size = 0

    def done() -> None:
        nonlocal size
        if part:
            for i, x in zip(part, _runs([texts[i] for i in part], needle).tolist(), strict=True):
                out[i] = x
        part.clear()
        size = 0

    for i, t in enumerate(texts):
        if not t or not needle:
            continue
        if len(t) < len(needle):  # windows are the needle's
            out[i] = float(_runs([needle], t)[0])
            continue
        part.append(i)
        size += len(t) + len(needle)
        if size >= PART:
            done()
    done()
    return out


def partial_ratio(text: str, needle: str) -> float:
    """The score of one text."""
    return partial_ratios([text], needle)[0]


def similarity_udf(needle: str):
    """The score as a vectorized function of a text column, for long texts and long needles."""
    if session := SparkSession.getActiveSession():
        ship(session)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(partial_ratios([None if t is None else str(t) for t in batch], needle), dtype="Float64")

    return score

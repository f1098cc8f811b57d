"""An inverted index from trigrams of names to entries.

Postings have one row for each distinct trigram of a name, ASCII case folded, so they are exact: an index search gives
the same rows as a scan, the predicate being checked again on what the index proposes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import glob
from ..plans import nodes as n
from ..plans.rewrite import flatten, optimize


def trigrams(text: str) -> list[str]:
    """Distinct folded trigrams of a text."""
    folded = glob.fold_literal(text)
    return list(dict.fromkeys(folded[i : i + 3] for i in range(len(folded) - 2)))


def glob_trigrams(pattern: str) -> list[str]:
    """Those of a pattern's literal runs: any match has them all."""
    return list(dict.fromkeys(t for kind, text in glob.pieces(pattern) if kind == "text" for t in trigrams(text)))


def path_trigrams(pattern: str) -> list[str]:
    """For a whole-path pattern: those of the last component that has any, since names are indexed, not paths.

    A wildcard may stand for separators, so only a literal run within one component speaks for a name: the run after
    the last separator belongs to the basename when nothing but literals follow it.
    """
    found = glob.pieces(pattern)
    tail: list[str] = []
    for kind, text in reversed(found):
        if kind == "text" and "/" in text:
            tail.append(text.rpartition("/")[2])
            return list(dict.fromkeys(t for x in tail for t in trigrams(x)))
        if kind != "text":
            return list(dict.fromkeys(t for x in tail for t in trigrams(x)))
        tail.append(text)
    return list(dict.fromkeys(t for x in tail for t in trigrams(x)))


def trigram_column(name: Column) -> Column:
    """The distinct folded trigrams of a name."""
    folded = glob.fold_ascii(name)
    each = F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda i: F.substring(folded, i, F.lit(3)))
    return F.when(F.length(name) >= 3, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def postings(entries: DataFrame, name: str = "basename", key: str = "entry_id") -> DataFrame:
    """(trigram, entry_id) of every entry; written sorted by trigram, a scan skips to what it needs."""
    return entries.select(F.col(key).alias("entry_id"), F.explode(trigram_column(F.col(name))).alias("trigram")).select("trigram", "entry_id")


def candidates(index: DataFrame, wanted: list[str], least: int | None = None) -> DataFrame:
    """entry_ids that have at least so many of the trigrams (all by default)."""
    least = len(wanted) if least is None else least
    hits = index.filter(F.col("trigram").isin(*wanted))
    return hits.groupBy("entry_id").agg(F.count("*").alias("hits")).filter(F.col("hits") >= least).select("entry_id")


def intersection(index: DataFrame, wanted: list[str]) -> DataFrame:
    """The same for all of them, by one semi join after another: for few, rare trigrams."""
    lists = [index.filter(F.col("trigram") == t).select("entry_id") for t in wanted]
    return reduce(lambda a, b: a.join(b, "entry_id", "left_semi"), lists)


def fuzzy_bound(needle: str, cutoff: float) -> int:
    """A number of the needle's trigrams that any name above the cutoff has; 0 if none must be there.

    A window of length w scores above the cutoff only if its common subsequence c is longer than cutoff/200 (n + w), so
    n - c of the needle's characters are missing and w - c of the window's are in between; each spoils at most three
    trigrams. Windows are n long at most. A name shorter than the needle, by two at most, is held against windows of the
    needle instead: what of the needle is outside spoils one trigram a character.
    """
    size, own = len(needle), len(trigrams(needle))
    kept = []
    for length in range(max(1, size - 2), size + 1):
        for window in range(1, length + 1):
            common = int(cutoff / 200 * (length + window)) + 1
            if common <= window:
                outside = size - window if length < size else 0
                kept.append(own - outside - 3 * (length - common + window - common))
    return max(0, min(kept, default=0))


def needed(node: n.Expr) -> tuple[list[str], int]:
    """(trigrams, how many of them) that an entry must have for a predicate to hold; none if the index cannot help."""
    if isinstance(node, n.Glob) and node.target != "link":
        wanted = glob_trigrams(node.pattern) if node.target == "basename" else path_trigrams(node.pattern)
        return wanted, len(wanted)
    if isinstance(node, n.Contains) and node.target == "basename":
        wanted = trigrams(node.needle)
        return wanted, len(wanted)
    if isinstance(node, n.Fuzzy) and node.target == "basename":
        return trigrams(node.needle), fuzzy_bound(node.needle, node.cutoff)
    return [], 0


def proposal(index: DataFrame, tree: n.Expr) -> DataFrame | None:
    """entry_ids that have every match of a tree, or None where only a scan will do.

    Of a chain of conjuncts the one with the most trigrams speaks; of alternatives all have to, and what they propose is
    put together. Nothing that looks at other entries, or is negated, speaks; pruning, quitting and acting depend on
    what is met before.
    """
    if any(x.barrier for x in tree.walk()):
        return None
    wanted = _wanted(optimize(tree))
    if wanted is None:
        return None
    several = [candidates(index, list(t), least) for t, least in dict.fromkeys(wanted)] or [index.filter(F.lit(False)).select("entry_id")]
    return several[0] if len(several) == 1 else reduce(DataFrame.unionAll, several)


def _wanted(tree: n.Expr) -> list[tuple[tuple[str, ...], int]] | None:
    """Lookups (trigrams, how many of them) that together find every match."""
    if isinstance(tree, n.And):
        found = [x for x in map(_wanted, flatten(tree, n.And)) if x is not None]
        return max(found, key=lambda x: (-len(x), min((least for _, least in x), default=0)), default=None)
    if isinstance(tree, n.Or):
        found = [_wanted(x) for x in flatten(tree, n.Or)]
        return None if None in found else sum(found, [])
    if isinstance(tree, n.Const) and not tree.value:
        return []
    wanted, least = needed(tree)
    return [(tuple(wanted), least)] if least else None


def indexed(entries: DataFrame, index: DataFrame, tree: n.Expr) -> DataFrame | None:
    """The entries that the index proposes for a tree, or None where only a scan will do."""
    found = proposal(index, tree)
    return None if found is None else entries.join(found, "entry_id", "left_semi")

import fnmatch
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborquery.functions import fuzzy, glob


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(list("ab*?[]!-.c")), max_size=8).map("".join), st.text("abc.-!\n", max_size=6))
def test_globs_are_those_of_the_shell(pattern, text):
    if re.search(r"\[[^\]]*[&~|^\[]", pattern) or re.search(r"\[[!]?[^\]]*$", pattern) and "[]" in pattern or "--" in pattern or re.search(r"\[!?\]", pattern):
        return  # sets on which the two dialects are not defined alike
    ours = glob.to_regex(pattern).replace(r"\z", r"\Z")
    assert bool(re.match(ours, text)) == fnmatch.fnmatchcase(text, pattern)


def test_globs_as_columns(spark):
    values = ["", "a", "ab", "abc", "a.b", "A", "a*c", "x/abc", None, "a\nb"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for pattern in ("", "*", "a*", "*b", "*b*", "a?", "[a-b]*", "[!a]*", r"a\*c", "ab", "*a*c", "a*b"):
        got = [r.x for r in df.select(glob.matches(F.col("v"), pattern).alias("x")).collect()]
        rule = re.compile(glob.to_regex(pattern).replace(r"\z", r"\Z"))
        assert [bool(x) for x in got] == [v is not None and bool(rule.match(v)) for v in values], pattern
    assert [r.x for r in df.select(glob.matches(F.col("v"), "A*", True).alias("x")).collect()].count(True) == 7


def slow_ratio(text, needle):
    if len(text) < len(needle):
        text, needle = needle, text
    best = 0.0
    if not needle:
        return best
    for start in range(1 - len(needle), len(text)):
        window = text[max(0, start) : start + len(needle)]
        row = [0] * (len(needle) + 1)
        for c in window:
            row = [0, *row[1:]] if not row else row
            last = 0
            for i, d in enumerate(needle, 1):
                last, row[i] = row[i], last + 1 if c == d else max(row[i], row[i - 1])
        best = max(best, 200.0 * row[-1] / (len(window) + len(needle)))
    return best


@settings(max_examples=400, deadline=None)
@given(st.text("abcé漢", max_size=12), st.text("abcé漢", min_size=1, max_size=7))
def test_vector_scores(text, needle):
    assert fuzzy.partial_ratio(text, needle) == pytest.approx(slow_ratio(text, needle))


def test_long_needles():
    needle = "abcdefgh" * 9
    assert fuzzy.partial_ratio(f"xx{needle}yy", needle) == 100.0
    assert fuzzy.partial_ratio(needle[:50], needle) == 100.0


def test_expression_and_function_scores(spark):
    texts = ["randomSymlink", "simlynk", "sym", "", "symlink", "xsymlnkx", "漢字symlink", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for needle in ("symlink", "s", "simlynk", "abcdefghijklmnopqrst"):
        rows = df.select(fuzzy.similarity(F.col("t"), needle).alias("a"), fuzzy.similarity_udf(needle)(F.col("t")).alias("b")).collect()
        for t, (a, b) in zip(texts, rows, strict=True):
            assert (a is None) if t is None else a == pytest.approx(slow_ratio(t, needle) if t else 0.0), (t, needle)
            assert (b is None or b != b) if t is None else b == pytest.approx(a)
    assert fuzzy.partial_ratio("randomSymlink".lower(), "symlink") == 100
    assert round(fuzzy.partial_ratio("randomSymlink", "symlink"), 1) == 92.3


def test_needle_limits():
    with pytest.raises(ValueError):
        fuzzy.similarity(F.lit("x"), "y" * 63)
    with pytest.raises(ValueError):
        fuzzy.similarity(F.lit("x"), "")


def test_long_needles_and_many_texts_equal_window_by_window():
    """Needles of one to three machine words, characters of no text, texts shorter than the needle, and nulls."""
    rng = random.Random(3)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    def slow(text, needle):
        text, needle = (needle, text) if len(text) < len(needle) else (text, needle)
        windows = [text[max(0, s) : s + len(needle)] for s in range(1 - len(needle), len(text))] if needle else []
        return max((200.0 * common(w, needle) / (len(w) + len(needle)) for w in windows), default=0.0)

    for size in (1, 2, 5, 9, 63, 64, 65, 70, 130):
        for _ in range(6):
            needle = "".join(rng.choice("abc\0é") for _ in range(size))
            texts = ["".join(rng.choice("abcd\0é") for _ in range(rng.choice((0, 1, 3, 20, 64, 80)))) for _ in range(4)]
            assert fuzzy.partial_ratios([*texts, None], needle) == [*(pytest.approx(slow(t, needle)) for t in texts), None]

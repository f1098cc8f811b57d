import re
import time
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from arborquery.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The base rules, straight from their patterns."""

    def passes(digits):
        total = 0
        for k, d in enumerate(reversed(digits)):
            d = int(d) * (1 + k % 2)
            total += d - 9 * (d > 9)
        return total % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and passes(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


@settings(max_examples=1500, deadline=None)
@given(st.text("ab@.-+ 0123459()\n%_é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(list("аbo@. ５") + [" at ", " dot ", "(at)", "one ", "two-", "plus ", "com", "​"]), max_size=30).map("".join))
def test_base_spans_stay_and_added_ones_lie_in_the_text(text):
    base, full = pii.find(text)
    for kind in pii.KINDS:
        assert set(base[kind]) <= set(full[kind])
        assert all(0 <= a < b <= len(text) for a, b in full[kind])


def test_disguises_map_back_to_the_source():
    cases = {
        "mail john dot doe at mail dot example dot com now": ("email", "john dot doe at mail dot example dot com"),
        "john (at) mail [dot] example (dot) com": ("email", "john (at) mail [dot] example (dot) com"),
        "é jоhn@exаmple.com ok": ("email", "jоhn@exаmple.com"),
        "dial plus one (four five six) five five five two one eight six ok": ("phone", "plus one (four five six) five five five two one eight six"),
        "host 192 dot 168 dot 1 dot 10 up": ("ip", "192 dot 168 dot 1 dot 10"),
        "no ４０４１８９４９７４６０８７９５.": ("card", "４０４１８９４９７４６０８７９５"),
    }
    for text, (kind, said) in cases.items():
        _, full = pii.find(text)
        assert [text[a:b] for a, b in full[kind]] == [said], text


def test_ordinary_text_is_left_alone(prose):
    for text in (prose(500), "We met at noon, dot your i at home.", "one two buckle my shoe", "L’été à Paris – “bien”", "at the dot at one"):
        assert not any(pii.find(text)[1].values())


#: What a worded address is, as a pattern that tries every place.
WORDED = re.compile(r"(?<![a-z0-9._%+-])([a-z0-9_%+-]+(?:(?:\.| dot )[a-z0-9_%+-]+)*?)( at |@)([a-z0-9-]+(?:(?: dot |\.)[a-z0-9-]+)*? dot [a-z]{2,}(?: dot [a-z]{2,})*)(?![a-z0-9])")


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", "x1", " dot ", " at ", "@", ".", " ", "-", "com", "dot", "at", "\n", "_"]), max_size=14).map("".join))
def test_worded_addresses_are_those_of_the_pattern(text):
    assert pii._worded(text) == [(m.start(), m.end(1), m.start(3), m.end()) for m in WORDED.finditer(text)]


def test_time_grows_in_proportion():
    """Ten times the text takes far less than a hundred times as long; what is quadratic would take minutes."""
    patterns = ("1", "1.", "+1 ", "a@", "a.", "one ", "aa dot ", "dot at ", "at dot ", "x at ", "x dot at dot ", "a@b dot ", " at a.b", "a at b.cd ", "< at ", "zero-", "1 ")
    for text in (*(p * 60_000 for p in patterns), "aa dot " * 30_000 + "at " + "aa1 dot " * 30_000, "x at a." + "b." * 100_000):
        began = time.perf_counter()
        pii.find(text)
        assert time.perf_counter() - began < 10, text[:20]


def test_query_rows(spark, odd_docs, no_docs, sf):
    rows = pii.op1_pii(spark, sf(documents=odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    empty = next(r for r in rows if r.doc_id == 1)
    assert (empty.n_email, empty.spans, empty.base_sha256) == (0, "", sha256(b"").hexdigest())
    assert pii.op1_pii(spark, sf(documents=no_docs)).collect() == []


def test_masking_keeps_columns_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a@b.cd or 1.2.3.4", 17, "x"), (2, None, None, None)], "doc_id long, text string, n_chars long, base string")
    assert [tuple(r) for r in pii.masked(docs).orderBy("doc_id").collect()] == [(1, "[email] or [ip]", 15, "x"), (2, None, None, None)]


def test_fragments_found_plainly_do_not_hide_the_whole():
    cases = {
        "to user@mail.example dot com now": ("email", "user@mail.example dot com", "user@mail.example"),
        "to jоhn@example.com now": ("email", "jоhn@example.com", "hn@example.com"),
        "on +44 20 7946 zero nine five eight now": ("phone", "+44 20 7946 zero nine five eight", "+44 20 7946"),
    }
    for text, (kind, whole, fragment) in cases.items():
        base, full = pii.find(text)
        assert [text[a:b] for a, b in base[kind]] == [fragment]
        assert {text[a:b] for a, b in full[kind]} == {whole, fragment}
        assert pii.mask(text) == f"{text[:2]} [{kind}] now"


def test_overlapping_spans_are_masked_as_one(monkeypatch):
    monkeypatch.setattr(pii, "find", lambda text: ({}, {"email": [(1, 4)], "ip": [(3, 6)], "card": [], "phone": [(6, 7)]}))
    assert pii.mask("abcdefgh") == "a[email][phone]h"


def test_at_before_an_ordinary_host_and_every_bracketed_sign():
    cases = ["jane at example.com", "jane.doe at mail.example.org", "jane dot doe at mail.example.org", "user@example<dot>com", "user@example< dot >com", "user@example<.>com"]
    cases += ["user< at >example.com", "user( @ )example.com", "user@example[ . ]com", "user <at> example {dot} com"]
    for said in cases:
        text = f"write: {said}, please"
        assert [text[a:b] for a, b in pii.find(text)[1]["email"]] == [said]
        assert pii.mask(text) == "write: [email], please"
    for text in ("Look at example.com for more.", "It was sold at shop.example.org", "we met at noon. then left", "at example.com"):
        assert not any(pii.find(text)[1].values()), text

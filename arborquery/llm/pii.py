"""Personal data, found in plain and in disguised form with offsets into the source text.

Plain identifiers are found by linear scans. Disguised ones are undone by transducers: one replaces homoglyphs and
full-width forms by their ASCII look-alikes and deletes invisible characters, one turns runs of spelled digits into
digits and at/dot disguises into @ and '.'. Each transducer emits its output together with an alignment of output
segments to source segments; detection runs on the output and spans go back through the alignments.
A text no rule touches is left as it is: its normal form is itself.

Defined cases: a null or empty text has no spans; repeated rows get equal results, each its own row; an empty table
gives an empty result; further columns of the input, whatever their names, are not read. Scans are linear, worded hosts
are followed once from any place, so very long texts are processed whole. Overlaps between different kinds are kept; in a kind, an added span may reach beyond
base spans that are fragments of it, which stay beside it, and is dropped only where a base span contains it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, ids_and_texts, map_arrow

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is entered at its first digit only and never given back: the run's other starts would fail alike.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LUHN = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    return (sum(map(int, digits[-1::-2])) + sum(_LUHN[int(d)] for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((lo, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    """Plain identifiers: per kind the leftmost non-overlapping matches, those failing their check dropped."""
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text),
        "card": cards(text),
        "phone": phones(text) if "+" in text else [],
    }


# Look-alikes of ASCII letters and digits in Cyrillic and Greek.
_LOOK_ALIKES = dict(
    zip(
        "АВЕКМНОРСТХУаеорсхуіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαιν",
        "ABEKMHOPCTXYaeopcxyijsdhqwABEZHIKMNOPTYXoaiv",
        strict=True,
    )
)
_GLYPHS = {ord(k): v for k, v in _LOOK_ALIKES.items()}
_GLYPHS |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms of ! to ~
_GLYPHS |= {base + d: str(d) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_GLYPHS |= {0x2024: ".", 0x3002: ".", 0xFE52: ".", 0xFE6B: "@", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-", 0x00A0: " ", 0x2009: " ", 0x202F: " ", 0x3000: " "}
_GLYPH = re.compile("[" + "".join(map(re.escape, map(chr, _GLYPHS))) + "]")
_INVISIBLE = re.compile("[­​‌‍⁠﻿]+")

_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DW = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
#: A run: at least four neighbours, digits or digit words, with a word among them; the run may begin with "plus".
_SPELLED = re.compile(rf"(?<![a-z0-9])(?:plus[ -])?(?:{_DW}|[0-9]+)(?:[ ().-]{{1,3}}(?:{_DW}|[0-9]+|dot|point)(?![a-z])){{3,}}", re.ASCII)
_SPELLED_HINT = re.compile(rf"{_DW}[ ().-]{{1,3}}(?:{_DW}(?![a-z])|[0-9]|dot |point )|[0-9][ ().-]{{1,3}}{_DW}(?![a-z])")
_PART = re.compile(rf"(plus[ -])|(?<![a-z]){_DW}(?![a-z])|( ?(?<![a-z])(?:dot|point)(?![a-z]) ?)")
_SIGN = r"(at|@|dot|\.)"
_BRACKETED = re.compile(" ?(?:" + "|".join(rf"\{a} ?{_SIGN} ?\{b}" for a, b in ("[]", "()", "{}")) + rf"|< ?{_SIGN} ?>) ?")
_BRACKET_HINT = re.compile(rf"[\[({{<] ?{_SIGN} ?[\])}}>]")
#: Of name at host dot tld, with the words "at" and "dot" or one of them already a sign: what stands between, a label
#: of the host, and what may stand for the last ones.
_BETWEEN = re.compile(r"(?= at )|@")
_LABEL = re.compile(r"[a-z0-9-]+")
_LAST = re.compile(r"[a-z]{2,}(?![a-z0-9])")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_%+-")
#: The word "at" before an ordinary host; the name is what stands left of it, but for words that lead to a place.
_AT_HOST = re.compile(r" at (?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?![a-z0-9]))")
_TO_A_PLACE = frozenset(
    "a an and are at available be been book bought browse buy call check checkout click contact details directly download email find follow found free here hosted i in info "
    "information instructions is it join learn live located look looked looking mail me met more now of on online only or order out page posted published purchase read register "
    "see shop sign site sold start starting stay stop store that the them there this today up updates us view visit was watch we website were work worked working works you".split()
)
_DOTTED = re.compile(r"(?<![a-z0-9.])[0-9]{1,3}(?: (?:dot|point) [0-9]{1,3}){3}(?![0-9])")
_DOT_WORD = re.compile(r" (?:dot|point) ")


class Alignment:
    """Where each segment of a transducer's output comes from."""

    __slots__ = ("at", "src", "same")

    def __init__(self, sites: list[tuple[int, int, str]], text: str):
        self.at, self.src, self.same = [], [], []
        pos = n = 0
        for lo, hi, new in sites:
            for a, b, m, same in ((pos, lo, lo - pos, True), (lo, hi, len(new), False)):
                if m or (not same and b > a):
                    self.at.append(n)
                    self.src.append((a, b))
                    self.same.append(same)
                    n += m
            pos = hi
        self.at.append(n)
        self.src.append((pos, len(text)))
        self.same.append(True)

    def back(self, lo: int, hi: int) -> tuple[int, int, bool]:
        """The source span of output [lo, hi), hi > lo, and whether a rewritten segment is in it."""
        i, j = bisect_right(self.at, lo) - 1, bisect_right(self.at, hi - 1) - 1
        start = self.src[i][0] + (lo - self.at[i] if self.same[i] else 0)
        end = self.src[j][0] + (hi - self.at[j]) if self.same[j] else self.src[j][1]
        return start, end, not all(self.same[i : j + 1])


def _apply(sites: list[tuple[int, int, str]], text: str) -> str:
    out, pos = [], 0
    for lo, hi, new in sites:
        out += [text[pos:lo], new]
        pos = hi
    return "".join([*out, text[pos:]])


def _glyph_sites(text: str) -> list[tuple[int, int, str]]:
    sites = [(m.start(), m.end(), _GLYPHS[ord(m.group())]) for m in _GLYPH.finditer(text)]
    sites += [(*m.span(), "") for m in _INVISIBLE.finditer(text)]
    return sorted(sites)


def _host_ends(low: str) -> Callable[[int], int | None]:
    """A function from where a worded host begins to where it ends, or None; a place is looked at once, whoever asks."""
    hosts: dict[int, int | None] = {}
    lasts: dict[int, int | None] = {}

    def last(at: int) -> int | None:
        """The end of last labels joined by the word "dot"."""
        seen, end = [], None
        while at not in lasts and (m := _LAST.match(low, at)):
            seen.append(at)
            end = m.end()
            if not low.startswith(" dot ", end):
                break
            at = end + 5
        else:
            end = lasts.setdefault(at, None) or end
        lasts.update(dict.fromkeys(seen, end))
        return end

    def host(at: int) -> int | None:
        seen, end = [], None
        while True:
            if at in hosts:
                end = hosts[at]
                break
            seen.append(at)
            if not (m := _LABEL.match(low, at)):
                break
            if low.startswith(" dot ", m.end()):
                at = m.end() + 5
                if (end := last(at)) is not None:
                    break
            elif low.startswith(".", m.end()):
                at = m.end() + 1
            else:
                break
        hosts.update(dict.fromkeys(seen, end))
        return end

    return host


def _worded(low: str) -> list[tuple[int, int, int, int]]:
    """(start, end of the name, start of the host, end) of addresses with the words "at" or "dot", from left to right."""
    found, done, host = [], 0, _host_ends(low)
    for m in _BETWEEN.finditer(low):
        at, after = m.start(), m.start() + (1 if m.group() else 4)
        if at <= done or (end := host(after)) is None:
            continue
        lo, start = at, None
        while True:  # a name, and what is joined to it on the left
            name = lo
            while lo > done and low[lo - 1] in _NAME_CHARS:
                lo -= 1
            if lo == name:
                break
            if lo == 0 or low[lo - 1] not in _LOCAL_CHARS:
                start = lo
            if lo - 1 > done and low[lo - 1] == ".":
                lo -= 1
            elif lo - 5 > done and low.startswith(" dot ", lo - 5):
                lo -= 5
            else:
                break
        if start is not None:
            found.append((start, at, after, end))
            done = end
        else:
            done = max(done, at)
    return found


def _word_sites(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: fold ASCII alone, so that offsets hold
        low = "".join(c.lower() if c < "\x80" else c for c in text)
    sites: list[tuple[int, int, str]] = []
    if _BRACKET_HINT.search(low):
        sites += [(*m.span(), "@" if next(filter(None, m.groups())) in ("at", "@") else ".") for m in _BRACKETED.finditer(low)]
    if " dot " in low or " point " in low:
        for start, stop, begin, end in _worded(low):
            sites += [(stop, begin, "@")] * (low[stop] != "@")
            sites += [(*d.span(), ".") for a, b in ((start, stop), (begin, end)) for d in _DOT_WORD.finditer(low, a, b)]
        sites += [(m.start() + d.start(), m.start() + d.end(), ".") for m in _DOTTED.finditer(low) for d in _DOT_WORD.finditer(m.group())]
    for m in _AT_HOST.finditer(low):
        lo, dots = m.start(), []
        while lo and (low[lo - 1] in _LOCAL_CHARS or (low.endswith(" dot ", 0, lo) and lo > 5 and low[lo - 6] in _LOCAL_CHARS)):
            if low[lo - 1] == " ":
                dots.append((lo - 5, lo, "."))
                lo -= 5
            else:
                lo -= 1
        if lo < m.start() and low[m.start() - 1] not in ".%" and low[lo : m.start()] not in _TO_A_PLACE:
            sites += [*dots, (*m.span(), "@")]
    if _SPELLED_HINT.search(low):
        for m in _SPELLED.finditer(low):
            parts = [(m.start() + p.start(), m.start() + p.end(), "+" if p[1] else "." if p[2] else _DIGIT_WORDS[p.group()]) for p in _PART.finditer(m.group())]
            if any(new.isdigit() for *_, new in parts):
                sites += parts
    kept, end = [], 0
    for s in sorted(set(sites), key=lambda s: (s[0], -s[1])):
        if s[0] >= end:
            kept.append(s)
            end = s[1]
    return kept


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Disguised identifiers: found in the normal form, over at least one rewritten segment, in no base span."""
    glyphs = [] if text.isascii() else _glyph_sites(text)
    mid = _apply(glyphs, text) if glyphs else text
    words = _word_sites(mid)
    if not glyphs and not words:
        return {k: [] for k in KINDS}
    first, second, normal = Alignment(glyphs, text), Alignment(words, mid), _apply(words, mid)
    out: dict[str, list[Span]] = {}
    for kind, spans in base_spans(normal).items():
        out[kind] = found = []
        taken = base[kind]
        for lo, hi in spans:
            if kind == "email" and not (normal[lo:hi].rpartition(".")[2].isalpha() and len(normal[lo:hi].rpartition(".")[2]) >= 2):
                continue
            a, b, new = second.back(lo, hi)
            a, b, newer = first.back(a, b)
            if (new or newer) and not any(x <= a and b <= y for x, y in taken):
                found.append((a, b))
    return out


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and all spans of a text, by kind."""
    base = base_spans(text)
    extra = added_spans(text, base)
    return base, {k: sorted(base[k] + extra[k]) for k in KINDS}


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with all spans: (id, base array, spans array of (kind, start, end)) as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base, full = find(text)
                for c, k in zip(cols, KINDS, strict=False):
                    c.append(len(base[k]))
                cols[4].append(_joined(base))
                cols[5].append(_joined(full))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"],
            )

    renamed = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_arrow(ids_and_texts(renamed), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def mask(text: str) -> str:
    """The text with spans replaced by kinds in brackets; the union of overlapping ones by the kind of the first, then longest."""
    _, spans = find(text)
    out, pos = [], 0
    for lo, neg, kind in sorted((a, -b, k) for k in KINDS for a, b in spans[k]):
        if lo >= pos:
            out += [text[pos:lo], f"[{kind}]"]
        pos = max(pos, -neg)
    return "".join([*out, text[pos:]]) if out else text


def masked(docs: DataFrame) -> DataFrame:
    """The documents with spans masked in the text and n_chars recounted; null texts stay null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else mask(t) for t in batch.column(names.index("text")).to_pylist()]
            cols = list(batch.columns)
            cols[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                kind = cols[names.index("n_chars")].type
                cols[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], kind)
            yield pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(docs, run, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    from pyspark.sql import functions as F

    found = detect(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")

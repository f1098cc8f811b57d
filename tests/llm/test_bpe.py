from hashlib import sha256

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from arborquery.llm import bpe

OURS = bpe.load(bpe.default_vocabulary(), bpe.default_pattern())
THEIRS = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=OURS.ranks, special_tokens={})


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(list("abehnot '.=-\n\t1é漢🙂") + ["the", "ing", "  ", "'s", "aaaa", "\r\n"]), max_size=60).map("".join))
def test_ids_equal_the_library(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5001, "ab" * 3000, "=" * 4096, "\n" * 3000, "é" * 1999, " " * 2001, "thethe" * 900])
def test_long_pieces(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=40))
def test_joining_is_encoding_the_whole(a, b):
    assert OURS.join(OURS.encode_bytes(a) if a else [], OURS.encode_bytes(b) if b else []) == (OURS.merge(a + b) if a + b else [])


def test_query_rows(spark, odd_docs, no_docs, sf):
    rows = bpe.op10_bpe(spark, sf(documents=odd_docs)).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        ids = THEIRS.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.op10_bpe(spark, sf(documents=no_docs)).collect() == []


def test_ids_column(spark):
    docs = spark.createDataFrame([(1, "the end"), (2, None)], "doc_id long, text string")
    assert [(r.ids, bytes(r.decoded)) for r in bpe.encoded(docs).orderBy("doc_id").collect()] == [(THEIRS.encode_ordinary("the end"), b"the end"), ([], b"")]

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from arborquery.llm import unigram


def library():
    m = sentencepiece.SentencePieceProcessor(model_file=unigram.default_model())
    t = Tokenizer(models.Unigram([(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())], 0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


THEIRS, OURS = library(), unigram.load(unigram.default_model())


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(list("aehnost1!\n\t▁ é漢🙂\x01") + ["the", "ation", "  "]), max_size=40).map("".join))
def test_counts_equal_the_library(text):
    assert OURS.count(text) == len(THEIRS.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.sampled_from([-1.0, -2.0, -3.0, -4.0]), min_size=1), st.text("abcd", min_size=1, max_size=9))
def test_counts_equal_trying_every_path(vocabulary, word):
    """All segmentations; ties by the tokenizer's rule, end by end."""
    counter = unigram.Counter(list(vocabulary.items()))
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = None
        for start in range(end):
            piece = word[start:end]
            score, n = vocabulary.get(piece), 1
            if score is None and len(piece) == 1:
                score, n = min(vocabulary.values()) - 10, len(piece.encode())
            if score is not None and (found is None or score + best[start][0] > found[0]):
                found = (score + best[start][0], n + best[start][1])
        best.append(found)
    assert counter.viterbi(word) == best[-1][1]


def test_query_rows(spark, odd_docs, no_docs, sf):
    rows = {r.doc_id: r.n_tokens for r in unigram.op8_token_counts(spark, sf(documents=odd_docs)).collect()}
    for r in odd_docs.collect():
        if len(r.text or "") < 10_000:
            assert rows[r.doc_id] == len(THEIRS.encode(r.text or "", add_special_tokens=False).ids)
    assert unigram.op8_token_counts(spark, sf(documents=no_docs)).collect() == []

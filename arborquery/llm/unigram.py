"""Token counts of a unigram tokenizer without building tokens.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at a position; dynamic programming keeps,
per position, the best score and the number of pieces that reach it. Words (a space and what follows up to the next
one, spaces shown as U+2581) are separate problems, so their counts are remembered.

The tokenizer's rules, kept exactly: scores add up in double precision from the left; a path replaces another only if
its score is greater, starts being tried in ascending order, so of equal paths the one with the longest last piece
stays; a character that is no piece of its own may be unknown, at the lowest score less 10; an unknown character
falls back to one piece for each of its UTF-8 bytes. Control and byte pieces are not matched in texts.

The vocabulary file at hand holds merge ranks as scores; a unigram model over these pieces and scores is what is
counted, not that file's own merge algorithm.

Defined cases: a null or empty text has 0 tokens; whole texts are counted, however long, in linear time; an empty
table gives an empty result; repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, ids_and_texts, map_arrow

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a worker remembers, and the longest such word.
CACHE_WORDS, CACHE_CHARS = 300_000, 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the model's ordinary pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Counter:
    """Counts pieces of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def viterbi(self, word: str) -> int:
        """Pieces of the best path through one word."""
        scores, counts = [0.0] * (len(word) + 1), [0] * (len(word) + 1)
        single, done = self.single, 0

        def unknown_at(end: int, has: bool) -> None:
            c = word[end - 1]
            if c not in single:
                score = self.unknown + scores[end - 1]
                if not has or score > scores[end]:
                    scores[end], counts[end] = score, counts[end - 1] + len(c.encode())

        for last, (length, value) in self.auto.iter(word):  # ends ascend; at one end the longest piece comes first
            end = last + 1
            if end != done:
                if done:
                    unknown_at(done, True)
                for e in range(done + 1, end):
                    unknown_at(e, False)
                scores[end], counts[end] = value + scores[end - length], counts[end - length] + 1
                done = end
            else:
                score = value + scores[end - length]
                if score > scores[end]:
                    scores[end], counts[end] = score, counts[end - length] + 1
        if done:
            unknown_at(done, True)
        for e in range(done + 1, len(word) + 1):
            unknown_at(e, False)
        return counts[-1]

    def word(self, word: str) -> int:
        n = self.viterbi(SPACE + word)
        if len(word) <= CACHE_CHARS:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            del words[0]  # a leading space is the first word's own
        known, slow = self.known.get, self.word
        return sum([known(w) or slow(w) for w in words])


@lru_cache(2)
def load(path: str) -> Counter:
    """The worker's counter, built once."""
    return Counter(read_pieces(path))


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every document."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(counter.count, batch.column(1).to_pylist()), pa.int64())], ["doc_id", "n_tokens"])

    return map_arrow(ids_and_texts(docs), run, "doc_id long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every whole text."""
    return counted(documents(spark, sf_dir))

"""Token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character of a marked word; dynamic programming
carries the best score and the piece count of the path that has it.  Scores are sums in double precision, and of equal
scores the path whose last piece starts first stays, as in the tokenizers library's unigram model.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaloom.llm.batches import WordTable, output, slices, texts_of

MARK = "▁"
#: What an unknown character costs beyond the lowest score of the vocabulary (fixed value of the format).
UNKNOWN_PENALTY = 10.0
_COUNTERS: dict[int, "UnigramCounter"] = {}

Vocabulary = list[tuple[str, float]]


def vocabulary_of(model_path: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece file as a unigram vocabulary; control pieces are left out."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(lib.id_to_piece(i), lib.get_score(i)) for i in range(lib.get_piece_size()) if not lib.is_control(i)]


def marked_words(text: str) -> list[str]:
    """The words that the marker starts, without it: one for each marker, after a text has been given a first one."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    return text[1:].split(" ") if text[0] == " " else text.split(" ")


class UnigramCounter:
    """One vocabulary in one Python worker; ``byte_fallback`` counts an unknown character as its bytes if those are pieces."""

    def __init__(self, vocabulary: Vocabulary, byte_fallback: bool = True):
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        scores = dict(vocabulary)
        for piece, score in scores.items():
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in scores for b in range(256))
        self.table = WordTable(lambda words: [self.count(MARK + w) for w in words])

    def count(self, word: str) -> int:
        """Pieces of one marked word."""
        size = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, found in self.pieces.iter(word):
            ends[end].append(found)
        best, pieces, unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        for end, found in enumerate(ends, 1):
            top, start, kept = None, 0, False
            single = False
            for length, score in found:
                here = best[end - length] + score
                single = single or length == 1
                if top is None or here > top or (here == top and end - length < start):
                    top, start, kept = here, end - length, True
            if not single and (top is None or best[end - 1] + self.unknown > top):
                top, start, kept = best[end - 1] + self.unknown, end - 1, False
            best[end], unknown[end] = top, not kept
            if kept:
                pieces[end] = pieces[start] + 1
            elif self.bytes:
                pieces[end] = pieces[start] + len(word[start].encode())
            else:  # unknown characters in a row are one piece
                pieces[end] = pieces[start] + (not unknown[start])
        return pieces[size]

    def counts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Pieces and marked words of each text."""
        words = [marked_words(t) for t in texts]
        known = self.table.covering(words).__getitem__
        return [sum(map(known, w)) for w in words], list(map(len, words))


def count_tokens(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", byte_fallback: bool = True,
) -> DataFrame:
    """(id, n_tokens, n_words) of every whole text, repeated rows included; null and empty texts have none.

    Each Python worker counts a distinct word once while its table holds it.  Nothing is shuffled; other columns are ignored.
    """
    schema = output(docs, id_col, ("n_tokens", "long"), ("n_words", "long"))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, byte_fallback))
    key = hash((tuple(vocabulary), byte_fallback))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTERS:
            _COUNTERS[key] = UnigramCounter(*shared.value)
        for batch in slices(batches, "text"):
            pieces, words = _COUNTERS[key].counts(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pieces, pa.int64()), pa.array(words, pa.int64())], names=schema.fieldNames())

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(apply, schema)

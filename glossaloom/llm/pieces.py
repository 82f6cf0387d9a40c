"""SentencePiece ids and texts through a table of distinct marked words.

When no piece of a model holds a whitespace marker behind another character, merges never join two marked words, so the
ids of a text are the ids of its words in order.  Each Python worker segments every distinct word that it meets once and
joins the ids back by position; models whose pieces do cross markers, or that normalise, are applied to whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaloom.llm.batches import WordTable, output, shared_bytes, slices, texts_of

MARK = "▁"
_MARKED_WORD = re.compile(f"{MARK}+[^{MARK}]*")
_CODECS: dict[tuple[int, bool, bool], "PieceCodec"] = {}


def words_stand_alone(model: bytes) -> bool:
    """Whether a model's pieces keep within marked words and its texts pass unnormalised."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(model)
    plain = spec.normalizer_spec
    return (
        plain.add_dummy_prefix and plain.escape_whitespaces and not plain.remove_extra_whitespaces
        and not plain.precompiled_charsmap and not spec.trainer_spec.treat_whitespace_as_suffix
        and not any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)
        and not any(p.type == p.USER_DEFINED for p in spec.pieces)
    )


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in _MARKED_WORD.findall(MARK + text.replace(" ", MARK))]


class PieceCodec:
    """One model in one Python worker."""

    def __init__(self, model: bytes, begin: bool = True, end: bool = True):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.head = self._packed([self.lib.bos_id()] if begin else [])
        self.tail = self._packed([self.lib.eos_id()] if end else [])
        self.table = WordTable(self._segment) if words_stand_alone(model) else None

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def _segment(self, words: list[str]) -> list[bytes]:
        # a lone marker is the word "", which the library would take for an empty text
        ids = self.lib.encode([w or MARK for w in words], num_threads=1)
        return [self._packed(i if w else self.lib.piece_to_id([MARK])) for w, i in zip(words, ids)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.table is None:
            return [self.head + self._packed(i) + self.tail for i in self.lib.encode(texts, num_threads=1)]
        words = [marked_words(t) for t in texts]
        known = self.table.covering(words).__getitem__
        return [self.head + b"".join(map(known, w)) + self.tail for w in words]

    def decode(self, packed: list[bytes]) -> list[str]:
        return [self.lib.decode(np.frombuffer(p, "<u4").tolist()) for p in packed]


def _codec(model: bytes, begin: bool, end: bool) -> PieceCodec:
    key = (hash(model), begin, end)
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(model, begin, end)
    return _CODECS[key]


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
    begin: bool = True, end: bool = True, decoded: bool = False,
) -> DataFrame:
    """Ids of every whole text: (id, n_tokens, ids) and, if ``decoded``, ``decoded`` from the same ids.

    ``ids`` is binary: little-endian unsigned 32-bit integers; ``id_array`` turns it into an array.  Null texts count as
    empty and get the begin and end ids alone.  One row comes out for each row that goes in, repeated rows included; other
    columns of ``docs`` are not looked at.  Nothing is shuffled.
    """
    model = shared_bytes(docs.sparkSession, model_path)
    fields = [("n_tokens", "long"), ("ids", "binary"), *([("decoded", "string")] if decoded else [])]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, begin, end)
        for batch in slices(batches, "text"):
            ids = codec.encode(texts_of(batch, "text"))
            columns = [batch.column("id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(codec.decode(ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *(f for f, _ in fields)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(apply, output(docs, id_col, *fields))


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from packed ids; null ids give the empty text."""
    model = shared_bytes(encoded.sparkSession, model_path)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, True, True)
        for batch in slices(batches, "ids"):
            texts = codec.decode([i or b"" for i in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=[id_col, "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(apply, output(encoded, id_col, ("text", "string")))


def id_array(packed: F.Column) -> F.Column:
    """Packed ids as array<bigint>, by Spark's own functions."""
    digits = F.hex(packed)
    place = F.sequence(F.lit(0), (F.length(packed) / 4 - 1).cast("int"))
    four = lambda i: F.substring(digits, i * 8 + 1, F.lit(8))
    swapped = lambda s: F.concat(*(F.substring(s, F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)))
    values = F.transform(place, lambda i: F.conv(swapped(four(i)), 16, 10).cast("long"))
    return F.when(F.length(packed) > 0, values).otherwise(F.array().cast("array<bigint>"))

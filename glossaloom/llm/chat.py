"""Chat formatting at token level.

Every role and text is encoded on its own, reserved ids above the vocabulary are spliced in as turn marks, and the loss
mask follows from prefix sums over segment lengths.  In the rendered text the marks are strings; where content holds such a
string, or a backslash, a backslash goes before it, so turns can be read back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaloom.llm.batches import output, shared_bytes, slices, texts_of
from glossaloom.llm.bytepairs import BytePairCodec, codec

#: The turn marks, in the order of their reserved ids: vocabulary size, + 1, + 2.
MARKS = ("<turn>", "<body>", "</turn>")
_ANY = "|".join(map(re.escape, MARKS))
_TO_ESCAPE = re.compile(rf"\\|{_ANY}")
_ESCAPED = re.compile(rf"\\(\\|{_ANY})")
_ESCAPED_OR_MARK = re.compile(rf"\\(?:\\|{_ANY})|({_ANY})")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation."""
    turns, start, role = [], 0, ""
    for found in _ESCAPED_OR_MARK.finditer(formatted):
        if found[1] is None:
            continue
        if found[1] == MARKS[1]:
            role = unescape(formatted[start : found.start()])
        elif found[1] == MARKS[2]:
            turns.append((role, unescape(formatted[start : found.start()])))
        start = found.end()
    return turns


def _segments(words: BytePairCodec, roles: list[str], texts: list[str]) -> tuple[list[bytes], list[int]]:
    """Ids of each turn, and how many of them stand before its text."""
    marks = [np.asarray([words.vocabulary + i], "<u4").tobytes() for i in range(len(MARKS))]
    wide = lambda packed: np.frombuffer(packed, words.dtype).astype("<u4").tobytes()
    heads = [marks[0] + wide(r) + marks[1] for r in words.encode(list(map(escape, roles)))]
    bodies = [wide(t) for t in words.encode(list(map(escape, texts)))]
    return [h + b + marks[2] for h, b in zip(heads, bodies)], [len(h) // 4 for h in heads]


def format_conversations(
    rows: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """(conv id, n_turns, ids, mask) of every conversation, its rows in order of turn.

    ``ids`` is binary, little-endian unsigned 32-bit integers; ``mask`` has a byte for each id, 1 on the ids of texts of
    ``loss_role``.  Null roles and texts count as empty, null turns come first, rows of equal turn follow each other by
    their ids and repeated rows all stay; a null conversation id is a conversation; other columns are ignored.  Turns are
    encoded before one shuffle by conversation and assembled as a sorted stream, one conversation in memory at a time.
    """
    spec = shared_bytes(rows.sparkSession, tokenizer_path)
    named = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    keys = T.StructType([T.StructField(c, named.schema[c].dataType) for c in ("conv", "turn")])
    encoded = T.StructType([*keys, *T.StructType.fromDDL("ids binary, head long, loss boolean")])
    made = output(rows, conv_col, ("n_turns", "long"), ("ids", "binary"), ("mask", "binary"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            roles = texts_of(batch, "role")
            ids, heads = _segments(codec(spec.value), roles, texts_of(batch, "text"))
            columns = [batch.column("conv"), batch.column("turn"), pa.array(ids, pa.binary()), pa.array(heads, pa.int64()), pa.array([r == loss_role for r in roles])]
            yield pa.RecordBatch.from_arrays(columns, names=encoded.fieldNames())

    def turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in slices(batches, "ids"):
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv", "ids", "head", "loss")))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, turns in groupby(turns_of(batches), key=lambda t: t[0]):
            parts, heads, losses = zip(*(t[1:] for t in turns))
            ends = np.cumsum([len(p) // 4 for p in parts])
            starts = np.concatenate([[0], ends[:-1]]) + np.asarray(heads)
            edges = np.zeros(int(ends[-1]) + 1, np.int8)
            chosen = np.asarray(losses, bool)
            np.add.at(edges, starts[chosen], 1)
            np.add.at(edges, ends[chosen] - 1, -1)  # the closing mark bears no loss
            mask = np.cumsum(edges[:-1], dtype=np.int8).tobytes()
            row = [pa.array([conv], made_conv), pa.array([len(parts)], pa.int64()), pa.array([b"".join(parts)], pa.binary()), pa.array([mask], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, names=made.fieldNames())

    made_conv = pa.int64() if isinstance(named.schema["conv"].dataType, T.LongType) else None
    ordered = named.mapInArrow(encode, encoded).repartition("conv").sortWithinPartitions("conv", "turn", "ids")
    return ordered.mapInArrow(assemble, made)


def read_back(formatted: DataFrame, tokenizer_path: str, conv_col: str = "conv_id") -> DataFrame:
    """(conv id, formatted, turns, loss_text) from ids and masks: the rendered text, its turns, and all text under the mask."""
    spec = shared_bytes(formatted.sparkSession, tokenizer_path)
    kinds = ("formatted", "string"), ("turns", "array<struct<role:string,text:string>>"), ("loss_text", "string")
    schema = output(formatted, conv_col, *kinds)

    def render(words: BytePairCodec, ids: np.ndarray) -> str:
        places = np.flatnonzero(ids >= words.vocabulary)
        runs = np.split(ids, np.stack([places, places + 1], axis=1).reshape(-1))
        texts = words.lib.decode_batch([r.tolist() for r in runs[0::2]], skip_special_tokens=False)
        marks = [MARKS[i - words.vocabulary] for i in ids[places].tolist()]
        return "".join(t + m for t, m in zip(texts, [*marks, ""]))

    def loss_text(words: BytePairCodec, ids: np.ndarray, mask: np.ndarray) -> str:
        edges = np.flatnonzero(np.diff(mask, prepend=0, append=0))
        runs = [ids[a:b].tolist() for a, b in zip(edges[0::2], edges[1::2])]
        return "".join(unescape(t) for t in words.lib.decode_batch(runs, skip_special_tokens=False))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = codec(spec.value)
        for batch in slices(batches, "ids"):
            ids = [np.frombuffer(i, "<u4") for i in batch.column("ids").to_pylist()]
            masks = [np.frombuffer(m, np.int8) for m in batch.column("mask").to_pylist()]
            texts = [render(words, i) for i in ids]
            turns = pa.array([[{"role": r, "text": t} for r, t in parse(x)] for x in texts], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            losses = pa.array([loss_text(words, i, m) for i, m in zip(ids, masks)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(conv_col), pa.array(texts, pa.string()), turns, losses], names=schema.fieldNames())

    return formatted.select(conv_col, "ids", "mask").mapInArrow(apply, schema)

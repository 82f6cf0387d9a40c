"""Token files of fixed-width packed ids, in document order, with offsets for random access.

A file set is a Parquet folder.  Each row is a block of whole documents: where it starts in its shard, the documents and
their offsets in the block, and the ids packed in the fewest bits that hold the vocabulary, little end first.  A shard is
a range of document ids, so shards in order give the stream of ids; ``shards`` holds where each of them starts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaloom.llm.batches import shared_bytes, slices, texts_of
from glossaloom.llm.bytepairs import codec

#: A block ends with the document that takes it to so many ids.
BLOCK_IDS = 1 << 16


def id_bits(vocabulary: int) -> int:
    """The fewest bits that hold ids 0 to ``vocabulary`` - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, ``bits`` each, little end first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits % 8 == 0:
        return np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4)[:, : bits // 8]).tobytes()
    planes = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start``; only the bytes that hold them are touched."""
    first, last = start * bits // 8, (start + count) * bits + 7 >> 3
    part = np.frombuffer(payload, np.uint8, last - first, first)
    wide = np.zeros((count, 4), np.uint8)
    if bits % 8 == 0:
        wide[:, : bits // 8] = part.reshape(count, bits // 8)
        return wide.reshape(-1).view("<u4")
    flat = np.unpackbits(part, bitorder="little")[start * bits - first * 8 :][: count * bits]
    planes = np.zeros((count, 32), np.uint8)
    planes[:, :bits] = flat.reshape(count, bits)
    return np.packbits(planes, axis=1, bitorder="little").reshape(-1).view("<u4")


def _block_schema(id_type: T.DataType) -> T.StructType:
    before = T.StructType.fromDDL("shard int, block long, shard_start long, bits int, n_ids long")
    after = T.StructType.fromDDL("doc_starts array<long>, payload binary")
    return T.StructType([*before, T.StructField("doc_ids", T.ArrayType(id_type)), *after])


def write_tokens(
    docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode every whole text, end each with ``end_id`` and write the packed stream in ascending id order to ``folder``.

    Texts are encoded as the library does without added special tokens: a special token's string in a text is that token.
    Null texts count as empty (the end id alone); rows with equal ids follow each other by text, repeated rows each come
    out; null ids come first; an empty table writes no blocks.  Other columns are ignored.  One range shuffle by id.
    Memory in a task is a slice of texts and one block.
    """
    spec = shared_bytes(docs.sparkSession, tokenizer_path)
    schema = _block_schema(docs.schema[id_col].dataType)
    arrow_id = pa.list_(pa.int64()) if isinstance(docs.schema[id_col].dataType, T.LongType) else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = codec(spec.value, plain_specials=False)
        bits, end, shard = id_bits(words.vocabulary), np.asarray([end_id], words.dtype).tobytes(), TaskContext.get().partitionId()
        ids: list = []
        parts: list[bytes] = []
        starts: list[int] = [0]
        state = {"block": 0, "start": 0}

        def block() -> pa.RecordBatch:
            stream = np.frombuffer(b"".join(parts), words.dtype)
            row = [shard, state["block"], state["start"], bits, len(stream), list(ids), starts[:-1], pack(stream, bits)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), arrow_id, pa.list_(pa.int64()), pa.binary()]
            state["block"], state["start"] = state["block"] + 1, state["start"] + len(stream)
            ids.clear(), parts.clear(), starts.__setitem__(slice(None), [0])
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=schema.fieldNames())

        for batch in slices(batches, "text"):
            for key, packed in zip(batch.column("id").to_pylist(), words.encode(texts_of(batch, "text"))):
                ids.append(key)
                parts.append(packed + end)
                starts.append(starts[-1] + len(parts[-1]) // words.dtype.itemsize)
                if starts[-1] >= block_ids:
                    yield block()
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(apply, schema).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    blocks = docs.sparkSession.read.schema(schema).parquet(f"{folder}/blocks")
    # one row for each writing task: where its shard starts
    sizes = sorted(map(tuple, blocks.groupBy("shard").agg(F.sum("n_ids")).collect()))
    bases = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    table = docs.sparkSession.createDataFrame([(s, b) for (s, _), b in zip(sizes, bases)], "shard int, base long")
    table.coalesce(1).write.parquet(f"{folder}/shards")
    table.sparkSession.createDataFrame([(json.dumps({"id": id_col, "kind": schema["doc_ids"].dataType.elementType.jsonValue()}),)], "spec string").coalesce(1).write.text(f"{folder}/spec")


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a file set, each with ``start``: ids of all documents before it."""
    spec = json.loads(spark.read.text(f"{folder}/spec").head()[0])
    kind = T.StructField.fromJson({"name": "x", "type": spec["kind"], "nullable": True, "metadata": {}}).dataType
    blocks = spark.read.schema(_block_schema(kind)).parquet(f"{folder}/blocks")
    shards = spark.read.schema("shard int, base long").parquet(f"{folder}/shards")
    return blocks.join(F.broadcast(shards), "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def read_documents(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids array<int>]) of each document, unpacked block by block."""
    spec = json.loads(spark.read.text(f"{folder}/spec").head()[0])
    blocks = read_blocks(spark, folder)
    kind = blocks.schema["doc_ids"].dataType.elementType
    told = "start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    schema = T.StructType([T.StructField(spec["id"], kind), *T.StructType.fromDDL(told)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, bits, count, starts, payload = (batch.column(c)[i].as_py() for c in ("start", "bits", "n_ids", "doc_starts", "payload"))
                stream = unpack(payload, bits, 0, count)
                edges = np.asarray([*starts, count], np.int64)
                sums = [zlib.crc32(stream[a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                columns = [batch.column("doc_ids")[i].values, pa.array(edges[:-1] + start), pa.array(np.diff(edges)), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(stream.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return blocks.select("start", "bits", "n_ids", "doc_ids", "doc_starts", "payload").mapInArrow(apply, schema)


def read_range(spark: SparkSession, folder: str, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` of the whole stream; only the blocks that hold them are read, and of those the bytes."""
    held = read_blocks(spark, folder).where((F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start))
    parts = []
    for row in held.select("start", "n_ids", "bits", "payload").orderBy("start").toLocalIterator():
        first, last = max(start, row.start), min(start + count, row.start + row.n_ids)
        parts.append(unpack(row.payload, row.bits, first - row.start, last - first))
    return np.concatenate([np.zeros(0, "<u4"), *parts])

"""Helpers of the Arrow operators: bounded slices of text, shared files, stable hash classes, word tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text a Python worker unpacks at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of about ``limit`` bytes of ``column``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(sizes)]):
            yield batch.slice(int(start), int(end - start))


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a slice, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def shared_bytes(spark: SparkSession, path: str):
    """A vocabulary file of the driver as a broadcast: executors need not hold the file."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name in the folder that all executors share (``spark.checkpoint.dir``); local sessions may lack one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and lost executors cost nothing."""
    path = shared_folder(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def output(docs: DataFrame, id_col: str, *fields: tuple[str, str]) -> T.StructType:
    """The schema (id, fields...), the id in the type that it has in ``docs``."""
    made = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)])
    return T.StructType([*made, *T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in fields))]) if fields else made


def hash_class(id_col: str, classes: int) -> Column:
    """crc32 of the id as text, modulo ``classes``: the stable split into learning and held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % classes


class WordTable:
    """Distinct words and what was computed for each, kept by a Python worker from task to task.

    ``compute`` takes a list of new words and gives a list of values.  At ``limit`` words the table starts afresh and takes
    from the one before it what comes up again: memory is bounded by two tables, frequent words stay, and a word that is
    gone is computed again, so results never depend on the limit.
    """

    def __init__(self, compute: Callable[[list[str]], list], limit: int = 400_000):
        self.compute, self.limit, self.known, self.before = compute, limit, {}, {}

    def covering(self, texts_words: list[list[str]]) -> dict:
        """The table, after it has learnt every word of ``texts_words``."""
        wanted = set().union(*texts_words)
        missing = wanted.difference(self.known)
        if len(self.known) + len(missing) > self.limit:
            self.before, self.known, missing = self.known, {}, wanted
        if missing:
            kept = {w: self.before[w] for w in missing if w in self.before}
            fresh = [w for w in missing if w not in kept]
            self.known |= kept
            self.known |= zip(fresh, self.compute(fresh))
        return self.known

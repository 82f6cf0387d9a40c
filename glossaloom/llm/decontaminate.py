"""Benchmark decontamination by SimHash windows.

For every benchmark item, windows of as many words as the item are fingerprinted: each bit of the SimHash is the sign of a sum
over the window's shingles, every occurrence weighing one.  Item fingerprints lie in a multi-index: if two fingerprints
differ in at most ``radius`` bits, in one of the blocks they differ in at most ``radius // blocks``, so looking up each block's
neighbourhood finds every item within the radius.  Candidates are verified by exact weighted Jaccard similarity of the
shingle multisets.

A text of fewer words than the item is one window, as long as it has enough shingles for the least similarity.
A window without any shingle of an item has similarity 0, so only windows that hold one are fingerprinted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaloom.llm.batches import output, slices, texts_of
from glossaloom.llm.shingles import WIDTH, shingled, word_hashes, words_of

SIMILARITY = 0.8
BITS, BLOCKS = 64, 8
#: Bits in which fingerprints at the least similarity may differ: the mean is 9.7 there, the deviation 2.9.
RADIUS = 22
#: Words of benchmark items held by a worker at once; more items are taken in further passes over the documents.
ITEM_WORDS = 2_000_000
_FILTER_BITS = 22


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of ``size`` shingles from each start."""
    signs = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(signs, axis=0, out=sums[1:])
    return np.packbits(sums[starts + size] - sums[starts] > 0, axis=1).view("<u8").reshape(-1)


def similarity(left: np.ndarray, right: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets."""
    kinds, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    a = np.bincount(place[: len(left)], minlength=len(kinds))
    b = np.bincount(place[len(left) :], minlength=len(kinds))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


class BlockIndex:
    """Items of one size by the blocks of their fingerprints."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
        near = apart <= radius // BLOCKS
        blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
        #: for each block and value, the items in the value's neighbourhood
        self.tables = [near[:, blocks[:, j]] for j in range(BLOCKS)]

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, item) of all pairs within the radius."""
        blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
        met = self.tables[0][blocks[:, 0]]
        for j in range(1, BLOCKS):
            met = met | self.tables[j][blocks[:, j]]
        at, item = np.nonzero(met)
        close = np.bitwise_count(prints[at] ^ self.prints[item]) <= self.radius
        return at[close], item[close]


@dataclass
class _Size:
    """Items of one number of words."""

    words: int
    items: list[int]
    bags: list[np.ndarray]
    index: BlockIndex
    shingles: np.ndarray


class ItemIndex:
    """A block of benchmark items in one worker."""

    def __init__(self, texts: list[str], least: float = SIMILARITY, radius: int = RADIUS):
        self.least = least
        words = [words_of(t) for t in texts]
        bags = [shingled(h) for h in word_hashes(words)]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w:
                by_size.setdefault(len(w), []).append(i)
        self.sizes = []
        for size, items in sorted(by_size.items()):
            own = [bags[i] for i in items]
            prints = np.concatenate([fingerprints(b, np.zeros(1, np.int64), len(b)) for b in own])
            self.sizes.append(_Size(size, items, own, BlockIndex(prints, radius), np.unique(np.concatenate(own))))
        self.widths = {}
        for width in {min(WIDTH, s.words) for s in self.sizes}:
            every = np.unique(np.concatenate([s.shingles for s in self.sizes if min(WIDTH, s.words) == width]))
            sieve = np.zeros(1 << _FILTER_BITS, bool)
            sieve[every >> np.uint64(64 - _FILTER_BITS)] = True
            self.widths[width] = (every, sieve)

    def hits(self, hashes: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """(item, first word, words, similarity, differing bits) of the best window of each item found in a text."""
        best: dict[int, tuple[int, int, int, float, int]] = {}
        for width, (every, sieve) in self.widths.items():
            if len(hashes) < width:
                continue
            shingles = shingled(hashes, width) if width < WIDTH else shingled(hashes)
            maybe = np.flatnonzero(sieve[shingles >> np.uint64(64 - _FILTER_BITS)])
            place = np.searchsorted(every, shingles[maybe])
            anchors = maybe[every[np.minimum(place, len(every) - 1)] == shingles[maybe]]
            if not len(anchors):
                continue
            for size in self.sizes:
                if min(WIDTH, size.words) != width:
                    continue
                words = min(size.words, len(hashes))
                span = words - width + 1
                if span < self.least * (size.words - width + 1):
                    continue
                own = anchors[np.isin(shingles[anchors], size.shingles)]
                starts = (own[:, None] - np.arange(span)[None, :]).reshape(-1)
                starts = np.unique(starts[(starts >= 0) & (starts <= len(hashes) - words)])
                if not len(starts):
                    continue
                low, high = int(starts[0]), int(starts[-1]) + span
                prints = fingerprints(shingles[low:high], starts - low, span)
                for at, item in zip(*size.index.within(prints)):
                    start = int(starts[at])
                    value = similarity(shingles[start : start + span], size.bags[item])
                    known = best.get(size.items[item])
                    if value >= self.least and (known is None or value > known[3]):
                        differing = int(np.bitwise_count(prints[at] ^ size.index.prints[item]))
                        best[size.items[item]] = (size.items[item], start, words, value, differing)
        return list(best.values())


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, item_words: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of the items in blocks of about ``item_words`` words, streamed to the driver one block at a time."""
    ids, texts, words = [], [], 0
    for row in benchmark.select(F.col(item_col).alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        ids.append(row.id)
        texts.append(row.text or "")
        words += len(texts[-1].split())
        if words >= item_words:
            yield ids, texts
            ids, texts, words = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY, radius: int = RADIUS, item_words: int = ITEM_WORDS,
) -> DataFrame:
    """(id, item id, start_word, n_words, similarity, differing_bits): the best window of each item in each document row.

    A row comes out for every document row and item row whose best window has ``similarity`` or more (of equal windows the
    first).  Items without words match nothing, null texts hold nothing, items of under five words are one shingle of their
    length.  Repeated rows of either table each count.  Documents are read once for each block of items, nothing is shuffled.
    """
    kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = output(docs, id_col, (item_col, kinds[1].simpleString()), ("start_word", "long"), ("n_words", "long"), ("similarity", "double"), ("differing_bits", "long"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def finder(ids: list, texts: list[str]):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, texts = shared.value
            index = ItemIndex(texts, similarity, radius)
            for batch in slices(batches, "text"):
                words = [words_of(t) for t in texts_of(batch, "text")]
                found = [(i, *hit) for i, h in enumerate(word_hashes(words)) for hit in index.hits(h)]
                places = pa.array([f[0] for f in found], pa.int64())
                told = [pa.array([f[k] for f in found], pa.float64() if k == 4 else pa.int64()) for k in (2, 3, 4, 5)]
                items = pa.array([ids[f[1]] for f in found], pa.int64() if kinds[1].simpleString() == "bigint" else None)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(places), items, *told], names=schema.fieldNames())

        return apply

    made = docs.sparkSession.createDataFrame([], schema)
    for ids, texts in _blocks(benchmark, item_col, item_text_col, item_words):
        made = made.unionByName(rows.mapInArrow(finder(ids, texts), schema))
    return made


def flag_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **finding) -> DataFrame:
    """(id, leaked) for every row of ``docs``, where ``id`` may be any column, a struct of the whole row too."""
    item_col, item_text_col = finding.get("item_col", "item_id"), finding.get("item_text_col", "text")
    least, radius = finding.get("similarity", SIMILARITY), finding.get("radius", RADIUS)
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(False).alias("leaked"))
    schema = made.schema
    for _, texts in _blocks(benchmark, item_col, item_text_col, finding.get("item_words", ITEM_WORDS)):
        shared = docs.sparkSession.sparkContext.broadcast(texts)

        def apply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, least, radius)
            for batch in slices(batches, "text"):
                words = [words_of(t) for t in texts_of(batch, "text")]
                leaked = [before or bool(index.hits(h)) for before, h in zip(batch.column("leaked").to_pylist(), word_hashes(words))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(leaked, pa.bool_())], names=["id", "text", "leaked"])

        made = made.mapInArrow(apply, schema)
    return made.select(F.col("id").alias(id_col), "leaked")

"""Word shingles as 64-bit integers, shared by the near-duplicate and the decontamination operators."""

from __future__ import annotations

import numpy as np
import xxhash

from glossaloom.llm.batches import WordTable

WIDTH = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A to Z in lower case."""
    return text.encode().lower().split()


#: Hashes of the words that this worker has met: few, as a hash costs little more than a look-up and the table outlives its stage.
_WORDS = WordTable(lambda words: list(map(xxhash.xxh3_64_intdigest, words)), 100_000)


def word_hashes(words: list[list[bytes]]) -> list[np.ndarray]:
    known = _WORDS.covering(words).__getitem__
    return [np.fromiter(map(known, w), np.uint64, len(w)) for w in words]


def shingled(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The shingle at every word position; a text of fewer than ``width`` words is one shingle, one of no words has none."""
    size = min(width, len(hashes))
    if not size:
        return hashes[:0]
    total = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        total = total * _ODD + hashes[i : len(hashes) - size + 1 + i]
    return mixed(total)


def numbered_copies(shingles: np.ndarray) -> np.ndarray:
    """A multiset as a set: the second, third ... copy of a shingle becomes a value of its own; sorted by shingle."""
    ordered = np.sort(shingles)
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)
    copy = np.arange(len(ordered)) - np.repeat(starts, np.diff([*starts, len(ordered)]))
    return mixed(ordered + copy.astype(np.uint64) * _ODD)

"""Language-model scores from word classes.

Exchange clustering assigns words to classes so that class bigrams of the corpus become likeliest; a word then costs the
transition from the class before it and its emission from its own class.  All counts are over all learning texts.

Words of at least ``least_count`` tokens are clustered, however many they are; all rarer words form one further class with
add-one emissions, and the end of a text is a class of its own.  The classes grow with the clustered words.

Words are known by 64-bit hashes: among ten million kinds of words two fall together with a probability of 3 in a million.
The driver and each worker hold some 20 bytes a clustered word.  The word pairs lie in a table dealt out by word, each pair
with both of its words, so a round of exchange reads it where it lies and shuffles nothing.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaloom.llm.batches import WordTable, slices, texts_of, written

#: Distinct words or word pairs that a task gathers before it hands them on.
GATHERED = 250_000
#: Tokens whose pairs a task gathers before it hands them on.
GATHERED_TOKENS = 1_000_000
#: Tokens for each part of the pair table, and the most parts.
PART_TOKENS, PARTS = 500_000, 2048
#: Counts up to this one change logarithms by matrix products.
SMALL = 6
#: Words whose best classes are sought at once.
BLOCK = 2000
_BOOKS: dict[str, "WordBook"] = {}
#: The end of a text; no word holds a blank.
END = b" "


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A to Z in lower case."""
    return text.encode().lower().split()


def count_words(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all rows: every word's tokens, and one end token a text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            made = [pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(made, names=["word", "c"])

        for batch in slices(batches, "text"):
            for text in texts_of(batch, "text"):
                held.update(words_of(text))
            held[END] += batch.num_rows
            if len(held) > GATHERED:
                yield handed_on()
        if held:
            yield handed_on()

    parts = texts.select(F.col(text_col).alias("text")).mapInArrow(apply, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


class WordBook:
    """Numbers of the known words in one worker: 0 is any other word, clustered words come first, ``end`` is the end."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.table = WordTable(self._found, 150_000)

    def _found(self, words: list[bytes]) -> list[int]:
        if not len(self.hashes):
            return [0] * len(words)
        asked = hashes_of(words)
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        return np.where(self.hashes[at] == asked, self.order[at] + 1, 0).tolist()

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Numbers of all words of all texts, word counts of the texts, the words."""
        words = [words_of(t) for t in texts]
        get = self.table.covering(words).__getitem__
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return np.fromiter((get(w) for ws in words for w in ws), np.int64, int(sizes.sum())), sizes, words


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _book(key: str, hashes: np.ndarray) -> WordBook:
    if key not in _BOOKS:
        _BOOKS.clear()
        _BOOKS[key] = WordBook(hashes)
    return _BOOKS[key]


def _with_ends(values: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``values`` with ``end`` after each text, and before the first; where each text's tokens start."""
    after = np.insert(values, np.cumsum(sizes), end)
    return np.concatenate([[end], after]), np.cumsum(sizes + 1) - (sizes + 1)


def _planes(values: np.ndarray) -> bytes:
    """Integers byte by byte, all lowest bytes first: the upper ones compress away."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``times`` of each."""
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(times, starts) if len(starts) else times


@dataclass
class Pairs:
    """Bigrams over the numbers 0 (a rare word), 1 to ``size`` and ``size`` + 1 (the end), dealt out by word.

    ``table``: a row for each part, the numbers of equal remainder by ``parts``.  A key is place in the part x ``span`` + the
    other number; ``keys0`` are pairs that the part's word begins, ``keys1`` those that it ends, ``times`` their counts.
    """

    table: DataFrame
    size: int
    parts: int

    @property
    def span(self) -> int:
        return self.size + 2

    @property
    def places(self) -> int:
        return -(-self.span // self.parts)


def count_pairs(texts: DataFrame, hashes: np.ndarray, parts: int, text_col: str = "text") -> Pairs:
    """Bigrams of all rows over the words of these hashes."""
    shared, key = texts.sparkSession.sparkContext.broadcast(hashes), uuid.uuid4().hex
    made = Pairs(texts, len(hashes), parts)
    span, places, end = made.span, made.places, len(hashes) + 1
    names = ["part", "side", "keys", "times"]

    def row(part: int, side: int, keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        told = [pa.array([part]), pa.array([side]), pa.array([_planes(np.diff(keys, prepend=0))], pa.binary()), pa.array([_planes(times)], pa.binary())]
        return pa.RecordBatch.from_arrays(told, names=names)

    def handed_on(streams: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        before, word = (np.concatenate([s[k] for s in streams]) for k in (0, 1))
        for side, (own, other) in enumerate(((before, word), (word, before))):
            keys, times = np.unique((own % parts * places + own // parts) * span + other, return_counts=True)
            edges = np.searchsorted(keys, np.arange(parts + 1) * (places * span))
            for part in np.flatnonzero(np.diff(edges)).tolist():
                held = slice(edges[part], edges[part + 1])
                yield row(part, side, keys[held] - part * places * span, times[held])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams, held = [], 0
        for batch in slices(batches, "text"):
            values, sizes, _ = _book(key, shared.value).numbered(texts_of(batch, "text"))
            stream, _ = _with_ends(values, sizes, end)
            streams.append((stream[:-1], stream[1:]))
            held += len(stream)
            if held > GATHERED_TOKENS:
                yield from handed_on(streams)
                streams, held = [], 0
        if streams:
            yield from handed_on(streams)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for part, side, keys, times in zip(*(batch.column(c).to_pylist() for c in names)):
                found.setdefault(part, ([], []))[side].append((keys, times))
        while found:
            part, sides = found.popitem()
            told = [pa.array([part])]
            for blobs in sides:
                none = np.zeros(0, np.int64)
                keys = np.concatenate([none, *(np.cumsum(_from_planes(k)) for k, _ in blobs)])
                keys, times = _summed(keys, np.concatenate([none, *(_from_planes(t) for _, t in blobs)]))
                told += [pa.array([_planes(np.diff(keys, prepend=0))], pa.binary()), pa.array([_planes(times)], pa.binary())]
            yield pa.RecordBatch.from_arrays(told, names=["part", "keys0", "times0", "keys1", "times1"])

    gathered = texts.select(F.col(text_col).alias("text")).mapInArrow(apply, "part long, side long, keys binary, times binary")
    dealt = gathered.repartition(parts, "part").mapInArrow(merged, "part long, keys0 binary, times0 binary, keys1 binary, times1 binary")
    made.table = written(dealt, "pairs")
    return made


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_move(follow: np.ndarray, lead: np.ndarray, own: float, now: int, table: np.ndarray, movable: int) -> tuple[int, float]:
    """The class, of the first ``movable``, in which a word raises the log-likelihood most, and by how much.

    ``follow`` and ``lead``: tokens of each class after and before the word; ``own``: its pairs with itself; ``table``: class bigrams.
    """
    follow, lead = follow.astype(np.float64), lead.astype(np.float64)
    follow[now] -= own
    lead[now] -= own
    rest = table.astype(np.float64)
    rest[now] -= follow
    rest[:, now] -= lead
    rest[now, now] -= own
    across = _xlogx(rest + follow) - _xlogx(rest)
    down = _xlogx(rest + lead[:, None]) - _xlogx(rest)
    diagonal = np.diag(rest)
    gain = across.sum(axis=1) - np.diag(across) + down.sum(axis=0) - np.diag(down)
    gain += _xlogx(diagonal + follow + lead + own) - _xlogx(diagonal)
    for margin, tokens in ((rest.sum(axis=1) + lead, follow.sum() + own), (rest.sum(axis=0) + follow, lead.sum() + own)):
        gain -= _xlogx(margin + tokens) - _xlogx(margin)
    target = int(gain[:movable].argmax())
    return (target, float(gain[target] - gain[now])) if gain[target] > gain[now] + 1e-9 else (now, 0.0)


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of class bigrams up to a constant of the corpus."""
    return float(_xlogx(table.astype(np.float64)).sum() - _xlogx(table.sum(axis=1).astype(np.float64)).sum() - _xlogx(table.sum(axis=0).astype(np.float64)).sum())


def best_moves(follow: np.ndarray, lead: np.ndarray, own: np.ndarray, now: np.ndarray, table: np.ndarray, movable: int) -> np.ndarray:
    """``best_move`` of many words (rows of ``follow`` and ``lead``) against one table."""
    rows, table = np.arange(len(now)), table.astype(np.float64)
    follow, lead = follow.astype(np.float64), lead.astype(np.float64)
    follow[rows, now] -= own
    lead[rows, now] -= own
    diagonal = np.diag(table)
    gain = _xlogx(diagonal + follow + lead + own[:, None]) - _xlogx(diagonal)
    kept = diagonal[now] - follow[rows, now] - lead[rows, now] - own
    at_home = _xlogx(diagonal[now]) - _xlogx(kept)
    for mine, others, cells in ((follow, lead, table), (lead, follow, table.T)):
        # cells[c, j]: tokens of class c beside class j on this side
        logs = _xlogx(cells)
        for n in range(1, SMALL + 1):
            gain += (mine == n).astype(np.float64) @ (_xlogx(cells + n) - logs).T
        word, j = np.nonzero(mine > SMALL)
        for at in range(0, len(word), 20_000):
            w, k = word[at : at + 20_000], j[at : at + 20_000]
            raised = _xlogx(cells.T[k] + mine[w, k][:, None]) - logs.T[k]
            starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            gain[w[starts]] += np.add.reduceat(raised, starts)
        # the word has left its class: cells beside that class, and the class itself
        beside, here = cells.T[now], mine[rows, now][:, None]
        gain += _xlogx(beside - others + here) - _xlogx(beside - others) - _xlogx(beside + here) + _xlogx(beside)
        gain -= _xlogx(diagonal + mine) - _xlogx(diagonal)
        left = _xlogx(cells[now]) - _xlogx(cells[now] - mine)
        left[rows, now] = 0
        at_home += left.sum(axis=1)
        margin, tokens = cells.sum(axis=1), mine.sum(axis=1) + own
        gain -= _xlogx(margin + tokens[:, None]) - _xlogx(margin)
        at_home -= _xlogx(margin[now]) - _xlogx(margin[now] - tokens)
    gain[rows, now] = at_home
    target = gain[:, :movable].argmax(axis=1)
    return np.where(gain[rows, target] > at_home + 1e-9, target, now)


def exchange(pairs: Pairs, classes: int, rounds: int | None, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(class of each number, class bigrams) after exchange.

    Number 1 is the most frequent word.  In a round every second word looks for its best class against the table of the
    round, in tasks over words; the last table that raised the likelihood wins.  Rounds end when two of them, so all words,
    gain less than ``tolerance`` a token, or after ``rounds``.  What tasks return is a class for each clustered word, 4 bytes
    each, and a cell for each pair of classes.
    """
    context, size, parts, span, places = pairs.table.sparkSession.sparkContext, pairs.size, pairs.parts, pairs.span, pairs.places
    total = classes + 2
    assigned = np.empty(span, np.int32)
    assigned[1 : size + 1] = np.arange(size) % classes
    assigned[[0, size + 1]] = classes, classes + 1

    def cells_of(row: dict, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.cumsum(_from_planes(row[f"keys{side}"]))
        return keys // span, keys % span, _from_planes(row[f"times{side}"])

    def numbers_of(part: int, turn: int) -> np.ndarray:
        """The words of a part that look for a class in this round."""
        numbers = np.arange(turn % 2, places, 2) * parts + part
        return numbers[(numbers >= 1) & (numbers <= size)]

    def table_of(assigned: np.ndarray) -> np.ndarray:
        shared = context.broadcast(assigned)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classed, table = shared.value.astype(np.int64), np.zeros(total * total)
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    place, other, times = cells_of(row, 0)
                    table += np.bincount(classed[place * parts + row["part"]] * total + classed[other], times, total * total)
            cell = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(table[cell].astype(np.int64))], names=["cell", "n"])

        table = np.zeros(total * total, np.int64)
        seen = pairs.table.select("part", "keys0", "times0").mapInArrow(apply, "cell long, n long")
        for r in seen.groupBy("cell").agg(F.sum("n").alias("n")).collect():
            table[r.cell] = r.n
        return table.reshape(total, total)

    def moved(assigned: np.ndarray, table: np.ndarray, turn: int) -> np.ndarray:
        shared = context.broadcast((assigned, table))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            assigned, table = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    numbers = numbers_of(row["part"], turn)
                    at = np.full(places, -1)
                    at[numbers // parts] = np.arange(len(numbers))
                    sides, own = [], np.zeros(len(numbers))
                    for side in (0, 1):
                        place, other, times = cells_of(row, side)
                        same = other == place * parts + row["part"]
                        place = at[place]
                        ours = place >= 0
                        own[place[ours & same]] = times[ours & same]
                        cells = place[ours] * total + assigned[other[ours]]
                        sides.append(np.bincount(cells, times[ours], len(numbers) * total).reshape(-1, total))
                    target = assigned[numbers]
                    for j in range(0, len(numbers), BLOCK):
                        held = slice(j, j + BLOCK)
                        target[held] = best_moves(sides[0][held], sides[1][held], own[held], target[held], table, classes)
                    yield pa.RecordBatch.from_arrays([pa.array([row["part"]]), pa.array([target.astype("<i4").tobytes()], pa.binary())], names=["part", "target"])

        fresh = assigned.copy()
        for r in pairs.table.mapInArrow(apply, "part long, target binary").collect():
            fresh[numbers_of(r.part, turn)] = np.frombuffer(r.target, "<i4")
        return fresh

    best, best_table, values = assigned, None, []
    while True:
        table = table_of(assigned)
        values.append(likelihood(table))
        if values[-1] >= max(values):
            best, best_table = assigned, table
        if not size or rounds is not None and len(values) > rounds:
            break
        if len(values) > 2 and max(values[-2:]) - max(values[:-2]) < tolerance * table.sum():
            break
        assigned = moved(assigned, table, len(values) - 1)
    return best, best_table


@dataclass
class ClassModel:
    """Counts of the learning texts, and the class model over the clustered words."""

    counts: DataFrame
    tokens: int
    distinct: int
    hashes: np.ndarray
    word_counts: np.ndarray
    clustered: int
    classes: np.ndarray
    table: np.ndarray
    smoothing: float = 0.1
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def words(self) -> list[bytes]:
        """The known words in the order of their numbers, gathered for inspection."""
        least = int(self.word_counts.min(initial=1 << 62))
        found = [bytes(r.word) for r in self.counts.where((F.col("c") >= least) & (F.col("word") != F.lit(END))).select("word").collect()]
        place = {h: i for i, h in enumerate(self.hashes.tolist())}
        return sorted(found, key=lambda w: place[xxhash.xxh3_64_intdigest(w)])

    @property
    def rare(self) -> tuple[int, int]:
        """Tokens and distinct words of the class of all other words (the end is neither)."""
        ends = int(self.table.sum(axis=0)[-1])
        return self.tokens - ends - int(self.word_counts[: self.clustered].sum()), max(0, self.distinct - (ends > 0) - self.clustered)

    def transitions(self) -> np.ndarray:
        """log10 P(class | class before), add-``smoothing``."""
        smooth = self.table + self.smoothing
        return np.log10(smooth / smooth.sum(axis=1, keepdims=True))

    def emissions(self) -> np.ndarray:
        """log10 P(word | its class) of the known words; index 0, any unlisted word, still lacks log10(c + 1)."""
        of_class = np.maximum(np.bincount(self.classes[1 : self.clustered + 1], self.word_counts[: self.clustered], len(self.table)), 1)
        tokens, kinds = self.rare
        values = np.log10(np.asarray([1, *self.word_counts], np.float64) + 1) - np.log10(tokens + kinds + 1)
        values[0] = -np.log10(tokens + kinds + 1)
        values[1 : self.clustered + 1] = np.log10(self.word_counts[: self.clustered]) - np.log10(of_class[self.classes[1 : self.clustered + 1]])
        return values


def _known(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the words of at least ``least`` tokens, the most frequent first: 16 bytes a word."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [hashes_of(batch.column("word").to_pylist()).astype("<u8").tobytes(), np.asarray(batch.column("c").to_pylist(), "<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in told], names=["hashes", "counts"])

    rows = counts.where((F.col("c") >= least) & (F.col("word") != F.lit(END))).mapInArrow(apply, "hashes binary, counts binary").collect()
    hashes, found = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in ((0, "<u8"), (1, "<i8")))
    order = np.lexsort((hashes, -found))
    return hashes[order], found[order]


def classes_for(words: int) -> int:
    """Classes for so many clustered words: their cube root, 48 at least."""
    return max(48, round(words ** (1 / 3)))


def fit(
    texts: DataFrame, text_col: str = "text", classes: int | None = None, rounds: int | None = None, least_share: float = 0.0,
    listed_share: float = 1 / 500_000, least_count: int = 5, tolerance: float = 0.002,
) -> ClassModel:
    """Learn from all rows of ``texts`` (null texts are empty).

    Words of at least ``least_count`` tokens (and ``least_share`` of all, if given) are clustered, into ``classes_for`` classes
    by default, until a word gains less than ``tolerance`` (natural logarithm, a token) or for ``rounds``.  They and words of
    ``listed_share`` of the tokens are known to every worker; the counts of all words stay a table.  An empty table gives a
    model in which every word is unknown.
    """
    counts = written(count_words(texts, text_col), "words")
    total = counts.agg(F.sum("c").alias("tokens"), F.count("*").alias("distinct")).head()
    tokens, distinct = int(total.tokens or 0), int(total.distinct)
    floor = max(least_count, least_share * tokens)
    hashes, word_counts = _known(counts, min(floor, listed_share * tokens))
    clustered = int((word_counts >= floor).sum())
    pairs = count_pairs(texts, hashes[:clustered], min(PARTS, max(16, tokens // PART_TOKENS)), text_col)
    assigned, table = exchange(pairs, classes or classes_for(clustered), rounds, tolerance)
    return ClassModel(counts, tokens, distinct, hashes, word_counts, clustered, assigned, table)


def score(docs: DataFrame, model: ClassModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every whole text, each row for itself.

    ``base_score`` is the add-one unigram log10 probability, ``score`` that of the class model, ``perplexity`` 10 to the mean
    negative ``score`` of a token.  Null texts are their end token alone.  Words that workers know are scored where the text
    is; the others, all of them rare, meet their counts in one shuffle and sum up by row.
    """
    end_count = int(model.table.sum(axis=0)[-1])
    whole = np.log10(model.tokens + model.distinct + 1)
    listed = np.log10(np.asarray([0, *model.word_counts], np.float64) + 1)
    class_of = np.full(len(model.hashes) + 1, len(model.table) - 2, np.int32)
    class_of[1 : model.clustered + 1] = model.classes[1 : model.clustered + 1]
    shared = docs.sparkSession.sparkContext.broadcast((model.hashes, model.transitions(), model.emissions(), listed, class_of))
    key, end = model.key + "s", len(model.table) - 1
    end_base = np.log10(end_count + 1)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, transitions, emissions, listed, class_of = shared.value
        book = _book(key, hashes)
        row = TaskContext.get().partitionId() << 34
        for batch in slices(batches, "text"):
            numbers, sizes, spelled = book.numbered(texts_of(batch, "text"))
            stream, starts = _with_ends(class_of[numbers], sizes, end)
            steps = np.add.reduceat(transitions[stream[:-1], stream[1:]], starts) if len(sizes) else np.zeros(0)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            summed = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)])[edges])
            base = summed(listed[numbers]) + end_base - (sizes + 1) * whole
            value = steps + summed(emissions[numbers])
            known = summed(numbers > 0).astype(np.int64) + (end_count > 0)
            unlisted = numbers == 0
            rows, rare, times = [], [], []
            for i, own in enumerate(spelled):
                found = Counter(own[j] for j in np.flatnonzero(unlisted[edges[i] : edges[i + 1]]).tolist())
                rows += [i] * len(found)
                rare += found.keys()
                times += found.values()
            places = np.concatenate([np.arange(len(sizes)), np.asarray(rows, np.int64)])
            more = len(rare)
            padded = lambda v: pa.array(np.concatenate([v, np.zeros(more, v.dtype)]))
            # a row's own sums travel under a key that no word can be: it spreads them evenly
            keys = [b" %d" % (row + i) for i in range(len(sizes))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(places)), pa.array(row + places), pa.array([*keys, *rare], pa.binary()),
                    pa.array(np.concatenate([np.zeros(len(sizes), np.int64), np.asarray(times, np.int64)])),
                    padded(sizes + 1), padded(known), padded(base), padded(value),
                ],
                names=["id", "row", "word", "times", "n_tokens", "n_known", "base", "value"],
            )
            row += len(sizes)

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    parts = named.mapInArrow(apply, f"id {kind}, row long, word binary, times long, n_tokens long, n_known long, base double, value double")
    met = parts.join(model.counts, "word", "left")
    gain = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)
    sums = met.groupBy("id", "row").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + gain).alias("base_score"), F.sum(F.col("value") + gain).alias("score"),
    )
    return sums.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )

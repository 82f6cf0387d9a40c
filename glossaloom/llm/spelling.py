"""Spelling variants by a dictionary of trie-node pairs.

The prefixes of all words are the nodes of a forward trie, their suffixes those of a reversed one; both are numbered.  A word
gives, for every place, the pair (node before the letter, node after it) with the letter skipped, and for every gap the pair
around it.  Two words share a skipped pair exactly if they differ by one replaced letter; a skipped pair of one is a gap pair
of the other exactly if a letter was inserted or deleted.  At most one word of each letter meets in a pair, so no group grows
with the data.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaloom.llm.batches import slices, texts_of, written

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One run in so many loses a letter before it is counted.
NOISE = 97
#: Words of a task that are counted before they are handed on.
COUNTED_AT_ONCE = 200_000
#: Bits of a node number below the part's number.
_LOCAL = 40

_LETTERS = bytes(c for c in range(256) if c in range(65, 91) or c in range(97, 123) or c >= 0xC0)
#: Every Latin-1 character that is no letter of a run as a space, A to Z in lower case.
_RUNS = bytes(c + 32 if c in range(65, 91) else c if c in _LETTERS else 32 for c in range(256))


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = NOISE, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT
) -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0 to U+00FF, A to Z lower-cased, of at least ``letters`` and ``count`` occurrences.

    With ``noise``, a run whose crc32 h of ``<id>:<run>`` it divides loses its letter h % length first; runs of a document
    without an id lose none.  A null text has no run; repeated rows count again.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        for part in slices(batches, "text"):
            for number, text in zip(part.column("id").to_pylist(), texts_of(part, "text")):
                # A character beyond Latin-1 becomes "?", which is no letter either.
                runs = Counter(text.encode("latin-1", "replace").translate(_RUNS).split())
                salt = zlib.crc32(f"{number}:".encode())
                for run, times in runs.items():
                    if len(run) < letters:
                        continue
                    if noise and number is not None:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), salt)
                        if h % noise == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < letters:
                                continue
                    totals[run] += times
            if len(totals) >= COUNTED_AT_ONCE:
                yield _counts(totals)
                totals = Counter()
        yield _counts(totals)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def _counts(totals: Counter) -> pa.RecordBatch:
    words = pa.array([w.decode("latin-1") for w in totals], pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(totals.values(), pa.int64())], ["word", "n"])


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of ``words`` (distinct word, n).

    Near: one code point inserted, deleted or replaced.  ``form`` is the near word of largest n (ties: the first in code-point
    order) if its n is at least twice the word's, ``root`` what forms lead to.  n at least doubles along forms, so the rounds
    that follow them grow with the logarithm of the logarithm of the largest n.
    """
    words = written(words.select("word", "n"), "counts")
    # Sorted by ranges, so numbers stand in code-point order and can settle ties.
    words = words.repartitionByRange("word").sortWithinPartitions("word").withColumn("no", F.monotonically_increasing_id())
    words = written(words.withColumn("part", F.spark_partition_id()), "words")
    back = words.select("no", F.reverse("word").alias("word")).repartitionByRange("word").withColumn("part", F.spark_partition_id())
    met = _near(_trie(words), _trie(written(back, "reversed")), words)
    best = written(met.groupBy("no").agg(F.sum("near").alias("n_near"), F.max("best").alias("best")), "near")

    chosen = words.select("word", "n", "no").join(best, "no", "left").withColumn("best_no", -F.col("best.minus"))
    chosen = chosen.withColumn("form_no", F.when(F.col("best.n") >= 2 * F.col("n"), F.col("best_no"))).drop("best_no", "best")
    chosen = written(chosen, "forms")
    ends = _ends(chosen.where("form_no is not null").select("no", F.col("form_no").alias("end")))
    named = chosen.join(ends, "no", "left")
    spelled = words.select("word", "n", "no")
    forms = spelled.select(F.col("no").alias("form_no"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    roots = spelled.select(F.col("no").alias("end"), F.col("word").alias("root"))
    return named.join(forms, "form_no", "left").join(roots, "end", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def _trie(words: DataFrame) -> DataFrame:
    """(no, path, fresh): the trie nodes along each word, from the root, and whether each letter differs from the one before.

    ``words``: no, word and part, parts being ranges of the sorted words.  A prefix that occurs in several parts is a prefix of
    the first word of a part; those are numbered alike everywhere from the first words, of which the driver holds one per
    range.  All other nodes lie in one part, where a new number is given at each letter not shared with the word before.
    """
    firsts = sorted((r.part, r.first) for r in words.groupBy("part").agg(F.min("word").alias("first")).collect())
    place = {part: k for k, (part, _) in enumerate(firsts)}
    marks = [first for _, first in firsts]
    shared = [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(marks, marks[1:])]

    def of_mark(k: int) -> list[int]:
        """Numbers along the first word of the k-th part: a prefix belongs to the earliest part whose first word has it."""
        owner, reach = [k] * (len(marks[k]) + 1), len(marks[k])
        for j in range(k, 0, -1):
            reach = min(reach, shared[j])
            owner[: reach + 1] = [j - 1] * (reach + 1)
            if not reach:
                break
        owner[0] = 0
        return [-1 - (part << _LOCAL) - depth for depth, part in enumerate(owner)]

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, path, last, following, given = None, "", [], [], "", 0
        for batch in batches:
            paths, fresh = [], []
            for here, word in zip(batch.column("part").to_pylist(), batch.column("word").to_pylist()):
                if here != part:
                    k, part, given = place[here], here, 0
                    following = marks[k + 1] if k + 1 < len(marks) else ""
                    last = of_mark(k + 1) if following else []
                    path = of_mark(k)
                else:
                    same = len(os.path.commonprefix([before, word]))
                    ahead = len(os.path.commonprefix([following, word]))
                    path = path[: same + 1]
                    path += last[len(path) : ahead + 1]
                    new = len(word) + 1 - len(path)
                    path += range((k << _LOCAL) + given, (k << _LOCAL) + given + new)
                    given += new
                before = word
                paths.append(path)
                fresh.append([True, *[a != b for a, b in zip(word, word[1:])]])
            made = [batch.column("no"), pa.array(paths, pa.list_(pa.int64())), pa.array(fresh, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(made, ["no", "path", "fresh"])

    dealt = words.select("part", "no", "word").repartition("part").sortWithinPartitions("part", "word")
    return dealt.mapInArrow(numbered, "no long, path array<long>, fresh array<boolean>")


def _near(forward: DataFrame, backward: DataFrame, words: DataFrame) -> DataFrame:
    """(no, near, best): for each pair a word meets others in, how many are near and the best of them by (n, -no).

    A letter deleted anywhere in a run of equal letters gives the same word, so only the first of a run counts as deleted.
    """
    both = forward.join(backward.select("no", F.reverse("path").alias("back")), "no").join(words.select("no", "n"), "no")
    size = F.size("fresh")
    skipped = F.zip_with(F.arrays_zip(F.slice("path", F.lit(1), size).alias("p"), F.slice("back", F.lit(2), size).alias("s")), "fresh", lambda pair, fresh: F.struct(
        pair["p"].alias("p"), pair["s"].alias("s"), fresh.alias("fresh"), F.lit(False).alias("gap")))
    gaps = F.zip_with("path", "back", lambda p, s: F.struct(p.alias("p"), s.alias("s"), F.lit(True).alias("fresh"), F.lit(True).alias("gap")))
    pairs = both.select("no", "n", F.explode(F.concat(skipped, gaps)).alias("pair")).select("no", "n", "pair.*")
    groups = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("n", "no", "fresh", "gap")).alias("met")).where(F.size("met") > 1)

    def others(own):
        near = F.filter("met", lambda x: F.when(own["gap"], ~x["gap"] & x["fresh"]).when(x["gap"], own["fresh"]).otherwise(x["no"] != own["no"]))
        ranks = F.transform(near, lambda x: F.struct(x["n"].alias("n"), (-x["no"]).alias("minus")))
        return F.struct(own["no"].alias("no"), F.size(ranks).alias("near"), F.array_max(ranks).alias("best"))

    return groups.select(F.explode(F.transform("met", others)).alias("own")).select("own.*").where("near > 0")


def _ends(links: DataFrame) -> DataFrame:
    """(no, end): where chains of ``links`` (no, end), which have no cycle, end; each round doubles the way gone."""
    links = written(links, "links")
    while True:
        onward = links.select(F.col("no").alias("end"), F.col("end").alias("further"))
        step = links.join(onward, "end", "left").select("no", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved"))
        step = written(step, "links")
        links = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return links

"""Quality rules: fixed limits, then robust multivariate outliers within each language and source.

Word, symbol, line and repetition counts of a text are transformed to a vector.  For every language and source the minimum
covariance determinant estimate of centre and scatter is found by concentration steps over all of its rows, and vectors
too far from the centre in Mahalanobis distance are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.llm.batches import output, slices, texts_of, written

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Spread that each transformed statistic has at least: what documents may differ by without being odd.
FLOORS = (0.06, 0.03, 0.10, 0.10, 1.0)
_SIZE = len(FLOORS)


def word_codes(words: list) -> np.ndarray:
    """Each word as the number of its first appearance among distinct words."""
    numbers: dict = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def repeated_words(codes: np.ndarray) -> int:
    """Words inside windows of eight words that occur twice or more in a text of coded words."""
    words = len(codes)
    if words <= WINDOW:
        return 0
    kinds, width = int(codes.max()) + 1, 1
    while width < WINDOW:  # exact numbers of runs of 2, 4 and 8 words
        runs = codes[:-width] * kinds + codes[width:]
        values, codes, counts = np.unique(runs, return_inverse=True, return_counts=True)
        kinds, width = len(values), width * 2
        if kinds == len(runs):
            return 0
    starts = np.flatnonzero(counts[codes] > 1)
    edges = np.zeros(words + 1, np.int64)
    edges[starts] += 1
    edges[starts + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(edges)))


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """``COUNTS`` of one whole text; words are runs of characters other than ASCII white space."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(word_codes(words)),
    )


def count_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *kept: str) -> DataFrame:
    """(id, kept columns, counts) for every row; null texts have no words."""
    schema = output(docs, id_col)
    for name in kept:
        schema = schema.add(docs.schema[name])
    for name in COUNTS:
        schema = schema.add(name, "long")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = np.asarray([text_counts(t) for t in texts_of(batch, "text")], np.int64).reshape(-1, len(COUNTS))
            carried = [c for name, c in zip(batch.schema.names, batch.columns) if name != "text"]
            yield pa.RecordBatch.from_arrays([*carried, *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=schema.fieldNames())

    return docs.select(id_col, *kept, F.col(text_col).alias("text")).mapInArrow(apply, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def transformed() -> list[Column]:
    """The vector of a text; counts are smoothed so that a short text is not odd by chance."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        F.log((chars + 250) / (n + 50)),
        F.sqrt(F.col("n_symbols") / (chars + 150)),
        F.sqrt(F.col("n_dup_lines") / (n / 10 + 10)),
        F.sqrt(F.col("n_repeat_words") / (n + 40)),
        F.log1p(n),
    ]


def chi_square(share: float, degrees: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    z = NormalDist().inv_cdf(share)
    return degrees * (1 - 2 / (9 * degrees) + z * (2 / (9 * degrees)) ** 0.5) ** 3


def _distance(x: Column, centre: Column, inverse: Column) -> Column:
    off = [x[i] - centre[i] for i in range(_SIZE)]
    return reduce(add, (off[i] * off[j] * inverse[i * _SIZE + j] for i in range(_SIZE) for j in range(_SIZE)))


def _estimates(moments: DataFrame) -> DataFrame:
    """(group, n, centre, inverse scatter, factor) from the moments of each group's half."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for r in f.itertuples(index=False):
                centre = np.asarray(r.sums) / r.held
                scatter = np.asarray(r.products).reshape(_SIZE, _SIZE) / r.held - np.outer(centre, centre)
                inverse = np.linalg.inv(scatter + np.diag(np.square(FLOORS)))
                made.append((r.group, r.n, centre.tolist(), inverse.reshape(-1).tolist()))
            yield pd.DataFrame(made, columns=["group", "n", "centre", "inverse"])

    return moments.mapInPandas(solve, "group string, n long, centre array<double>, inverse array<double>")


def _concentrated(rows: DataFrame, estimates: DataFrame, share: float) -> DataFrame:
    """One concentration step: the estimates of each group's ``share`` of rows nearest to the present centre."""
    near = rows.join(estimates, "group").select("group", "x", _distance(F.col("x"), F.col("centre"), F.col("inverse")).alias("d"))
    limits = near.groupBy("group").agg(F.percentile_approx("d", share, 1000).alias("limit"), F.count("*").alias("n"))
    limits = written(limits, "mcd")
    held = near.join(limits, "group").where("d <= limit")
    x = [F.col("x")[i] for i in range(_SIZE)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(_SIZE) for j in range(i, _SIZE)]
    moments = held.groupBy("group").agg(F.first("n").alias("n"), F.count("*").alias("held"), *sums, *products)
    return _estimates(moments.select(
        "group", "n", "held", F.array(*(f"s{i}" for i in range(_SIZE))).alias("sums"),
        F.array(*(f"p{min(i, j)}_{max(i, j)}" for i in range(_SIZE) for j in range(_SIZE))).alias("products"),
    ))


def minimum_covariance(rows: DataFrame, share: float = 0.75, steps: int = 3) -> DataFrame:
    """(group, n, centre, inverse): minimum covariance determinant estimates over all rows (group, x) of each group.

    The start is each group's median and median deviation; ``steps`` concentration steps follow.  Every step is an
    aggregation that combines before it shuffles, so a group may hold any share of the rows; what is joined to the rows is a
    written row for each group, which Spark broadcasts while its size allows.
    """
    middle = rows.groupBy("group").agg(
        F.count("*").alias("n"), F.array(*(F.percentile_approx(F.col("x")[i], 0.5, 1000) for i in range(_SIZE))).alias("centre")
    )
    middle = written(middle, "mcd")
    off = rows.join(middle, "group")
    spread = off.groupBy("group").agg(
        F.first("n").alias("n"), F.first("centre").alias("centre"),
        *(F.percentile_approx(F.abs(F.col("x")[i] - F.col("centre")[i]), 0.5, 1000).alias(f"m{i}") for i in range(_SIZE)),
    )
    zero = F.lit(0.0)
    scale = [1 / (F.pow(F.col(f"m{i}") * 1.4826, 2) + FLOORS[i] ** 2) for i in range(_SIZE)]
    estimates = written(spread.select(
        "group", "n", "centre", F.array(*(scale[i] if i == j else zero for i in range(_SIZE) for j in range(_SIZE))).alias("inverse")
    ), "mcd")
    for _ in range(steps):
        estimates = written(_concentrated(rows, estimates, share), "mcd")
    return estimates


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    share: float = 0.75, steps: int = 3, least_rows: int = 100, tail: float = 1e-6,
) -> DataFrame:
    """(id, counts, base_failed, distance, kept) for every row of ``docs``.

    ``base_failed``: under 20 words, or over 30 of 100 words in repeated windows.  ``distance`` is the squared Mahalanobis
    distance to the estimate of the row's language and source, of its language if those have under ``least_rows`` rows
    that pass the base, of all rows if that has too few, null if even those are too few (then nothing is odd).  A row is
    kept if the base passes and its distance is within the chi-square quantile of ``1 - tail``.

    Null or empty texts have no words and fail; null languages or sources are groups of their own; repeated rows each get
    a row; other columns are ignored.  One pass over the texts; the rest works on the counts.
    """
    named = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        *(F.concat(F.lit(f"{level} "), F.to_json(F.struct(*(F.col(c).alias(str(i)) for i, c in enumerate(columns))))).alias(f"g{level}")
          for level, columns in ((2, (lang_col, source_col)), (1, (lang_col,)))),
    )
    table = written(count_texts(named, "id", "text", "g2", "g1"), "counts").withColumn("g0", F.lit("0"))
    table = table.withColumn("x", F.array(*transformed())).withColumn("base_failed", base_failed())
    levels = ("g2", "g1", "g0")
    passed = table.where("not base_failed")
    rows = passed.select(F.explode(F.array(*levels)).alias("group"), "x")
    estimates = minimum_covariance(rows, share, steps).where(F.col("n") >= least_rows)
    for level in levels:
        found = estimates.where(F.col("group").startswith(level[1])).select(
            F.col("group").alias(level), F.col("centre").alias(f"c{level}"), F.col("inverse").alias(f"i{level}")
        )
        table = table.join(F.broadcast(found) if level == "g0" else found, level, "left")
    distance = F.coalesce(*(_distance(F.col("x"), F.col(f"c{g}"), F.col(f"i{g}")) for g in levels))
    near = F.coalesce(F.col("distance") <= chi_square(1 - tail, _SIZE), F.lit(True))
    return (
        table.withColumn("distance", distance)
        .select(F.col("id").alias(id_col), *COUNTS, "base_failed", "distance", (~F.col("base_failed") & near).alias("kept"))
    )

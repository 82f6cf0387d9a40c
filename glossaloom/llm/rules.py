"""Quality by a sparse ensemble of rules.

Trees are grown on statistics of labelled texts, every path from a root becomes a conjunctive rule, a lasso logistic
regression gives few of the rules a weight, and the weighted rules are compiled into one Spark column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.llm.batches import output, slices, texts_of, written
from glossaloom.llm.outliers import SPACES, repeated_words, word_codes

STATISTICS = (
    "words", "word_length", "symbol_share", "digit_share", "upper_share", "stop_share", "bar_share", "distinct_share", "top_share",
    "repeat_share", "dup_line_share", "line_words", "short_share", "long_share",
)
_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEeInfity]+)\)$")
#: A rule: conditions (statistic, whether above, threshold), all of which must hold.
Rule = tuple[tuple[int, bool, float], ...]


def text_statistics(text: str) -> tuple[float, ...]:
    """``STATISTICS`` of one whole text; shares are 0 where there is nothing to share."""
    words = text.encode().split()
    n, chars = len(words), len(text) - sum(map(text.count, SPACES))
    codes = word_codes(words)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    lengths = np.fromiter(map(len, words), np.int64, n)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    among = np.bincount(np.minimum(points, 128), minlength=129)
    per_char, per_word = 1 / max(chars, 1), 1 / max(n, 1)
    return (
        float(n), chars * per_word, float(among[[35, 42, 36, 37, 38, 124, 60, 62]].sum()) * per_char, float(among[48:58].sum()) * per_char,
        float(among[65:91].sum()) * per_char, float(among[[33, 46, 63]].sum()) * per_word, float(among[124]) * per_word,
        (int(codes.max()) + 1) * per_word if n else 0.0, float(np.bincount(codes).max()) * per_word if n else 0.0,
        repeated_words(codes) * per_word, (len(lines) - len(set(lines))) / max(len(lines), 1), n / max(len(lines), 1),
        float(np.count_nonzero(lengths <= 3)) * per_word, float(np.count_nonzero(lengths >= 12)) * per_word,
    )


def text_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics) for every row; a null text has the statistics of the empty one."""
    schema = output(docs, id_col, *((name, "double") for name in STATISTICS))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = np.asarray([text_statistics(t) for t in texts_of(batch, "text")], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, rows.T.copy())], names=schema.fieldNames())

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(apply, schema)


def tree_rules(printed: str) -> list[Rule]:
    """The rules of every path, inner nodes included, in a printed forest; a path's conditions on one side are merged."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, bool, float]] = []
    depths: list[int] = []
    for line in printed.splitlines():
        node = _SPLIT.match(line)
        if not node:
            if line.lstrip().startswith("Tree"):
                path, depths = [], []
            continue
        depth = len(node[1])
        while depths and depths[-1] >= depth:
            depths.pop(), path.pop()
        depths.append(depth)
        path.append((int(node[3]), node[4] == ">", float(node[5])))
        tight: dict[tuple[int, bool], float] = {}
        for statistic, above, limit in path:
            known = tight.get((statistic, above), limit)
            tight[statistic, above] = max(known, limit) if above else min(known, limit)
        found[tuple(sorted((s, a, v) for (s, a), v in tight.items()))] = None
    return list(found)


def rule_column(rule: Rule) -> Column:
    """Whether a row of statistics meets a rule."""
    return reduce(and_, (F.col(STATISTICS[s]) > v if above else F.col(STATISTICS[s]) <= v for s, above, v in rule))


@dataclass
class RuleModel:
    """Log-odds: ``bias`` plus the weights of the rules that hold."""

    bias: float
    weighted: list[tuple[Rule, float]]

    def score(self) -> Column:
        odds = reduce(add, (F.when(rule_column(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weighted), F.lit(self.bias))
        return 1 / (1 + F.exp(-odds))

    def readable(self) -> list[str]:
        told = lambda r: " and ".join(f"{STATISTICS[s]} {'>' if a else '<='} {v:.6g}" for s, a, v in r)
        return [f"{w:+.4f} if {told(r)}" for r, w in sorted(self.weighted, key=lambda x: -abs(x[1]))]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 20_000,
    trees: int = 20, depth: int = 3, lasso: float = 0.002, seed: int = 7,
) -> RuleModel:
    """Learn from the statistics of labelled texts, about ``rows`` of them at most, chosen by a hash of the id.

    An id with several labels has their majority (1 on a tie); null labels are not labels.  Without labels the score is one half
    everywhere; where all labels agree it is their smoothed share.
    """
    wanted = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key"))
    wanted = wanted.agg((F.avg(label_col) >= 0.5).cast("double").alias("label"))
    count = wanted.count()
    place = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("labels")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = wanted.where(place < rows / max(count, 1))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), F.col("id") == F.col("key"))
    chosen = written(text_table(texts, "label", "text"), "labelled").coalesce(2)  # small: many short jobs follow
    kinds = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
    total, good = sum(kinds.values()), kinds.get(1.0, 0)
    if len(kinds) < 2:
        share = (good + 1) / (total + 2)
        return RuleModel(float(np.log(share / (1 - share))), [])
    seen = VectorAssembler(inputCols=list(STATISTICS), outputCol="statistics").transform(chosen)
    forest = RandomForestClassifier(
        featuresCol="statistics", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="0.5", seed=seed
    ).fit(seen)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return RuleModel(float(np.log(good / (total - good))), [])
    held = chosen.select("label", array_to_vector(F.array(*(rule_column(r).cast("double") for r in rules))).alias("rules"))
    line = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=40, standardization=False).fit(held)
    return RuleModel(float(line.intercept), [(r, float(w)) for r, w in zip(rules, line.coefficients.toArray()) if w])


def judge(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """(id, statistics, score, predicted) for every row, repeated rows included; ``predicted`` is 1 from a score of ``least``.

    Null and empty texts are scored by the statistics of an empty text.  Nothing is shuffled.
    """
    judged = text_table(docs, id_col, text_col).withColumn("score", model.score())
    return judged.withColumn("predicted", (F.col("score") >= least).cast("int"))

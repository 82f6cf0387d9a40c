"""Order-dependent results over groups too large for one task.

A window over a whole novel would run in one task.  These helpers cut the order into ranges, solve each
range by itself, and carry only one summary row per range across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossaloom.plans.lineage import cut

#: Distinct numbers per range in number-ordered helpers.
SPAN = 1 << 16


def ranked(df: DataFrame, by: str, order: list[Column], name: str = "rank") -> DataFrame:
    """Number the rows of each ``by`` from 1 in ``order`` without bringing a group into one task.

    Rows are range-partitioned and sorted once; positions come from the partition offsets.
    """
    placed = cut(df.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order))
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_id", 33).cast("int")).withColumn(
        "_row", F.col("_id").bitwiseAND((1 << 33) - 1)
    )
    # One row per (group, range): a group's ranges are few, whatever its rows.
    runs = placed.groupBy(by, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (
        placed.join(runs.select(by, "_part", "_first", "_skip"), [by, "_part"])
        .withColumn(name, F.col("_row") - F.col("_first") + F.col("_skip") + 1)
        .drop("_id", "_part", "_row", "_first", "_skip")
    )


def neighbours(df: DataFrame, by: str, number: str) -> DataFrame:
    """``by, number, previous, next`` over the distinct numbers of each group, by strict inequality."""
    nums = df.select(by, number).distinct().withColumn("_span", F.floor(F.col(number) / SPAN))
    inside = W.partitionBy(by, "_span").orderBy(number)
    nums = nums.withColumn("previous", F.lag(number).over(inside)).withColumn("next", F.lead(number).over(inside))
    spans = nums.groupBy(by, "_span").agg(F.min(number).alias("_low"), F.max(number).alias("_high"))
    across = W.partitionBy(by).orderBy("_span")
    spans = spans.select(
        by, "_span", F.lag("_high").over(across).alias("_before"), F.lead("_low").over(across).alias("_after")
    )
    return nums.join(spans, [by, "_span"]).select(
        by,
        number,
        F.coalesce("previous", "_before").alias("previous"),
        F.coalesce("next", "_after").alias("next"),
    )


def latest_before(df: DataFrame, by: str, number: str, known: Column) -> DataFrame:
    """``by, number, at``: the largest number strictly below each number where ``known`` holds."""
    marks = df.groupBy(by, number).agg(F.max(F.when(known, F.col(number))).alias("_mark"))
    marks = marks.withColumn("_span", F.floor(F.col(number) / SPAN))
    before = W.partitionBy(by, "_span").orderBy(number).rowsBetween(W.unboundedPreceding, -1)
    marks = marks.withColumn("at", F.max("_mark").over(before))
    spans = marks.groupBy(by, "_span").agg(F.max("_mark").alias("_last"))
    earlier = W.partitionBy(by).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select(by, "_span", F.max("_last").over(earlier).alias("_carried"))
    return marks.join(spans, [by, "_span"]).select(by, number, F.coalesce("at", "_carried").alias("at"))


def last_of(changes: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """One row per ``key``: the last by column ``order``; equal or absent orders are settled by the greatest row."""
    row = F.struct(*[c for c in changes.columns if c not in key])
    by = F.struct(F.col(order), row) if order else row
    return changes.groupBy(*key).agg(F.max_by(row, by).alias("_last")).select(*key, "_last.*").select(*changes.columns)


def first_rows(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows per group; Spark limits each map partition to ``k`` before the shuffle."""
    name = rank or "_rn"
    kept = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
    return kept if rank else kept.drop(name)

"""Cutting lineage in iterative jobs, and size checks before a broadcast or a collect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows a driver-side list or an explicit broadcast may hold.  Anything larger takes the shuffled path.
SMALL_ROWS = 100_000


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The files outlive lost executors, so an iterative job restarts from its last round.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: as ``cut``, for texts and long tables, at a fraction of the disk."""
    _ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table out to all cores.

    A table of fewer splits than cores (one small file) would keep text work on one core; a large table has
    more splits than cores and is left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` shuffled once by ``keys`` into a fixed number of partitions.

    What is then exploded, ranked, grouped by and joined with on just these keys stays where it lies.  The number is fixed
    because partitions that are merged while the query runs are not always merged alike on both sides of a join.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

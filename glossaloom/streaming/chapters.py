"""Chapters arriving over time: incremental mining, streaming pre-pass, and gated character records.

Sinks write one folder per micro-batch and overwrite it on a retry, so a restarted batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossaloom.operators.extract import SIGNAL_COLUMNS, apply_support, raw_signals
from glossaloom.operators.lore import settle_characters, summarise_sightings
from glossaloom.operators.mining import Mined, mine_policies
from glossaloom.operators.substitution import prepass, trace_rows

CHAPTER_SCHEMA = "novel STRING, chapter BIGINT, text STRING"


def read_chapters(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CHAPTER_SCHEMA)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def collect_signals(chapters: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store the raw signals of every arriving chapter under ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        raw = raw_signals(batch)
        seen = batch.select("novel", "chapter", F.lit(batch_id).alias("batch")).distinct()
        raw.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/signals/b{batch_id}")
        seen.write.mode("overwrite").parquet(f"{path}/chapters/b{batch_id}")

    return _start(chapters, write, checkpoint)


def mine_collected(spark: SparkSession, path: str, min_support: int = 2, **options) -> Mined:
    """Policies of everything collected so far; a chapter sent again counts in its last version."""
    read = lambda kind: spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/{kind}")
    last = read("chapters").groupBy("novel", "chapter").agg(F.max("batch").alias("batch"))
    raw = read("signals").join(last, ["novel", "chapter", "batch"], "left_semi")
    totals = last.groupBy("novel").agg(F.count("*").alias("total_chapters"))
    return mine_policies(apply_support(raw, min_support).select(*SIGNAL_COLUMNS), totals, min_support=min_support, **options)


def stream_prepass(chapters: DataFrame, policies: DataFrame, forms: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Substitute policies in arriving chapters; texts and traces land under ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rewritten, _ = prepass(batch, policies, forms)
        rewritten.select("novel", "chapter", F.col("new_text").alias("text")).write.mode("overwrite").parquet(f"{path}/texts/b{batch_id}")
        trace_rows(rewritten).write.mode("overwrite").parquet(f"{path}/trace/b{batch_id}")

    return _start(chapters, write, checkpoint)


def stream_characters(sightings: DataFrame, existing: DataFrame, path: str, checkpoint: str, bypass: bool = False) -> StreamingQuery:
    """Keep character records current while sightings arrive in any chapter order.

    The sighting summary is a streaming aggregation, so its state lives in Spark's state store; each batch writes
    the records it changed under ``path``, computed against the records as they were at the start.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        who = batch.select("novel", "name")
        records = settle_characters(existing.join(who, ["novel", "name"], "left_semi"), batch, bypass)
        records.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/b{batch_id}")

    return _start(summarise_sightings(sightings, existing), write, checkpoint, "update")


def current_characters(spark: SparkSession, existing: DataFrame, path: str) -> DataFrame:
    """The last written record of each character, and existing ones never seen."""
    written = spark.read.option("recursiveFileLookup", "true").parquet(path)
    last = written.groupBy("novel", "name").agg(F.max("batch").alias("batch"))
    fresh = written.join(last, ["novel", "name", "batch"]).drop("batch")
    untouched = existing.join(last, ["novel", "name"], "left_anti")
    return fresh.unionByName(untouched, allowMissingColumns=True)

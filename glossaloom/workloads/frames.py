"""How the driver's tables stand in for the corpus: a novel per language, a chapter per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaloom.plans.lineage import spread


#: The last capitalised word of a whole text, and the word that follows it.
LAST_NAME = r"(?s)^(?:.*[^\p{L}\p{N}_])?(\p{Lu}[\p{L}\p{N}_]*(?: [\p{L}\p{N}_]+)?)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of texts, dealt out to all cores when it has fewer splits."""
    return spread(table(spark, sf, name))


def chapters(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "documents").select(
        F.col("lang").alias("novel"), (F.col("doc_id") + 1).alias("chapter"), "text"
    )


def totals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("novel")).agg(F.count("*").alias("total_chapters"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns with the turn before them: a generated text and its source."""
    talk = texts(spark, sf, "conversations")
    earlier = talk.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    return (
        talk.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("generated"))
        .join(earlier, ["conv_id", "turn"])
    )


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Stored chapters: novel = source, 40 documents a number, English = original, labels = state."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("chapter_id"),
        F.col("source").alias("novel"),
        (F.floor(F.col("doc_id") / 40) + 1).alias("number"),
        F.when(F.col("lang") == "en", "original").otherwise("mtl").alias("source_type"),
        F.col("text").alias("raw_text"),
        F.when(good, F.col("text")).alias("refined_text"),
        F.when(F.col("toxic") == 1, F.md5("text")).alias("summary"),
        F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "failed").when(F.col("n_chars") > 1000, "queued")
        .otherwise("pending").alias("status"),
    )


def novels(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.groupBy(F.col("source").alias("novel")).agg(
        F.max("doc_id").alias("created_at"), F.max("lang").alias("source_language"), F.max("source").alias("name"), F.max("source").alias("title")
    )


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as processing jobs of the chapter with the user's number."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("chapter_id"), F.lit("rewrite").alias("job_type"),
        F.col("event_type").alias("status"), F.col("ts").alias("started_at"), F.col("props").alias("result_summary"),
    )


def policy_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A policy per document: the last capitalised name of its text, weighed by length, flagged by its labels."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("lang").alias("novel"),
        F.concat(F.lit("d_"), F.col("doc_id").cast("string")).alias("policy_id"),
        F.lit("entity-naming").alias("type"),
        F.regexp_extract("text", LAST_NAME, 1).alias("trigger"),
        F.regexp_extract("text", LAST_NAME, 1).alias("render_as"),
        F.when(F.col("n_chars") > 500, "deterministic").otherwise("prompted").alias("applies"),
        (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("confidence"),
        F.col("n_chars").alias("evidence_count"),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("needs_review"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("rejected"),
        F.lit("").alias("note"),
        (F.col("doc_id") + 1).alias("rank"),
    )


def policy_form_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = policy_rows(spark, sf)
    names = F.array_distinct(F.array(F.col("trigger"), F.substring_index("trigger", " ", 1)))
    return rows.select("novel", "policy_id", F.posexplode(names).alias("pos", "form")).withColumn("pos", F.col("pos").cast("bigint"))


def glossary_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    name = F.regexp_extract("text", LAST_NAME, 1)
    return docs.select(
        F.col("lang").alias("novel"), F.col("doc_id").alias("entry_id"), name.alias("canonical"),
        F.array(F.substring_index(name, " ", 1)).alias("aliases"), F.lit("entity").alias("entity_type"), F.lit(0.9).alias("confidence"),
        F.array(F.md5("text")).alias("evidence_contexts"),
        F.create_map(F.lit("gender"), F.when(F.col("n_chars") > 500, "female").otherwise("")).alias("metadata"),
    )


def sightings(spark: SparkSession, sf: str) -> DataFrame:
    """Later turns of a conversation as sightings of a character of that name."""
    talk = table(spark, sf, "conversations").where("turn > 0")
    return _character(talk).select("novel", "name", F.col("turn").alias("chapter"), F.lit(0).alias("pos"), "text", F.col("text").alias("quote"),
                                   "gender", "race_or_identity", "speech_style", "background")


def known_characters(spark: SparkSession, sf: str) -> DataFrame:
    """First turns of labelled conversations as known characters; a good label means verified."""
    talk = table(spark, sf, "conversations").where("turn = 0")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"), (F.col("quality") == 1).alias("verified"))
    return _character(talk.join(labels, "conv_id")).select(
        "novel", "name", "gender", "race_or_identity", "speech_style", "background",
        F.create_map().cast("map<string,string>").alias("proposed"), "verified", F.array().cast("array<string>").alias("evidence"),
    )


def _character(talk: DataFrame) -> DataFrame:
    return (
        talk.withColumn("novel", F.lit("talk")).withColumn("name", F.concat(F.lit("Speaker"), F.col("conv_id").cast("string")))
        .withColumn("gender", F.col("role"))
        .withColumn("race_or_identity", F.regexp_extract("text", r"(?U)^\W*(\w+)", 1))
        .withColumn("speech_style", F.regexp_extract("text", r"(?U)(\w+)\W*$", 1))
        .withColumn("background", F.lit(""))
    )

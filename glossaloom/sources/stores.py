"""Reading and writing stores: policies, glossary, rules, audits and reports as JSON lines or partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from glossaloom.operators.mining import Mined
from glossaloom.plans.ordered import last_of
from glossaloom.sources.corpus import read_text_tree


POLICY_JSON = (
    "id STRING, novel STRING, type STRING, trigger STRING, action STRING, confidence DOUBLE, evidence ARRAY<BIGINT>, match ARRAY<STRING>, "
    "applies STRING, scores MAP<STRING,DOUBLE>, category STRING, note STRING, needs_review BOOLEAN, llm_rejected BOOLEAN, "
    "contexts ARRAY<STRING>, metadata MAP<STRING,STRING>"
)
GLOSSARY_JSON = (
    "canonical STRING, match ARRAY<STRING>, aliases ARRAY<STRING>, type STRING, confidence DOUBLE, chapters ARRAY<BIGINT>, needs_review BOOLEAN"
)
ERROR_JSON = (
    "id STRING, mtl_phrase STRING, korean_source STRING, correct_translation STRING, category STRING, context STRING, notes STRING, auto_apply BOOLEAN"
)


def render_as(action: str | None = "action", trigger: str = "trigger"):
    """The rendering of a policy whose action is an object, JSON text, or unusable."""
    return F.coalesce(F.get_json_object(action, "$.render_as"), F.col(trigger))


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Policies from JSON lines; blank lines are skipped, missing fields take their defaults."""
    rows = spark.read.schema(POLICY_JSON).json(path).where("id is not null or trigger is not null")
    return with_policy_defaults(rows)


#: Names of the engine's columns in policy files, and the way back.
_FILE_NAMES = {"policy_id": "id", "rejected": "llm_rejected"}


def read_store(spark: SparkSession, path: str) -> Mined:
    """The policies, forms, evidence and contexts of a file that ``write_store`` wrote, lists spread into rows again."""
    rows = read_policies(spark, path)
    for engine, name in _FILE_NAMES.items():
        rows = rows.withColumnRenamed(name, engine)
    key = ["novel", "policy_id"]
    spread = lambda c, pos, value: rows.select(*key, F.posexplode(c).alias("pos", value)).withColumn("pos", (F.col("pos") + pos).cast("bigint"))
    return Mined(
        rows.withColumn("evidence_count", F.size("evidence").cast("bigint")).drop("match", "evidence", "contexts", "action"),
        spread("match", 0, "form"), rows.select(*key, F.explode("evidence").alias("chapter")), spread("contexts", 1, "context"),
    )


def write_store(store: Mined, path: str) -> None:
    """All policies of a store, rejected ones with their mark, as policy files."""
    whole = store.assembled()
    whole = whole.withColumn("action", F.struct(F.col("render_as").alias("render_as"))).drop("render_as", "evidence_count", "rank")
    for engine, name in _FILE_NAMES.items():
        whole = whole.withColumnRenamed(engine, name)
    write_policies(whole, path)


def with_policy_defaults(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("render_as", render_as())
        .withColumn("match", F.coalesce("match", F.array().cast("array<string>")))
        .withColumn("evidence", F.coalesce("evidence", F.array().cast("array<bigint>")))
        .withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
        .withColumn("applies", F.coalesce("applies", F.lit("deterministic")))
        .withColumn("category", F.coalesce("category", F.lit("")))
        .withColumn("note", F.coalesce("note", F.lit("")))
        .withColumn("needs_review", F.coalesce("needs_review", F.lit(False)))
        .withColumn("llm_rejected", F.coalesce("llm_rejected", F.lit(False)))
    )


def decode_policies(stored: DataFrame) -> DataFrame:
    """Stored rows with JSON text and "true"/"false" columns to typed policies with defaults."""
    texts, flag = "array<string>", lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("false"))) == "true"
    typed = (
        stored.withColumn("match", F.from_json("match_forms", texts))
        .withColumn("evidence", F.from_json("evidence_chapters", "array<bigint>"))
        .withColumn("scores", F.from_json("scores", "map<string,double>"))
        .withColumn("contexts", F.from_json("contexts", texts))
        .withColumn("metadata", F.from_json("metadata_json", "map<string,string>"))
        .withColumn("needs_review", flag("needs_review"))
        .withColumn("llm_rejected", flag("llm_rejected"))
        .drop("match_forms", "evidence_chapters", "metadata_json")
    )
    return with_policy_defaults(typed)


def write_policies(policies: DataFrame, path: str) -> None:
    """JSON lines by falling confidence; fields without content are left out."""
    blank_text = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    blank_list = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    true_only = lambda c: F.when(F.col(c), F.lit(True)).alias(c)
    kinds = {f.name: f.dataType.typeName() for f in policies.schema}
    columns = []
    for name in policies.columns:
        if kinds[name] in ("array", "map"):
            columns.append(blank_list(name))
        elif kinds[name] == "boolean":
            columns.append(true_only(name))
        elif kinds[name] == "string" and name not in ("novel", "policy_id", "id", "trigger"):
            columns.append(blank_text(name))
        else:
            columns.append(F.col(name))
    policies.orderBy(F.col("confidence").desc()).select(*columns).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_glossary(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """A glossary written as JSON lines (what ``write_json`` writes), or with ``layout="array"`` as one JSON array a file."""
    whole_files = {"lines": "false", "array": "true"}[layout]
    return spark.read.schema(GLOSSARY_JSON).option("multiLine", whole_files).json(path).where("canonical is not null")


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Audit, trace, glossary and report rows as JSON lines, partitioned by ``by``."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "true")
    (writer.partitionBy(*by) if by else writer).json(path)


def read_known_errors(spark: SparkSession, path: str) -> DataFrame:
    """Error rules; a missing or broken file gives none."""
    try:
        rules = spark.read.schema(ERROR_JSON).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], ERROR_JSON)
    return rules.where("mtl_phrase is not null")


# --------------------------------------------------------------------------- tables on storage


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """``current`` with rows of ``changes`` inserted or replaced by key.

    Of repeated keys the last change by column ``order`` counts (the greatest row, where there is no order).
    """
    latest = last_of(changes, key, order)
    latest = latest.drop(order) if order and order not in current.columns else latest
    return current.join(latest.select(*key), key, "left_anti").unionByName(latest, allowMissingColumns=True)


def replace_novels(df: DataFrame, path: str, novels: DataFrame | None = None) -> None:
    """Replace the partitions of the novels in ``df`` and leave all others.

    ``novels(novel)`` lists what is replaced; one of them without rows in ``df`` loses its old rows too.
    """
    if novels is not None:
        spark, gone = df.sparkSession, novels.select("novel").distinct().join(df.select("novel").distinct(), "novel", "left_anti")
        files = spark._jvm.org.apache.hadoop.fs
        for row in gone.toLocalIterator():
            folder = files.Path(f"{path}/novel={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(row.novel)}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("novel").parquet(path)


def seed(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of novels that have none yet; running it twice adds nothing."""
    return incoming.join(existing.select("novel").distinct(), "novel", "left_anti")


#: Folder of a novel, source type of its chapters, and file names; the group is the chapter number.
CHAPTER_FILES = {
    "originals": ("original", r"^(\d+)(?:-.*)?\.txt$"),
    "mtl": ("mtl", r"^chapter-(\d+)\.txt$"),
}


def chapter_files(spark: SparkSession, folder: str) -> DataFrame:
    """``novel, number, source_type, text, checksum`` from files ``<folder>/<novel>/originals/NNN-....txt`` and
    ``<folder>/<novel>/mtl/chapter-NNN.txt``; other files are left out,
    as are empty ones, which hold no chapter.  Of several files of one chapter the first by name counts.
    """
    place = F.reverse(F.split("path", "/"))
    texts = read_text_tree(spark, folder).select(
        F.get(place, F.lit(2)).alias("novel"), F.get(place, F.lit(1)).alias("_kind"), F.col("name").alias("_file"), F.col("raw").alias("text")
    )
    kind, number = F.lit(None).cast("string"), F.lit("")
    for name, (source_type, pattern) in CHAPTER_FILES.items():
        kind = F.when(F.col("_kind") == name, F.lit(source_type)).otherwise(kind)
        number = F.when(F.col("_kind") == name, F.regexp_extract("_file", pattern, 1)).otherwise(number)
    rows = texts.select("novel", number.try_cast("bigint").alias("number"), kind.alias("source_type"), "text", F.sha2("text", 256).alias("checksum"), "_file")
    key = ["novel", "number", "source_type"]
    firsts = rows.where("number is not null").groupBy(*key).agg(F.min("_file").alias("_file"))
    return rows.join(firsts, [*key, "_file"]).select(*key, "text", "checksum")


def seed_chapters(existing: DataFrame, files: DataFrame, by_file: bool = False) -> DataFrame:
    """The chapters of ``files`` that are to be added: those of novels that have none of their source type yet.

    ``by_file``: those whose number and checksum the novel does not have yet, so that changed files come again.  A second
    run adds nothing either way.
    """
    known = ["novel", "source_type", "number", "checksum"] if by_file else ["novel", "source_type"]
    return files.join(existing.select(*known).distinct(), known, "left_anti").select(*files.columns)


def backfill(chapters: DataFrame, outputs: DataFrame) -> DataFrame:
    """Fill ``refined_text`` of MTL chapters that lack it from ``outputs(novel, number, text)`` and complete them."""
    joined = chapters.join(outputs.select("novel", "number", F.col("text").alias("_out")), ["novel", "number"], "left")
    fill = (F.col("source_type") == "mtl") & F.col("refined_text").isNull() & F.col("_out").isNotNull()
    new = {"refined_text": F.when(fill, F.col("_out")).otherwise(F.col("refined_text")), "status": F.when(fill, "completed").otherwise(F.col("status"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in chapters.columns])


def clear_outputs(chapters: DataFrame, novels: DataFrame | None = None) -> DataFrame:
    """Forget refined texts, summaries and status, of the given novels or of all."""
    hit = F.lit(True)
    if novels is not None:
        chapters = chapters.join(novels.select("novel").distinct().withColumn("_hit", F.lit(True)), "novel", "left")
        hit = F.coalesce("_hit", F.lit(False))
    blank = lambda c: F.when(hit, F.lit(None)).otherwise(F.col(c))
    return (
        chapters.withColumn("refined_text", blank("refined_text")).withColumn("summary", blank("summary"))
        .withColumn("status", F.when(hit, "unprocessed").otherwise(F.col("status"))).drop("_hit")
    )


def delete_novels(table: DataFrame, novels: DataFrame, via: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(remaining, removed)`` rows of a child table; ``via(chapter_id, novel)`` links a table without a novel."""
    gone = novels.select("novel").distinct()
    if via is None:
        return table.join(gone, "novel", "left_anti"), table.join(gone, "novel", "left_semi")
    chapters = via.join(gone, "novel", "left_semi").select("chapter_id").distinct()
    return table.join(chapters, "chapter_id", "left_anti"), table.join(chapters, "chapter_id", "left_semi")


def removal_counts(tables: dict[str, DataFrame], novels: DataFrame) -> DataFrame:
    """How many rows of each table a deletion would remove (dry run)."""
    counts = [delete_novels(t, novels)[1].agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def not_blank(column: str):
    return F.coalesce(F.col(column), F.lit("")).rlike(r"(?U)\S")



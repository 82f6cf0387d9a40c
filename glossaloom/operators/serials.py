"""Catalogue queries over novels, stored chapters and jobs.

Stored chapters have ``chapter_id, novel, number, source_type, raw_text, refined_text, summary, status``;
jobs have ``job_id, chapter_id, job_type, status, started_at, result_summary``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaloom.plans.ordered import first_rows, latest_before, neighbours

# States of work that a restart interrupts.
ACTIVE_CHAPTER = ["processing", "queued", "cleaning", "applying_rules", "rewriting", "validating", "extracting_lore", "extracting"]
ACTIVE_JOB = ["running", "queued"]


def novel_list(novels: DataFrame, chapters: DataFrame) -> DataFrame:
    """Novels, newest first, with their chapter counts."""
    counts = chapters.groupBy("novel").agg(F.count("*").alias("n_chapters"))
    return novels.join(counts, "novel", "left").fillna(0, ["n_chapters"]).orderBy(F.col("created_at").desc(), "novel")


def novel_detail(novels: DataFrame, chapters: DataFrame, policies: DataFrame, glossary: DataFrame) -> DataFrame:
    """One row per novel with the counts of its chapters, policies and glossary entries."""
    out = novels
    for df, name in ((chapters, "n_chapters"), (policies, "n_policies"), (glossary, "n_glossary")):
        out = out.join(df.groupBy("novel").agg(F.count("*").alias(name)), "novel", "left").fillna(0, [name])
    return out


def search_novels(novels: DataFrame, needle: str = "", language: str | None = None) -> DataFrame:
    low = needle.lower()
    hit = F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(low))
    found = novels.where(hit) if needle else novels
    return found.where(F.col("source_language") == language) if language else found


def total_chapters(novel_rows: DataFrame) -> DataFrame:
    return novel_rows.agg(F.coalesce(F.sum("n_chapters"), F.lit(0)).alias("total_chapters"))


def chapter_list(chapters: DataFrame, source_type: str | None = None) -> DataFrame:
    kept = chapters.where(F.col("source_type") == source_type) if source_type else chapters
    return kept.orderBy("novel", "number", "source_type")


def chapter_by_number(chapters: DataFrame) -> DataFrame:
    """One version per number, the last source type in name order (original before mtl)."""
    return first_rows(chapters, ["novel", "number"], [F.col("source_type").desc(), F.col("chapter_id")], 1)


def readable_chapters(chapters: DataFrame) -> DataFrame:
    return chapters.where("refined_text is not null").select("chapter_id", "novel", "number", "source_type", "refined_text")


def chapter_neighbours(chapters: DataFrame) -> DataFrame:
    """Each chapter with the ids of a previous and a next chapter by strict number (the smallest id of that number)."""
    links = neighbours(chapters, "novel", "number")
    ids = chapters.groupBy("novel", "number").agg(F.min("chapter_id").alias("id"))
    before = ids.select("novel", F.col("number").alias("previous"), F.col("id").alias("previous_id"))
    after = ids.select("novel", F.col("number").alias("next"), F.col("id").alias("next_id"))
    return (
        chapters.select("chapter_id", "novel", "number").join(links, ["novel", "number"])
        .join(before, ["novel", "previous"], "left").join(after, ["novel", "next"], "left")
        .select("chapter_id", "novel", "number", "previous_id", "next_id")
    )


def with_reference(chapters: DataFrame) -> DataFrame:
    """MTL chapters with the original text of the same number."""
    original = chapters.where("source_type = 'original'").groupBy("novel", "number").agg(F.min_by("raw_text", "chapter_id").alias("reference_text"))
    return chapters.where("source_type = 'mtl'").join(original, ["novel", "number"], "left")


def with_previous_refined(chapters: DataFrame) -> DataFrame:
    """MTL chapters with the latest earlier completed MTL chapter that has refined text."""
    mtl = chapters.where("source_type = 'mtl'")
    done = (F.col("status") == "completed") & F.col("refined_text").isNotNull()
    at = latest_before(mtl, "novel", "number", done).select("novel", "number", F.col("at").alias("previous_number"))
    texts = mtl.where(done).groupBy("novel", F.col("number").alias("previous_number")).agg(F.min_by("refined_text", "chapter_id").alias("previous_text"))
    return mtl.join(at, ["novel", "number"], "left").join(texts, ["novel", "previous_number"], "left")


def chapter_jobs(jobs: DataFrame, k: int = 30) -> DataFrame:
    """The last ``k`` jobs of each chapter."""
    return first_rows(jobs, ["chapter_id"], [F.col("started_at").desc(), F.col("job_id").desc()], k, "rank")


def novel_jobs(jobs: DataFrame, chapters: DataFrame, k: int = 50) -> DataFrame:
    """The last ``k`` jobs of each novel; each map task keeps only its own last ``k``."""
    owned = jobs.join(chapters.select("chapter_id", "novel"), "chapter_id")
    return first_rows(owned, ["novel"], [F.col("started_at").desc(), F.col("job_id").desc()], k, "rank")


def sweep_interrupted(chapters: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Work that was under way becomes failed; the old status ``pending`` becomes ``unprocessed``."""
    why = F.lit("interrupted by a restart")
    stuck = F.col("status").isin(ACTIVE_CHAPTER)
    swept = chapters.withColumn("error_message", F.when(stuck, why)).withColumn(
        "status", F.when(stuck, "failed").when(F.col("status") == "pending", "unprocessed").otherwise(F.col("status"))
    )
    hung = F.col("status").isin(ACTIVE_JOB)
    return swept, jobs.withColumn("error_message", F.when(hung, why)).withColumn("status", F.when(hung, "failed").otherwise(F.col("status")))


def chapter_grid(chapters: DataFrame, status: str = "all", needle: str = "") -> DataFrame:
    """One row per number with its versions' state, filtered by the status of the MTL version and by digits."""
    mtl = F.col("source_type") == "mtl"
    grid = chapters.groupBy("novel", "number").agg(
        F.count("*").alias("n_versions"),
        F.min_by(F.when(mtl, F.col("status")), F.when(mtl, F.col("chapter_id"))).alias("mtl_status"),
        F.max(F.col("source_type") == "original").alias("has_original"),
    )
    if needle:
        grid = grid.where(F.contains(F.col("number").cast("string"), F.lit(needle)))
    wanted = {"completed": ["completed"], "processing": ["processing", "pending"], "failed": ["failed"]}
    return grid if status == "all" else grid.where(F.col("mtl_status").isin(wanted.get(status, [status])))


def preferred_versions(chapters: DataFrame, originals_only: bool = False) -> DataFrame:
    """``novel, number, chapter_id, text, version``: original, else refined, else machine translation."""
    blank = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)\S")
    original = (F.col("source_type") == "original") & ~blank("raw_text")
    version = lambda o, name, c: F.struct(F.lit(o).alias("o"), F.lit(name).alias("version"), F.col(c).alias("text"))
    choice = F.when(original, version(1, "original", "raw_text"))
    if not originals_only:
        choice = choice.when(~blank("refined_text"), version(2, "refined", "refined_text")).when(~blank("raw_text"), version(3, "mtl", "raw_text"))
    ranked = chapters.select("novel", "number", "chapter_id", choice.alias("c")).where("c is not null")
    best = ranked.groupBy("novel", "number").agg(F.min(F.struct("c.o", "chapter_id")).alias("b"))
    picked = ranked.join(best.select("novel", "number", "b.chapter_id"), ["novel", "number", "chapter_id"])
    return picked.select("novel", "number", "chapter_id", "c.text", "c.version")


def lore_sources(chapters: DataFrame, selected: DataFrame | None = None, originals_only: bool = False) -> DataFrame:
    """Texts to read for lore: the selected chapters, or all numbers that have no summary yet."""
    if selected is not None:
        return preferred_versions(chapters.join(selected.select("chapter_id"), "chapter_id", "left_semi"), originals_only)
    done = chapters.where(F.coalesce("summary", F.lit("")).rlike(r"(?U)\S")).select("novel", "number").distinct()
    return preferred_versions(chapters.join(done, ["novel", "number"], "left_anti"), originals_only)


def job_summaries(jobs: DataFrame) -> DataFrame:
    """Jobs with the fields of their JSON summary."""
    s = F.from_json("result_summary", "mode STRING, deterministic_count INT, prompted_count INT, conflicts INT, processing_time_ms BIGINT, logs ARRAY<STRING>")
    return jobs.withColumn("_s", s).select(*[c for c in jobs.columns if c != "result_summary"], "_s.*")


def apply_changes(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Apply a change table with column ``op`` (create, update, delete); an update keeps fields it leaves null."""
    fields = [c for c in current.columns if c not in key]
    c = changes.select(*key, "op", *[F.col(f).alias(f"_{f}") for f in fields])
    kept = current.join(c.where("op <> 'create'"), key, "left").where("coalesce(op, '') <> 'delete'")
    updated = kept.select(*key, *[F.coalesce(f"_{f}", f).alias(f) for f in fields])
    created = c.where("op = 'create'").select(*key, *[F.col(f"_{f}").alias(f) for f in fields])
    return updated.unionByName(created.join(current.select(*key), key, "left_anti")).select(*current.columns)

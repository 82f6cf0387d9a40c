"""Character lore: reading model replies, evidence quotes, and gated updates of character records.

A character record is keyed by ``novel, name``.  Updates come in chapter order, yet the outcome only needs
the first sighting, the first change that a verified record has to propose, and the last sighting, so it is an
aggregation: chapters may arrive in any order and no character is folded in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.functions import text as X
from glossaloom.lexicon import Lexicon
from glossaloom.operators.mining import is_generic
from glossaloom.operators.modelcalls import call_model, unfence

LORE = (
    "chapter_summary STRING, characters ARRAY<STRUCT<name:STRING, gender:STRING, race_or_identity:STRING, speech_style:STRING, "
    "background:STRING, introduction_context:STRING, introduction_snippet:STRING>>"
)
FIELDS = ["gender", "race_or_identity", "speech_style", "background"]
WHO = ["novel", "name"]


def lore_prompt(text: Column, max_words: int = 4000) -> Column:
    """The task with the first ``max_words`` words (shorter texts as they are)."""
    ws = X.words(text)
    head = F.when(F.size(ws) > max_words, F.array_join(F.slice(ws, 1, max_words), " ")).otherwise(text)
    task = (
        "Summarise this chapter in two or three sentences and list every named character. Reply with JSON {\"chapter_summary\", "
        "\"characters\": [{\"name\", \"gender\", \"race_or_identity\", \"speech_style\", \"introduction_context\"}]}; quote "
        "introduction_context word for word.\n"
    )
    return F.concat(F.lit(task), head)


def extract_lore(chapters: DataFrame, model_fn: Callable[[list[str]], Sequence[str]]) -> DataFrame:
    """``novel, chapter, text, summary, characters``; a failed or unreadable reply gives no characters."""
    replies = call_model(chapters.select("novel", "chapter", "text", lore_prompt(F.col("text")).alias("prompt")), "prompt", model_fn)
    data = F.from_json(unfence(F.col("reply")), LORE)
    return replies.select(
        "novel", "chapter", "text", F.coalesce(data["chapter_summary"], F.lit("")).alias("summary"), data["characters"].alias("characters")
    )


def character_rows(lore: DataFrame) -> DataFrame:
    """One row per character sighting, in reply order."""
    rows = lore.select("novel", "chapter", "text", F.posexplode("characters").alias("pos", "c")).select("novel", "chapter", "text", "pos", "c.*")
    quote = F.coalesce("introduction_snippet", "background", "introduction_context")
    return rows.where("coalesce(name, '') <> ''").select(
        *WHO, "chapter", "pos", "text", quote.alias("quote"), *[F.coalesce(f, F.lit("")).alias(f) for f in FIELDS]
    )


def evidence_quotes(k: int = 3) -> Column:
    """For a sighting row: up to ``k`` lines that hold the name or the quote's first 15 characters, else the
    quote itself as a sentence; null without a usable quote."""
    quote = F.col("quote")
    lines = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda p: p != "")
    holds = F.filter(lines, lambda p: F.contains(p, F.col("name")) | F.contains(p, F.substring(quote, 1, 15)))
    bare = X.strip(quote)
    sentence = F.when(bare.rlike("[.!?\"']$"), bare).otherwise(F.concat(bare, F.lit(".")))
    usable = F.length(X.strip(F.coalesce(quote, F.lit("")))) > 3
    return F.when(usable, F.when(F.size(holds) > 0, F.slice(holds, 1, k)).otherwise(F.array(sentence)))


def summarise_sightings(sightings: DataFrame, existing: DataFrame) -> DataFrame:
    """Per character what an update needs; a plain aggregation, so it also runs on a stream."""
    known = existing.select(*WHO, *[F.col(f).alias(f"_{f}") for f in FIELDS], "verified")
    changes = {
        f: F.when((F.col(f) != "") & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.col(f)) for f in ("speech_style", "race_or_identity")
    }
    proposal = F.map_filter(F.create_map(*[x for f, c in changes.items() for x in (F.lit(f), c)]), lambda k, v: v.isNotNull())
    seen = (
        sightings.join(known, WHO, "left")
        .withColumn("_at", F.struct("chapter", "pos"))
        .withColumn("_meta", F.struct(*FIELDS))
        .withColumn("_proposal", proposal)
        .withColumn("_change_at", F.when(F.col("verified") & (F.size("_proposal") > 0), F.col("_at")))
        .withColumn("_quotes", evidence_quotes())
    )
    return seen.groupBy(*WHO).agg(
        F.min("_at").alias("first_at"),
        F.max("_at").alias("last_at"),
        F.max_by("_meta", "_at").alias("last_meta"),
        F.min("_change_at").alias("change_at"),
        F.min_by("_proposal", "_change_at").alias("change"),
        F.min_by("_quotes", F.when(F.col("_quotes").isNotNull(), F.col("_at"))).alias("quotes"),
    )


def update_characters(existing: DataFrame, sightings: DataFrame, bypass: bool = False, strict_parity: bool = False, lex: Lexicon | None = None) -> DataFrame:
    """Character records after ``sightings``.

    ``existing`` has ``novel, name, <fields>, proposed map, verified, evidence array``.  A new character starts
    unverified (verified with ``bypass``).  An unverified record is overwritten by each sighting.  A verified one
    keeps its fields, proposes a changed speech style or identity, and by that becomes unverified.
    Generic names such as a bare title start no record unless ``strict_parity``.
    """
    return settle_characters(existing, summarise_sightings(sightings, existing), bypass, strict_parity, lex)


def settle_characters(existing: DataFrame, summary: DataFrame, bypass: bool = False, strict_parity: bool = False, lex: Lexicon | None = None) -> DataFrame:
    """Existing records and their sighting summaries to new records."""
    out = existing.withColumn("_old", F.lit(True)).join(summary, WHO, "full")
    old = F.coalesce("_old", F.lit(False))
    touched = F.col("last_at").isNotNull()
    no_props = F.create_map().cast("map<string,string>")
    was_verified = F.coalesce("verified", F.lit(False))
    overwrite = touched & (~old | F.lit(bypass) | ~was_verified | (F.col("change_at").isNotNull() & (F.col("last_at") > F.col("change_at"))))
    proposed = F.when(touched & F.lit(bypass) & old, no_props).when(
        touched & old & was_verified & F.col("change_at").isNotNull(), F.col("change")
    ).otherwise(F.coalesce("proposed", no_props))
    verified = F.when(~touched, F.col("verified")).when(F.lit(bypass), F.lit(True)).when(~old, F.lit(False)).otherwise(
        was_verified & F.col("change_at").isNull()
    )
    result = out.select(
        *WHO,
        *[F.when(overwrite, F.col("last_meta")[f]).otherwise(F.col(f)).alias(f) for f in FIELDS],
        proposed.alias("proposed"),
        verified.alias("verified"),
        F.when(F.size(F.coalesce("evidence", F.array().cast("array<string>"))) > 0, F.col("evidence")).otherwise(
            F.coalesce("quotes", F.array().cast("array<string>"))
        ).alias("evidence"),
        old.alias("_old"),
        F.col("first_at.chapter").alias("first_chapter"),
    )
    if not strict_parity:
        lowered = F.initcap(F.regexp_replace("name", "(?i)^(the|a|an) ", ""))
        result = result.where(F.col("_old") | ~is_generic(lowered, lex or Lexicon()))
    return result.withColumn("is_new", ~F.col("_old")).drop("_old")


def new_character_policies(characters: DataFrame, policies: DataFrame) -> DataFrame:
    """Policies for new characters that have none: certain to 0.9, under review until the record is verified."""
    fresh = characters.where("is_new").join(policies.select("novel", F.col("trigger").alias("name")).distinct(), WHO, "left_anti")
    return fresh.select(
        "novel", F.concat(F.lit("c_"), F.sha1(F.concat_ws("\u0001", *WHO))).alias("policy_id"), F.lit("entity-naming").alias("type"),
        F.col("name").alias("trigger"), F.col("name").alias("render_as"), F.lit("deterministic").alias("applies"), F.lit(0.9).alias("confidence"),
        (~F.col("verified")).alias("needs_review"), F.lit(False).alias("rejected"),
        F.format_string("Extracted from Chapter %d Lore", "first_chapter").alias("note"),
    )


def write_summaries(chapters: DataFrame, lore: DataFrame) -> DataFrame:
    """Stored chapters with the new summaries; an empty one changes nothing."""
    new = lore.where("coalesce(summary, '') <> ''").select("novel", F.col("chapter").alias("number"), F.col("summary").alias("_new"))
    return chapters.join(new, ["novel", "number"], "left").withColumn("summary", F.coalesce("_new", "summary")).select(*chapters.columns)

"""Style experiments: the same chapters rewritten under several conditions, and what each condition gains.

A condition is a set of style-line sources.  Conditions are rows of a table, the lines of a chapter are joined to them, and
the deterministic part of the rewrite is worked out once for all conditions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaloom.operators.alignment import align_paired, faithfulness, similarity_excluding
from glossaloom.operators.rewriting import KEY, deterministic_rewrite, rewrite_chapters
from glossaloom.operators.style import METRICS, stylometry, stylometry_delta, voice_richness
from glossaloom.plans.lineage import cut

#: Baseline, written profile, exemplars, exemplars with editing tendencies and measured style; lines keep this order.
CONDITIONS: dict[str, list[str]] = {"A": [], "B": ["profile"], "C": ["exemplar"], "D": ["exemplar", "tendency", "measured"]}


def condition_lines(lines: DataFrame, conditions: Mapping[str, Sequence[str]] = CONDITIONS) -> DataFrame:
    """``novel, chapter, condition, rank, excerpt``: the style lines that each condition shows for a chapter.

    ``lines`` has ``novel, chapter, source, rank, line``; sources come in the order the condition lists them.
    """
    rows = [(c, s, k) for c, sources in conditions.items() for k, s in enumerate(sources)]
    table = lines.sparkSession.createDataFrame(rows, "condition string, source string, place int")
    rank = F.struct("place", "rank", "line")
    return lines.join(F.broadcast(table), "source").select(*KEY, "condition", rank.alias("rank"), F.col("line").alias("excerpt"))


def ablate(
    chapters: DataFrame,
    policies: DataFrame,
    forms: DataFrame,
    glossary: DataFrame,
    lines: DataFrame,
    model_fn: Callable[[list[str]], Sequence[str]],
    conditions: Mapping[str, Sequence[str]] = CONDITIONS,
    rules: DataFrame | None = None,
    references: DataFrame | None = None,
) -> DataFrame:
    """``novel, chapter, condition, mtl, generated``: every chapter rewritten under every condition."""
    parts = deterministic_rewrite(chapters, policies, forms, glossary, rules)
    parts = {name: cut(frame) for name, frame in parts.items()}
    shown = condition_lines(lines, conditions)
    runs = None
    for name in conditions:
        style = shown.where(F.col("condition") == name).drop("condition")
        out = rewrite_chapters(chapters, policies, forms, glossary, references=references, style=style, model_fn=model_fn, parts=parts)
        run = out["result"].select(*KEY, F.lit(name).alias("condition"), F.col("rewritten").alias("generated"))
        runs = run if runs is None else runs.unionByName(run)
    return runs.join(chapters.select(*KEY, F.col("text").alias("mtl")), KEY)


def ablation_scores(runs: DataFrame, originals: DataFrame, names: DataFrame) -> DataFrame:
    """The runs with their measures against the original chapter; chapters without one are left out.

    ``originals`` has ``novel, chapter, text``, ``names`` has ``novel, pos, name``.  Measures: similarity of generated and machine text
    to the original, with and without names, faithfulness, distance in each style metric, and voice richness.
    """
    keys = [*KEY, "condition"]
    rows = cut(runs.join(originals.select(*KEY, F.col("text").alias("original")), KEY))
    scored = faithfulness(align_paired(rows), "generated", "original")
    for side in ("generated", "mtl"):
        scored = similarity_excluding(scored, side, "original", names, f"sim_{side}_original_norm", keys)
    for side in ("generated", "original", "mtl"):
        scored = stylometry(scored, side, f"{side}_")
        scored = scored.withColumn(f"voice_{side}", voice_richness(f"{side}_"))
    deltas = [stylometry_delta("generated_", "original_", m).alias(f"delta_{m}") for m in METRICS]
    return scored.select(
        *keys, "sim_generated_original", "sim_mtl_original", "delta_vs_mtl", "sim_generated_original_norm", "sim_mtl_original_norm",
        "intrusion_score", "drop_score", "coverage", *deltas, "voice_generated", "voice_original", "voice_mtl",
    )


def ablation_table(scores: DataFrame, metric: str = "sim_generated_original", conditions: Sequence[str] = tuple(CONDITIONS)) -> DataFrame:
    """One row per chapter, one column per condition: ``metric`` of ``scores(novel, chapter, condition, ...)`` pivoted."""
    return scores.groupBy(*KEY).pivot("condition", list(conditions)).agg(F.avg(metric))

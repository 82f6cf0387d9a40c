"""How close a generated chapter is to its original, its machine translation, and its translator's voice."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.functions import text as X
from glossaloom.operators.modelcalls import call_model, unfence
from glossaloom.operators.retrieval import contains_join
from glossaloom.operators.style import METRICS, stylometry, stylometry_delta, voice_richness
from glossaloom.plans.lineage import cut

LONE_WEIGHT = 2.1640825608571353  # (ln(3/2) + 1) squared: a token only one of the two texts has


def text_histogram(text: Column) -> Column:
    return X.histogram(X.content_tokens(F.coalesce(text, F.lit(""))))


def similarity(a: Column, b: Column) -> Column:
    """TF-IDF cosine of two texts, to four digits."""
    return X.rounded(X.tfidf_cosine(text_histogram(a), text_histogram(b)), 4)


def _without(text: Column, names: Column) -> Column:
    """Blank out each name in turn, wherever it stands, ignoring case."""
    quoted = lambda n: F.concat(F.lit("(?iu)\\Q"), F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.aggregate(names, text, lambda t, n: F.regexp_replace(t, quoted(n), F.lit(" ")))


def contained_names(texts: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, names``: per text the listed names whose every word it contains, in list order.

    ``names`` has ``novel, pos, name``.  Blanking one name only ever leaves a blank behind, so no other name
    can come to stand in the text.
    """
    piece = F.reverse(F.array_sort(F.transform(X.words(F.col("name")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    keyed = names.where("name <> ''").withColumn("piece", F.coalesce(F.get(piece, F.lit(0))["w"], F.col("name")))
    low = F.lower("text")
    hits = contains_join(texts.select(*keys, "text"), keyed.select("novel", "pos", "name", "piece"), ["novel"], "piece")
    hits = hits.where(F.forall(X.words(F.lower("name")), lambda w: F.contains(low, w)))
    return hits.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "name"))), lambda s: s["name"]).alias("names"))


def without_names(rows: DataFrame, columns: list[str], names: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``columns`` of ``rows``, every listed name blanked out; a null text is empty.

    A name that only one of the texts holds leaves the others as they are, so all columns are looked through together.
    """
    listed = contained_names(rows.select(*keys, F.concat_ws("\n", *columns).alias("text")), names, keys)
    joined = rows.select(*keys, *columns).join(listed, keys, "left")
    held = F.coalesce("names", F.array().cast("array<string>"))
    return joined.select(*keys, *[_without(F.coalesce(c, F.lit("")), held).alias(c) for c in columns])


def similarity_excluding(pairs: DataFrame, a: str, b: str, names: DataFrame, output: str, keys: list[str]) -> DataFrame:
    """Add ``output``: the similarity of ``a`` and ``b`` once every listed name is blanked out of both."""
    bare = without_names(pairs, [a, b], names, keys).select(*keys, similarity(F.col(a), F.col(b)).alias(output))
    return pairs.join(bare, keys, "left")


def align_paired(df: DataFrame) -> DataFrame:
    """Add the similarity of ``generated`` and of ``mtl`` to ``original``, and the gain."""
    df = df.withColumn("_o", text_histogram(F.col("original")))
    for side in ("generated", "mtl"):
        df = df.withColumn(f"sim_{side}_original", X.rounded(X.tfidf_cosine(text_histogram(F.col(side)), F.col("_o")), 4))
    return df.withColumn("delta_vs_mtl", X.rounded(F.col("sim_generated_original") - F.col("sim_mtl_original"), 4)).drop("_o")


def bank_counts(bank: DataFrame) -> DataFrame:
    """Token counts of a style bank: ``novel, t, n``."""
    return bank.select("novel", F.explode(X.histogram(X.content_tokens(F.col("excerpt")))).alias("h")).groupBy("novel", F.col("h.t").alias("t")).agg(
        F.sum("h.n").alias("n")
    )


def similarity_to_bank(texts: DataFrame, bank: DataFrame, keys: list[str], text: str = "generated") -> DataFrame:
    """``keys, sim_generated_stylebank``: similarity to all excerpts of the novel as one text.

    The bank stays a table of token counts; its text is never put together.
    """
    counts = bank_counts(bank)
    norms = counts.groupBy("novel").agg(F.sum(F.col("n") * F.col("n")).alias("bank_squares"))
    tokens = texts.select(*keys, F.explode_outer(text_histogram(F.col(text))).alias("h")).select(*keys, "h.t", F.col("h.n").alias("m"))
    met = tokens.join(counts, ["novel", "t"], "left").groupBy(*keys).agg(
        F.sum(F.col("m") * F.coalesce("n", F.lit(0))).alias("dot"),
        F.sum(F.col("m") * F.col("m") * F.when(F.col("n").isNull(), LONE_WEIGHT).otherwise(1.0)).alias("text_norm"),
        F.sum(F.coalesce(F.col("n") * F.col("n"), F.lit(0))).alias("shared_squares"),
    )
    joined = met.join(norms, "novel", "left")
    bank_norm = LONE_WEIGHT * (F.col("bank_squares") - F.col("shared_squares")) + F.col("shared_squares")
    score = F.when(
        (F.col("text_norm") > 0) & (F.col("bank_squares") > 0), F.col("dot") / (F.sqrt("text_norm") * F.sqrt(bank_norm))
    ).otherwise(0.0)
    return joined.select(*keys, X.rounded(score, 4).alias("sim_generated_stylebank"))


def name_adherence(texts: DataFrame, names: DataFrame, keys: list[str], text: str = "generated") -> DataFrame:
    """``keys, names_total, names_present, name_adherence`` against the canonical names of the novel."""
    listed = names.select("novel", "pos", "name")
    totals = listed.groupBy("novel").agg(F.count("*").alias("names_total"))
    held = contains_join(texts.select(*keys, F.coalesce(text, F.lit("")).alias("text")), listed, ["novel"], "name")
    present = held.groupBy(*keys).agg(F.count("*").alias("names_present"))
    joined = texts.select(*keys).join(present, keys, "left").join(totals, "novel", "left").fillna(0, ["names_present", "names_total"])
    share = F.when(F.col("names_total") > 0, X.rounded(F.col("names_present") / F.col("names_total"), 4))
    return joined.withColumn("name_adherence", share)


def faithfulness(df: DataFrame, generated: str = "generated", source: str = "source") -> DataFrame:
    """Add intrusion, drop and coverage of ``generated`` against ``source``; all inside the row.

    With columns ``generated_entities`` and ``source_entities`` (array<struct<text,label>>) it also adds person
    retention and the names that the source never mentions.
    """
    gen, src = F.coalesce(F.col(generated), F.lit("")), F.coalesce(F.col(source), F.lit(""))
    tokens = lambda t: F.array_distinct(X.content_tokens(t, 4))
    df = df.withColumn("_gt", tokens(gen)).withColumn("_st", tokens(src))

    def unsupported(text: Column, other: str) -> Column:
        # Both arrays are bound once: a column used in a lambda could be recomputed for every sentence.
        def share(ss: Column, known: Column) -> Column:
            lone = F.filter(ss, lambda s: X.let(tokens(s), lambda ts: (F.size(ts) > 0) & ~F.arrays_overlap(ts, known)))
            return F.when(F.size(ss) > 0, X.rounded(F.size(lone) / F.size(ss), 4)).otherwise(0.0)

        return X.let(F.col(other), lambda known: X.let(X.full_sentences(text), lambda ss: share(ss, known)))

    covered = F.size(F.array_intersect("_gt", "_st"))
    out = (
        df.withColumn("intrusion_score", unsupported(gen, "_st"))
        .withColumn("drop_score", unsupported(src, "_gt"))
        .withColumn("coverage", F.when(F.size("_st") > 0, X.rounded(covered / F.size("_st"), 4)))
        .drop("_gt", "_st")
    )
    if "generated_entities" not in df.columns:
        return out

    def labelled(column: str, labels: list[str]) -> Column:
        return F.array_distinct(F.transform(F.filter(column, lambda e: e["label"].isin(labels)), lambda e: e["text"]))

    absent = lambda names: F.array_sort(F.filter(names, lambda n: ~F.contains(F.lower(src), F.lower(n))))
    people, known = labelled("generated_entities", ["PERSON"]), labelled("source_entities", ["PERSON"])
    return (
        out.withColumn("person_retention", F.when(F.size(known) > 0, X.rounded(F.size(F.array_intersect(known, people)) / F.size(known), 4)))
        .withColumn("gen_persons", F.size(people))
        .withColumn("novel_persons", absent(people))
        .withColumn("novel_person_count", F.size("novel_persons"))
        .withColumn("novel_org_gpe", absent(labelled("generated_entities", ["ORG", "GPE", "LOC"])))
    )


def alignment_report(generated: DataFrame, original: DataFrame, mtl: DataFrame, bank: DataFrame, names: DataFrame) -> DataFrame:
    """One row per generated chapter: tier 1 against its original, tier 2 against voice and names.

    The three text frames have ``novel, chapter, text``; ``bank`` has ``novel, excerpt``, ``names`` has
    ``novel, pos, name``.
    """
    keys = ["novel", "chapter"]
    rows = (
        generated.select(*keys, F.col("text").alias("generated"))
        .join(original.select(*keys, F.col("text").alias("original")), keys, "left")
        .join(mtl.select(*keys, F.col("text").alias("mtl")), keys, "left")
        .withColumn("tier", F.when(F.col("original").isNotNull(), 1).otherwise(2))
    )
    # The texts of a chapter side by side: looked through for names, and measured.
    rows = cut(rows)
    bare = without_names(rows, ["generated", "original", "mtl"], names, keys).withColumn("_o", text_histogram(F.col("original")))
    bare = cut(bare.select(*keys, *[
        X.rounded(X.tfidf_cosine(text_histogram(F.col(side)), F.col("_o")), 4).alias(f"sim_{side}_original_norm") for side in ("generated", "mtl")
    ]))
    rows = faithfulness(align_paired(rows).withColumn("source", F.coalesce("original", "mtl"))).join(bare, keys, "left")
    for side in ("generated", "original", "mtl"):
        rows = stylometry(rows, side, f"{side}_")
    rows = rows.select(
        "*",
        voice_richness("generated_").alias("voice_generated"),
        F.when(F.col("original").isNotNull(), voice_richness("original_")).alias("voice_original"),
        F.when(F.coalesce("mtl", F.lit("")) != "", voice_richness("mtl_")).alias("voice_mtl"),
        *[F.when(F.col("tier") == 1, stylometry_delta("generated_", "original_", m)).alias(f"delta_{m}") for m in METRICS],
    )
    unpaired = rows.where("tier = 2").select(*keys, "generated")
    proxies = similarity_to_bank(unpaired, bank, keys).join(name_adherence(unpaired, names, keys), keys)
    paired_only = ["sim_generated_original", "sim_mtl_original", "delta_vs_mtl", "sim_generated_original_norm", "sim_mtl_original_norm"]
    return rows.join(proxies, keys, "left").select(
        *keys, "tier",
        *[F.when(F.col("tier") == 1, F.col(c)).alias(c) for c in paired_only],
        "sim_generated_stylebank", "names_total", "names_present", "name_adherence",
        "intrusion_score", "drop_score", "coverage", "voice_generated", "voice_original", "voice_mtl",
        *[f"delta_{m}" for m in METRICS],
    )


def tier_summary(report: DataFrame) -> DataFrame:
    """Averages and wins per tier."""
    norm_gain = F.col("sim_generated_original_norm") - F.col("sim_mtl_original_norm")
    return report.groupBy("tier").agg(
        F.count("*").alias("n"),
        F.avg("delta_vs_mtl").alias("avg_delta"),
        F.count_if(F.col("delta_vs_mtl") > 0).alias("wins"),
        F.avg(norm_gain).alias("avg_norm_delta"),
        F.avg("name_adherence").alias("avg_name_adherence"),
        F.avg("intrusion_score").alias("avg_intrusion"),
        F.avg(F.coalesce("voice_generated", F.lit(0.0))).alias("avg_voice_generated"),
        F.avg(F.coalesce("voice_original", F.lit(0.0))).alias("avg_voice_original"),
        F.avg(F.coalesce("voice_mtl", F.lit(0.0))).alias("avg_voice_mtl"),
        *[F.avg(F.coalesce(f"delta_{m}", F.lit(0.0))).alias(f"avg_delta_{m}") for m in METRICS],
    )


def judge_prompt(generated: Column, source: Column) -> Column:
    return F.concat(
        F.lit(
            "Rate the repaired text from 0 to 5 for faithfulness to the source and for fluency. Reply with JSON "
            '{"faithfulness": int, "fluency": int, "notes": string}.\nSOURCE\n'
        ),
        source, F.lit("\nREPAIRED\n"), generated,
    )


JUDGEMENT = "faithfulness INT, fluency INT, notes STRING"


def parse_judgement(reply: Column) -> Column:
    """``struct<faithfulness, fluency, notes>``; null fields when the reply is no such JSON."""
    return F.from_json(reply, JUDGEMENT)


def judge_chapters(pairs: DataFrame, model_fn: Callable[[list[str]], Sequence[str]]) -> DataFrame:
    """``pairs`` with the scores ``faithfulness``, ``fluency`` and ``notes`` of columns ``generated`` and ``source``, and ``error``.

    ``error`` says why a pair has no scores: the call failed, or the reply was no such JSON.
    """
    prompt = judge_prompt(F.coalesce("generated", F.lit("")), F.coalesce("source", F.lit("")))
    said = call_model(pairs.withColumn("_prompt", prompt), "_prompt", model_fn)
    said = said.withColumn("_said", parse_judgement(unfence(F.col("reply"))))
    error = F.coalesce("error", F.when(F.col("_said.faithfulness").isNull() | F.col("_said.fluency").isNull(), F.lit("no scores in the reply")))
    return said.select(*pairs.columns, "_said.*", error.alias("error"))

"""Policy mining: signals are grouped by name, merged into clusters, scored, and ranked.

The result is relational.  ``policies`` has one bounded row per policy; surface forms, evidence chapters
and example sentences are long tables, so a name that fills a third of the corpus stays many small rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.functions import text as X
from glossaloom.functions.names import name_key, sorted_tokens
from glossaloom.lexicon import Lexicon
from glossaloom.operators.clustering import leader_clusters
from glossaloom.operators.similarity import edit_pairs, shared_cliques, substring_pairs
from glossaloom.plans.lineage import cut
from glossaloom.plans.ordered import first_rows, ranked

REVIEW_CONFIDENCE = 0.6


@dataclass
class Mined:
    """policies: one row each.  forms(novel, policy_id, pos, form); evidence(novel, policy_id, chapter);
    contexts(novel, policy_id, pos, context)."""

    policies: DataFrame
    forms: DataFrame
    evidence: DataFrame
    contexts: DataFrame

    def assembled(self) -> DataFrame:
        """Policies with array columns, for export of stores whose lists fit a row."""
        keys = ["novel", "policy_id"]
        listed = self.forms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("m"))
        chapters = self.evidence.groupBy(*keys).agg(F.sort_array(F.collect_set("chapter")).alias("evidence"))
        quotes = self.contexts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "context"))).alias("c"))
        return (
            self.policies.join(listed, keys, "left").join(chapters, keys, "left").join(quotes, keys, "left")
            .withColumn("match", F.col("m.form")).withColumn("contexts", F.col("c.context")).drop("m", "c")
        )


# --------------------------------------------------------------------------- relation between name keys


def name_relations(names: DataFrame, threshold: float, lex: Lexicon, min_len_for_edit: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(pairs, cliques)`` for name keys: same words, a contained name, a shared core word, or close spelling."""
    return name_pairs(names, threshold, lex, min_len_for_edit), shared_cliques(name_memberships(names, lex))


def name_memberships(names: DataFrame, lex: Lexicon) -> DataFrame:
    """``novel, name, clique``: names of the same words, or of several words with a core word in common, share a clique."""
    stops = X.words_lit(lex.name_stopwords)
    tokens = X.words(F.col("name"))
    same_words = names.select("novel", "name", F.concat(F.lit("w:"), F.array_join(sorted_tokens(F.col("name")), " ")).alias("clique"))
    core = F.filter(F.array_distinct(tokens), lambda t: (F.length(t) >= 4) & ~F.array_contains(stops, t))
    shared_word = names.where(F.size(tokens) > 1).select(
        "novel", "name", F.explode(F.transform(core, lambda t: F.concat(F.lit("t:"), t))).alias("clique")
    )
    return same_words.unionByName(shared_word)


def name_pairs(names: DataFrame, threshold: float, lex: Lexicon, min_len_for_edit: int = 1, only: DataFrame | None = None) -> DataFrame:
    """``novel, lo, hi``: one name holds the other, or close spelling; with ``only(novel, name)`` pairs of which one is listed.

    A lone word is not tied to a longer name merely because that name contains it.
    """
    stops = X.words_lit(lex.name_stopwords)
    short, long = X.words(F.col("short")), X.words(F.col("long"))
    bare = (F.size(short) == 1) & (F.size(F.array_distinct(long)) > 1) & F.array_contains(long, F.get(short, F.lit(0)))
    contained = (
        substring_pairs(names, only=only)
        .where(F.exists(short, lambda t: ~F.array_contains(stops, t)) & ~bare)
        .select("novel", F.least("short", "long").alias("lo"), F.greatest("short", "long").alias("hi"))
    )
    spelled = edit_pairs(names, threshold, min_length=min_len_for_edit, only=only)
    return contained.unionByName(spelled).distinct()


def cluster_names(names: DataFrame, threshold: float = 0.3, lex: Lexicon | None = None, min_len_for_edit: int = 1) -> DataFrame:
    """``novel, name, leader`` for ``names(novel, name)``."""
    names = cut(names.select("novel", "name").distinct())
    return leader_clusters(names, *name_relations(names, threshold, lex or Lexicon(), min_len_for_edit))


# --------------------------------------------------------------------------- cleaning of surface forms


def bare_form(text: Column) -> Column:
    return F.regexp_replace(X.strip(text), "^['`\"]+|['`\"]+$", "")


def clean_form(form: Column) -> Column:
    """Without surrounding quotes and punctuation, single blanks, without one leading article."""
    core = F.regexp_replace(X.strip(form), r"^['`\".,;:!?()\[\]{}]+|['`\".,;:!?()\[\]{}]+$", "")
    ws = X.words(core)
    article = F.lower(F.coalesce(F.get(ws, F.lit(0)), F.lit(""))).isin("the", "a", "an")
    return X.strip(F.array_join(F.slice(ws, F.when(article, 2).otherwise(1), F.size(ws) + 1), " "))


def is_generic(canonical: Column, lex: Lexicon) -> Column:
    return F.forall(X.words(canonical), lambda w: F.array_contains(X.words_lit(lex.generic), w))


def leads_with(form: Column, words: list[str], fold: bool = False) -> Column:
    first = X.first_word(form)
    return F.array_contains(X.words_lit([w.lower() for w in words] if fold else words), F.lower(first) if fold else first)


# --------------------------------------------------------------------------- scoring


def confidence(n: Column, consistency: Column, base: float = 0.5, per_occurrence: float = 0.03) -> Column:
    """Uncapped confidence: more sightings raise it, inconsistent spelling halves it at worst."""
    return (F.lit(base) + F.lit(per_occurrence) * n) * (F.lit(0.5) + F.lit(0.5) * consistency)


def form_counts(signals: DataFrame) -> DataFrame:
    """One row per surface form with its name key; the only step that sees every signal."""
    counted = signals.groupBy("novel", "text").agg(
        F.count("*").alias("n"),
        F.min("seq").alias("seen"),
        F.max(F.col("type") == "honorific").alias("is_honorific"),
        F.max(F.col("extractor").startswith("terminology.")).alias("is_term"),
    )
    return counted.withColumn("name", name_key(F.col("text")))


@dataclass
class Clusters:
    """What scoring needs of clusters, keyed by ``novel, leader``: ``chosen`` (n_chapters, raw_canonical, canonical), ``aliases``
    (alias), ``quotes`` (context, pos), ``evidence`` (chapter), ``occurrence`` (n_signals, is_honorific, is_term) and ``texts``
    (text, n), the surface forms as they stand."""

    chosen: DataFrame
    aliases: DataFrame
    quotes: DataFrame
    evidence: DataFrame
    occurrence: DataFrame
    texts: DataFrame

    TABLES = ("chosen", "aliases", "quotes", "evidence", "occurrence", "texts")


def describe_clusters(forms: DataFrame, signals: DataFrame, min_support: int, lex: Lexicon) -> Clusters:
    """Canonical name, aliases, evidence and quotes of every cluster of ``forms`` (form counts with ``leader``) that has enough
    chapters and a usable name.  ``signals``: novel, chapter, text, seq, context."""
    group = ["novel", "leader"]
    sightings = signals.select("novel", "text", "chapter").distinct().join(forms.select("novel", "text", "leader"), ["novel", "text"])
    evidence = sightings.select(*group, "chapter").distinct()
    support = evidence.groupBy(*group).agg(F.count("*").alias("n_chapters")).where(F.col("n_chapters") >= min_support)

    surface = forms.groupBy(*group, bare_form(F.col("text")).alias("form")).agg(
        F.sum("n").alias("n"), F.min(F.struct("name", "seen")).alias("seen")
    )
    poor_lead = F.when(leads_with(F.col("form"), lex.penalty_leads), 1).otherwise(0)
    chosen = (
        surface.groupBy(*group)
        .agg(F.min_by("form", F.struct(poor_lead, -F.col("n"), F.col("seen"))).alias("raw_canonical"))
        .withColumn("canonical", clean_form(F.col("raw_canonical")))
        .join(support, group)
        .where(
            (F.col("canonical") != "")
            & ~is_generic(F.col("canonical"), lex)
            & ~leads_with(F.col("canonical"), lex.fragment_leads)
        )
    )
    chosen = cut(chosen)
    aliases = (
        surface.join(chosen.select(*group, "raw_canonical", "canonical"), group)
        .where(F.col("form") != F.col("raw_canonical"))
        .withColumn("alias", clean_form(F.col("form")))
        .where(
            (F.col("alias") != "")
            & (F.col("alias") != F.col("canonical"))
            & ~leads_with(F.col("alias"), lex.stop_words + lex.stop_prefixes, fold=True)
        )
        .select(*group, "alias")
        .distinct()
    )
    kept = forms.join(chosen.select(*group), group, "left_semi")
    occurrence = kept.groupBy(*group).agg(
        F.sum("n").alias("n_signals"), F.max("is_honorific").alias("is_honorific"), F.max("is_term").alias("is_term")
    )
    texts = kept.select(*group, "text", "n")
    return Clusters(chosen, aliases, _first_contexts(signals, kept), evidence.join(chosen.select(*group), group, "left_semi"), occurrence, texts)


def score_clusters(
    clusters: Clusters,
    totals: DataFrame,
    min_confidence: float = 0.4,
    base: float = 0.5,
    per_occurrence: float = 0.03,
    cap: float = 0.99,
    deterministic_at: float = 0.8,
    verified: bool = False,
) -> Mined:
    """Scores, ranks, review flags and ids; nothing here looks at signals again."""
    group = ["novel", "leader"]
    named = clusters.chosen.select(*group, F.col("canonical").alias("text"))
    as_named = clusters.texts.join(named, [*group, "text"]).groupBy(*group).agg(F.sum("n").alias("n_canonical"))
    occurrence = clusters.occurrence.join(as_named, group, "left")
    scored = (
        clusters.chosen.join(occurrence, group)
        .join(totals.select("novel", "total_chapters"), "novel")
        .withColumn("frequency", X.rounded(F.least(F.col("n_chapters") / F.col("total_chapters"), F.lit(1.0)), 3))
        .withColumn("consistency", X.rounded(F.coalesce("n_canonical", "n_signals") / F.col("n_signals"), 3))
        .withColumn("raw_confidence", confidence(F.col("n_signals"), F.col("consistency"), base, per_occurrence))
        .withColumn("_conf", F.least("raw_confidence", F.lit(cap)))
        .withColumn("_conf", F.when(F.lit(verified), F.greatest("_conf", F.lit(0.85))).otherwise(F.col("_conf")))
        .where(F.col("_conf") >= min_confidence)
        .select(
            *group,
            F.when(F.col("is_honorific"), "honorific").when(F.col("is_term"), "terminology").otherwise("entity-naming").alias("type"),
            F.col("canonical").alias("trigger"),
            X.rounded(F.col("_conf"), 3).alias("confidence"),
            F.when(F.col("_conf") >= deterministic_at, "deterministic").otherwise("prompted").alias("applies"),
            "frequency", "consistency", F.lit(1.0).alias("context_score"), "raw_confidence",
            "n_signals", F.col("n_chapters").alias("evidence_count"),
        )
    )
    policies = flag_for_review(ranked(scored, "novel", [F.col("confidence").desc(), F.col("leader")]))
    policies = cut(policies.withColumn("policy_id", F.format_string("p_%03d", "rank")))

    ids = policies.select(*group, "policy_id", "trigger")
    alias_rank = ranked(clusters.aliases.join(ids, group).select("novel", "policy_id", "alias")
                        .withColumn("_key", F.concat_ws("\u0001", "novel", "policy_id")), "_key", [F.col("alias")], "pos")
    all_forms = (
        ids.select("novel", "policy_id", F.lit(0).cast("bigint").alias("pos"), F.col("trigger").alias("form"))
        .unionByName(alias_rank.select("novel", "policy_id", "pos", F.col("alias").alias("form")))
    )
    public = policies.select(
        "novel", "policy_id", "type", "trigger", F.col("trigger").alias("render_as"), "applies", "confidence",
        "raw_confidence", "frequency", "consistency", "context_score", "evidence_count", "n_signals",
        "needs_review", F.lit(False).alias("rejected"), "note", "rank", F.col("leader").alias("name"),
    )
    keyed = lambda df: df.join(ids.select(*group, "policy_id"), group)
    return Mined(
        public,
        all_forms,
        keyed(clusters.evidence).select("novel", "policy_id", "chapter"),
        keyed(clusters.quotes).select("novel", "policy_id", "pos", "context"),
    )


def mine_policies(
    signals: DataFrame,
    totals: DataFrame,
    min_support: int = 2,
    min_confidence: float = 0.4,
    threshold: float = 0.3,
    base: float = 0.5,
    per_occurrence: float = 0.03,
    cap: float = 0.99,
    deterministic_at: float = 0.8,
    merge_variants: bool = True,
    min_len_for_edit: int = 1,
    lex: Lexicon | None = None,
    verify: Callable[[DataFrame], DataFrame] | None = None,
) -> Mined:
    """Signals to policies.  ``totals`` has ``novel, total_chapters``.

    ``verify`` may take candidates ``novel, leader, canonical, aliases, contexts`` and return the confirmed
    ones as ``novel, leader, canonical, aliases`` (null aliases keep the mined ones).
    """
    lex = lex or Lexicon()
    counts = cut(form_counts(signals))
    if merge_variants:
        clusters = cluster_names(counts.select("novel", "name"), threshold, lex, min_len_for_edit)
        forms = cut(counts.join(clusters, ["novel", "name"]))
    else:
        forms = counts.withColumn("leader", F.col("name"))
    found = describe_clusters(forms, signals, min_support, lex)
    if verify is not None:
        found = _confirmed(found, verify)
    return score_clusters(found, totals, min_confidence, base, per_occurrence, cap, deterministic_at, verify is not None)


def _confirmed(found: Clusters, verify: Callable[[DataFrame], DataFrame]) -> Clusters:
    """The clusters that ``verify`` confirms, under the names it gives."""
    group = ["novel", "leader"]
    listed = found.aliases.groupBy(*group).agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    sentences = found.quotes.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("pos", "context"))).alias("q"))
    candidates = found.chosen.join(listed, group, "left").join(sentences, group, "left")
    confirmed = cut(
        verify(candidates.select(*group, "canonical", "aliases", F.col("q.context").alias("contexts"))).select(
            *group, F.col("canonical").alias("_name"), F.col("aliases").alias("_aliases")
        )
    )
    chosen = found.chosen.join(confirmed, group).withColumn("canonical", F.coalesce("_name", "canonical")).drop("_name", "_aliases")
    renamed = confirmed.where(F.col("_aliases").isNotNull())
    aliases = (
        found.aliases.join(renamed, group, "left_anti")
        .join(confirmed.select(*group), group, "left_semi")
        .unionByName(renamed.select(*group, F.explode("_aliases").alias("alias")))
        .distinct()
    )
    return replace(found, chosen=chosen, aliases=aliases)


def _first_contexts(signals: DataFrame, forms: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` distinct non-empty sentences of each cluster, in reading order."""
    quoted = (
        signals.select("novel", "text", "seq", X.strip(F.coalesce("context", F.lit(""))).alias("context"))
        .where("context != ''")
        .groupBy("novel", "text", "context")
        .agg(F.min("seq").alias("seq"))
    )
    placed = (
        quoted.join(forms.select("novel", "text", "name", "leader"), ["novel", "text"])
        .groupBy("novel", "leader", "context")
        .agg(F.min(F.struct("name", "seq")).alias("at"))
    )
    return first_rows(placed, ["novel", "leader"], [F.col("at")], k, "pos").drop("at")


def flag_for_review(policies: DataFrame) -> DataFrame:
    """Mark lone words that are part of a longer same-type name, and low confidence; neither stays deterministic."""
    words = F.array_distinct(X.words(F.col("trigger")))
    longer = (
        policies.where(F.size(words) > 1)
        .select("novel", "type", F.explode(words).alias("word"), "rank")
        .groupBy("novel", "type", "word")
        .agg(F.min("rank").alias("of_rank"))
    )
    lone = policies.where(F.size(words) == 1).withColumn("word", F.get(words, F.lit(0)))
    others = policies.where(F.coalesce(F.size(words) != 1, F.lit(True))).withColumn("of_rank", F.lit(None).cast(longer.schema["of_rank"].dataType))
    flagged = lone.join(longer, ["novel", "type", "word"], "left").drop("word").unionByName(others)
    low = F.col("confidence") < REVIEW_CONFIDENCE
    ambiguous = F.col("of_rank").isNotNull()
    note = F.concat_ws(
        "; ",
        F.when(ambiguous, F.format_string("ambiguous subset of p_%03d", "of_rank")),
        F.when(low, F.lit("low confidence, needs review")),
    )
    return (
        flagged.withColumn("note", note)
        .withColumn("needs_review", ambiguous | low)
        .withColumn("applies", F.when(ambiguous | low, "prompted").otherwise(F.col("applies")))
        .drop("of_rank")
    )


def mining_summary(policies: DataFrame) -> DataFrame:
    """Counts by type and mode plus a grand total, in one pass."""
    return (
        policies.groupingSets([["type"], ["applies"], []], "type", "applies")
        .agg(
            F.count("*").alias("n"),
            F.avg("confidence").alias("avg_confidence"),
            F.count_if(F.col("confidence") < REVIEW_CONFIDENCE).alias("low"),
            F.count_if("needs_review").alias("review"),
            F.count_if("rejected").alias("rejected"),
        )
    )

"""Signal extraction: one row per place where a chapter shows a name, term or form of address.

``chapters`` frames have ``novel, chapter, text``.  All patterns of a chapter are found in one scan of the
text: runs of capitalised words are marked once, and titles, suffix phrases, multi-word and single names
are read off each run with array functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.functions import text as X
from glossaloom.lexicon import SOUND_WORDS, Lexicon
from glossaloom.operators.modelcalls import apply_rowwise
from glossaloom.plans.lineage import cut

CAPITAL_RUN = r"(?U)(?=[A-Z])\b[A-Z][a-z]++\b(?:\s++[A-Z][a-z]++\b)*+"
BRACKET = r"\[[^\]]{2,50}\]"
QUOTED = r"'[A-Z][^']{2,50}'"
POSSESSIVE = r"(?U)(?=[A-Z])\b[A-Z][a-z]++\b(?:'s?\s++[A-Z][a-z]++\b)++"

# Forms of address by source language, in reporting order.
UNIVERSAL_ADDRESS = [
    r"Your\s+Excellency", r"Your\s+Majesty", r"Your\s+Highness", r"Your\s+Honor", r"Your\s+Grace",
    r"Your\s+Lordship", r"(?i:My\s+Lord)", r"(?i:My\s+Lady)", r"Sir\s+Knight",
]
KOREAN_ADDRESS = [
    "hyung|Hyung", "noona|Noona", "oppa|Oppa", "unni|Unni", "ahjussi|Ahjussi", "sunbae|Sunbae|senpai|Senpai",
    "hubae|Hubae", "nim|Nim", "ajumma|Ajumma",
]
JAPANESE_SUFFIXES = ["-san", "-sama", "-kun", "-chan", "-sensei", "-senpai", "-dono"]
CHINESE_ADDRESS = [
    r"Senior\s+Brother|Junior\s+Brother", r"Senior\s+Sister|Junior\s+Sister", r"Elder\s+Brother|Elder\s+Sister",
    r"Martial\s+Uncle|Martial\s+Aunt", r"Martial\s+Brother|Martial\s+Sister", r"Dao\s+Friend|Fellow\s+Daoist",
    r"Sect\s+Master|Sect\s+Leader", r"Young\s+Master|Young\s+Miss", "Patriarch|Matriarch", "Ancestor",
]
ADDRESS_BY_LANGUAGE = {
    "korean": KOREAN_ADDRESS,
    "japanese": [rf"\w+{suffix}" for suffix in JAPANESE_SUFFIXES],
    "chinese": CHINESE_ADDRESS,
}

#: Where a signal stands in the reading order that breaks ties: extractor family, chapter, pattern, place.
SEQ_FIELDS = ["family", "chapter", "pattern", "s", "m", "sub"]
ENTITY, TERMINOLOGY, HONORIFIC, MODEL = range(4)


def _signal(kind: str, extractor: str, family: int, pattern: int | Column, occ: Column, text: Column, context: Column,
            sub: Column, support: str | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(extractor).alias("extractor"),
        F.lit(family).alias("family"),
        (F.lit(pattern) if isinstance(pattern, int) else pattern).alias("pattern"),
        occ["s"].alias("s"),
        occ["m"].alias("m"),
        sub.cast("int").alias("sub"),
        text.alias("text"),
        context.alias("context"),
        F.lit(support).cast("string").alias("support"),
    )


def _run_signals(runs: Column, lex: Lexicon) -> Column:
    """Title names, suffix phrases, multi-word and single names of every capital run."""
    titles, suffixes = X.words_lit(lex.titles), X.words_lit(lex.domain_suffixes)
    stops, prefixes = X.words_lit(lex.stop_words), X.words_lit(lex.stop_prefixes)

    def of_run(occ: Column) -> Column:
        def with_words(ws: Column) -> Column:
            def with_gaps(gaps: Column) -> Column:
                n = F.size(ws)

                def phrase(first: Column, last: Column) -> Column:
                    """Words ``first..last`` (1-based) with the blanks between them."""
                    tail = F.zip_with(
                        F.slice(gaps, first, F.greatest(last - first, F.lit(0))),
                        F.slice(ws, first + 1, F.greatest(last - first, F.lit(0))),
                        lambda gap, w: F.concat(gap, w),
                    )
                    return F.concat(F.get(ws, first - 1), F.array_join(tail, ""))

                def context(first: Column, last: Column) -> Column:
                    before = F.when(first > 1, F.concat(phrase(F.lit(1), first - 1), F.get(gaps, first - 2))).otherwise("")
                    after = F.when(last < n, F.concat(F.get(gaps, last - 1), phrase(last + 1, n))).otherwise("")
                    return F.when(occ["left"].isNull(), occ["context"]).otherwise(
                        X.clip_context(F.concat(occ["left"], before), phrase(first, last), F.concat(after, occ["right"]))
                    )

                def all_stop(upto: Column) -> Column:
                    return F.forall(F.slice(ws, 1, upto), lambda w: F.array_contains(stops, w))

                def titled(at: Column) -> Column:
                    name, ctx = phrase(at + 1, n), context(at, n)
                    full = F.concat(F.get(ws, at - 1), F.lit(" "), name)
                    signals = F.array(
                        _signal("entity", "entity.title_name", ENTITY, 0, occ, full, ctx, F.lit(0)),
                        _signal("entity", "entity.title_name_bare", ENTITY, 0, occ, name, ctx, F.lit(1)),
                    )
                    return F.slice(signals, 1, F.when(F.array_contains(stops, name), 1).otherwise(2))

                def suffixed(last: Column) -> Column:
                    return F.array(_signal("entity", "entity.domain_suffix", ENTITY, 1, occ, phrase(F.lit(1), last),
                                           context(F.lit(1), last), F.lit(0)))

                first_title = F.array_position(
                    F.transform(F.slice(ws, 1, F.greatest(n - 1, F.lit(0))), lambda w: F.array_contains(titles, w)),
                    F.lit(True),
                ).cast("int")
                last_suffix = F.coalesce(
                    F.array_max(F.filter(F.sequence(F.lit(1), n), lambda i: F.array_contains(suffixes, F.get(ws, i - 1)))),
                    F.lit(0),
                )
                head = F.get(ws, F.lit(0))
                multi = X.only_if(
                    (n >= 2) & (n <= 4) & ~F.array_contains(stops, head) & ~F.array_contains(prefixes, head) & ~all_stop(n),
                    lambda: F.array(_signal("entity", "entity.multi_cap", ENTITY, 2, occ, occ["text"],
                                            context(F.lit(1), n), F.lit(0))),
                )
                inside = F.filter(
                    F.sequence(F.lit(1), n),
                    lambda i: (F.length(F.get(ws, i - 1)) >= 3)
                    & ~F.array_contains(stops, F.get(ws, i - 1))
                    & ~F.when(i == 1, X.opens_sentence(occ)).otherwise(F.get(gaps, i - 2).rlike("\n[ \t]*$")),
                )
                singles = F.transform(
                    inside,
                    lambda i: _signal("entity", "entity.single_cap", ENTITY, 3, occ, F.get(ws, i - 1), context(i, i), i,
                                      support="single"),
                )
                title_at = F.filter(F.array(first_title), lambda at: at > 0)
                suffix_at = F.filter(F.array(last_suffix), lambda at: (at >= 2) & ~all_stop(at))
                phrases = X.only_if(
                    n >= 2,
                    lambda: F.concat(
                        F.flatten(F.transform(title_at, titled)), F.flatten(F.transform(suffix_at, suffixed)), multi
                    ),
                )
                return F.concat(phrases, singles)

            return X.let(X.found(occ["text"], r"(?U)\s+"), with_gaps)

        return X.let(F.split(occ["text"], r"(?U)\s+"), with_words)

    return F.flatten(F.transform(runs, of_run))


def _term_signals(text: Column) -> Column:
    def plain(occs: Column, extractor: str, pattern: int, form: Callable[[Column], Column]) -> Column:
        return F.transform(
            occs,
            lambda o: _signal("terminology", extractor, TERMINOLOGY, pattern, o, form(o), o["context"], F.lit(0), "term"),
        )

    inner = lambda o: X.strip(F.substring(o["text"], F.lit(2), F.length(o["text"]) - 2))
    bracket = F.filter(
        plain(X.occurrences(text, BRACKET), "terminology.bracket", 0, inner),
        lambda s: (s["text"] != "") & ~s["text"].startswith("#")
        & ~(s["text"].rlike(r"^\p{Ll}") & F.contains(s["text"], F.lit(" "))),
    )
    quoted = F.filter(
        plain(X.occurrences(text, QUOTED), "terminology.quoted", 1, inner), lambda s: F.size(X.words(s["text"])) >= 2
    )
    possessive = plain(X.occurrences(text, POSSESSIVE), "terminology.possessive", 2, lambda o: o["text"])
    return F.concat(
        X.only_if(F.contains(text, F.lit("[")), lambda: bracket),
        X.only_if(F.contains(text, F.lit("'")), lambda: F.concat(quoted, possessive)),
    )


def address_patterns(languages: Sequence[str] | None = None) -> list[str]:
    """Universal forms of address plus those of ``languages`` (all when None; unknown ones add nothing)."""
    keys = ADDRESS_BY_LANGUAGE if not languages else [x.lower() for x in languages]
    return UNIVERSAL_ADDRESS + [p for k in keys for p in ADDRESS_BY_LANGUAGE.get(k, [])]


def _address_signals(text: Column, languages: Sequence[str] | None) -> Column:
    """Fixed phrases cannot overlap one another, so one alternation finds them all; name suffixes go one by one."""
    patterns = address_patterns(languages)

    def signals(found: Column, number: Callable[[Column], Column]) -> Column:
        return F.transform(
            found,
            lambda o: _signal("honorific", "honorific.pattern", HONORIFIC, number(o["text"]), o, o["text"], o["context"], F.lit(0)),
        )

    fixed = [(i, p) for i, p in enumerate(patterns) if not p.startswith(r"\w+")]
    # The first-letter test keeps the costlier Unicode word boundary off most characters.
    any_fixed = r"(?U)(?=[hHnNoOuUaAsSmMyYJEDFP])\b(?:" + "|".join(p for _, p in fixed) + r")\b"

    def fixed_number(match: Column) -> Column:
        return F.coalesce(*[F.when(match.rlike(f"(?U)^(?:{p})$"), F.lit(i)) for i, p in fixed])

    # Most texts hold no form at all: asking for one first spares them the marking and cutting.
    parts = [X.only_if(text.rlike(any_fixed), lambda: signals(X.occurrences(text, any_fixed), fixed_number))]
    for i, p in enumerate(patterns):
        if p.startswith(r"\w+"):
            suffix = p[3:]
            parts.append(
                X.only_if(
                    F.contains(text, F.lit(suffix)),
                    lambda i=i, p=p: signals(X.occurrences(text, rf"(?U)\b{p}\b"), lambda _: F.lit(i)),
                )
            )
    return F.concat(*parts)


SIGNAL_COLUMNS = ["novel", "chapter", "type", "extractor", "text", "context", "seq"]


def raw_signals(
    chapters: DataFrame,
    lex: Lexicon | None = None,
    languages: Sequence[str] | None = None,
    families: Sequence[int] = (ENTITY, TERMINOLOGY, HONORIFIC),
) -> DataFrame:
    """Signals before the support filter; ``support`` names the group whose support is tested."""
    lex = lex or Lexicon()
    parts = {
        ENTITY: lambda text: _run_signals(X.occurrences(text, CAPITAL_RUN), lex),
        TERMINOLOGY: _term_signals,
        HONORIFIC: lambda text: _address_signals(text, languages),
    }
    # Few texts hold the reserved characters; the clean text is bound, as it is asked for some twenty things.
    marked = F.contains("text", F.lit(X.OPEN)) | F.contains("text", F.lit(X.CLOSE))
    clean = F.when(marked, F.translate("text", X.OPEN + X.CLOSE, "")).otherwise(F.col("text"))
    signals = X.let(clean, lambda text: F.concat(*[parts[f](text) for f in families]))
    found = chapters.select("novel", "chapter", F.explode(signals).alias("x"))
    seq = F.struct(
        F.col("x.family").alias("family"), F.col("chapter"), F.col("x.pattern").alias("pattern"),
        F.col("x.s").alias("s"), F.col("x.m").alias("m"), F.col("x.sub").alias("sub"),
    )
    return found.select("novel", "chapter", "x.type", "x.extractor", "x.text", "x.context", seq.alias("seq"), "x.support")


def apply_support(raw: DataFrame, min_support: int = 2) -> DataFrame:
    """Keep single names and terms that occur in at least ``min_support`` chapters of their novel."""
    if min_support <= 1:
        return raw.select(*SIGNAL_COLUMNS)
    known = (
        raw.where(F.col("support").isNotNull())
        .groupBy("novel", "support", "text")
        .agg(F.countDistinct("chapter").alias("n_chapters"))
        .where(F.col("n_chapters") >= min_support)
    )
    kept = raw.where(F.col("support").isNotNull()).join(known, ["novel", "support", "text"], "left_semi")
    return raw.where(F.col("support").isNull()).select(*SIGNAL_COLUMNS).unionByName(kept.select(*SIGNAL_COLUMNS))


def extract_signals(
    chapters: DataFrame,
    min_support: int = 2,
    lex: Lexicon | None = None,
    languages: Sequence[str] | None = None,
    entity_fn: Callable[[list[str]], list[list[tuple]]] | None = None,
    families: Sequence[int] = (ENTITY, TERMINOLOGY, HONORIFIC),
    materialise: bool = True,
) -> DataFrame:
    """All signals of ``chapters``.

    ``materialise`` writes the raw signals to the checkpoint folder, so that the support filter and every
    later mining step read signals and the corpus itself is scanned once.
    """
    raw = raw_signals(chapters, lex, languages, families)
    signals = apply_support(cut(raw) if materialise else raw, min_support)
    if entity_fn is not None:
        signals = signals.unionByName(model_entities(chapters, entity_fn))
    return signals


def signal_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("type").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- model-found entities

# Labels kept, and the tags of words that lead a fragment.
ENTITY_LABELS = ["PERSON", "ORG", "GPE", "FAC", "PRODUCT", "NORP", "LOC", "EVENT", "WORK_OF_ART"]
FRAGMENT_TAGS = ["VBG", "VBN", "VBD", "VB", "VBP", "VBZ"]

ENTITY_ROWS = (
    "found array<struct<text:string,label:string,first_tag:string,first_pos:string,n_tokens:int,sentence:string>>"
)


def is_noise(text: Column) -> Column:
    """Too short, no letters, a sound word, or a two- or three-letter block said twice."""
    low = F.regexp_replace(F.lower(text), "[!-]+$", "")
    return (
        (F.length(X.strip(text)) < 2)
        | ~text.rlike(r"\p{L}")
        | low.isin(SOUND_WORDS)
        | ((F.length(low) >= 4) & low.rlike(r"(?s)(.{2,3})\1"))
    )


def entity_rows(texts: DataFrame, entity_fn: Callable[[list[str]], list[list[tuple]]]) -> DataFrame:
    """One row per entity that ``entity_fn(texts)`` reports as (text, label, tag, pos, n_tokens, sentence)."""
    found = apply_rowwise(texts, ["text"], ENTITY_ROWS, entity_fn)
    keep = [c for c in texts.columns if c != "text"]
    return found.select(*keep, F.posexplode("found").alias("i", "e")).select(*keep, "i", "e.*")


def model_entities(chapters: DataFrame, entity_fn: Callable[[list[str]], list[list[tuple]]]) -> DataFrame:
    """Signals of an entity model, without noise, fragments and lone common nouns."""
    text = X.strip(F.col("text"))
    rows = entity_rows(chapters.select("novel", "chapter", "text"), entity_fn).where(
        F.col("label").isin(ENTITY_LABELS)
        & ~is_noise(text)
        & ~F.coalesce(F.col("first_tag").isin(FRAGMENT_TAGS), F.lit(False))
        & ~((F.col("n_tokens") == 1) & F.coalesce(F.col("first_pos") != "PROPN", F.lit(False)))
    )
    seq = F.struct(
        F.lit(MODEL).alias("family"), F.col("chapter"), F.lit(0).alias("pattern"),
        F.lit(0).alias("s"), F.col("i").cast("int").alias("m"), F.lit(0).alias("sub"),
    )
    return rows.select(
        "novel", "chapter", F.lit("entity").alias("type"), F.concat(F.lit("ner.model."), F.col("label")).alias("extractor"),
        text.alias("text"), F.substring(X.strip(F.coalesce("sentence", F.lit(""))), 1, 200).alias("context"), seq.alias("seq"),
    )

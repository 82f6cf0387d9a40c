"""Passages: retrieval, substitution, shielding, cleaning and chunking of the documents, with policies mined
from their single names."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaloom.functions import text as X
from glossaloom.operators import chunks as C
from glossaloom.operators import extract as E
from glossaloom.operators import mining as M
from glossaloom.operators import retrieval as R
from glossaloom.operators import rewriting as W
from glossaloom.operators import substitution as S
from glossaloom.sources import corpus
from glossaloom.workloads.frames import chapters, table, texts, totals, turns
from glossaloom.workloads.names import _SCORES


def store(spark, sf):
    """Policies of single names (one form each), under the same rules as ``form_policies``."""
    signals = E.extract_signals(chapters(spark, sf), families=[E.ENTITY]).where("extractor = 'entity.single_cap'")
    return M.mine_policies(signals, totals(spark, sf), merge_variants=False)


def retrieved_policies(spark, sf):
    s = store(spark, sf)
    return R.retrieve_policies(chapters(spark, sf), s.policies, s.forms).select("novel", "chapter", "policy_id")


def retrieved_top_policies(spark, sf):
    s = store(spark, sf)
    return R.retrieve_policies(chapters(spark, sf), s.policies, s.forms, k=2).select("novel", "chapter", "policy_id")


def prompted_policies(spark, sf):
    s = store(spark, sf)
    matched = R.retrieve_policies(chapters(spark, sf), s.policies, s.forms)
    wanted = s.policies.where("applies = 'prompted' and not rejected").select("novel", "policy_id", "trigger")
    return matched.join(wanted, ["novel", "policy_id"]).select("novel", "chapter", "trigger")


def policy_spans(spark, sf):
    s = store(spark, sf)
    spans = R.find_spans(chapters(spark, sf), s.policies, s.forms)
    return spans.groupBy("novel", "chapter", "policy_id").agg(F.count("*").alias("n"), F.min("first").alias("first_token"))


def prepass_texts(spark, sf):
    s = store(spark, sf)
    rewritten, _ = S.prepass(chapters(spark, sf), s.policies, s.forms)
    return rewritten.select("novel", "chapter", F.md5("new_text").alias("text_md5"))


def prepass_trace(spark, sf):
    s = store(spark, sf)
    rewritten, _ = S.prepass(chapters(spark, sf), s.policies, s.forms)
    return S.trace_rows(rewritten).select("novel", "chapter", "original", "output", "policy_id", "confidence", "start", "stop")


def shield_mapping(spark, sf):
    s = store(spark, sf)
    names = s.policies.select("novel", F.col("trigger").alias("canonical"), F.col("trigger").alias("form"))
    return S.shield_entities(chapters(spark, sf), names)[1]


def shield_round_trip(spark, sf):
    s = store(spark, sf)
    names = s.policies.select("novel", F.col("trigger").alias("canonical"), F.col("trigger").alias("form"))
    shielded, mapping = S.shield_entities(chapters(spark, sf), names)
    back = S.restore_entities(shielded.select("novel", "chapter", F.col("shielded").alias("text")), mapping)
    return back.select("novel", "chapter", F.md5(F.lower("text")).alias("text_md5"))


def known_phrases(spark, sf):
    """Documents that hold a whole benchmark passage, found as error phrases."""
    rules = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("mtl_phrase"))
    return S.scan_known_errors(chapters(spark, sf), rules).select("novel", "chapter", "id")


def corrected_phrases(spark, sf):
    """Benchmark passages as error phrases; what they are corrected to is an error phrase itself."""
    passages = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("mtl_phrase"), F.lit("fixed passage").alias("correct_translation")
    ).where("mtl_phrase <> ''")
    second = passages.select(F.lit("again").alias("id"), F.lit("fixed passage").alias("mtl_phrase"), F.lit("mended text").alias("correct_translation")).distinct()
    rules = passages.unionByName(second).withColumn("auto_apply", F.lit(None).cast("boolean"))
    guard = chapters(spark, sf).select("novel").distinct().withColumn("form", F.lit("of the"))
    out = S.apply_known_errors(chapters(spark, sf), rules, guard)
    return out.where("size(fixes) > 0").select("novel", "chapter", F.size("fixes").alias("n_fixes"), F.md5("fixed_text").alias("text_md5"))


def cleaned_texts(spark, sf):
    return chapters(spark, sf).select("novel", "chapter", F.md5(S.clean_artifacts(F.col("text"))).alias("text_md5"))


def chapter_chunks(spark, sf):
    text = X.normalise_newlines(F.col("text"))
    rows = chapters(spark, sf).select("novel", "chapter", F.posexplode(C.chunk_text(text)).alias("k", "chunk"))
    return rows.select("novel", "chapter", "k", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


def reference_chunks(spark, sf):
    """Turns as chunks of a conversation aligned with its next turn's lines."""
    df = turns(spark, sf).select("conv_id", "turn", C.chunk_text(X.normalise_newlines(F.col("source")), 60, 40, 80).alias("c"),
                                 X.normalise_newlines(F.col("generated")).alias("r"))
    rows = df.select("conv_id", "turn", F.posexplode(C.align_reference(F.col("c"), F.col("r"))).alias("k", "reference"))
    return rows.select("conv_id", "turn", "k", F.md5("reference").alias("reference_md5"))


def continuity_tails(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.md5(C.tail_paragraphs(X.normalise_newlines(F.col("source")))).alias("tail_md5"))


def chapter_lines(spark, sf):
    ls = X.lines(F.col("text"))
    return chapters(spark, sf).select("novel", "chapter", F.size(ls).alias("n_lines"), F.md5(F.array_join(ls, "|")).alias("lines_md5"))


def chapter_sentences(spark, sf):
    ss = X.full_sentences(F.col("text"))
    return chapters(spark, sf).select("novel", "chapter", F.size(ss).alias("n_sentences"), F.md5(F.array_join(ss, "|")).alias("sentences_md5"))


def page_texts(spark, sf):
    text = corpus.html_to_text(F.col("html"))
    return texts(spark, sf, "pages").select("page_id", F.length(text).alias("chars"), F.size(X.lines(text)).alias("n_lines"))


def page_chapters(spark, sf):
    """Pages as files: notes stripped, split at headings, numbered."""
    files = texts(spark, sf, "pages").select(F.col("url").alias("path"), corpus.html_to_text(F.col("html"), drop_script=True).alias("raw"))
    rows = corpus.chapter_rows(files, marker=r"Part \d+", strips=corpus.STRIP_PATTERNS)
    return rows.select("path", "pos", "chapter", "title", F.size("paragraphs").alias("n_paragraphs"))


def full_rewrite(spark, sf):
    """The deterministic rewrite of every chapter: cleaned, substituted, corrected."""
    s = store(spark, sf)
    glossary = s.policies.select(
        "novel", F.col("trigger").alias("canonical"), F.array().cast("array<string>").alias("aliases"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    out = W.rewrite_chapters(chapters(spark, sf), s.policies, s.forms, glossary)
    return out["result"].select("novel", "chapter", "mode", "deterministic_count", "prompted_count", F.md5("rewritten").alias("text_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        retrieved_policies, retrieved_top_policies, prompted_policies, policy_spans, prepass_texts, prepass_trace, shield_mapping,
        shield_round_trip, known_phrases, corrected_phrases, cleaned_texts, chapter_chunks, reference_chunks, continuity_tails,
        chapter_lines, chapter_sentences, page_texts, page_chapters, full_rewrite,
    )
}

_D = "docs as (select lang as novel, doc_id + 1 as chapter, text from documents)"
# Whole words of a document as a list; a form of one word matches a word, ignoring case.
_SEQ = _SCORES + """, seq as (select lang as novel, doc_id + 1 as chapter, regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]') as tk from documents),
place as (select novel, chapter, unnest(tk) as w, unnest(range(1, len(tk) + 1)) as i, unnest(list_transform(tk, lambda x, k: list_sum(list_transform(tk[1:k-1], lambda y: length(y))))) as before from seq),
hit as (select place.*, policy_id, trigger, applies, confidence from place join form_policy p on p.novel = place.novel and lower(w) = lower(trigger))
"""
_SEQ_LIGHT = _SCORES + """, seq as (select lang as novel, doc_id + 1 as chapter, regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]') as tk from documents),
place as (select novel, chapter, unnest(tk) as w, unnest(range(1, len(tk) + 1)) as i from seq),
hit as (select place.*, policy_id, trigger, applies, confidence from place join form_policy p on p.novel = place.novel and lower(w) = lower(trigger))
"""
_FOUND = _SCORES + """, found as (select d.lang as novel, d.doc_id + 1 as chapter, policy_id, trigger, applies, p.rank from documents d
  join (select f.*, cast(substring(policy_id, 3) as int) as rank from form_policy f) p on p.novel = d.lang
  where regexp_matches(lower(d.text), '(^|[^a-z0-9])' || lower(trigger) || '([^a-z0-9]|$)'))
"""
_REWRITTEN = _SEQ_LIGHT + """, swap as (select novel, chapter, i, trigger, w from hit where applies = 'deterministic'),
words as (select place.novel, place.chapter, string_agg(coalesce(swap.trigger, place.w), '' order by place.i) as text
  from place left join swap on swap.novel = place.novel and swap.chapter = place.chapter and swap.i = place.i group by all),
out as (select seq.novel, seq.chapter, coalesce(words.text, '') as text from seq left join words using (novel, chapter))
"""
_CLEAN = f"""array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '{S.WATERMARK.replace("(?iU)", "(?i)")}')
  and not regexp_matches(x, '^\\s*([*=_+\\-]\\s*){{3,}}$')), chr(10))"""
_CLEANED = f"regexp_replace(regexp_replace({_CLEAN}, '{S.WATERMARK.replace('(?iU)', '(?i)')}', '', 'g'), '\\[([^\\]\\n]*)\\]', '\\1', 'g')"
_SPACE = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]"
_PARA = "list_filter(list_transform(regexp_split_to_array({c}, '\\n+'), lambda p: trim(p, e' \\t\\n\\r')), lambda p: p <> '')"

# Rules one after another; a passage that stands twice in a row shares the blank between, so each rule is tried twice.
_OUTSIDE = "[^\\p{L}\\p{N}_]"
_ONE_RULE = f"regexp_replace(TEXT, '(^|{_OUTSIDE})(?:' || regexp_escape(x) || ')($|{_OUTSIDE})', '\\1fixed passage\\2', 'gi')"
_SECOND = f"'(^|{_OUTSIDE})(?i:fixed passage)($|{_OUTSIDE})'"
_CORRECTED = f"""with rules as (
  select list(text order by -length(text), text) as phrases from (select distinct text from benchmark where text <> '')),
one as (
  select lang as novel, doc_id + 1 as chapter, text as before, list_reduce(list_prepend(text, phrases), lambda t, x: case when contains(lower(t), lower(x)) then {_ONE_RULE.replace("TEXT", _ONE_RULE.replace("TEXT", "t"))} else t end) as text
  from documents, rules),
two as (
  select *, len(regexp_extract_all(text, {_SECOND})) as k, len(regexp_extract_all(before, {_SECOND})) as k0,
    regexp_replace(text, {_SECOND}, '\\1mended text\\2', 'g') as fixed from one)
select novel, chapter, (2 * k - k0)::int as n_fixes, md5(fixed) as text_md5 from two where 2 * k - k0 > 0"""

SQL = {
    "corrected_phrases": _CORRECTED,
    "retrieved_policies": _FOUND + " select novel, chapter, policy_id from found",
    "retrieved_top_policies": _FOUND + """ select novel, chapter, policy_id from (select *, row_number() over (partition by novel, chapter order by length(trigger) desc, rank) as k from found) where k <= 2""",
    "prompted_policies": _FOUND + " select novel, chapter, trigger from found where applies = 'prompted'",
    "policy_spans": _SEQ_LIGHT + " select novel, chapter, policy_id, count(*) as n, min(i)::int as first_token from hit group by all",
    "prepass_texts": _REWRITTEN + " select novel, chapter, md5(text) as text_md5 from out",
    "prepass_trace": _SEQ_LIGHT + """, length_before as (select novel, chapter, i, w, (sum(length(w)) over (partition by novel, chapter order by i) - length(w))::int as start from place)
select hit.novel, hit.chapter, hit.w as original, hit.trigger as output, policy_id, confidence, start, (start + length(hit.w))::int as stop
from hit join length_before b using (novel, chapter, i) where applies = 'deterministic' and hit.w <> hit.trigger""",
    "shield_mapping": _SEQ_LIGHT + """, f as (select novel, chapter, trigger as canonical, min(i) as first from hit group by all)
select novel, chapter, canonical, '__ENT_' || (row_number() over (partition by novel, chapter order by first) - 1) || '__' as placeholder from f""",
    "shield_round_trip": "select lang as novel, doc_id + 1 as chapter, md5(lower(text)) as text_md5 from documents",
    "known_phrases": """select lang as novel, doc_id + 1 as chapter, item_id::varchar as id from documents d join benchmark b on contains(lower(d.text), lower(b.text))""",
    "cleaned_texts": f"select lang as novel, doc_id + 1 as chapter, md5({_CLEANED}) as text_md5 from documents",
    "continuity_tails": f"""with talk as (select a.conv_id, a.turn, b.text as source from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1 where a.role = 'assistant'),
p as (select conv_id, turn, {_PARA.format(c='source')} as p from talk)
select conv_id, turn, md5(array_to_string(p[-2:], e'\\n\\n')) as tail_md5 from p""",
    "chapter_lines": f"""with l as (select lang as novel, doc_id + 1 as chapter, list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '[^\\s\\x{{a0}}]')) as l from documents)
select novel, chapter, len(l)::int as n_lines, md5(array_to_string(l, '|')) as lines_md5 from l""",
    "chapter_sentences": f"""with m as (select lang as novel, doc_id + 1 as chapter, regexp_replace(text, '([.!?]){_SPACE}+', '\\1' || chr(1), 'g') as m from documents),
s as (select novel, chapter, list_filter(list_transform(string_split(m, chr(1)), lambda s: trim(s, e' \\t\\n\\r')), lambda s: s <> '') as s from m)
select novel, chapter, len(s)::int as n_sentences, md5(array_to_string(s, '|')) as sentences_md5 from s""",
    "full_rewrite": _REWRITTEN.replace("from documents)", f"from (select * replace ({_CLEANED} as text) from documents))") .replace(_SCORES.replace("from documents)", f"from (select * replace ({_CLEANED} as text) from documents))"), _SCORES)
    + """, trace as (select novel, chapter, count(*) as k from swap where w <> trigger group by all),
found as (select d.novel, d.chapter, count(*) as k from (select novel, chapter, string_agg(w, '' order by i) as text from place group by all) d
  join form_policy p on p.novel = d.novel and regexp_matches(lower(d.text), '(^|[^a-z0-9])' || lower(trigger) || '([^a-z0-9]|$)')
  where p.applies = 'prompted' group by all)
select out.novel, out.chapter, 'fallback_faithful_repair' as mode, coalesce(trace.k, 0) as deterministic_count, coalesce(found.k, 0) as prompted_count,
  md5(regexp_replace(out.text, '([^\\n])\\n([^\\n])', '\\1' || e'\\n\\n' || '\\2', 'g')) as text_md5
from out left join trace using (novel, chapter) left join found using (novel, chapter)""",
}

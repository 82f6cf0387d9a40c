"""Names: signals, form counts, scores, clusters and policies over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaloom.functions import text as X
from glossaloom.functions.names import name_key
from glossaloom.lexicon import Lexicon
from glossaloom.operators import extract as E
from glossaloom.operators import mining as M
from glossaloom.operators.similarity import edit_pairs, substring_pairs
from glossaloom.workloads.frames import chapters, totals

LEX = Lexicon()


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# Alternating word and separator tokens of each document, numbered from 1.
TOKENS = """
with docs as (
  select lang as novel, doc_id + 1 as chapter, text,
         regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+') tk from documents),
tok as (select novel, chapter, tk, unnest(range(1, len(tk) + 1)) i from docs),
word as (select novel, chapter, i, tk[i] w, case when i > 1 then tk[i-1] else '' end gap, i = 1 as at_start,
         regexp_full_match(tk[i], '[\\p{L}\\p{N}_]+') as is_word from tok),
cap as (select novel, chapter, i, w, gap, at_start, is_word, regexp_full_match(w, '[A-Z][a-z]+') as is_cap from word)
"""

SINGLES = (
    TOKENS
    + f""", single as (
  select novel, chapter, w as form from cap
  where regexp_full_match(w, '[A-Z][a-z]{{2,}}') and not list_contains({_sql_list(LEX.stop_words)}, w)
    and not at_start and not regexp_matches(regexp_replace(gap, '[ \\t]+$', ''), '[.!?\\n"'']$')
    and not (i = 2 and regexp_replace(gap, '[ \\t]+$', '') = ''))
"""
)

# Runs of capitalised words joined by blanks.
RUNS = (
    TOKENS
    + r""", marked as (
  select *, lag(is_cap) over (partition by novel, chapter order by i) as cap1,
         lag(is_cap, 2) over (partition by novel, chapter order by i) as cap2 from cap),
starts as (
  select *, case when cap2 and regexp_full_match(gap, '\s+') then 0 else 1 end as new_run from marked where is_cap),
numbered as (select *, sum(new_run) over (partition by novel, chapter order by i) as run from starts),
runs as (
  select novel, chapter, run, count(*) as n, list(w order by i) as ws,
         list(case when new_run = 1 then w else gap || w end order by i) as joined,
         string_agg(case when new_run = 1 then w else gap || w end, '' order by i) as phrase
  from numbered group by novel, chapter, run)
"""
)


def single_names(spark, sf):
    signals = E.extract_signals(chapters(spark, sf), families=[E.ENTITY])
    return (
        signals.where("extractor = 'entity.single_cap'").groupBy("novel", F.col("text").alias("form"))
        .agg(F.count("*").alias("n"), F.countDistinct("chapter").alias("n_chapters"))
    )


def phrase_names(spark, sf):
    raw = E.raw_signals(chapters(spark, sf), families=[E.ENTITY])
    return (
        raw.where("extractor = 'entity.multi_cap'").groupBy("novel", "chapter", F.col("text").alias("form"))
        .agg(F.count("*").alias("n"))
    )


def suffix_names(spark, sf):
    raw = E.raw_signals(chapters(spark, sf), families=[E.ENTITY])
    return (
        raw.where("extractor in ('entity.domain_suffix', 'entity.title_name', 'entity.title_name_bare')")
        .groupBy("novel", "extractor", F.col("text").alias("form")).agg(F.count("*").alias("n"))
    )


def signal_contexts(spark, sf):
    raw = E.raw_signals(chapters(spark, sf), families=[E.ENTITY])
    return (
        raw.where("extractor = 'entity.single_cap'")
        .select("novel", "chapter", F.col("text").alias("form"), F.length("context").alias("context_chars"), F.md5("context").alias("context_md5"))
    )


def signal_type_counts(spark, sf):
    return E.signal_counts(E.extract_signals(chapters(spark, sf), families=[E.ENTITY]))


def signal_families(spark, sf):
    raw = E.raw_signals(chapters(spark, sf))
    return raw.groupBy("novel", "type", "extractor").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_forms"))


def name_keys(spark, sf):
    words = chapters(spark, sf).select("novel", F.explode(X.words(F.col("text"))).alias("w")).distinct()
    return words.select("novel", name_key(F.col("w")).alias("name")).groupBy("novel", "name").agg(F.count("*").alias("n_forms"))


def _single_signals(spark, sf):
    return E.extract_signals(chapters(spark, sf), families=[E.ENTITY]).where("extractor = 'entity.single_cap'")


def form_policies(spark, sf):
    mined = M.mine_policies(_single_signals(spark, sf), totals(spark, sf), merge_variants=False)
    return mined.policies.select(
        "novel", "policy_id", "type", "trigger", "applies", "confidence", "frequency", "consistency", "evidence_count",
        "n_signals", "needs_review", "note",
    )


def _names(spark, sf):
    return M.form_counts(_single_signals(spark, sf)).select("novel", "name").distinct()


def close_spellings(spark, sf):
    return edit_pairs(_names(spark, sf), 0.3)


def closer_spellings_strict(spark, sf):
    return edit_pairs(_names(spark, sf), 0.35, strict=True)


def contained_names(spark, sf):
    return substring_pairs(_names(spark, sf))


def name_clusters(spark, sf):
    names = M.form_counts(E.extract_signals(chapters(spark, sf))).select("novel", "name").distinct()
    return M.cluster_names(names)


def _mined(spark, sf):
    return M.mine_policies(E.extract_signals(chapters(spark, sf)), totals(spark, sf))


def policies(spark, sf):
    return _mined(spark, sf).policies


def policy_forms(spark, sf):
    return _mined(spark, sf).forms


def policy_evidence(spark, sf):
    return _mined(spark, sf).evidence


def policy_contexts(spark, sf):
    return _mined(spark, sf).contexts


def policy_summary(spark, sf):
    mined = M.mine_policies(_single_signals(spark, sf), totals(spark, sf), merge_variants=False)
    return M.mining_summary(mined.policies).select(
        "type", "applies", "n", F.round("avg_confidence", 4).alias("avg_confidence"), "low", "review", "rejected"
    )


QUERIES = {
    f.__name__: f
    for f in (
        single_names, phrase_names, suffix_names, signal_contexts, signal_type_counts, signal_families, name_keys,
        form_policies, close_spellings, closer_spellings_strict, contained_names, name_clusters, policies, policy_forms,
        policy_evidence, policy_contexts, policy_summary,
    )
}

_FORM_STATS = SINGLES + """, kept as (
  select * from single where (novel, form) in (
    select (novel, form) from single group by novel, form having count(distinct chapter) >= 2)),
raw_forms as (select novel, lower(form) as name, form, count(*) as n from kept group by all),
names as (
  select novel, name, sum(n) as n_signals,
         arg_min(form, {'n': -n, 'form': form}) as top_form from raw_forms group by all)
"""

_SCORES = _FORM_STATS + f""", sizes as (select lang as novel, count(*) as total_chapters from documents group by lang),
spread as (select novel, lower(form) as name, count(distinct chapter) as evidence_count from kept group by all),
seen as (
  select novel, lower(form) as name, form, min(chapter) as first_chapter, count(*) as n from kept group by all),
canon as (select novel, name, arg_min(form, {{'n': -n, 'first': first_chapter}}) as trigger, sum(n) as n_signals, max(n) as n_canonical
  from seen group by all),
scored as (
  select novel, name, trigger, n_signals, evidence_count,
    case when (evidence_count / total_chapters) * 16 = floor((evidence_count / total_chapters) * 16)
         then round_even(evidence_count / total_chapters, 3) else round(evidence_count / total_chapters, 3) end as frequency,
    case when (n_canonical / n_signals) * 16 = floor((n_canonical / n_signals) * 16)
         then round_even(n_canonical / n_signals, 3) else round(n_canonical / n_signals, 3) end as consistency
  from canon join spread using (novel, name) join sizes using (novel)
  where not list_contains({_sql_list(LEX.generic)}, trigger) and not list_contains({_sql_list(LEX.fragment_leads)}, trigger)),
graded as (
  select *, least((0.5 + 0.03 * n_signals::double) * (0.5 + 0.5 * consistency), 0.99::double) as conf from scored),
placed as (
  select *, round(conf, 3) as confidence,
    row_number() over (partition by novel order by round(conf, 3) desc, name) as rank from graded where conf >= 0.4),
form_policy as (
  select novel, printf('p_%03d', rank) as policy_id, 'entity-naming' as type, trigger,
    case when confidence < 0.6 then 'prompted' when conf >= 0.8 then 'deterministic' else 'prompted' end as applies,
    confidence, frequency, consistency, evidence_count, n_signals::bigint as n_signals, confidence < 0.6 as needs_review,
    case when confidence < 0.6 then 'low confidence, needs review' else '' end as note
  from placed)
"""

_PHRASE_FILTER = (
    f"n >= 2 and n <= 4 and not list_contains({_sql_list(LEX.stop_words)}, ws[1]) "
    f"and not list_contains({_sql_list(LEX.stop_prefixes)}, ws[1]) "
    f"and len(list_filter(ws, lambda w: not list_contains({_sql_list(LEX.stop_words)}, w))) > 0"
)

SQL = {
    "single_names": SINGLES + """
select novel, form, count(*) as n, count(distinct chapter) as n_chapters from single
group by novel, form having count(distinct chapter) >= 2""",
    "phrase_names": RUNS + f"""
select novel, chapter, phrase as form, count(*) as n from runs where {_PHRASE_FILTER} group by all""",
    "suffix_names": RUNS + f""", suffix_at as (
  select *, list_max(list_filter(range(1, n + 1), lambda i: list_contains({_sql_list(LEX.domain_suffixes)}, ws[i]))) as k from runs),
title_at as (select *, list_min(list_filter(range(1, n), lambda i: list_contains({_sql_list(LEX.titles)}, ws[i]))) as k from runs),
titled as (select novel, ws[k] as title, ws[k+1] || array_to_string(joined[k+2:], '') as name from title_at where k is not null),
every as (
  select novel, 'entity.domain_suffix' as extractor, array_to_string(joined[1:k], '') as form from suffix_at
  where k >= 2 and len(list_filter(ws[1:k], lambda w: not list_contains({_sql_list(LEX.stop_words)}, w))) > 0
  union all select novel, 'entity.title_name', title || ' ' || name from titled
  union all select novel, 'entity.title_name_bare', name from titled where not list_contains({_sql_list(LEX.stop_words)}, name))
select novel, extractor, form, count(*) as n from every group by all""",
    "signal_contexts": f"""
with seg as (select lang as novel, doc_id + 1 as chapter, unnest(regexp_split_to_array(text, '[.!?\n]')) as s from documents),
tk as (select *, regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') as t from seg),
w as (select novel, chapter, trim(s, e' \\t\\r')[:200] as context, t, unnest(range(1, len(t) + 1)) as i from tk)
select novel, chapter, t[i] as form, length(context)::int as context_chars, md5(context) as context_md5 from w
where regexp_full_match(t[i], '[A-Z][a-z]{{2,}}') and not list_contains({_sql_list(LEX.stop_words)}, t[i]) and i > 1
  and not regexp_matches(regexp_replace(t[i-1], '[ \\t]+$', ''), '["'']$') and not (i = 2 and regexp_replace(t[1], '[ \\t]+$', '') = '')""",
    "signal_type_counts": RUNS.replace("with docs", "with docs", 1) + f""", single as (
  select novel, chapter, w as form from cap
  where regexp_full_match(w, '[A-Z][a-z]{{2,}}') and not list_contains({_sql_list(LEX.stop_words)}, w)
    and not at_start and not regexp_matches(regexp_replace(gap, '[ \\t]+$', ''), '[.!?\\n"'']$')
    and not (i = 2 and regexp_replace(gap, '[ \\t]+$', '') = '')),
kept as (select * from single where (novel, form) in (
    select (novel, form) from single group by novel, form having count(distinct chapter) >= 2)),
suffix_at as (select *, list_max(list_filter(range(1, n + 1), lambda i: list_contains({_sql_list(LEX.domain_suffixes)}, ws[i]))) as k from runs),
title_at as (select *, list_min(list_filter(range(1, n), lambda i: list_contains({_sql_list(LEX.titles)}, ws[i]))) as k from runs)
select 'entity' as type,
  (select count(*) from kept) + (select count(*) from runs where {_PHRASE_FILTER})
  + (select count(*) from suffix_at where k >= 2 and len(list_filter(ws[1:k], lambda w: not list_contains({_sql_list(LEX.stop_words)}, w))) > 0)
  + (select count(*) from title_at where k is not null)
  + (select count(*) from title_at where k is not null and not (n = k + 1 and list_contains({_sql_list(LEX.stop_words)}, ws[n]))) as n""",
    "name_keys": """
with w as (select distinct lang as novel, unnest(regexp_split_to_array(text, '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+')) as w from documents)
select novel, regexp_replace(regexp_replace(trim(lower(strip_accents(w))), '[-\\s]+', ' ', 'g'), '''s\\b', '', 'g') as name,
  count(*) as n_forms from w where w <> '' group by all""",
    "form_policies": _SCORES + " select * from form_policy",
    "close_spellings": _FORM_STATS + """
select a.novel, a.name as lo, b.name as hi from names a join names b on a.novel = b.novel and a.name < b.name
where levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) <= 0.3""",
    "closer_spellings_strict": _FORM_STATS + """
select a.novel, a.name as lo, b.name as hi from names a join names b on a.novel = b.novel and a.name < b.name
where levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) < 0.35""",
    "contained_names": _FORM_STATS + """
select a.novel, a.name as short, b.name as long from names a join names b on a.novel = b.novel and length(a.name) < length(b.name)
where length(a.name) >= 4 and contains(b.name, a.name)""",
    "policy_summary": _SCORES + """
select type, applies, count(*) as n, round(avg(confidence), 4) as avg_confidence,
  count(*) filter (where confidence < 0.6) as low, count(*) filter (where needs_review) as review, 0::bigint as rejected
from form_policy group by grouping sets ((type), (applies), ())""",
}

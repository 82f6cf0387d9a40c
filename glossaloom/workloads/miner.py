"""DuckDB twin of the whole miner: signals of all families, the relation between names, the scan in key order, and policies.

Clusters come from a recursive scan that takes one name at a time and remembers the leaders, which is how leader clustering is
defined; the library reaches the same by components and joins.
"""

from __future__ import annotations

from glossaloom.lexicon import Lexicon
from glossaloom.operators import extract as E
from glossaloom.workloads.names import _PHRASE_FILTER, RUNS, SINGLES, TOKENS, _sql_list

LEX = Lexicon()
_NAME_STOPS = _sql_list(LEX.name_stopwords)
_SINGLE = SINGLES[len(TOKENS) :].replace("select novel, chapter, w as form from cap", "select novel, chapter, w as form, i from cap")


def _rounded(x: str) -> str:
    """Three digits; exact halves, which are multiples of 1/16 at that place, go to the even side."""
    return f"case when ({x}) * 16 = floor(({x}) * 16) then round_even({x}, 3) else round({x}, 3) end"


# Every signal of the entity family with the tokens it spans; words and gaps alternate, so word k of a run is token i + 2 (k - 1).
SIGNALS = (
    RUNS
    + _SINGLE
    + f""",
at_run as (
  select r.*, f.i0, list_max(list_filter(range(1, n + 1), lambda k: list_contains({_sql_list(LEX.domain_suffixes)}, ws[k]))) as suffix,
    list_min(list_filter(range(1, n), lambda k: list_contains({_sql_list(LEX.titles)}, ws[k]))) as title
  from runs r join (select novel, chapter, run, min(i) as i0 from numbered group by all) f using (novel, chapter, run)),
entity as (
  select novel, chapter, 0 as pattern, i0 as pos, 0 as sub, 'entity.title_name' as extractor, ws[title] || ' ' || ws[title + 1] || array_to_string(joined[title + 2:], '') as text,
    i0 + 2 * (title - 1) as a, i0 + 2 * (n - 1) as b from at_run where title is not null
  union all select novel, chapter, 0, i0, 1, 'entity.title_name_bare', ws[title + 1] || array_to_string(joined[title + 2:], ''), i0 + 2 * (title - 1), i0 + 2 * (n - 1)
    from at_run where title is not null and not (n = title + 1 and list_contains({_sql_list(LEX.stop_words)}, ws[n]))
  union all select novel, chapter, 1, i0, 0, 'entity.domain_suffix', array_to_string(joined[1:suffix], ''), i0, i0 + 2 * (suffix - 1)
    from at_run where suffix >= 2 and len(list_filter(ws[1:suffix], lambda w: not list_contains({_sql_list(LEX.stop_words)}, w))) > 0
  union all select novel, chapter, 2, i0, 0, 'entity.multi_cap', phrase, i0, i0 + 2 * (n - 1) from at_run where {_PHRASE_FILTER}
  union all select novel, chapter, 3, i, 0, 'entity.single_cap', form, i, i from single)
"""
)

_ADDRESS = [p for p in E.address_patterns() if not p.startswith(r"\w+")]
_SUFFIXED = [p for p in E.address_patterns() if p.startswith(r"\w+")]


def _count(kind: str, extractor: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"select novel, '{kind}' as type, '{extractor}' as extractor, unnest(regexp_extract_all(text, '{quoted}')) as text from docs"


# The other families are only counted: the documents hold at most a few of their signals, and none that reaches a policy.
FAMILIES = SIGNALS + f""", others as (
  select novel, type, extractor, trim(text[2:-2]) as text from ({_count('terminology', 'terminology.bracket', E.BRACKET)})
    where trim(text[2:-2]) <> '' and not starts_with(trim(text[2:-2]), '#') and not regexp_matches(trim(text[2:-2]), '^\\p{{Ll}}.* ')
  union all select novel, type, extractor, trim(text[2:-2]) from ({_count('terminology', 'terminology.quoted', E.QUOTED)}) where regexp_matches(trim(text[2:-2]), '\\S\\s+\\S')
  union all {_count('terminology', 'terminology.possessive', "\\b[A-Z][a-z]+\\b(?:'s?\\s+[A-Z][a-z]+\\b)+")}
  union all {_count('honorific', 'honorific.pattern', "\\b(?:" + "|".join(_ADDRESS) + ")\\b")}
  union all {" union all ".join(_count('honorific', 'honorific.pattern', rf"\b{p}\b") for p in _SUFFIXED)})
select novel, type, extractor, count(*) as n, count(distinct text) as n_forms
from (select novel, 'entity' as type, extractor, text from entity union all select * from others) group by all"""

# Names, their relation and the scan.
CLUSTERS = SIGNALS.replace("\nwith docs", "\nwith recursive docs", 1) + f""",
known as (select novel, text from entity where pattern = 3 group by all having count(distinct chapter) >= 2),
signals as (
  select *, {{'chapter': chapter, 'pattern': pattern, 'pos': pos, 'sub': sub}} as seq, regexp_replace(lower(text), '[-\\s]+', ' ', 'g') as name
  from entity where pattern < 3 or (novel, text) in (select (novel, text) from known)),
forms as (select novel, text, name, count(*) as n, min(seq) as seen from signals group by all),
keys as (
  select novel, name, row_number() over (partition by novel order by name) as k, string_split(name, ' ') as words
  from (select distinct novel, name from forms)),
related as (
  select b.novel, b.k, list(a.k) as below
  from keys a join keys b on a.novel = b.novel and a.k < b.k
  where list_sort(a.words) = list_sort(b.words)
    or (length(a.name) >= 4 and length(b.name) >= 4 and (contains(a.name, b.name) or contains(b.name, a.name))
      and len(list_filter(case when length(a.name) <= length(b.name) then a.words else b.words end, lambda w: not list_contains({_NAME_STOPS}, w))) > 0
      and not (len(a.words) = 1 and len(list_distinct(b.words)) > 1 and list_contains(b.words, a.words[1]))
      and not (len(b.words) = 1 and len(list_distinct(a.words)) > 1 and list_contains(a.words, b.words[1])))
    or (len(a.words) > 1 and len(b.words) > 1
      and len(list_filter(list_intersect(a.words, b.words), lambda w: length(w) >= 4 and not list_contains({_NAME_STOPS}, w))) > 0)
    or levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) <= 0.3
  group by b.novel, b.k),
ordered as (select keys.novel, keys.k, keys.name, coalesce(below, []) as below from keys left join related using (novel, k)),
scan(novel, k, leader, leaders) as (
  select novel, k, k, [k] from ordered where k = 1
  union all
  select novel, k, coalesce(taken, k), case when taken is null then list_append(leaders, k) else leaders end
  from (select o.novel, o.k, s.leaders, list_min(list_intersect(o.below, s.leaders)) as taken from scan s join ordered o on o.novel = s.novel and o.k = s.k + 1)),
clusters as (select s.novel, o.name, l.name as leader from scan s join ordered o using (novel, k) join ordered l on l.novel = s.novel and l.k = s.leader)
"""

_ARTICLE = "regexp_replace({}, '^(?i:the|a|an) ', '')"
_CLEAN = _ARTICLE.format("regexp_replace(regexp_replace(form, '^[''`\".,;:!?()\\[\\]{{}}]+|[''`\".,;:!?()\\[\\]{{}}]+$', '', 'g'), '\\s+', ' ', 'g')").replace("{{", "{").replace("}}", "}")
_LEADS = _sql_list(sorted({w.lower() for w in LEX.stop_words + LEX.stop_prefixes}))

POLICIES = CLUSTERS + f""",
led as (select f.*, leader from forms f join clusters using (novel, name)),
placed as (select s.novel, s.chapter, s.text, s.seq, s.name, s.a, s.b, leader from signals s join clusters using (novel, name)),
evidence as (select distinct novel, leader, chapter from placed),
spread as (select novel, leader, count(*) as evidence_count from evidence group by all having count(*) >= 2),
surface as (select novel, leader, text as form, sum(n)::bigint as n, min({{'name': name, 'seen': seen}}) as seen from led group by all),
raw as (
  select novel, leader, form as raw_canonical from (
    select *, row_number() over (partition by novel, leader order by case when list_contains({_sql_list(LEX.penalty_leads)}, string_split(form, ' ')[1]) then 1 else 0 end, -n, seen) as r from surface)
  where r = 1),
named as (select novel, leader, raw_canonical, {_CLEAN.replace("form", "raw_canonical")} as canonical from raw),
chosen as (
  select named.*, evidence_count from named join spread using (novel, leader)
  where canonical <> '' and len(list_filter(string_split(canonical, ' '), lambda w: not list_contains({_sql_list(LEX.generic)}, w))) > 0
    and not list_contains({_sql_list(LEX.fragment_leads)}, string_split(canonical, ' ')[1])),
aliases as (
  select distinct s.novel, s.leader, alias from (select novel, leader, form, {_CLEAN} as alias from surface) s join chosen c using (novel, leader)
  where form <> raw_canonical and alias <> '' and alias <> canonical and not list_contains({_LEADS}, lower(string_split(alias, ' ')[1]))),
occurrence as (select novel, leader, sum(n)::bigint as n_signals, sum(n) filter (text = canonical) as n_canonical from led join chosen using (novel, leader) group by all),
sizes as (select lang as novel, count(*) as total_chapters from documents group by lang),
shares as (
  select c.*, n_signals, evidence_count / total_chapters as f, coalesce(n_canonical, n_signals) / n_signals as k from chosen c join occurrence using (novel, leader) join sizes using (novel)),
scored as (select *, {_rounded("least(f, 1.0::double)")} as frequency, {_rounded("k")} as consistency from shares),
graded as (
  select *, (0.5::double + 0.03::double * n_signals) * (0.5::double + 0.5::double * consistency) as raw_confidence from scored),
ranked as (
  select *, round(least(raw_confidence, 0.99::double), 3) as confidence,
    row_number() over (partition by novel order by round(least(raw_confidence, 0.99::double), 3) desc, leader) as rank from graded where raw_confidence >= 0.4::double),
flagged as (
  select r.*, (select min(o.rank) from ranked o where o.novel = r.novel and len(string_split(r.canonical, ' ')) = 1 and len(list_distinct(string_split(o.canonical, ' '))) > 1
    and list_contains(string_split(o.canonical, ' '), r.canonical)) as of_rank from ranked r),
policies as (
  select novel, leader, printf('p_%03d', rank) as policy_id, 'entity-naming' as type, canonical as trigger, canonical as render_as,
    case when of_rank is not null or confidence < 0.6::double then 'prompted' when least(raw_confidence, 0.99::double) >= 0.8::double then 'deterministic' else 'prompted' end as applies,
    confidence, raw_confidence, frequency, consistency, 1.0::double as context_score, evidence_count, n_signals,
    of_rank is not null or confidence < 0.6::double as needs_review, false as rejected,
    concat_ws('; ', case when of_rank is not null then printf('ambiguous subset of p_%03d', of_rank) end, case when confidence < 0.6::double then 'low confidence, needs review' end) as note,
    rank, leader as name
  from flagged)
"""

# The sentence around the tokens a to b of a document, cut at 200 characters.
QUOTES = POLICIES + """,
around as (
  select p.novel, p.leader, p.seq, p.name, trim(trim(regexp_extract(array_to_string(tk[1:a - 1], ''), '[^.!?\\n]*$') || array_to_string(tk[a:b], '')
    || regexp_extract(array_to_string(tk[b + 1:], ''), '^[^.!?\\n]*'), e' \\t\\n\\r')[:200], e' \\t\\n\\r') as context
  from placed p join docs using (novel, chapter)),
quotes as (
  select *, row_number() over (partition by novel, leader order by first_at) as pos
  from (select novel, leader, context, min({'name': name, 'seq': seq}) as first_at from around where context <> '' group by all))
select p.novel, policy_id, pos, context from quotes q join policies p using (novel, leader) where pos <= 3"""

#: The queries themselves are registered beside those of single names.
QUERIES: dict = {}

SQL = {
    "signal_families": FAMILIES,
    "name_clusters": CLUSTERS + " select novel, name, leader from clusters",
    "policies": POLICIES + " select * exclude (leader) from policies",
    "policy_forms": POLICIES + """ select novel, policy_id, 0 as pos, trigger as form from policies
  union all select p.novel, policy_id, row_number() over (partition by p.novel, policy_id order by alias), alias from aliases a join policies p using (novel, leader)""",
    "policy_evidence": POLICIES + " select p.novel, policy_id, chapter from evidence e join policies p using (novel, leader)",
    "policy_contexts": QUOTES,
}

"""Voice: stylometry, excerpts, exemplars and retrieval over documents, benchmark, embeddings and turns.

The documents hold one paragraph per line, so chapters are given blank-line paragraphs first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaloom.functions import text as X
from glossaloom.lexicon import STYLE_STOPWORDS
from glossaloom.operators import style as S
from glossaloom.workloads.frames import chapters, table, turns


def sql_round(expr: str, digits: int) -> str:
    scale = 2 ** (digits + 1)
    return f"(case when ({expr}) * {scale} = floor(({expr}) * {scale}) then round_even({expr}, {digits}) else round({expr}, {digits}) end)"


def _spaced(spark, sf):
    return chapters(spark, sf).withColumn("text", X.normalise_newlines(F.col("text")))


def style_statistics(spark, sf):
    stats = S.style_stats(chapters(spark, sf), ["novel"])
    return stats.select(
        "novel", "n_chapters", "n_sentences", "n_words", "n_dialogue",
        F.round("mean_words", 6).alias("mean_words"), F.round("dialogue_percent", 6).alias("dialogue_percent"),
    )


def chapter_stylometry(spark, sf):
    return S.stylometry(chapters(spark, sf)).select("novel", "chapter", *S.METRICS, S.voice_richness(digits=6).alias("voice_richness"))


def turn_stylometry_delta(spark, sf):
    df = S.stylometry(S.stylometry(turns(spark, sf), "generated", "g_"), "source", "s_")
    return df.select("conv_id", "turn", *[S.stylometry_delta("g_", "s_", m).alias(m) for m in S.METRICS])


def scene_counts(spark, sf):
    rows = S.paragraph_rows(_spaced(spark, sf)).withColumn("scene", S.classify_scene(F.col("paragraph")))
    return rows.groupBy("novel", "scene").agg(F.count("*").alias("n"), F.sum(F.length("paragraph")).alias("chars"))


def chapter_excerpts(spark, sf):
    return S.pick_excerpts(_spaced(spark, sf)).select("novel", "chapter", "rank", F.md5("excerpt").alias("excerpt_md5"))


def scene_exemplars(spark, sf):
    return S.exemplars(_spaced(spark, sf)).select("novel", "chapter", "scene", "rank", F.md5("text").alias("text_md5"))


def style_bank_sizes(spark, sf):
    bank = S.style_bank(_spaced(spark, sf), per_chapter=1, max_chars=300)
    return bank.groupBy("novel").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("chapter").isNull()).alias("n_stats"), F.max(F.length("excerpt")).alias("longest")
    )


def excerpt_retrieval(spark, sf):
    docs = chapters(spark, sf).select(F.col("chapter").alias("query_id"), "text")
    bank = table(spark, sf, "benchmark").select(F.col("item_id"), F.col("text").alias("excerpt"))
    return S.retrieve_excerpts(docs, bank, k=4).select("query_id", "item_id", "rank", F.round("score", 9).alias("score"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("scene"), "embedding")


def exemplar_vectors(spark, sf):
    v = _vectors(spark, sf)
    bank = v.select(F.col("vec_id").alias("item_id"), "scene", "embedding")
    top = S.retrieve_exemplars(v.select(F.col("vec_id").alias("query_id"), "embedding"), bank, k=3)
    return top.select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


def exemplar_vectors_balanced(spark, sf):
    v = _vectors(spark, sf)
    bank = v.select(F.col("vec_id").alias("item_id"), "scene", "embedding")
    top = S.retrieve_exemplars(
        v.select(F.col("vec_id").alias("query_id"), "embedding"), bank, k=2, scenes=[str(i) for i in range(10)]
    )
    return top.select("scene", "query_id", "item_id", "rank", F.round("score", 6).alias("score"))


def exemplar_words(spark, sf):
    asked = turns(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("generated").alias("text"))
    bank = table(spark, sf, "benchmark").select("item_id", F.lit("description").alias("scene"), "text")
    return S.retrieve_exemplars(asked, bank, k=3).select("query_id", "item_id", "rank", F.round("score", 9).alias("score"))


def content_words(spark, sf):
    docs = chapters(spark, sf).select("novel", "chapter", S.style_tokens(F.col("text")).alias("t"))
    return docs.select("novel", "chapter", F.size("t").alias("n_tokens"), F.md5(F.array_join(F.sort_array("t"), " ")).alias("tokens_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        style_statistics, chapter_stylometry, turn_stylometry_delta, scene_counts, chapter_excerpts, scene_exemplars,
        style_bank_sizes, excerpt_retrieval, exemplar_vectors, exemplar_vectors_balanced, exemplar_words, content_words,
    )
}

_SPACE = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]"
_DIALOGUE = r'"[^"]+"|“[^”]+”'
_STOP = "[" + ", ".join(f"'{w}'" for w in STYLE_STOPWORDS) + "]"


def _words(expr: str) -> str:
    return f"len(list_filter(regexp_split_to_array({expr}, '{_SPACE}+'), lambda w: w <> ''))"


def _sentences(column: str) -> str:
    """Sentence list: mark the blank after a sentence end, then split at the mark."""
    marked = f"regexp_replace({column}, '([.!?]){_SPACE}+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s, e' \\t\\n\\r')), lambda s: s <> '')"


def _profile(relation: str, keys: str, text: str) -> str:
    contractions = S.CONTRACTIONS.replace("(?iU)\\b", "(?i)\\b").replace("'", "''")
    return f"""
ss as (select {keys}, {_sentences(text)} as s from {relation}),
sent as (select {keys}, len(s) as n, list_transform(s, lambda x: {_words('x')}) as lens,
  len(list_filter(s, lambda x: regexp_matches(x, '{contractions}'))) as n_contr,
  len(list_filter(s, lambda x: regexp_matches(x, '{_DIALOGUE}'))) as n_dlg,
  flatten(list_transform(s, lambda x: regexp_extract_all(lower(x), '[a-z'']{{3,}}'))) as toks from ss),
hist as (select {keys}, n, n_contr, n_dlg, lens, toks,
  len(toks) as n_tok, len(list_distinct(toks)) as n_types,
  len(list_filter(map_values(list_histogram(toks)), lambda v: v = 1)) as n_hapax,
  list_sum(lens)::double / n as mean from sent where n > 0),
prof as (select {keys},
  {sql_round('mean', 2)} as avg_sentence_length,
  {sql_round('list_sum(list_transform(lens, lambda l: (l - mean) * (l - mean))) / n', 2)} as sentence_length_variance,
  {sql_round('case when n_tok > 0 then n_types / n_tok else 0.0::double end', 4)} as lexical_richness,
  {sql_round('case when n_tok > 0 then coalesce(n_hapax, 0) / n_tok else 0.0::double end', 4)} as hapax_ratio,
  {sql_round('n_contr / n', 4)} as contraction_rate, {sql_round('n_dlg / n', 4)} as dialog_share from hist)
"""


_DOCS = "docs as (select lang as novel, doc_id + 1 as chapter, text from documents)"
_PARAS = (
    _DOCS
    + r""", paras as (select novel, chapter, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda p: trim(p, e' \t\n\r')), lambda p: p <> '')) as paragraph,
   unnest(range(len(list_filter(regexp_split_to_array(text, '\n+'), lambda p: trim(p, e' \t\n\r') <> '')))) as pos from docs)"""
)
_SCENE = f"""case when regexp_matches(paragraph, '["“]') then 'dialogue'
 when regexp_matches(lower(paragraph), '{S.THOUGHT_WORDS}') then 'internal'
 when {_words('paragraph')} < 25 then 'transition'
 when len(regexp_extract_all(lower(paragraph), '{S.ACTION_VERBS.replace("(?U)", "")}')) >= 3 then 'action' else 'description' end"""

_JACCARD = """case when len(a.t) = 0 or len(b.t) = 0 then 0.0 else len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) end"""

SQL = {
    "style_statistics": f"""
with {_DOCS}, s as (select novel, {_sentences('text')} as s from docs),
c as (select novel, len(s) as n, list_sum(list_transform(s, lambda x: {_words('x')})) as w,
  len(list_filter(s, lambda x: regexp_matches(x, '{_DIALOGUE}'))) as d from s)
select novel, count(*) as n_chapters, sum(n)::bigint as n_sentences, sum(w)::bigint as n_words, sum(d)::bigint as n_dialogue,
  round(sum(w) / sum(n), 6) as mean_words, round(100 * sum(d) / sum(n), 6) as dialogue_percent from c group by novel""",
    "chapter_stylometry": f"""
with {_DOCS}, {_profile('docs', 'novel, chapter', 'text')}
select docs.novel, docs.chapter, avg_sentence_length, sentence_length_variance, lexical_richness, hapax_ratio, contraction_rate, dialog_share,
  coalesce({sql_round('0.4::double * lexical_richness + 0.3::double * dialog_share + 0.3::double * (least(sentence_length_variance, 500.0::double) / 500.0::double)', 6)}, 0.0) as voice_richness
from docs left join prof using (novel, chapter)""",
    "scene_counts": f"""
with {_PARAS} select novel, {_SCENE} as scene, count(*) as n, sum(length(paragraph))::bigint as chars from paras group by all""",
    "chapter_excerpts": f"""
with {_PARAS}, r as (select *, row_number() over (partition by novel, chapter
  order by len(regexp_extract_all(paragraph, '{_DIALOGUE}')) desc, length(paragraph) desc, pos) as rank from paras)
select novel, chapter, rank::int as rank, md5(case when length(paragraph) <= 350 then paragraph
  else regexp_replace(paragraph[:350], '(?s) [^ ]*$', '') || '…' end) as excerpt_md5 from r where rank <= 2""",
    "scene_exemplars": f"""
with {_PARAS}, q as (select *, {_SCENE} as scene, {_words('paragraph')} as nw, len(regexp_extract_all(paragraph, '["“]')) as nq from paras),
r as (select *, row_number() over (partition by novel, chapter, scene
  order by nq / greatest(nw, 1) * 10 + least(nw / 50, 1.0) desc, pos) as rank from q)
select novel, chapter, scene, rank::int as rank, md5(paragraph[:500]) as text_md5 from r where rank <= 3""",
    "style_bank_sizes": f"""
with {_PARAS}, r as (select *, row_number() over (partition by novel, chapter
  order by len(regexp_extract_all(paragraph, '{_DIALOGUE}')) desc, length(paragraph) desc, pos) as rank from paras),
e as (select novel, case when length(paragraph) <= 300 then paragraph
  else regexp_replace(paragraph[:300], '(?s) [^ ]*$', '') || '…' end as excerpt from r where rank <= 1)
select novel, count(*) + 1 as n_lines, 1::bigint as n_stats, max(length(excerpt))::int as longest from e group by novel""",
    "excerpt_retrieval": f"""
with a as (select doc_id + 1 as query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda t: length(t) > 2 and not list_contains({_STOP}, t))) as t from documents),
b as (select item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda t: length(t) > 2 and not list_contains({_STOP}, t))) as t,
  case when regexp_matches(text, '{S.SOUNDS.replace("(?iU)", "(?i)")}') then 0.15::double else 0.0::double end as bonus from benchmark),
s as (select query_id, item_id, {_JACCARD} + bonus as score from a, b),
r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s)
select query_id, item_id, rank::int as rank, round(score, 9) as score from r where rank <= 4""",
    "exemplar_vectors": """
with s as (select a.vec_id as query_id, b.vec_id as item_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score from embeddings a, embeddings b),
r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s)
select query_id, item_id, rank::int as rank, round(score, 6) as score from r where rank <= 3""",
    "exemplar_vectors_balanced": """
with s as (select b.label::varchar as scene, a.vec_id as query_id, b.vec_id as item_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score from embeddings a, embeddings b),
r as (select *, row_number() over (partition by scene, query_id order by score desc, item_id) as rank from s)
select scene, query_id, item_id, rank::int as rank, round(score, 6) as score from r where rank <= 2""",
    "exemplar_words": f"""
with a as (select conv_id * 1000 + turn as query_id, list_distinct(regexp_extract_all(lower(text), '[a-z'']{{3,}}')) as t from conversations x
  where role = 'assistant' and exists (select 1 from conversations y where y.conv_id = x.conv_id and y.turn = x.turn - 1)),
b as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z'']{{3,}}')) as t from benchmark),
s as (select query_id, item_id, {_JACCARD} as score from a, b),
r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s)
select query_id, item_id, rank::int as rank, round(score, 9) as score from r where rank <= 3""",
    "content_words": f"""
with a as (select lang as novel, doc_id + 1 as chapter, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda t: length(t) > 2 and not list_contains({_STOP}, t))) as t from documents)
select novel, chapter, len(t)::int as n_tokens, md5(array_to_string(list_sort(t), ' ')) as tokens_md5 from a""",
}

_TALK = """talk as (select a.conv_id, a.turn, a.text as generated, b.text as source from conversations a
  join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1 where a.role = 'assistant')"""


def _renamed(prefix: str, text: str) -> str:
    body = _profile("talk", "conv_id, turn", text)
    for name in ("ss", "sent", "hist", "prof"):
        body = body.replace(f"{name} as (", f"{prefix}{name} as (").replace(f"from {name}", f"from {prefix}{name}")
    return body


SQL["turn_stylometry_delta"] = (
    f"with {_TALK}, {_renamed('g_', 'generated')}, {_renamed('s_', 'source')} select talk.conv_id, talk.turn, "
    + ", ".join(sql_round(f"abs(coalesce(g_prof.{m}, 0.0) - coalesce(s_prof.{m}, 0.0))", 4) + f" as {m}" for m in S.METRICS)
    + " from talk left join g_prof using (conv_id, turn) left join s_prof using (conv_id, turn)"
)

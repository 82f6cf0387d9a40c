"""Alignment: similarity, name adherence, faithfulness and the tiered report over conversation turns.

A turn of the assistant is the generated chapter, the turn before it the machine translation, and the turn
after it, where there is one, the original.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaloom.operators import ablation as B
from glossaloom.operators import alignment as A
from glossaloom.operators import chunks as C
from glossaloom.operators.style import METRICS
from glossaloom.plans.ordered import ranked
from glossaloom.workloads.frames import chapters, table, texts, turns
from glossaloom.workloads.voice import _sentences, sql_round

KEYS = ["novel", "chapter"]


def _talk(spark, sf):
    """generated, mtl and original frames keyed by novel and chapter."""
    talk = texts(spark, sf, "conversations").withColumn("novel", F.lit("talk"))
    number = F.col("conv_id") * 1000 + F.col("turn")
    generated = talk.where("role = 'assistant'").select("novel", number.alias("chapter"), "text")
    mtl = talk.select("novel", (number + 1).alias("chapter"), "text")
    original = talk.where("turn > 0").select("novel", (number - 1).alias("chapter"), "text")
    return generated, original, mtl


def _bank(spark, sf):
    return table(spark, sf, "benchmark").select(F.lit("talk").alias("novel"), F.col("text").alias("excerpt"))


def _names(spark, sf):
    """The capitalised words of all benchmark passages stand for glossary names."""
    words = F.regexp_extract_all("text", F.lit("([A-Z][a-z]{2,})"), 1)
    items = table(spark, sf, "benchmark").select("item_id", F.explode(words).alias("name"))
    firsts = items.groupBy("name").agg(F.min("item_id").alias("item_id")).withColumn("novel", F.lit("talk"))
    return ranked(firsts, "novel", [F.col("item_id"), F.col("name")], "pos").select("novel", "pos", "name")


def turn_similarity(spark, sf):
    df = turns(spark, sf)
    return df.select("conv_id", "turn", A.similarity(F.col("generated"), F.col("source")).alias("similarity"))


def paired_similarity(spark, sf):
    generated, original, mtl = _talk(spark, sf)
    df = (
        generated.withColumnRenamed("text", "generated").join(original.withColumnRenamed("text", "original"), KEYS)
        .join(mtl.withColumnRenamed("text", "mtl"), KEYS)
    )
    return A.align_paired(df).select("chapter", "sim_generated_original", "sim_mtl_original", "delta_vs_mtl")


def similarity_without_names(spark, sf):
    df = turns(spark, sf).select(F.lit("talk").alias("novel"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chapter"), "generated", "source")
    out = A.similarity_excluding(df, "generated", "source", _names(spark, sf), "similarity", KEYS)
    return out.select("chapter", "similarity")


def stylebank_similarity(spark, sf):
    generated = _talk(spark, sf)[0].withColumnRenamed("text", "generated")
    return A.similarity_to_bank(generated, _bank(spark, sf), KEYS).select("chapter", "sim_generated_stylebank")


def chapter_name_adherence(spark, sf):
    docs = chapters(spark, sf).select(F.lit("talk").alias("novel"), "chapter", F.col("text").alias("generated"))
    return A.name_adherence(docs, _names(spark, sf), KEYS).select("chapter", "names_total", "names_present", "name_adherence")


def turn_faithfulness(spark, sf):
    return A.faithfulness(turns(spark, sf)).select("conv_id", "turn", "intrusion_score", "drop_score", "coverage")


def turn_lost_numbers(spark, sf):
    lost = C.lost_numbers(F.col("source"), F.col("generated"))
    return turns(spark, sf).select("conv_id", "turn", F.size(lost).alias("n_lost"), F.array_join(lost, ",").alias("lost"))


def _report(spark, sf):
    generated, original, mtl = _talk(spark, sf)
    return A.alignment_report(generated, original, mtl, _bank(spark, sf), _names(spark, sf))


def alignment_report(spark, sf):
    return _report(spark, sf).drop("novel", *[f"delta_{m}" for m in METRICS], "voice_generated", "voice_original", "voice_mtl")


def alignment_tiers(spark, sf):
    summary = A.tier_summary(_report(spark, sf))
    return summary.select("tier", "n", "wins", *[F.round(c, 3).alias(c) for c in ("avg_delta", "avg_norm_delta", "avg_name_adherence", "avg_intrusion")])


def _conditions(spark, sf):
    """Two conditions over the turns that have all three texts: A leaves the machine text, B is the assistant's."""
    generated, original, mtl = _talk(spark, sf)
    machine = mtl.withColumnRenamed("text", "mtl")
    runs = generated.withColumnRenamed("text", "said").join(machine, KEYS).select(
        *KEYS, "mtl", F.explode(F.create_map(F.lit("A"), "mtl", F.lit("B"), "said")).alias("condition", "generated")
    )
    return B.ablation_scores(runs, original, _names(spark, sf))


def condition_scores(spark, sf):
    return _conditions(spark, sf).select(
        "chapter", "condition", "sim_generated_original", "sim_mtl_original", "delta_vs_mtl", "sim_generated_original_norm",
        "intrusion_score", "drop_score", "coverage",
    )


def condition_table(spark, sf):
    return B.ablation_table(_conditions(spark, sf), "delta_vs_mtl", ["A", "B"]).select("chapter", F.col("A").alias("gain_a"), F.col("B").alias("gain_b"))


QUERIES = {
    f.__name__: f
    for f in (
        turn_similarity, paired_similarity, similarity_without_names, stylebank_similarity, chapter_name_adherence,
        turn_faithfulness, turn_lost_numbers, alignment_report, alignment_tiers, condition_scores, condition_table,
    )
}

_TURNS = """talk as (select a.conv_id, a.turn, a.conv_id * 1000 + a.turn as chapter, a.text as generated, b.text as source from conversations a
  join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1 where a.role = 'assistant')"""
_THREE = """three as (select a.conv_id * 1000 + a.turn as chapter, a.text as generated, o.text as original, m.text as mtl from conversations a
  left join conversations o on a.conv_id = o.conv_id and o.turn = a.turn + 1
  left join conversations m on a.conv_id = m.conv_id and m.turn = a.turn - 1 where a.role = 'assistant')"""
_NAMES = """names as (select name, min(item_id) as pos from (select item_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}')) as name from benchmark)
  group by name)"""


def _cosine(name: str, relation: str, key: str, a: str, b: str) -> str:
    """CTEs ending in ``name(key, sim)``."""
    return f"""
{name}_t as (select {key}, 0 as side, unnest(regexp_extract_all(lower(coalesce({a}, '')), '[a-z'']+')) as t from {relation}
  union all select {key}, 1, unnest(regexp_extract_all(lower(coalesce({b}, '')), '[a-z'']+')) from {relation}),
{name}_c as (select {key}, t, count(*) filter (where side = 0) as na, count(*) filter (where side = 1) as nb from {name}_t group by all),
{name}_w as (select *, case when na > 0 and nb > 0 then 1.0::double else 2.1640825608571353::double end as w from {name}_c),
{name}_s as (select {key}, sum(na * nb)::double as dot, sum(na * na * w) as a2, sum(nb * nb * w) as b2 from {name}_w group by all),
{name} as (select r.{key}, {sql_round("coalesce(case when a2 > 0 and b2 > 0 then dot / (sqrt(a2) * sqrt(b2)) end, 0.0::double)", 4)} as sim
  from {relation} r left join {name}_s using ({key}))"""


def _faith(relation: str, keys: str, gen: str, src: str) -> str:
    toks = lambda e: f"list_distinct(regexp_extract_all(lower({e}), '[a-z'']{{4,}}'))"
    lone = lambda s, other: f"len(list_filter({s}, lambda x: len({toks('x')}) > 0 and not list_has_any({toks('x')}, {other})))"
    return f"""
fp as (select {keys}, {_sentences(gen)} as gs, {_sentences(src)} as ss, {toks(gen)} as gt, {toks(src)} as st from {relation}),
faith as (select {keys},
  {sql_round(f"case when len(gs) > 0 then {lone('gs', 'st')} / len(gs) else 0.0::double end", 4)} as intrusion_score,
  {sql_round(f"case when len(ss) > 0 then {lone('ss', 'gt')} / len(ss) else 0.0::double end", 4)} as drop_score,
  case when len(st) > 0 then {sql_round("len(list_intersect(gt, st)) / len(st)", 4)} end as coverage from fp)"""


_REMOVED = "list_reduce(list_prepend({c}, (select list(name order by pos, name) from names)), lambda acc, n: regexp_replace(acc, n, ' ', 'gi'))"
_BANK_SIM = f"""
bank as (select t, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z'']+')) as t from benchmark) group by t),
gen_t as (select chapter, t, count(*) as m from (select chapter, unnest(regexp_extract_all(lower(generated), '[a-z'']+')) as t from gen) group by all),
met as (select chapter, sum(m * coalesce(n, 0))::double as dot, sum(m * m * case when n is null then 2.1640825608571353::double else 1.0::double end) as a2,
  sum(coalesce(n * n, 0))::double as shared from gen_t left join bank using (t) group by chapter),
style as (select chapter, {sql_round("coalesce(dot / (sqrt(a2) * sqrt(2.1640825608571353::double * ((select sum(n * n) from bank)::double - shared) + shared)), 0.0::double)", 4)} as sim
  from gen left join met using (chapter))"""
_GEN = "gen as (select conv_id * 1000 + turn as chapter, text as generated from conversations where role = 'assistant')"
_ADHERE = f"""
held as (select chapter, count(*) as k from gen, names where contains(lower(generated), lower(name)) group by chapter),
adhere as (select chapter, (select count(*) from names) as names_total, coalesce(k, 0) as names_present,
  {sql_round("coalesce(k, 0) / (select count(*) from names)", 4)} as name_adherence from gen left join held using (chapter))"""

_REPORT = f"""with {_THREE}, {_NAMES}, {_GEN}, {_BANK_SIM}, {_ADHERE},
src as (select chapter, generated, coalesce(original, mtl, '') as source from three),
{_faith('src', 'chapter', 'generated', 'source')},
bare as (select chapter, {_REMOVED.format(c="generated")} as generated, {_REMOVED.format(c="coalesce(mtl, '')")} as mtl, {_REMOVED.format(c="coalesce(original, '')")} as original from three),
{_cosine('g', 'three', 'chapter', 'generated', 'original')}, {_cosine('m', 'three', 'chapter', 'mtl', 'original')},
{_cosine('gn', 'bare', 'chapter', 'generated', 'original')}, {_cosine('mn', 'bare', 'chapter', 'mtl', 'original')},
report as (
select chapter, case when original is not null then 1 else 2 end as tier,
  case when original is not null then g.sim end as sim_generated_original, case when original is not null then m.sim end as sim_mtl_original,
  case when original is not null then {sql_round("g.sim - m.sim", 4)} end as delta_vs_mtl,
  case when original is not null then gn.sim end as sim_generated_original_norm, case when original is not null then mn.sim end as sim_mtl_original_norm,
  case when original is null then style.sim end as sim_generated_stylebank,
  case when original is null then names_total end as names_total, case when original is null then names_present end as names_present,
  case when original is null then name_adherence end as name_adherence, intrusion_score, drop_score, coverage
from three join g using (chapter) join m using (chapter) join gn using (chapter) join mn using (chapter)
  join style using (chapter) join adhere using (chapter) join faith using (chapter))
"""

_RUNS = f"""{_THREE}, whole as (select * from three where original is not null and mtl is not null and generated is not null),
runs as (select chapter * 2 as k, chapter, 'A' as condition, mtl as generated, mtl, original from whole
  union all select chapter * 2 + 1, chapter, 'B', generated, mtl, original from whole),
{_cosine('g', 'runs', 'k', 'generated', 'original')}, {_cosine('m', 'runs', 'k', 'mtl', 'original')}"""

SQL = {
    "condition_scores": f"""with {_NAMES}, {_RUNS}, {_faith('runs', 'k', 'generated', 'original')},
bare as (select k, {_REMOVED.format(c="generated")} as generated, {_REMOVED.format(c="original")} as original from runs),
{_cosine('gn', 'bare', 'k', 'generated', 'original')}
select chapter, condition, g.sim as sim_generated_original, m.sim as sim_mtl_original, {sql_round("g.sim - m.sim", 4)} as delta_vs_mtl,
  gn.sim as sim_generated_original_norm, intrusion_score, drop_score, coverage
from runs join g using (k) join m using (k) join gn using (k) join faith using (k)""",
    "condition_table": f"""with {_RUNS} select chapter, max(case when condition = 'A' then {sql_round("g.sim - m.sim", 4)} end) as gain_a,
  max(case when condition = 'B' then {sql_round("g.sim - m.sim", 4)} end) as gain_b from runs join g using (k) join m using (k) group by chapter""",
    "turn_similarity": f"with {_TURNS}, {_cosine('c', 'talk', 'chapter', 'generated', 'source')} select conv_id, turn, sim as similarity from talk join c using (chapter)",
    "paired_similarity": f"""with {_THREE}, whole as (select * from three where original is not null and mtl is not null),
{_cosine('g', 'whole', 'chapter', 'generated', 'original')}, {_cosine('m', 'whole', 'chapter', 'mtl', 'original')}
select chapter, g.sim as sim_generated_original, m.sim as sim_mtl_original, {sql_round("g.sim - m.sim", 4)} as delta_vs_mtl from g join m using (chapter)""",
    "similarity_without_names": f"""with {_TURNS}, {_NAMES},
bare as (select chapter, {_REMOVED.format(c="generated")} as generated, {_REMOVED.format(c="source")} as source from talk),
{_cosine('c', 'bare', 'chapter', 'generated', 'source')} select chapter, sim as similarity from c""",
    "stylebank_similarity": f"with {_GEN}, {_BANK_SIM} select chapter, sim as sim_generated_stylebank from style",
    "chapter_name_adherence": f"""with {_NAMES}, gen as (select doc_id + 1 as chapter, text as generated from documents), {_ADHERE}
select chapter, names_total, names_present, name_adherence from adhere""",
    "turn_faithfulness": f"with {_TURNS}, {_faith('talk', 'conv_id, turn', 'generated', 'source')} select * from faith",
    "turn_lost_numbers": f"""with {_TURNS}, n as (select conv_id, turn, regexp_extract_all(source, '\\b\\d+(?:[.,]\\d+)?\\b') as s, regexp_extract_all(generated, '\\b\\d+(?:[.,]\\d+)?\\b') as g from talk),
l as (select conv_id, turn, list_filter(s, lambda x, i: list_position(s, x) = i and len(list_filter(g, lambda y: y = x)) < len(list_filter(s, lambda y: y = x))) as lost from n)
select conv_id, turn, len(lost)::int as n_lost, array_to_string(lost, ',') as lost from l""",
    "alignment_report": _REPORT + " select * from report",
    "alignment_tiers": _REPORT + """ select tier, count(*) as n, count(*) filter (where delta_vs_mtl > 0) as wins, round(avg(delta_vs_mtl), 3) as avg_delta,
  round(avg(sim_generated_original_norm - sim_mtl_original_norm), 3) as avg_norm_delta, round(avg(name_adherence), 3) as avg_name_adherence,
  round(avg(intrusion_score), 3) as avg_intrusion from report group by tier""",
}

"""Catalogue queries over documents as stored chapters and events as jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaloom.operators import serials as Q
from glossaloom.operators.style import prior_excerpts
from glossaloom.sources import corpus, stores
from glossaloom.workloads.frames import jobs, novels, stored, table
from glossaloom.workloads.voice import _DIALOGUE, _JACCARD, _STOP
from glossaloom.operators.style import SOUNDS


def novel_list(spark, sf):
    return Q.novel_list(novels(spark, sf), stored(spark, sf)).select("novel", "created_at", "n_chapters")


def novel_detail(spark, sf):
    chapters = stored(spark, sf)
    done = chapters.where("refined_text is not null")
    return Q.novel_detail(novels(spark, sf), chapters, done, chapters.where("summary is not null")).select(
        "novel", "n_chapters", "n_policies", "n_glossary"
    )


def novel_search(spark, sf):
    found = Q.search_novels(Q.novel_list(novels(spark, sf), stored(spark, sf)), "SRC1", "fr")
    return found.select("novel", "n_chapters")


def total_chapters(spark, sf):
    return Q.total_chapters(Q.novel_list(novels(spark, sf), stored(spark, sf)))


def original_chapters(spark, sf):
    return Q.chapter_list(stored(spark, sf), "original").select("chapter_id", "novel", "number")


def chapter_by_number(spark, sf):
    return Q.chapter_by_number(stored(spark, sf)).select("novel", "number", "chapter_id", "source_type")


def readable_chapters(spark, sf):
    return Q.readable_chapters(stored(spark, sf)).select("chapter_id", "novel", "number", F.md5("refined_text").alias("text_md5"))


def chapter_neighbours(spark, sf):
    return Q.chapter_neighbours(stored(spark, sf))


def reference_lookup(spark, sf):
    return Q.with_reference(stored(spark, sf)).select("chapter_id", "novel", "number", F.md5("reference_text").alias("reference_md5"))


def previous_refined(spark, sf):
    return Q.with_previous_refined(stored(spark, sf)).select("chapter_id", "previous_number", F.md5("previous_text").alias("previous_md5"))


def chapter_jobs(spark, sf):
    return Q.chapter_jobs(jobs(spark, sf)).select("chapter_id", "job_id", "rank")


def novel_jobs(spark, sf):
    return Q.novel_jobs(jobs(spark, sf), stored(spark, sf)).select("novel", "job_id", "rank")


def interrupted_sweep(spark, sf):
    swept, hung = Q.sweep_interrupted(stored(spark, sf), jobs(spark, sf).withColumn("status", F.when(F.col("status") == "click", "running").otherwise(F.col("status"))))
    chapters = swept.groupBy("status").agg(F.count("*").alias("n"), F.count("error_message").alias("n_messages")).withColumn("kind", F.lit("chapter"))
    return chapters.unionByName(
        hung.groupBy("status").agg(F.count("*").alias("n"), F.count("error_message").alias("n_messages")).withColumn("kind", F.lit("job"))
    )


def chapter_grid(spark, sf):
    return Q.chapter_grid(stored(spark, sf))


def chapter_grid_completed(spark, sf):
    return Q.chapter_grid(stored(spark, sf), "completed", "1")


def preferred_versions(spark, sf):
    return Q.preferred_versions(stored(spark, sf)).select("novel", "number", "chapter_id", "version", F.md5("text").alias("text_md5"))


def lore_sources(spark, sf):
    return Q.lore_sources(stored(spark, sf)).select("novel", "number", "chapter_id", "version")


def job_summaries(spark, sf):
    s = Q.job_summaries(jobs(spark, sf))
    return s.groupBy("status").agg(F.count("*").alias("n"), F.count("mode").alias("n_modes"))


def chapter_validation(spark, sf):
    good, bad = corpus.validate_chapters(stored(spark, sf))
    tagged = good.select("novel", F.lit("good").alias("verdict")).unionByName(bad.select("novel", F.array_join("problems", ",").alias("verdict")))
    return tagged.groupBy("novel", "verdict").agg(F.count("*").alias("n"))


def seed_missing_novels(spark, sf):
    done = stored(spark, sf).where("summary is not null and source_type = 'mtl'")
    return stores.seed(done, stored(spark, sf)).groupBy("novel").agg(F.count("*").alias("n"))


def backfilled_chapters(spark, sf):
    outputs = table(spark, sf, "benchmark").select(
        F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("novel"), F.lit(1).cast("bigint").alias("number"), "text"
    )
    filled = stores.backfill(stored(spark, sf), outputs)
    return filled.groupBy("novel", "status").agg(F.count("*").alias("n"), F.count("refined_text").alias("n_refined"))


def removal_dry_run(spark, sf):
    gone = stored(spark, sf).where("status = 'failed' and source_type = 'mtl'").select("novel")
    return stores.removal_counts({"chapters": stored(spark, sf), "novels": novels(spark, sf)}, gone)


def index_by_number(spark, sf):
    files = table(spark, sf, "pages").select("page_id", F.col("url").alias("name"), F.col("html").alias("raw"))
    return corpus.index_by_number(files, "page_id").select("chapter", F.md5("text").alias("text_md5"))


def change_table(spark, sf):
    current = table(spark, sf, "documents").select("doc_id", "lang", "source")
    changes = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "delete").when(F.col("quality") == 1, "update").otherwise("create").alias("op"),
        F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"),
    )
    return Q.apply_changes(current, changes, ["doc_id"])


def prior_voice_lines(spark, sf):
    """MTL chapters with their four closest lines of earlier originals; number = document number."""
    docs = table(spark, sf, "documents")
    spaced = docs.select(F.lit("all").alias("novel"), F.col("doc_id").alias("chapter"), F.regexp_replace("text", "\n", "\n\n").alias("text"), "lang")
    none = spark.createDataFrame([], "novel string, pos int, text string")
    lines = prior_excerpts(spaced.where("lang <> 'en'"), spaced.where("lang = 'en'"), none)
    return lines.select("chapter", "rank", F.round("score", 9).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        novel_list, novel_detail, novel_search, total_chapters, original_chapters, chapter_by_number, readable_chapters, chapter_neighbours,
        reference_lookup, previous_refined, chapter_jobs, novel_jobs, interrupted_sweep, chapter_grid, chapter_grid_completed,
        preferred_versions, lore_sources, job_summaries, chapter_validation, seed_missing_novels, backfilled_chapters, removal_dry_run,
        index_by_number, change_table, prior_voice_lines,
    )
}

_S = """with st as (select d.doc_id as chapter_id, source as novel, floor(d.doc_id / 40)::bigint + 1 as number,
  case when lang = 'en' then 'original' else 'mtl' end as source_type, text as raw_text,
  case when quality = 1 then text end as refined_text, case when toxic = 1 then md5(text) end as summary,
  case when quality = 1 then 'completed' when quality = 0 then 'failed' when n_chars > 1000 then 'queued' else 'pending' end as status
  from documents d left join labels l on d.doc_id = l.doc_id),
nov as (select source as novel, max(doc_id) as created_at, max(lang) as source_language from documents group by source),
counted as (select nov.*, (select count(*) from st where st.novel = nov.novel) as n_chapters from nov)
"""
_MTL = _S + ", mtl as (select * from st where source_type = 'mtl')"
_VERSION = """, v as (select novel, number, chapter_id, case when source_type = 'original' and trim(raw_text) <> '' then 1 when trim(coalesce(refined_text, '')) <> '' then 2
  when trim(raw_text) <> '' then 3 end as o, raw_text, refined_text from {t}),
best as (select *, row_number() over (partition by novel, number order by o, chapter_id) as rn from v where o is not null)"""
_TOK = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z'']+'), lambda t: length(t) > 2 and not list_contains({_STOP}, t)))"

SQL = {
    "novel_list": _S + "select novel, created_at, n_chapters from counted",
    "novel_detail": _S + """select novel, count(*) as n_chapters, count(refined_text) as n_policies, count(summary) as n_glossary from st group by novel""",
    "novel_search": _S + "select novel, n_chapters from counted where contains(lower(novel), 'src1') and source_language = 'fr'",
    "total_chapters": _S + "select sum(n_chapters)::bigint as total_chapters from counted",
    "original_chapters": _S + "select chapter_id, novel, number from st where source_type = 'original'",
    "chapter_by_number": _S + """select novel, number, chapter_id, source_type from (select *, row_number() over (partition by novel, number order by source_type desc, chapter_id) as rn from st) where rn = 1""",
    "readable_chapters": _S + "select chapter_id, novel, number, md5(refined_text) as text_md5 from st where refined_text is not null",
    "chapter_neighbours": _S + """select chapter_id, novel, number,
  (select min(chapter_id) from st b where b.novel = a.novel and b.number = (select max(number) from st c where c.novel = a.novel and c.number < a.number)) as previous_id,
  (select min(chapter_id) from st b where b.novel = a.novel and b.number = (select min(number) from st c where c.novel = a.novel and c.number > a.number)) as next_id from st a""",
    "reference_lookup": _MTL + """, o as (select novel, number, arg_min(raw_text, chapter_id) as r from st where source_type = 'original' group by all)
select chapter_id, novel, number, md5(r) as reference_md5 from mtl left join o using (novel, number)""",
    "previous_refined": _MTL + """, done as (select novel, number, arg_min(refined_text, chapter_id) as t from mtl where status = 'completed' and refined_text is not null group by all),
p as (select a.chapter_id, max(d.number) as previous_number from mtl a left join done d on d.novel = a.novel and d.number < a.number group by a.chapter_id)
select chapter_id, previous_number, md5(d.t) as previous_md5 from p join mtl using (chapter_id) left join done d on d.novel = mtl.novel and d.number = previous_number""",
    "chapter_jobs": """select chapter_id, job_id, rank::int as rank from (select user_id as chapter_id, event_id as job_id,
  row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events) where rank <= 30""",
    "novel_jobs": """select novel, job_id, rank::int as rank from (select source as novel, event_id as job_id,
  row_number() over (partition by source order by ts desc, event_id desc) as rank from events join documents on doc_id = user_id) where rank <= 50""",
    "interrupted_sweep": _S + """, c as (select case when status in ('queued') then 'failed' when status = 'pending' then 'unprocessed' else status end as s2, status = 'queued' as hit from st),
j as (select case when event_type = 'click' then 'failed' else event_type end as s2, event_type = 'click' as hit from events)
select 'chapter' as kind, s2 as status, count(*) as n, count(*) filter (where hit) as n_messages from c group by s2
union all select 'job', s2, count(*), count(*) filter (where hit) from j group by s2""",
    "chapter_grid": _S + """select novel, number, count(*) as n_versions, arg_min(status, chapter_id) filter (where source_type = 'mtl') as mtl_status,
  bool_or(source_type = 'original') as has_original from st group by all""",
    "chapter_grid_completed": _S + """select * from (select novel, number, count(*) as n_versions, arg_min(status, chapter_id) filter (where source_type = 'mtl') as mtl_status,
  bool_or(source_type = 'original') as has_original from st group by all) where mtl_status = 'completed' and contains(number::varchar, '1')""",
    "preferred_versions": _S + _VERSION.format(t="st") + """ select novel, number, chapter_id, ['original', 'refined', 'mtl'][o] as version,
  md5(case when o = 2 then refined_text else raw_text end) as text_md5 from best where rn = 1""",
    "lore_sources": _S + ", todo as (select * from st where (novel, number) not in (select (novel, number) from st where trim(coalesce(summary, '')) <> ''))"
    + _VERSION.format(t="todo") + " select novel, number, chapter_id, ['original', 'refined', 'mtl'][o] as version from best where rn = 1",
    "job_summaries": "select event_type as status, count(*) as n, 0::bigint as n_modes from events group by event_type",
    "chapter_validation": _S + """, c as (select *, count(*) over (partition by novel, number, source_type) as copies from st),
v as (select novel, array_to_string(list_filter([case when trim(raw_text, e' \\n\\t\\r') = '' then 'no text' end, case when copies > 1 then 'duplicate' end], lambda x: x is not null), ',') as p from c)
select novel, case when p = '' then 'good' else p end as verdict, count(*) as n from v group by all""",
    "seed_missing_novels": _S + """select novel, count(*) as n from st where novel not in (select novel from st where summary is not null and source_type = 'mtl') group by novel""",
    "backfilled_chapters": _S + """, f as (select st.*, b.text as o, source_type = 'mtl' and refined_text is null and b.text is not null as fill from st
  left join benchmark b on st.novel = 'src' || b.item_id and st.number = 1)
select novel, case when fill then 'completed' else status end as status, count(*) as n, count(case when fill then o else refined_text end) as n_refined from f group by all""",
    "removal_dry_run": _S + """, gone as (select distinct novel from st where status = 'failed' and source_type = 'mtl')
select 'chapters' as "table", count(*) as n from st where novel in (from gone) union all select 'novels', count(*) from nov where novel in (from gone)""",
    "index_by_number": """with f as (select url as name, html as raw, regexp_extract(url, '(\\d+)', 1) as d from pages)
select d::bigint as chapter, md5(arg_max(raw, name)) as text_md5 from f where d <> '' group by d::bigint""",
    "change_table": """with c as (select doc_id, case when toxic = 1 then 'delete' when quality = 1 then 'update' else 'create' end as op from labels)
select d.doc_id, case when op = 'update' then 'xx' else lang end as lang, source from documents d left join c using (doc_id) where coalesce(op, '') <> 'delete'
union all select doc_id, 'xx', null from c where op = 'create' and doc_id not in (select doc_id from documents)""",
    "prior_voice_lines": f"""with paras as (select doc_id, lang, unnest(list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda p: trim(p, e' \\t\\n\\r')), lambda p: p <> '')) as paragraph,
   unnest(range(len(list_filter(regexp_split_to_array(text, '\\n+'), lambda p: trim(p, e' \\t\\n\\r') <> '')))) as pos from documents),
r as (select *, row_number() over (partition by doc_id order by len(regexp_extract_all(paragraph, '{_DIALOGUE}')) desc, length(paragraph) desc, pos) as rank from paras where lang = 'en'),
e as (select case when length(paragraph) <= 300 then paragraph else regexp_replace(paragraph[:300], '(?s) [^ ]*$', '') || '…' end as excerpt, min(doc_id) as number from r where rank = 1 group by 1),
b as (select number, {_TOK.format('excerpt')} as t, case when regexp_matches(excerpt, '{SOUNDS.replace("(?iU)", "(?i)")}') then 0.15::double else 0.0::double end as bonus from e),
a as (select doc_id, {_TOK.format('text')} as t from documents where lang <> 'en'),
s as (select a.doc_id as chapter, {_JACCARD} + bonus as score, number from a join b on b.number < a.doc_id),
k as (select *, row_number() over (partition by chapter order by score desc, number) as rank from s)
select chapter, rank::int as rank, round(score, 9) as score from k where rank <= 4""",
}

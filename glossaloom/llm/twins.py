"""DuckDB twins of the corpus queries that SQL can express, written apart from the operators they check."""

from __future__ import annotations

import math

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32: the remainder table from its polynomial, then a fold over bytes.
_CRC_TABLE = """
crc_bits(i, v, k) as (
  select i, i, 0 from range(256) r(i)
  union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from crc_bits where k < 8),
crc_table as (select list(v order by i) as tab from crc_bits where k = 8)"""


def _crc(octets: str) -> str:
    """crc32 of a list of bytes; ``crc_table`` must be in the from clause."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def url_filter(rules: list[tuple[str, str]], settings) -> str:
    """The tree of ``settings``, one set of tables a level; the fold over siblings is a recursion over their ranks."""
    s, bound = settings, math.sqrt(0.5 * math.log(2 / settings.risk))
    purity = f"(labels - bads + {s.strength}::double * above) / (labels + {s.strength}::double)"
    sums = "sum(n)::bigint as n, sum(labels)::bigint as labels, sum(bads)::bigint as bads"
    fits = []
    for text, told in sorted(rules, key=lambda r: (-len(r[0]), r[1] != "block", r[0])):
        host, _, rest = text.partition("/")
        fits.append((f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{rest}')", text, told))
    rule = "case " + " ".join(f"when {when} then '{text}'" for when, text, _ in fits) + " end"
    told = "case " + " ".join(f"when {when} then '{verdict}'" for when, _, verdict in fits) + " end"
    levels = [f"""
w0 as (select p.host, segments, p.n, p.labels, p.bads, '' as node, h.purity from paths p join hosts h using (host))"""]
    for k in range(s.levels):
        levels.append(f"""
s{k} as (
  select *, segments[{k + 1}] as segment, case when len(segments) = {k} then '$'
    when regexp_full_match(regexp_replace(segments[{k + 1}], '\\.[A-Za-z0-9]{{1,5}}\\z', ''), '[0-9]+') then '*digits'
    when regexp_matches(regexp_replace(segments[{k + 1}], '\\.[A-Za-z0-9]{{1,5}}\\z', ''), '[0-9]') then '*mixed' else '*letters' end as kind from w{k}),
g{k} as (select host, node, segment, kind, {sums}, any_value(purity) as above from s{k} group by all),
m{k} as (
  select *, case when segment is not null and n >= {s.least_rows} and n >= {s.least_share}::double * (sum(n) over (partition by host, node))::bigint
    then '=' || segment else kind end as name from g{k}),
n{k} as (select host, node, name, {sums}, any_value(above) as above from m{k} group by host, node, name),
r{k} as (
  select host, node, name, labels, bads, row_number() over (partition by host, node order by {purity}, name) as r from n{k} where name <> '$'),
f{k}(host, node, name, r, labels, bads, cluster) as (
  select host, node, name, r, labels, bads, 0 from r{k} where r = 1
  union all
  select x.host, x.node, x.name, x.r, case when apart then x.labels else f.labels + x.labels end, case when apart then x.bads else f.bads + x.bads end,
    f.cluster + apart::int
  from (
    select f.*, x as x, f.labels > 0 and x.labels > 0 and abs(f.bads::double / f.labels - x.bads::double / x.labels)
      > {bound!r}::double * (1 / sqrt(f.labels::double) + 1 / sqrt(x.labels::double)) as apart
    from f{k} f join r{k} x on x.host = f.host and x.node = f.node and x.r = f.r + 1) f),
c{k} as (select host, node, name, cluster from f{k} union all select host, node, name, -1 from n{k} where name = '$'),
b{k} as (
  select host, node, cluster, min(name) as branch, sum(labels)::bigint as labels, sum(bads)::bigint as bads, any_value(above) as above
  from c{k} join n{k} using (host, node, name) group by host, node, cluster),
o{k} as (select c.host, c.node, c.name, b.branch, {purity} as purity from c{k} c join b{k} b using (host, node, cluster)),
d{k} as (
  select s.host, s.segments, s.n, s.labels, s.bads, s.segment, s.node || '/' || coalesce(a.branch, b.branch) as node, coalesce(a.purity, b.purity) as purity
  from s{k} s left join o{k} a on a.host = s.host and a.node = s.node and a.name = '=' || s.segment
    left join o{k} b on b.host = s.host and b.node = s.node and b.name = s.kind),
w{k + 1} as (select host, segments, n, labels, bads, node, purity from d{k} where segment is not null)""")
    ended = " union all ".join(f"select host, segments, node, purity from d{k} where segment is null" for k in range(s.levels))
    return f"""with recursive
labelled as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 when quality is null or toxic is null then null else 0 end) as bad from labels group by doc_id),
split as (
  select page_id, {_LOWER.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")} as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
urls as (
  select page_id, host, path, list_filter(string_split(path, '/'), lambda x: x <> '')[1:{s.levels}] as segments, bad
  from split left join labelled on doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[/.]|\\z)', 1) as bigint)),
paths as (select host, segments, count(*) as n, count(bad) as labels, count(*) filter (bad = 1) as bads from urls group by all),
hosts as (select host, {purity.replace("above", f"{s.prior}::double")} as purity from (select host, {sums} from paths group by host)),{",".join(levels)},
told as ({ended} union all select host, segments, node, purity from w{s.levels})
select page_id, host, path, {rule} as rule, node as template, purity,
  coalesce({told}, case when purity < {s.least_purity}::double then 'block' else 'allow' end) as verdict
from urls join told using (host, segments)"""


CONVERSATION_TRIE = f"""with recursive {_CRC_TABLE},
t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 as place
  from conversations where conv_id is not null),
ids as (
  select conv_id, {_crc("list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::bigint)")} % 9 as h
  from (select distinct conv_id from t), crc_table),
built as (
  select i.conv_id, 0 as half, t.place, t.role, t.text from ids i join t on t.conv_id = i.conv_id - i.conv_id % 5 and t.place < i.h
  union all select i.conv_id, 1, t.place, t.role, t.text from ids i join t on t.conv_id = i.conv_id and t.place >= i.h),
rows_of as (select conv_id, list({{'role': role, 'text': text}} order by half, place) as turns from built group by conv_id),
talks as (select conv_id, coalesce(turns, []) as turns from ids left join rows_of using (conv_id)),
marked as (select conv_id, len(turns) as size, turns, unnest(range(0, len(turns) + 1)) as depth from talks),
nodes as (
  select turns[1:depth] as key, depth, min(conv_id) as conv_id, count(*) as n_convs,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (size = depth) as ends from marked group by all),
parents as (select key[1:depth - 1] as key, count(*) as n_children from nodes where depth > 0 group by all),
valued as (
  select n.*, coalesce(n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * strlen(n.key[depth].text) end as saved
  from nodes n left join parents p on n.key = p.key),
tops as (select key, depth, saved, n_children, unnest(range(0, depth + 1)) as up from valued),
below as (select key[1:up] as key, sum(saved)::bigint as saved_tokens, count(*) filter (n_children = 0) as n_leaves from tops group by all)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, b.n_leaves, b.saved_tokens, sha256(coalesce(v.ends, '')) as ends_sha256
from valued v join below b on b.key = v.key left join nodes p on v.depth > 0 and p.depth = v.depth - 1 and p.key = v.key[1:v.depth - 1]"""

_OCTETS = """flatten(list_transform(string_split(doc_id::varchar || ':' || run, ''),
      lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [195::bigint, ord(c)::bigint - 64] end))"""

SPELLING_VARIANTS = f"""with recursive {_CRC_TABLE},
runs as (
  select doc_id, {_LOWER.format("run")} as run, count(*) as times
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents) group by all),
hashed as (select run, times, length(run) as size, {_crc(_OCTETS)} as h from runs, crc_table where length(run) >= 5),
kept as (select case when h % 97 = 0 then left(run, (h % size)::int) || substr(run, (h % size)::int + 2) else run end as word, times from hashed),
words as (select word, sum(times)::bigint as n from kept where length(word) >= 5 group by word having sum(times) >= 3),
cut as (
  select word, left(word, i::int) || '?' || substr(word, i::int + 2) as gap, left(word, i::int) || substr(word, i::int + 2) as short
  from (select word, unnest(range(0, length(word))) as i from words)),
near as (
  select a.word, b.word as other from cut a join cut b on a.gap = b.gap and a.word <> b.word
  union select c.word, w.word from cut c join words w on w.word = c.short
  union select w.word, c.word from cut c join words w on w.word = c.short),
ranked as (
  select near.word, other, w.n as other_n, count(*) over (partition by near.word) as n_near,
    row_number() over (partition by near.word order by w.n desc, other) as r from near join words w on w.word = other),
best as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * w.n then other end as form, case when other_n >= 2 * w.n then other_n end as form_n
  from words w left join ranked r on r.word = w.word and r.r = 1),
chains(word, here) as (select word, word from words union all select c.word, b.form from chains c join best b on b.word = c.here where b.form is not null),
ends as (select c.word, c.here as root from chains c join best b on b.word = c.here where b.form is null)
select word, n, n_near, form, form_n, root from best join ends using (word)"""

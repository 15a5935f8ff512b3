"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from tidewire.llm.collisions import LEAST
from tidewire.llm.spelling import CHANGED, LEAST_LETTERS, LEAST_TIMES, TIMES_MORE
from tidewire.llm.topk import EVERY, SCALE, TOP
from tidewire.llm.urlfilter import ALPHABET, KEPT, ORDER, RULES, WEIGHT

_USABLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def vector_neardup() -> str:
    return f"""
with recursive v as (
  select vec_id, case when {_USABLE} and len(list_filter(embedding, lambda x: x <> 0)) > 0
    then embedding::double[] end as e from embeddings),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= {LEAST}),
reach(a, b) as (
  select vec_id, vec_id from v
  union select reach.a, links.b from reach join links on reach.b = links.a)
select v.vec_id, coalesce(n, 0) as n_links, least as component_id, v.vec_id = least as kept
from v left join (select a, count(*) as n from links group by a) on v.vec_id = a
  join (select a as of, min(b) as least from reach group by a) on v.vec_id = of"""


def topk() -> str:
    return f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where vec_id is not null and {_USABLE}),
scores as (
  select q.vec_id as query_id, x.vec_id, cast(list_dot_product(q.v, x.v) as bigint) as score
  from v q join v x on q.vec_id <> x.vec_id where q.vec_id % {EVERY} = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores)
where rank <= {TOP}"""


def url_filter() -> str:
    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' or ends_with(host, '.{r[1]}')) and starts_with(path, '{r[2]}')"
    rule = " ".join(f"when {fits(r)} then '{r[1]}{r[2]}'" for r in by_length)
    said = " ".join(f"when {fits(r)} then '{r[0]}'" for r in by_length)
    rest = "case when contains(u, '://') then substr(u, strpos(u, '://') + 3) else '' end"
    orders = ""
    for o in range(ORDER + 1):
        low = f"join p{o - 1} l on substr(t.s, 2, {o}) = l.s" if o else f"cross join (select 1.0 / {ALPHABET} as pa, 1.0 / {ALPHABET} as pr) l"
        orders += f""",
t{o} as (select substr(g, {ORDER + 1 - o}, {o + 1}) as s, sum(a) as a, sum(r) as r from counts group by 1),
x{o} as (select substr(s, 1, {o}) as h, sum(a) as ca, sum(r) as cr from t{o} group by 1),
p{o} as (select t.s, (a + {WEIGHT} * pa) / (ca + {WEIGHT}) as pa, (r + {WEIGHT} * pr) / (cr + {WEIGHT}) as pr
  from t{o} t join x{o} on substr(t.s, 1, {o}) = h {low})"""
    return f"""
with u as (select row_number() over () as k, page_id, coalesce(url, '') as u from pages),
parts as (
  select *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from (select *, {rest} as rest from u)),
ruled as (
  select *, case {rule} end as rule, case {said} end as said, contains('{KEPT}', left(md5(u), 1)) as kept from parts),
grams as (
  select k, case when not kept then said end as kind, unnest(list_transform(range(1, length(u) + 2),
    lambda i: substr(repeat(chr(2), {ORDER}) || u || chr(3), i, {ORDER + 1}))) as g from ruled),
counts as (
  select g, count(*) filter (kind = 'allow') as a, count(*) filter (kind = 'block') as r from grams group by g){orders},
scored as (
  select * from ruled join (select k as of, avg(ln(pa) - ln(pr)) as score from grams join p{ORDER} on g = s group by k) on k = of),
kinds as (select said, avg(score) as m, stddev_pop(score) as d from scored where kept and said is not null group by said),
edge as (
  select coalesce(max(case when a.d + b.d > 0 then (a.m * b.d + b.m * a.d) / (a.d + b.d) else (a.m + b.m) / 2 end), 0.0) as edge
  from kinds a join kinds b on a.said = 'allow' and b.said = 'block')
select page_id, host, path, rule, coalesce(said, case when score >= edge then 'allow' else 'block' end) as verdict
from scored cross join edge"""


def _crc_table() -> list[int]:
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def spelling() -> str:
    step = f"lambda c, x: xor(c >> 8, {_crc_table()}[1 + xor(c & 255, x)])"
    return f"""
with runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\u00c0-\u00ff]{{{LEAST_LETTERS},}}')) as run from documents),
counted as (select doc_id, run, count(*) as n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as h from runs group by all),
marked as (
  select run, n, xor(4294967295, list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::bigint),
    {step}, 4294967295::bigint)) as m from counted),
words as (
  select word, sum(n)::bigint as n from (
    select n, case when m % {CHANGED} <> 0 then run else substr(run, 1, m % length(run)) || substr(run, m % length(run) + 2) end as word
    from marked) where length(word) >= {LEAST_LETTERS} group by word having sum(n) >= {LEAST_TIMES}),
holes as (
  select word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as replaced, substr(word, 1, i - 1) || substr(word, i + 1) as less
  from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (
  select a.word, b.word as near, b.n as near_n from holes a join holes b on a.replaced = b.replaced and a.word <> b.word
  union select h.word, w.word, w.n from holes h join words w on h.less = w.word
  union select w.word, h.word, h.n from holes h join words w on h.less = w.word),
best as (
  select word, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from pairs group by word),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= {TIMES_MORE} * w.n then near end as form,
    case when near_n >= {TIMES_MORE} * w.n then near_n end as form_n from words w left join best b on w.word = b.word),
way as (
  with recursive way(word, reached, depth) as (
    select word, word, 0 from forms
    union all select way.word, form, depth + 1 from way join forms on way.reached = forms.word where form is not null)
  select word, arg_max(reached, depth) as root from way group by word)
select f.word, n, n_near, form, form_n, root from forms f join way on f.word = way.word"""


SQL: dict[str, str] = {
    "op3_vector_neardup": vector_neardup(),
    "op8_url_filter": url_filter(),
    "op10_topk": topk(),
    "op12_spelling_variants": spelling(),
}

"""SQL of the spelling and centroid queries, put together from parameters."""

from __future__ import annotations

USABLE = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64"


def centroid_sql(clusters: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Plain rounds: every distance to every centroid, from exact double products."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} as materialized (select v.row, arg_min(c.c, {{'d': v.s + c.s - 2 * list_dot_product(v.t, c.t), 'c': c.c}}) as c,
  min(v.s + c.s - 2 * list_dot_product(v.t, c.t))::bigint as distance from v cross join c{k} c group by v.row)""")
        if k < rounds:
            steps.append(f"""
m{k} as (select a.c, i, floor(sum(v.t[i]) / count(*)) as x from a{k} a join v on v.row = a.row, range(1, 65) r(i) group by a.c, i),
n{k} as (select c, list(x order by i) as t from m{k} group by c),
c{k + 1} as materialized (select o.c, coalesce(n.t, o.t) as t, list_dot_product(coalesce(n.t, o.t), coalesce(n.t, o.t)) as s from c{k} o left join n{k} n on n.c = o.c)""")
    return f"""
with u as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as t from embeddings where {USABLE}),
v as materialized (select row_number() over () as row, vec_id, t, list_dot_product(t, t) as s from u),
c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), t) - 1 as c, t, s from v where vec_id is not null qualify c < {clusters}),{",".join(steps)}
select v.vec_id, a.c::int as cluster, a.distance, (sum(a.distance) over (partition by a.c))::bigint as cluster_inertia, (sum(a.distance) over ())::bigint as inertia,
  sha256(array_to_string(list_transform(c.t, lambda x: x::bigint), ',')) as centroid_sha256
from a{rounds} a join v on v.row = a.row join c{rounds} c on c.c = a.c"""


#: Near words by the strings that one deletion leaves: equal at the same place, or equal to the other word.
SPELLING = r"""
with recursive k as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i)) as t),
r as (select coalesce(doc_id::varchar, '') as name, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents),
g as (select name, run, count(*) as n from r group by all),
b as (select g.*, flatten(list_transform(string_split(name || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [(unicode(x) >> 6 | 192)::bigint, (unicode(x) & 63 | 128)::bigint] end)) as bytes from g),
h as (select run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, k.t[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as h from b, k),
d as (select n, case when h % 97 = 0 then run[:(h % len(run))::bigint] || run[(h % len(run))::bigint + 2:] else run end as word from h),
w as materialized (select word, sum(n)::bigint as n from d where len(word) >= 5 group by word having sum(n) >= 3),
c as (select word, n, unnest(range(1, len(word) + 1)) as i from w),
e as materialized (select word, n, i, word[:i - 1] || word[i + 1:] as cut from c),
p as (select a.word, b.word as near, b.n as m from e a join e b on a.cut = b.cut and a.i = b.i and a.word <> b.word
      union select e.word, w.word, w.n from e join w on e.cut = w.word union select w.word, e.word, e.n from e join w on e.cut = w.word),
f as (select word, count(*) as n_near, arg_min(near, {'m': -m, 'near': near}) as near, max(m) as m from p group by word),
t as materialized (select w.word, w.n, coalesce(f.n_near, 0)::bigint as n_near, case when f.m >= 2 * w.n then f.near end as form, case when f.m >= 2 * w.n then f.m end as form_n from w left join f on f.word = w.word),
u as (select word, word as at from t union all select u.word, t.form from u join t on t.word = u.at where t.form is not null)
select t.word, t.n, t.n_near, t.form, t.form_n, u.at as root from t join u on u.word = t.word join t z on z.word = u.at where z.form is null"""

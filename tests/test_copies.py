"""Exact copies in the pairs and groups of near duplicates, against brute force over all rows."""

import duckdb
from memlake.functions import text as X
from memlake.operators import analyse as A
from memlake.operators import write as L
from memlake.plans import registry
from memlake.plans.common import WORDS
from memlake.schema import memories
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
BASE = "one two three four five six seven eight nine ten"
TEXTS = ["a b", "B a", "a  b", "c", *[BASE] * 3, BASE + " x", "alone here", "", "", None, None]


def brute_groups(rows, t):
    """(label, members, best) of the groups in which any two rows meet that are similar, copies included."""
    sets = {i: frozenset(w) for i, w in rows if w}
    ids, root, best = sorted(sets), {i: i for i in sets}, []

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if min(len(sets[a]), len(sets[b])) < t * max(len(sets[a]), len(sets[b])):
                continue
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= t:
                x, y = sorted((top(a), top(b)))
                root[y] = x
                best.append((a, j))
    members, found = {}, {}
    for i in ids:
        members[top(i)] = members.get(top(i), 0) + 1
    for a, j in best:
        found[top(a)] = max(found.get(top(a), 0), j)
    return sorted(((g, n, round(found[g], 6)) for g, n in members.items() if n > 1), key=lambda r: (-r[1], r[0]))


def plain(df):
    return [(r.label, r.members, round(r.best, 6)) for r in df.collect()]


def test_groups_count_exact_copies(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, content string")
    assert plain(L.duplicate_groups(rows, 0.85)) == [(4, 4, 1.0), (0, 3, 1.0)]
    assert {(r.id, r.representative) for r in A.copy_classes(rows).collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 4), (6, 4), (7, 7), (8, 8)}


def test_groups_of_the_table(spark):
    words = [(r.id, r.w) for r in memories(spark, SF).select("id", F.array_distinct(X.tokenize(F.col("content"))).alias("w")).collect()]
    assert plain(registry.queries()["l3_duplicate_groups"](spark, SF)) == brute_groups(words, 0.85)[:50]


def test_group_sizes_by_sql(spark):
    """The same from SQL over representatives weighted by their copies."""
    sql = rf"""with recursive s as (select list_sort(list_distinct({WORDS})) as s, min(doc_id) as id, count(*) as copies from '{SF}/documents.parquet' group by 1),
    w as (select id, unnest(s) as w from s), c as (select x.id as a, y.id as b, count(*) as common from w x join w y on x.w = y.w and x.id < y.id group by 1, 2),
    j as (select a, b, common / (len(x.s) + len(y.s) - common) as similarity from c join s x on x.id = a join s y on y.id = b where common / (len(x.s) + len(y.s) - common) >= 0.85),
    n as (select a as u, b as v from j union select b, a from j), r as (select distinct u, u as v from n union select r.u, n.v from r join n on r.v = n.u), l as (select u, min(v) as label from r group by 1),
    g as (select coalesce(label, id) as label, sum(copies)::bigint as members, max(case when copies > 1 then 1.0 end) as same from s left join l on u = id where len(s) > 0 group by 1),
    b as (select label, max(similarity) as near from j join l on u = a group by 1)
    select label, members, round(greatest(same, near), 6) from g left join b using (label) where members > 1 order by members desc, label limit 50"""
    assert plain(registry.queries()["l3_duplicate_groups"](spark, SF)) == [(a, b, float(c)) for a, b, c in duckdb.sql(sql).fetchall()]

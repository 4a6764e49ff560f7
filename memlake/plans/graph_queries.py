"""Queries on recorded relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import analyse as A
from memlake.operators import graph as G
from memlake.plans.common import EDGE, MEM, query, table
from memlake.schema import edges, memories

KIND = ("cause", "temporal", "constraint")
LINKS = f"{EDGE}, link as (select a, b, case a % 3 when 0 then '{KIND[0]}' when 1 then '{KIND[1]}' else '{KIND[2]}' end as relation, (b % 10) / 10.0 as weight from edge), near as (select a, b, relation, weight from link union all select b, a, relation, weight from link), root as (select distinct a as id from edge where a % 50 = 0)"


def links(spark, d):
    kind = F.when(F.col("a") % 3 == 0, KIND[0]).when(F.col("a") % 3 == 1, KIND[1]).otherwise(KIND[2])
    return edges(spark, d).withColumn("relation", kind).withColumn("weight", F.col("b") % 10 / 10.0)


def roots(spark, d):
    return edges(spark, d).where("a % 50 = 0").select(F.col("a").alias("id")).distinct()


@query(f"with {LINKS} select a as id, relation, array_to_string(list_sort(list_distinct(list(b))), ',') as neighbours from near group by a, relation")
def g1_neighbours(spark, d):
    return G.neighbours(links(spark, d), links(spark, d).select(F.explode(F.array("a", "b")).alias("id"))).withColumn("neighbours", F.array_join("neighbours", ","))


HOPS = """h1 as (select a as root, b as node, max(weight) as weight from near where a in (select id from root) group by 1, 2),
 h2 as (select root, near.b as node, max(near.weight) * 0.7 as weight from h1 join near on h1.node = near.a where near.b <> root and not exists (select 1 from h1 x where x.root = h1.root and x.node = near.b) group by 1, 2),
 h3 as (select root, near.b as node, max(near.weight) * 0.49 as weight from h2 join near on h2.node = near.a where near.b <> root and not exists (select 1 from h1 x where x.root = h2.root and x.node = near.b) and not exists (select 1 from h2 x where x.root = h2.root and x.node = near.b) group by 1, 2)"""


PATHS = """p1 as (select a as root, b as node, weight, relation, [a, b] as path, 1 as hop from near where a in (select id from root)),
 b1 as (select root, node, min({'l': -weight, 'p': path, 'r': relation}) as z from p1 group by 1, 2),
 p2 as (select b1.root, near.b as node, near.weight, near.relation, list_append(b1.z.p, near.b) as path from b1 join near on near.a = b1.node where near.b <> b1.root and not exists (select 1 from b1 x where x.root = b1.root and x.node = near.b)),
 b2 as (select root, node, min({'l': -weight, 'p': path, 'r': relation}) as z from p2 group by 1, 2),
 hop as (select root, node, 1 as hop, round(-z.l, 6) as weight, z.r as relation, array_to_string(z.p, '-') as path from b1 union all select root, node, 2, round(-z.l * 0.7, 6), z.r, array_to_string(z.p, '-') from b2)"""


@query(f"with {LINKS}, {PATHS} select * from hop where relation in ('cause', 'temporal')")
def g3_khop(spark, d):
    found = G.khop(links(spark, d), roots(spark, d), 2, ["cause", "temporal"])
    return found.withColumn("weight", F.round("weight", 6)).withColumn("path", F.array_join("path", "-"))


@query(f"with {LINKS}, {HOPS} select root, node, 1 as hop, round(weight, 6) as weight from h1 union all select root, node, 2, round(weight, 6) from h2 union all select root, node, 3, round(weight, 6) from h3")
def g3_khop_three(spark, d):
    """Three hops (more are asked for)."""
    return G.khop(links(spark, d), roots(spark, d), 9).select("root", "node", "hop", F.round("weight", 6).alias("weight"))


@query(f"with {LINKS}, p as (select distinct x.a as root, y.b as node, x.b as via from near x join near y on x.b = y.a where x.a in (select id from root) and y.b <> x.a) select root, node, count(*) as paths, min(via) as via from p where not exists (select 1 from near where near.a = p.root and near.b = p.node) group by 1, 2")
def g4_indirect(spark, d):
    return G.indirect(links(spark, d), roots(spark, d))


FAR = """far as (select x.a as root, y.b as node, x.b as mid, x.relation as one, y.relation as two from near x join near y on x.b = y.a where x.a in (select id from root) and y.b <> x.a and not (x.relation = 'temporal' and y.relation = 'temporal')),
 ind as (select root, node, count(distinct mid) as paths, min({'mid': mid, 'one': one, 'two': two}) as z from far where not exists (select 1 from near where near.a = far.root and near.b = far.node) group by 1, 2)"""


@query(f"with {LINKS}, {FAR} select root, node, paths, concat_ws('-', root, z.mid, node) as path, concat(z.one, ' → ', z.two) as via, concat(root, ' and ', z.mid, ' (', z.one, '), ', z.mid, ' and ', node, ' (', z.two, ')') as why from ind")
def g4_indirect_paths(spark, d):
    """Typed paths over two steps; two temporal ones in a row count as one event."""
    return G.indirect_paths(links(spark, d), roots(spark, d), ("temporal",)).withColumn("path", F.array_join("path", "-"))


@query(f"""with {LINKS}, {FAR}, {HOPS}, n as (select root, node, 1 as hop, weight from h1 union all select root, node, 2, weight from h2),
 e as (select root, node, row_number() over (partition by root order by hop, weight desc, node) as rank, count(*) over (partition by root) as total from n), k as (select * from e where rank < 10),
 h as (select root, node from k union select root, root from k), d as (select x.root, count(*) as direct from link join h x on x.node = link.a join h y on y.node = link.b and y.root = x.root group by 1),
 f as (select root, count(*) as indirect from ind semi join k using (root, node) group by 1)
 select k.root, count(*) + 1 as nodes, coalesce(any_value(direct), 0) as direct, coalesce(any_value(indirect), 0) as indirect, max(total) as total, max(total) >= 10 as truncated from k left join d on d.root = k.root left join f on f.root = k.root group by k.root""")
def g5_ego_report(spark, d):
    """Counts of the nearest nodes, their recorded edges and the indirect ones."""
    return G.ego_report(links(spark, d), roots(spark, d), 10, ("temporal",))


@query(f"with {LINKS}, {HOPS}, n as (select root, node, 1 as hop, weight from h1 union all select root, node, 2, weight from h2), r as (select root, node, hop, round(weight, 6) as weight, row_number() over (partition by root order by hop, round(weight, 6) desc, node) as rank, count(*) over (partition by root) as total from n) select *, total >= 10 as truncated from r where rank < 10")
def g5_ego_graph(spark, d):
    return G.ego_graph(links(spark, d).withColumn("weight", F.round("weight", 6)), roots(spark, d), 10).withColumn("weight", F.round("weight", 6))


@query(f"""with {LINKS}, {HOPS}, n as (select root, node, 1 as hop, weight from h1 union all select root, node, 2, weight from h2), r as (select root, node, row_number() over (partition by root order by hop, round(weight, 6) desc, node) as rank from n),
 k as (select root, node from r where rank < 10 union select root, root from r) select k.root, link.a, link.b, link.relation, link.a = k.root or link.b = k.root as direct from link join k on k.node = link.a join k y on y.root = k.root and y.node = link.b""")
def g5_ego_edges(spark, d):
    return G.ego_edges(links(spark, d), G.ego_graph(links(spark, d).withColumn("weight", F.round("weight", 6)), roots(spark, d), 10))


RELATED = "p as (select distinct doc_id % 50 as a, doc_id % 37 as b, case when doc_id % 3 = 0 then 'derived_from' else 'related' end as relation from documents)"


@query(f"with {RELATED} select distinct case when relation = 'related' then least(a, b) else a end as a, case when relation = 'related' then greatest(a, b) else b end as b, relation, 1.0::double as weight from p where a <> b")
def g8_write_back(spark, d):
    """Record-layer relations into the edge table: symmetric ones once, directed ones as they are."""
    kind = F.when(F.col("doc_id") % 3 == 0, "derived_from").otherwise("related")
    return G.write_back(table(spark, d, "documents").select((F.col("doc_id") % 50).alias("a"), (F.col("doc_id") % 37).alias("b"), kind.alias("relation")))


@query(f"with {MEM}, e as (select doc_id as a, doc_id * 7 % 500 as b, case doc_id % 4 when 0 then '{G.LOGICAL[0].upper()}' when 1 then '{G.LOGICAL[2]}' when 2 then 'likes' else '{G.LOGICAL[4]}' end as relation from documents), alive as (select id from mem where memory_type <> 'synthesis') select a, b, lower(relation) as relation, case when a = b then 'loop' when lower(relation) = 'likes' then 'unknown_type' when a not in (select id from alive) or b not in (select id from alive) then 'missing_end' else 'ok' end as verdict from e")
def g9_ingest_edges(spark, d):
    kind = F.when(F.col("doc_id") % 4 == 0, G.LOGICAL[0].upper()).when(F.col("doc_id") % 4 == 1, G.LOGICAL[2]).when(F.col("doc_id") % 4 == 2, "likes").otherwise(G.LOGICAL[4])
    incoming = table(spark, d, "documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") * 7 % 500).alias("b"), kind.alias("relation"))
    return G.ingest_edges(incoming, memories(spark, d).where("memory_type != 'synthesis'"))


@query(f"""with {MEM}, e as (select doc_id as a, doc_id * 7 % 500 as b, case doc_id % 4 when 0 then '{G.LOGICAL[0]}' when 1 then '{G.LOGICAL[2]}' when 2 then 'likes' else '{G.LOGICAL[4]}' end as relation from documents), alive as (select id from mem where memory_type <> 'synthesis'),
 ok as (select a, b, relation, 1.0::double as weight, 1 as n from e where a <> b and relation <> 'likes' and a in (select id from alive) and b in (select id from alive) union all select doc_id, doc_id * 7 % 500, '{G.LOGICAL[2]}', 0.5, 0 from documents where doc_id % 8 = 1),
 t as (select case when relation = 'coordinate' then least(a, b) else a end as a, case when relation = 'coordinate' then greatest(a, b) else b end as b, relation, weight, n from ok where a <> b) select a, b, relation, arg_min(weight, n) as weight from t group by 1, 2, 3""")
def g9_accept_edges(spark, d):
    """External edges that are good, with those that were stored before."""
    kind = F.when(F.col("doc_id") % 4 == 0, G.LOGICAL[0]).when(F.col("doc_id") % 4 == 1, G.LOGICAL[2]).when(F.col("doc_id") % 4 == 2, "likes").otherwise(G.LOGICAL[4])
    docs, b = table(spark, d, "documents"), (F.col("doc_id") * 7 % 500).alias("b")
    verdicts = G.ingest_edges(docs.select(F.col("doc_id").alias("a"), b, kind.alias("relation")), memories(spark, d).where("memory_type != 'synthesis'"))
    stored = docs.where("doc_id % 8 = 1").select(F.col("doc_id").alias("a"), b, F.lit(G.LOGICAL[2]).alias("relation"), F.lit(0.5).alias("weight"))
    return G.accept_edges(verdicts, stored)


@query("with s as (select user_id, (value % 100) / 100.0 as score from events), r as (select *, row_number() over (partition by user_id order by score desc) as r from s), t as (select user_id, max(score) as top, coalesce(max(score) filter (where r = 2), 0) as nxt, list(score) as s from r where r <= 3 group by 1), c as (select *, case when top >= 0.85 and round(top - nxt, 9) >= 0.2 then 'contract' when round(top - nxt, 9) >= 0.15 then 'single' else 'branch' end as decision from t) select user_id, decision, case when decision = 'branch' then greatest(len(list_filter(s, lambda x: x >= 0.8 * top)), 2) else 1 end::int as width from c")
def g10_decide_branch(spark, d):
    return G.decide_branch(table(spark, d, "events").select("user_id", (F.col("value") % 100 / 100.0).alias("score")), "user_id", "score")


@query("with m as (select doc_id as id, unnest([doc_id - 1, doc_id - 1, doc_id * 2]) as src from documents where doc_id % 7 = 0), l as (select distinct id as a, src as b from m where src in (select doc_id from documents)) select a, b, 'derived_from' as relation from l union all select b, a, 'crystallized_into' from l")
def j6_derived_from(spark, d):
    src = F.when(F.col("doc_id") % 7 == 0, F.array(F.col("doc_id") - 1, F.col("doc_id") - 1, F.col("doc_id") * 2))
    return G.derived_from(table(spark, d, "documents").select(F.col("doc_id").alias("id"), src.alias("source_ids")))


@query(rf"""with f as (select doc_id as id, unnest(list_distinct(list_filter(regexp_extract_all(lower(concat(text, ' see src/File_', doc_id % 97, '.py')), '[a-z0-9_.-]*[a-z0-9_-]'),
   lambda w: regexp_matches(w, '^[a-z0-9_.-]{{2,}}\.[a-z0-9]{{1,8}}$') and regexp_matches(w, '[a-z].*\.') and regexp_matches(w, '\.[0-9]*[a-z][a-z0-9]*$') and length(w) >= 4))) as name from documents),
 g as (select count(distinct id) as size from f), h as (select name from f, g group by name, size having count(*) >= 5 and count(*) >= 0.35 * size), u as (select * from f where name not in (select name from h))
 select x.id as a, y.id as b, count(*) as shared from u x join u y on x.name = y.name and x.id < y.id group by 1, 2""")
def j5_shared_artifact(spark, d):
    """Files that texts name, one of them added to each text (the tables name too few)."""
    from memlake.functions.rules import extract_artifacts

    text = F.concat("text", F.lit(" see src/File_"), (F.col("doc_id") % 97).cast("string"), F.lit(".py"))
    named = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("grp"), F.explode(extract_artifacts(text)).alias("name"))
    return A.shared_names(named, "name", "doc", "grp")


@query("""with e as (select doc_id as a, doc_id + 1 as b from documents where doc_id % 3 = 0), s as (select doc_id as a, doc_id + 1 as b from documents where doc_id % 2 = 0), t as (select doc_id as a, doc_id + 2 as b from documents where doc_id % 5 = 0),
 u as (select a, b, 'stored' as relation, 0 as i from e union all select a, b, 'same_event', 1 from s union all select a, b, 'shared_entity', 2 from t), z as (select a, b, arg_min(relation, i) as relation, count(distinct relation) as kinds from u group by 1, 2)
 select a, b, relation, kinds, case relation when 'stored' then 'a recorded edge' when 'same_event' then 'the same event' else 'a shared name' end as why, case when length(text) > 80 then concat(substr(text, 1, 80), '…') else text end as preview from z left join documents on doc_id = b""")
def j7_relations(spark, d):
    pair = lambda m, step: table(spark, d, "documents").where(f"doc_id % {m} = 0").select((F.col("doc_id") + step).alias("a"), F.col("doc_id").alias("b"))
    return G.relations({"stored": pair(3, 1), "same_event": pair(2, 1), "shared_entity": pair(5, 2)}, memories(spark, d))


@query("with c as (select distinct doc_id % 50 as a, doc_id % 37 as b from documents), e as (select doc_id % 37 as a, doc_id % 50 as b from documents where doc_id % 3 = 0) select a, b from c where not exists (select 1 from e where (e.a = c.a and e.b = c.b) or (e.a = c.b and e.b = c.a))")
def j14_unlinked(spark, d):
    docs = table(spark, d, "documents")
    wanted = docs.select((F.col("doc_id") % 50).alias("a"), (F.col("doc_id") % 37).alias("b")).distinct()
    return G.unlinked(wanted, docs.where("doc_id % 3 = 0").select((F.col("doc_id") % 37).alias("a"), (F.col("doc_id") % 50).alias("b")))


@query("with e as (select user_id, time_bucket(interval 1 day, ts) as bucket, count(*) as size, epoch(date_trunc('second', max(ts)))::bigint - epoch(date_trunc('second', min(ts)))::bigint as span from events group by 1, 2) select user_id, bucket, size, span from e where size >= 2 and span / size >= 60")
def j3_inferred_events(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return G.inferred_events(e, "user_id", "ts", "1 day").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("""with e as (select user_id, event_id, ts, time_bucket(interval 1 day, ts) as bucket, epoch(date_trunc('second', ts))::bigint as s from events),
 k as (select user_id, bucket from e group by 1, 2 having count(*) >= 2 and (max(s) - min(s)) / count(*) >= 60),
 l as (select user_id, bucket, event_id, lag(event_id) over w as p, s - lag(s) over w as gap from e join k using (user_id, bucket) window w as (partition by user_id, bucket order by ts, event_id))
 select least(p, event_id) as a, greatest(p, event_id) as b, bucket, case when gap < 120 then concat(gap, 's') else concat(gap // 60, 'min') end as gap from l where p is not null and not (least(p, event_id) % 7 = 0)""")
def j3_inferred_links(spark, d):
    """Links inside inferred events, but for pairs (here those whose smaller id is divisible by 7) that an explicit event links."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    every = G.inferred_links(e, "user_id", "ts", "1 day")
    return G.inferred_links(e, "user_id", "ts", "1 day", explicit=every.where("a % 7 = 0").select("a", "b")).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("with recursive v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as vec from embeddings), r as (select vec_id // 50 as qid, vec_id as id, row_number() over (partition by vec_id // 50 order by vec_id) as rank from embeddings), p as (select r.qid, rank, r.id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) as u from r join v on v.id = r.id), w as (select qid, rank, id, [u] as kept, true as stays from p where rank = 1 union all select p.qid, p.rank, p.id, case when s.stays then list_append(w.kept, p.u) else w.kept end, s.stays from w join p on p.qid = w.qid and p.rank = w.rank + 1, lateral (select len(list_filter(w.kept, lambda y: list_dot_product(y, p.u) >= 0.3)) = 0 as stays) s) select qid, id, rank::int as rank from w where stays")
def r6_fold_similar(spark, d):
    from pyspark.sql import Window as W

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    ranked = v.select(F.floor(F.col("id") / 50).alias("qid"), "id").withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("id")))
    return G.fold_similar(ranked, v, 0.3)

"""Queries on the write path."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import scoped_store
from memlake.operators import store as S
from memlake.operators import write as L
from memlake.plans.common import MEM, NOW, query, table
from memlake.schema import memories
from memlake.storage import scratch

GONE = f"coalesce(ttl_days > 0 and {NOW} > age_minutes + ttl_days * 1440, false)"
WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda w: w <> ''))"
OWNER = "case floor(doc_id / 3) % 3 when 1 then 'u1' when 2 then 'u2' end"
MATCH = f"""b as (select doc_id as id, lang, {OWNER} as owner, {WORDS} as s from documents), n as (select * from b where id % 2 = 1), o as (select * from b where id % 2 = 0),
 nw as (select id, lang, owner, unnest(s) as w from n), ow as (select id, lang, owner, unnest(s) as w from o),
 c as (select nw.id, ow.id as target, count(*) as common from nw join ow on nw.w = ow.w and nw.lang is not distinct from ow.lang and nw.owner is not distinct from ow.owner group by 1, 2),
 j as (select c.id, target, common / (len(n.s) + len(o.s) - common) as similarity from c join n on n.id = c.id join o on o.id = c.target), m as (select id, arg_min(target, {{'s': -similarity, 't': target}}) as target, max(similarity) as similarity from j where similarity >= 0.5 group by 1)"""


def halves(spark, d):
    mem = memories(spark, d)
    return mem.where("id % 2 = 1"), mem.where("id % 2 = 0")


@query(f"with {MATCH} select id, target, round(similarity, 6) as similarity from m")
def j12_write_merge_match(spark, d):
    return L.best_match(*halves(spark, d), 0.5, ["tag", "user_id"]).withColumn("similarity", F.round("similarity", 6))


def judged_sql(failed: str = "false") -> str:
    """What becomes of odd documents: equal new ones of a scope after the first are no-ops."""
    return f"""{MATCH}, j0 as (select d.doc_id as id, d.text, d.lang, {OWNER.replace("doc_id", "d.doc_id")} as owner, m.target, {failed} as failed, t.text as old from documents d left join m on m.id = d.doc_id left join documents t on t.doc_id = m.target where d.doc_id % 2 = 1),
 j1 as (select *, min(id) over (partition by lang, owner, text, target is null, failed) as first from j0),
 w as (select id, text, case when target is null and not failed and first <> id then first else target end as target,
  case when failed then 'failed' when target is not null and old = text then 'no_op' when target is not null then 'merge' when first <> id then 'no_op' else 'new' end as outcome from j1)"""


@query(f"with {judged_sql()} select id, target, outcome from w")
def l2_remember_batch(spark, d):
    return L.remember_batch(*halves(spark, d), 0.5, ["tag", "user_id"])


TAKEN = judged_sql("d.doc_id % 14 = 7")


def remembered(spark, d):
    """Odd documents (some without content) into a store of the even ones."""
    rows = memories(spark, d).select("id", "content", F.array("tag").alias("tags"), "tag", "importance", "privacy_level", F.col("age_minutes").alias("created"), F.col("age_minutes").alias("updated"), "user_id")
    new = rows.where("id % 2 = 1").withColumn("content", F.when(F.col("id") % 14 != 7, F.col("content")))
    root = scratch(spark, "store")
    scoped_store.create(rows.where("id % 2 = 0"), root, ["tag", "user_id"])
    counts = scoped_store.remember(new, root, 0.5)
    return scoped_store.read(spark, root), counts


@query(f"with {TAKEN} select count(*) filter (where outcome = 'new') as written, count(*) filter (where outcome = 'merge') as merged, count(*) filter (where outcome = 'no_op') as unchanged, count(*) filter (where outcome = 'failed') as failed from w")
def l20_migrate_items(spark, d):
    return remembered(spark, d)[1]


@query(f"""with {TAKEN}, x as (select doc_id as target, doc_id as updated, text, 0 as new from documents where doc_id % 2 = 0 union all select id, id, text, 0 from w where outcome = 'new' union all select target, id, text, 1 from w where outcome = 'merge'),
 g as (select *, coalesce(lag(text) over o <> text, false) as changed from x window o as (partition by target order by updated, new, text))
 select target as id, md5(arg_max(text, {{'u': updated, 'n': new, 't': text}})) as content, sum(new)::bigint as merged, count(*) filter (where changed) + 1 as version, least(count(*) filter (where changed), 5)::int as kept from g group by 1""")
def l2_remember_written(spark, d):
    """What the store holds after the batch was written."""
    return remembered(spark, d)[0].select("id", F.md5("content").alias("content"), "merged", "version", F.size("history").alias("kept"))


@query(f"""with {MEM}, x as (select id, case when id % 3 = 0 then id else id - id % 3 end as target, content, importance, privacy_level, user_id, age_minutes, tag, (id % 3 <> 0)::int as new,
   case when id % 4 <> 0 then concat('e', id % 10) end as event_id, [concat('n', id % 6)] as entities from mem),
 g as (select *, coalesce(lag(content) over o <> content, false) as changed, row_number() over (partition by target order by age_minutes desc, new desc, content desc) as back from x window o as (partition by target order by age_minutes, new, content)),
 k as (select target, max(importance) as importance, min(age_minutes) as created, arg_max(content, {{'u': age_minutes, 'n': new}}) as content, min(case privacy_level when 'session' then 0 when 'user' then 1 else 2 end) as p,
   coalesce(max(user_id) filter (where new = 0), max(user_id)) as user_id, sum(new)::bigint as merged, array_to_string(list_sort(list_distinct(list(tag))), ',') as tags,
   array_to_string(list_sort(list_distinct(flatten(list(entities)))), ',') as entities, arg_max(event_id, age_minutes) filter (where event_id is not null) as event_id, count(*) filter (where changed) + 1 as version from g group by 1)
 select target as id, content, tags, entities, event_id, importance, case p when 0 then 'session' when 1 then 'user' else 'global' end as privacy_level, created, user_id, merged, version, (version - 1)::int as kept from k""")
def l1_merge_into(spark, d):
    rows = memories(spark, d).select(
        "id", "content", F.array("tag").alias("tags"), F.array(F.concat(F.lit("n"), (F.col("id") % 6).cast("string"))).alias("entities"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("e"), (F.col("id") % 10).cast("string"))).alias("event_id"),
        "importance", "privacy_level", F.col("age_minutes").alias("created"), F.col("age_minutes").alias("updated"), "user_id",
    )
    out = L.merge_into(rows.where("id % 3 = 0"), rows.where("id % 3 != 0").withColumn("target", F.col("id") - F.col("id") % 3))
    return out.withColumn("tags", F.array_join("tags", ",")).withColumn("entities", F.array_join("entities", ",")).withColumn("kept", F.size("history")).drop("history", "updated")


@query(f"""with recursive s as (select list_sort(list_distinct({WORDS})) as s, min(doc_id) as id, count(*) as copies from documents group by 1), w as (select id, unnest(s) as w from s),
 c as (select x.id as a, y.id as b, count(*) as common from w x join w y on x.w = y.w and x.id < y.id group by 1, 2),
 j as (select a, b, common / (len(x.s) + len(y.s) - common) as similarity from c join s x on x.id = a join s y on y.id = b where common / (len(x.s) + len(y.s) - common) >= 0.85),
 n as (select a as u, b as v from j union select b, a from j), r as (select distinct u, u as v from n union select r.u, n.v from r join n on r.v = n.u), l as (select u, min(v) as label from r group by 1),
 g as (select coalesce(label, id) as label, sum(copies)::bigint as members, max(case when copies > 1 then 1.0 end) as same from s left join l on u = id where len(s) > 0 group by 1), b as (select label, max(similarity) as near from j join l on u = a group by 1),
 k as (select label, members, round(greatest(same, near), 6)::double as best from g left join b using (label) where members > 1)
 select label, members, best, case when length(text) > 200 then concat(substr(text, 1, 200), '…') else text end as preview, (select count(*) from documents) as scanned, (select count(*) from k) as total, (select count(*) from k) > 50 as truncated
 from k join documents on doc_id = label order by members desc, label limit 50""")
def l3_duplicate_groups(spark, d):
    return L.duplicate_groups(memories(spark, d), 0.85).withColumn("best", F.round("best", 6))


@query(f"with {MEM} select id, case when {GONE} then 'archive' else 'active' end as place from mem")
def l5_archive_expired(spark, d):
    stays, moves = L.split_by(memories(spark, d), S.expired(F.col("age_minutes"), F.col("ttl_days"), NOW))
    return stays.select("id", F.lit("active").alias("place")).unionByName(moves.select("id", F.lit("archive").alias("place")))


@query(f"""with {MEM}, t as (select id from mem where tag = 'en' and age_minutes >= 100), g as (select id from t join mem using (id) order by age_minutes desc, id limit 30)
 select case when id in (select id from g) then 'archive' else 'active' end as place, count(*) as rows, min(id) as first, (select count(*) from t) as matched, (select count(*) from g) as archived, 0 as dry from mem group by 1""")
def l6_archive_by_tag(spark, d):
    """Both sides after the move; ``dry`` counts what a dry run moved."""
    active, archive, report = L.archive_by_tag(memories(spark, d), "en", 100, 30)
    dry = L.archive_by_tag(memories(spark, d), "en", 100, 30, dry_run=True)[1].agg(F.count("*").cast("int").alias("dry"))
    sides = active.select("id", F.lit("active").alias("place")).unionByName(archive.select("id", F.lit("archive").alias("place")))
    return sides.groupBy("place").agg(F.count("*").alias("rows"), F.min("id").alias("first")).join(F.broadcast(report)).join(F.broadcast(dry))


@query(f"with {MEM}, a as (select * from mem where {GONE}) select id, ttl_days, age_minutes, 'active' as place from mem where not {GONE} union all select id, 30, 0, 'active' from a where id % 5 = 1 union all select id, ttl_days, age_minutes, 'archive' from a where id % 5 <> 1")
def l7_unarchive(spark, d):
    mem = memories(spark, d)
    stays, moves = L.split_by(mem, S.expired(F.col("age_minutes"), F.col("ttl_days"), NOW))
    active, archive = L.unarchive(stays, moves, mem.where("id % 5 = 1").select("id"), 30)
    return active.withColumn("place", F.lit("active")).unionByName(archive.withColumn("place", F.lit("archive"))).select("id", "ttl_days", "age_minutes", "place")


@query(f"with {MEM} select id from mem where {GONE} and id % 3 <> 0")
def l8_purge_archived(spark, d):
    mem = memories(spark, d)
    archive = L.split_by(mem, S.expired(F.col("age_minutes"), F.col("ttl_days"), NOW))[1]
    return L.purge_archived(archive, mem.where("id % 3 = 0")).select("id")


@query("select doc_id as id, case when doc_id % 4 = 0 and doc_id % 8 <> 0 then concat(text, '!') else text end as content, case when doc_id % 4 = 0 and doc_id % 8 <> 0 then 8 else 7 end as version, case when doc_id % 4 = 0 and doc_id % 8 <> 0 then '3,4,5,6,7' else '2,3,4,5,6' end as history from documents")
def l10_correct(spark, d):
    old = F.transform(F.sequence(F.lit(2), F.lit(6)), lambda v: F.struct(v.alias("version"), F.lit("old").alias("content"), F.lit("why").alias("reason")))
    mem = memories(spark, d).select("id", "content", F.lit(7).alias("version"), old.alias("history"))
    edit = F.when(F.col("id") % 8 != 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    out = L.correct(mem, mem.where("id % 4 = 0").select("id", edit.alias("content"), F.lit("typo").alias("reason")))
    return out.select("id", "content", "version", F.array_join(F.transform("history", lambda h: h["version"].cast("string")), ",").alias("history"))


@query(f"with {MEM}, r as (select distinct user_id as owner, lower(substr(content, 1, 5)) as target from mem where id % 20 = 0 and length(content) > 5) select distinct id from mem join r on user_id is not distinct from owner and contains(lower(content), target)")
def f14_suppress_matching(spark, d):
    mem = memories(spark, d)
    asked = mem.where("id % 20 = 0 and length(content) > 5").select("user_id", F.substring("content", 1, 5).alias("target"))
    return L.suppress_matching(mem, asked)


VEC = "v as (select vec_id as id, label, list_transform(embedding, lambda x: x::double) as vec from embeddings), g as (select vec_id as id, label as cluster from embeddings)"


def clusters(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("cluster"))
    return v.select("id", "cluster"), v.select("id", "vec")


@query(f"with {VEC}, u as (select g.cluster, v.id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) as u from g join v on v.id = g.id), p as (select x.cluster, avg(list_dot_product(x.u, y.u)) as m from u x join u y on x.cluster = y.cluster and x.id < y.id group by 1) select p.cluster, n, round(1 - m, 6) as gain from p join (select cluster, count(*) as n from g group by 1) k on k.cluster = p.cluster")
def l13_information_gain(spark, d):
    return L.information_gain(*clusters(spark, d)).withColumn("gain", F.round("gain", 6))


@query("""with recursive v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as vec from embeddings), u as (select id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) as u from v),
 p as (select x.id as a, y.id as b from u x join u y on x.id < y.id and list_dot_product(x.u, y.u) >= 0.3), n as (select a as u, b as v from p union all select b, a from p),
 r as (select u, u as v from (select distinct u from n) union select r.u, n.v from r join n on r.v = n.u), l as (select u as id, min(v) as cluster from r group by 1), k as (select cluster, count(*) as size from l group by 1)
 select id, cluster, size from l join k using (cluster) where size >= 3""")
def l12_cluster_vectors(spark, d):
    from memlake.operators.vectors import similar_pairs

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return L.cluster_vectors(similar_pairs(v, 0.3, 64), 3)


@query("with m as (select doc_id as id, source as cluster, text from documents), r as (select *, row_number() over (partition by cluster order by id) as r, count(*) over (partition by cluster) as total from m) select cluster, total, string_agg(substr(text, 1, 100), chr(10) order by id) as digest from r where r <= 5 group by 1, 2")
def l14_summarise_clusters(spark, d):
    mem = memories(spark, d)
    return L.summarise_clusters(mem.select("id", F.col("project").alias("cluster")), mem)


@query(f"with {MEM}, h as (select user_id as id, count(*) as hits, avg((value % 100) / 100.0) as mean from events group by 1) select m.id, hits, round(mean, 6) as mean from (select id from mem where memory_type = 'synthesis') m join h on h.id = m.id where hits >= 3 and mean < 0.3")
def l17_quarantine(spark, d):
    hits = table(spark, d, "events").select(F.col("user_id").alias("id"), (F.col("value") % 100 / 100.0).alias("quality"))
    return L.quarantine(memories(spark, d).where("memory_type = 'synthesis'"), hits).withColumn("mean", F.round("mean", 6))


@query("with l as (select distinct l_orderkey as a, l_partkey as b from lineitem) select a, b, round(1.0 / count(*) over (partition by a), 6) as weight from l")
def l18_unfold(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return L.unfold(pairs).withColumn("weight", F.round("weight", 6))


@query("select doc_id as id, case when doc_id % 3 = 0 then length(text) else -1 end::int as n, 2 as derived_version from documents")
def l19_backfill_derived(spark, d):
    rows = memories(spark, d).select("id", "content", F.lit(-1).alias("n"), F.when(F.col("id") % 3 != 0, 2).when(F.col("id") % 2 == 0, 1).alias("derived_version"))
    return L.backfill_derived(rows, 2, {"n": F.length("content")}).select("id", "n", "derived_version")

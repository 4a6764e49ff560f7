"""Queries on logs, distributions, runs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import analyse as A
from memlake.operators import report as R
from memlake.operators import stats as T
from memlake.operators import store as S
from memlake.operators import vectors as V
from memlake.plans.common import CONV, MEM, NOW, query, table
from memlake.schema import memories, turns

GONE = f"coalesce(ttl_days > 0 and {NOW} > age_minutes + ttl_days * 1440, false)"
SCORES = "s as (select user_id % 50 as grp, event_id, (value % 100) / 100.0 as x from events where value is not null)"


def scores(spark, d):
    return table(spark, d, "events").where("value is not null").select((F.col("user_id") % 50).alias("grp"), "event_id", (F.col("value") % 100 / 100.0).alias("x"))


@query(f"""with {MEM}, c as (select distinct conv_id as caller, case when conv_id % 10 = 9 then null when conv_id % 2 = 0 then 'user' else 'session' end as level,
   case when conv_id % 3 > 0 then concat('u', conv_id % 3) end as cu, concat('s', conv_id % 8) as cs from conversations)
 select caller, id from mem join c on level is not null and privacy_level = level and user_id is not distinct from cu and (level = 'user' or session_id is not distinct from cs)
 union all select null, id from mem where privacy_level = 'global' union all select caller, null from c where level is null""")
def f4_visible_join(spark, d):
    """Who sees what: a null caller stands for everyone, a null id for every row."""
    conv = table(spark, d, "conversations").select("conv_id").distinct()
    level = F.when(F.col("conv_id") % 10 == 9, F.lit(None)).when(F.col("conv_id") % 2 == 0, "user").otherwise("session")
    user = F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("u"), (F.col("conv_id") % 3).cast("string")))
    session = F.concat(F.lit("s"), (F.col("conv_id") % 8).cast("string"))
    return R.visible_join(memories(spark, d), conv.select(F.col("conv_id").alias("caller"), level.alias("level"), user.alias("user_id"), session.alias("session_id")))


@query(f"with {MEM} select id from mem where not {GONE} and memory_type not in ('code_context', 'synthesis') and (privacy_level = 'global' or (privacy_level = 'user' and user_id is null))")
def f7_incidents(spark, d):
    return T.incidents(memories(spark, d), NOW, "user").select("id")


@query("""select event_id, event_type from events where ts >= '2024-01-05' and ts < '2024-01-20' and event_type in ('error', 'purchase') and (user_id = 7 or event_id = 7 or user_id % 2 = 0)
 order by ts desc, event_id desc limit 200""")
def f16_audit_query(spark, d):
    touched = F.when((F.col("user_id") % 2 == 0) | (F.col("event_id") == 7), F.array(F.lit(7))).otherwise(F.array(F.col("user_id").cast("int")))
    e = table(spark, d, "events").withColumn("ids", touched)
    return R.audit_query(e, "2024-01-05", "2024-01-20", ["error", "purchase"], 7, limit=200).select("event_id", "event_type")


@query(f"with {MEM} select id, {GONE} as expired from mem where memory_type = 'fact' and (privacy_level = 'global' or (privacy_level = 'user' and user_id is not distinct from 'u1'))")
def f18_archive_list(spark, d):
    return T.archive_list(memories(spark, d).where("memory_type = 'fact'"), NOW, "user", user="u1").select("id", "expired")


@query("select user_id, count(*) filter (where event_type in ('purchase', 'click')) as positive, count(*) filter (where event_type = 'error') as negative, count(*) as n, round((count(*) filter (where event_type in ('purchase', 'click')) - count(*) filter (where event_type = 'error')) / count(*), 6) as score from events group by 1")
def f20_a12_feedback(spark, d):
    return R.association_feedback(table(spark, d, "events"), "user_id", "event_type").withColumn("score", F.round("score", 6))


@query("""select event_type, case event_id % 5 when 0 then 'association_relevance' when 1 then 'isolate_memory' else 'retrieval_result' end as target, case when event_type in ('purchase', 'click') then 'positive' when event_type = 'error' then 'negative' else 'neutral' end as kind, count(*) as n from events group by all""")
def f20_classify_feedback(spark, d):
    sent = F.when(F.col("event_id") % 5 == 0, "association").when(F.col("event_id") % 5 == 1, "isolate").when(F.col("event_id") % 5 == 2, "what")
    told = table(spark, d, "events").select("event_type", R.feedback_target(sent).alias("target"), R.classify_feedback(F.col("event_type")).alias("kind"))
    return told.groupBy("event_type", "target", "kind").agg(F.count("*").alias("n"))


@query("with w as (select row_number() over (order by item_id desc) as pos, item_id as id from benchmark) select pos, id, text from w join documents on doc_id = id")
def j1_lookup(spark, d):
    wanted = table(spark, d, "benchmark").agg(F.sort_array(F.collect_list("item_id"), False).alias("ids")).select(F.posexplode("ids").alias("p", "id"))  # one request: a list of ids
    return S.lookup(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), wanted.select("id", (F.col("p") + 1).alias("pos"))).select("pos", "id", "text")


@query()
def j9_vector_topk_lsh(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return V.vector_topk_lsh(v.where("id % 50 = 0"), v, 10, 64, 48, 5)


@query("select doc_id as id, array_to_string(list_distinct_in_order, ',') as tags from (select doc_id, list_filter([lang, source, 'kept'], lambda x, i: x is not null and list_position([lang, source, 'kept'], x) = i) as list_distinct_in_order from documents)")
def u1_merge_tags(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("a"), F.array(F.lit("kept"), "lang").alias("b"))
    return docs.select("id", F.array_join(S.merge_tags(F.col("a"), F.col("b")), ",").alias("tags"))


@query(f"with {MEM} select id from mem where not {GONE}")
def u4_taken_out(spark, d):
    mem = memories(spark, d)
    return S.taken_out(mem, mem.where(S.expired(F.col("age_minutes"), F.col("ttl_days"), NOW))).select("id")


META = "m as (select event_id, ts, case when event_id % 11 <> 0 then user_id % 3 end as f, event_id % 4 as g from events)"


def association_log(spark, d):
    fast = F.when(F.col("event_id") % 11 != 0, (F.col("user_id") % 3).cast("string")).otherwise("many")
    metadata = F.create_map(F.lit("fast_hits"), fast, F.lit("deep_hits"), (F.col("event_id") % 4).cast("string"))
    return table(spark, d, "events").select("event_id", "ts", metadata.alias("metadata"))


@query(f"""with {META} select count(*) as executions, round(avg(f + g), 6) as mean_candidates, count(*) filter (where f > 0 and g = 0) as fast_only,
 count(*) filter (where f = 0 and g > 0) as deep_only, count(*) filter (where f > 0 and g > 0) as both, max(ts) as last_at from m where f is not null""")
def a10_association_activity(spark, d):
    return R.association_activity(association_log(spark, d)).withColumn("mean_candidates", F.round("mean_candidates", 6))


@query(f"with {META} select event_id, ts, f + g as candidates from m where f is not null order by ts desc, event_id desc limit 10")
def a10_newest_associations(spark, d):
    return R.newest_associations(association_log(spark, d))


@query(f"""with {CONV}, g as (select event_id, count(*) as support, substr(arg_max(content, {{'n': length(content), 'i': -id}}), 1, 40) as text from conv group by 1 having count(*) >= 2),
 e as (select 'event' as kind, cast(event_id as varchar) as key, support, text from g order by support desc, event_id limit 4), m as (select turn as name, count(distinct conv_id * 1000 + turn) as support from conversations group by 1),
 h as (select turn as name from conversations group by 1 having count(*) >= 5 and count(*) >= 0.35 * (select count(*) from conversations)),
 n as (select 'name' as kind, cast(name as varchar) as key, support, cast(name as varchar) as text from m where support >= 2 and name not in (select name from h) order by support desc, key limit 4)
 select row_number() over (order by kind, support desc, length(key), key) as place, * from (select * from e union all select * from n) qualify place <= 4""")
def a15_suggestions(spark, d):
    rows = turns(spark, d)
    return T.suggestions(rows, rows.select(F.col("turn").alias("name"), F.col("id").alias("doc"), F.lit(0).alias("grp")))


@query(f"with {MEM} select id, age_minutes, cast(id % 4 as int) as source_count, count(*) over () as total from mem where memory_type = 'synthesis' order by age_minutes desc, id limit 50")
def a16_synthesis_timeline(spark, d):
    made = memories(spark, d).where("memory_type = 'synthesis'")
    sourced = made.withColumn("source_ids", F.slice(F.array(F.col("id"), F.col("id") + 1, F.col("id") + 2), F.lit(1), (F.col("id") % 4).cast("int")))
    return S.page(sourced.select("id", "age_minutes", F.size("source_ids").alias("source_count")), [F.desc("age_minutes"), "id"], 50, 0).drop("truncated")


@query("with u as (select generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as x from embeddings) select i::int as i, round(avg(x), 6) as mean from u group by 1")
def a18_mean_vector(spark, d):
    v = table(spark, d, "embeddings").select(F.col("embedding").alias("vec"))
    return V.mean_vector(v, 64).withColumn("mean", F.round("mean", 6))


@query(f"with {MEM} select 'content' as name, count(distinct project) as sketches, true as close from mem union all select 'tag', count(distinct project), true from mem union all select 'user_id', count(distinct project), true from mem")
def a19_united_sketches(spark, d):
    """Sketches of each project, united: within 2 % of the exact numbers."""
    mem, columns = memories(spark, d), ["content", "tag", "user_id"]
    told = T.united_distinct(T.distinct_sketches(mem, ["project"], columns))
    exact = mem.agg(*[F.count_distinct(c).alias(c) for c in columns]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("exact")) for c in columns])).alias("x")).select("x.*")
    return told.join(exact, "name").select("name", "sketches", (F.abs(F.col("distinct") - F.col("exact")) <= 0.02 * F.col("exact")).alias("close"))


@query()
def a19_approx_distinct(spark, d):
    return memories(spark, d).agg(F.approx_count_distinct("content").alias("contents"), F.approx_count_distinct("user_id").alias("users"))


@query(f"""with {MEM}, c as (select count(*) as n, sum(count(*)) over () as t from embeddings group by label % 8), en as (select round(-sum(n / t * log2(n / t)), 6) as entropy from c)
 select 'memory_type' as section, memory_type as key, count(*)::double as value from mem group by 2 union all select 'project', lower(project), count(*)::double from mem group by 2 union all select 'events', event_type, count(*)::double from events group by 2
 union all select 'total', 'expired', count(*) filter (where {GONE})::double from mem where id % 7 <> 3 union all select 'classes', 'entropy', entropy from en
 union all select 'synthesis', 'ratio', round(count(*) filter (where memory_type = 'synthesis') / count(*), 6) from mem
 union all select 'health', case when round(entropy / 3, 6) * 100 < 30 then 'poor' when round(entropy / 3, 6) * 100 < 50 then 'fair' else 'good' end, round(entropy / 3, 6) * 100 from en""".replace("count(*)::double as value from mem group by 2", "count(*)::double as value from mem where id % 7 <> 3 group by 2").replace("count(*)::double from mem group by 2", "count(*)::double from mem where id % 7 <> 3 group by 2"))
def a20_corpus_report(spark, d):
    """The report of a store of which every row with id % 7 = 3 lies in the archive."""
    mem = memories(spark, d)
    classes = table(spark, d, "embeddings").select((F.col("label") % 8).alias("bucket"))
    return T.corpus_report(mem.where("id % 7 != 3"), table(spark, d, "events"), classes, mem.where("id % 7 = 3"), NOW)


@query(f"with {SCORES}, t as (select grp, count(x) as n, avg(x) as m, stddev_pop(x) as s from s group by 1) select event_id from s join t on s.grp = t.grp where case when n >= 4 and t.s > 1e-6 then (x - m) / t.s >= 0.35 else x >= 0.62 end")
def w5_zscore_threshold(spark, d):
    return R.zscore_threshold(scores(spark, d), "grp", "x").select("event_id")


@query(f"with {SCORES} select grp, round(stddev_pop(x) / avg(x), 6) as concentration, stddev_pop(x) / avg(x) >= 0.3151 as passes from s group by 1")
def w6_concentration(spark, d):
    return R.concentration(scores(spark, d), "grp", "x").withColumn("concentration", F.round("concentration", 6))


@query("with c as (select user_id % 50 as grp, event_type as bucket, count(*) as n from events group by 1, 2), z as (select *, (n - avg(n) over (partition by grp)) / stddev_pop(n) over (partition by grp) as z from c), r as (select *, row_number() over (partition by grp order by round(z, 9) desc, bucket) as rank from z where z > 0) select grp, bucket, rank from r where rank <= 3")
def w7_positive_topk_z(spark, d):
    counts = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("grp"), F.col("event_type").alias("bucket")).agg(F.count("*").alias("n"))
    return R.positive_topk_z(counts, "grp", "bucket", "n").select("grp", "bucket", "rank")


@query("""with e as (select user_id, event_id, lag(event_id) over (partition by user_id order by event_id) as before from events),
 k as (select *, event_id % 500 = 3 or coalesce(before % 500 = 250, false) as bad from e where event_id % 500 <> 250)
 select user_id, min(event_id) filter (where bad) as first_break, count(*) as entries from k group by 1""")
def w9_chain_verify(spark, d):
    """Sealed logs in which some entries were edited and some taken out afterwards."""
    payload = F.concat_ws("|", F.col("event_id").cast("string"), "event_type")
    sealed = R.seal_chain(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", payload)
    edited = sealed.withColumn("event_type", F.when(F.col("event_id") % 500 == 3, F.lit("forged")).otherwise(F.col("event_type")))
    return R.chain_verify(edited.where("event_id % 500 != 250"), "user_id", "event_id", payload)


@query("with c as (select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) as turn from events) select event_id, turn from c where turn <= 40 order by turn, user_id limit 40")
def w10_rotate_seeds(spark, d):
    return S.rotate_seeds(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id", 40).select("event_id", "turn")


RANKED = f"{MEM}, rk as (select project as qid, id, row_number() over (partition by project order by importance desc, id) as rank, 1.0 / row_number() over (partition by project order by importance desc, id) as score from mem), fd as (select project as qid, id, age_minutes as place from mem where id % 3 = 0)"


@query(f"with {RANKED}, fr as (select *, row_number() over (partition by qid order by place, id) as turn from fd where not exists (select 1 from rk where rk.rank <= 20 and rk.qid = fd.qid and rk.id = fd.id)), f3 as (select * from fr where turn <= 3), tk as (select qid, count(*) as taken from f3 group by 1), kp as (select rk.* from rk left join tk on rk.qid = tk.qid where rank <= 20 - coalesce(taken, 0)), la as (select qid, min(score) as last, max(rank) as base from kp group by 1) select qid, id, rank, round(score, 6) as score from kp union all select f3.qid, id, base + turn, round(last * 0.99, 6) from f3 join la on f3.qid = la.qid")
def w11_slot_inject(spark, d):
    ranked = A.topk(memories(spark, d).select(F.col("project").alias("qid"), "id", "importance"), "qid", "importance", "id", 20).select("qid", "id", "rank", (1.0 / F.col("rank")).alias("score"))
    found = memories(spark, d).where("id % 3 = 0").select(F.col("project").alias("qid"), "id", F.col("age_minutes").alias("place"))
    return R.slot_inject(ranked, found, 20).withColumn("score", F.round("score", 6))


@query("select conv_id, turn, concat('session:', conv_id) as event_id, row_number() over (partition by conv_id order by turn, text) as place from conversations")
def w12_sessionise(spark, d):
    return S.sessionise(table(spark, d, "conversations"), "conv_id", ["turn", "text"]).select("conv_id", "turn", "event_id", "place")


JUDGED = "r1 as (select user_id as qid, event_id as id, row_number() over (partition by user_id order by value desc, event_id) as rank from events), r2 as (select user_id as qid, event_id as id, row_number() over (partition by user_id order by event_id) as rank from events), rel as (select user_id as qid, event_id as id from events where event_type = 'purchase')"


def runs(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), "value", "event_type", (-F.col("event_id")).alias("early"))
    return A.topk(e, "qid", "value", "id", 10), A.topk(e, "qid", "early", "id", 10), e.where("event_type = 'purchase'").select("qid", "id")


def metric(name: str) -> str:
    return f"{name} as (select rel.qid, coalesce(1.0 / min(rank), 0) as rr, count(rank) / count(*) as recall from rel left join (select * from {name[-2:]} where rank <= 10) r on r.qid = rel.qid and r.id = rel.id group by 1)"


@query(f"with {JUDGED}, {metric('e_r1')}, {metric('e_r2')}, m as (select 'mrr' as metric, (select avg(rr) from e_r1) as base, (select avg(rr) from e_r2) as other union all select 'recall', (select avg(recall) from e_r1), (select avg(recall) from e_r2)) select metric, round(base, 6) as base, round(other, 6) as other, round((other - base) / base * 100, 4) as improvement, other > base as better from m")
def e1_e2_e4_compare_runs(spark, d):
    first, second, rel = runs(spark, d)
    mean = lambda run: A.evaluate(run, rel, 10).agg(F.avg("rr").alias("mrr"), F.avg("recall").alias("recall")).unpivot([], ["mrr", "recall"], "metric", "value")
    return R.compare_runs(mean(first), mean(second)).select("metric", F.round("base", 6).alias("base"), F.round("other", 6).alias("other"), F.round("improvement", 4).alias("improvement"), "better")


@query(f"with {JUDGED}, {metric('e_r1')} select qid % 10 as shard, count(*) as queries, round(avg(rr), 6) as mrr, round(avg(recall), 6) as recall from e_r1 group by rollup (qid % 10)")
def e5_metrics_by(spark, d):
    first, _, rel = runs(spark, d)
    dims = rel.select("qid", (F.col("qid") % 10).alias("shard")).distinct()
    return T.metrics_by(first, rel, dims, "shard", 10).select("shard", "queries", F.round("mrr", 6).alias("mrr"), F.round("recall", 6).alias("recall"))


@query(f"with {JUDGED} select q.qid, count(r2.id) as common, count(r2.id) >= 3 as robust from (select * from r1 where rank <= 5) q left join (select * from r2 where rank <= 5) r2 on r2.qid = q.qid and r2.id = q.id group by 1")
def e6_noise_robustness(spark, d):
    first, second, _ = runs(spark, d)
    return R.noise_robustness(first, second)


@query(f"with {JUDGED} select qid, id, rank from r1 where rank <= 5 and id in (select event_id from events where event_type = 'error')")
def e6_noise_check(spark, d):
    """Error events are the noise here."""
    return T.noise_check(runs(spark, d)[0], table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id")))


@query(f"""with {MEM}, w as (select distinct conv_id as qid, case when conv_id % 2 = 0 then 'user' else 'session' end as level, case when conv_id % 3 > 0 then concat('u', conv_id % 3) end as cu, concat('s', conv_id % 8) as cs from conversations),
 r as (select qid, (qid * 13 + n) % (select count(*) from documents) as id from w, range(20) t(n)) select r.qid, mem.id, privacy_level from r join w on w.qid = r.qid join mem on mem.id = r.id
 where not (privacy_level = 'global' or (privacy_level = level and user_id is not distinct from cu and (level = 'user' or session_id is not distinct from cs)))""")
def e8_isolation_check(spark, d):
    """A run made without regard to its callers: what they should not have seen."""
    mem, n = memories(spark, d), table(spark, d, "documents").count()
    conv = table(spark, d, "conversations").select(F.col("conv_id").alias("qid")).distinct()
    user = F.when(F.col("qid") % 3 > 0, F.concat(F.lit("u"), (F.col("qid") % 3).cast("string")))
    callers = conv.select("qid", F.when(F.col("qid") % 2 == 0, "user").otherwise("session").alias("level"), user.alias("user_id"), F.concat(F.lit("s"), (F.col("qid") % 8).cast("string")).alias("session_id"))
    run = conv.select("qid", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")).select("qid", ((F.col("qid") * 13 + F.col("k")) % n).alias("id"))
    return T.isolation_check(run, mem, callers)


@query(r"""with t as (select doc_id, lang, list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g') <> '') as ps from documents),
 c as (select lang, doc_id, unnest(ps) as p, generate_subscripts(ps, 1) % 2 as odd from t) select lang as language, count(distinct doc_id) as files, count(*) as chunks, 1.0::double as mean_lines,
 array_to_string(list_filter([case when count(*) filter (where odd = 0) > 0 then concat('even:', count(*) filter (where odd = 0)) end, case when count(*) filter (where odd = 1) > 0 then concat('odd:', count(*) filter (where odd = 1)) end], lambda x: x is not null), ' ') as types from c group by 1""")
def a13_codebase_stats(spark, d):
    """Paragraphs of documents as chunks, in two types."""
    from memlake.operators.corpus import chunk_paragraphs

    docs = table(spark, d, "documents").select(F.struct("doc_id", "lang").alias("k"), F.col("text").alias("content"))
    chunks = chunk_paragraphs(docs, "k").select(F.col("k.doc_id").alias("file"), F.col("k.lang").alias("language"), F.col("chunk_no").alias("start_line"), F.col("chunk_no").alias("end_line"), F.when(F.col("chunk_no") % 2 == 0, "odd").otherwise("even").alias("chunk_type"))
    return T.codebase_stats(chunks)


@query(f"with {MEM} select id, case when length(content) > 100 then concat(substr(content, 1, 100), '…') else content end as preview, count(*) over () as total from mem where id % 3 = 1 and project = (select min(project) from mem) order by age_minutes desc, id limit 50")
def f19_distilled_index(spark, d):
    mem = memories(spark, d)
    tagged = mem.withColumn("tags", F.when(F.col("id") % 3 == 1, F.array("tag", F.lit("distilled"))).otherwise(F.array("tag")))
    return T.distilled_index(tagged, 80, project=mem.agg(F.min("project")).first()[0])


@query(f"with {MEM}, e as (select doc_id as a, doc_id * 7 % 500 as b from documents), gone as (select id from mem where memory_type = 'fact') select 'edge' as what, a as id, b as other from e where a not in (select id from gone) and b not in (select id from gone) union all select 'row', id, null from mem where id not in (select id from gone)")
def l9_forget(spark, d):
    """Rows and edges that are left after forgetting all facts."""
    links, mem = table(spark, d, "documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") * 7 % 500).alias("b")), memories(spark, d)
    rows, edges_ = S.forget(mem, links, mem.where("memory_type = 'fact'"))
    kept = edges_.select(F.lit("edge").alias("what"), F.col("a").alias("id"), F.col("b").alias("other"))
    return kept.unionByName(rows.select(F.lit("row").alias("what"), "id", F.lit(None).cast("long").alias("other")))


@query("""with e as (select event_id, ts, [event_id % 40, event_id % 40 + 1] as ids, [event_id % 40, event_id % 7, event_id % 40 + 1] as trail, case when event_type = 'purchase' then 'seen' end as evidence from events where event_type <> 'error'),
 r as (select event_id, ts, evidence, list_filter(ids, lambda x: x % 3 = 0) as ids, list_filter(trail, lambda x: x % 3 = 0) as trail from e),
 k as (select event_id, evidence, array_to_string(ids, ',') as ids, array_to_string(trail, ',') as trail, len(list_filter(ids, lambda x: x % 5 = 0)) > 0 as expired, len(trail) > 1 as multi_hop, ts from r where len(ids) > 0 and len(trail) > 1 and evidence is not null)
 select event_id, evidence, ids, trail, expired, multi_hop, count(*) over () as total, count(*) over () > 110 as truncated from k order by ts desc, event_id desc limit 100 offset 10""")
def f17_association_records(spark, d):
    """Retrieval events with the ids and steps the caller may see; those without any id drop out."""
    ids, trail = F.array(F.col("event_id") % 40, F.col("event_id") % 40 + 1), F.array(F.col("event_id") % 40, F.col("event_id") % 7, F.col("event_id") % 40 + 1)
    evidence = F.when(F.col("event_type") == "purchase", "seen")
    log = table(spark, d, "events").where("event_type != 'error'").select("event_id", "ts", ids.alias("ids"), trail.alias("trail"), evidence.alias("evidence"))
    mem = memories(spark, d)
    out = T.association_records(log, mem.where("privacy_level = 'session'"), mem.where("ttl_days = 0"), 100, 10, multi_hop=True, evidence_only=True)
    return out.select("event_id", "evidence", F.array_join("ids", ",").alias("ids"), F.array_join("trail", ",").alias("trail"), "expired", "multi_hop", "total", "truncated")
"""Registered queries over the test tables and their SQL, one for each operator of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.operators import analyse as A
from memlake.operators import stats as T
from memlake.operators import store as S
from memlake.plans import corpus_queries, graph_queries, recall_queries, report_queries, retrieval_queries, stream_queries, write_queries  # noqa: F401  (registers its queries)
from memlake.operators.vectors import vector_topk
from memlake.plans.common import CONV, EDGE, MEM, NOW, QUERIES, SQL, WORDS, bm25_sql, query, table
from memlake.schema import edges, memories, turns
from memlake.storage import checkpointed


def oplog(spark, d) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").when((F.col("event_type") == "signup") & (F.col("event_id") % 97 == 0), "clear").otherwise("upsert")
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), "value", op.alias("op"))


OPLOG = "log as (select user_id, event_id as seq, value, case when event_type = 'error' then 'delete' when event_type = 'signup' and event_id % 97 = 0 then 'clear' else 'upsert' end as op from events)"


@query(f"with {OPLOG}, r as (select *, row_number() over (partition by user_id order by seq desc) as n from log where op <> 'clear') select user_id, seq, value from r where n = 1 and op <> 'delete'")
def s1_compact_log(spark, d):
    return S.compact_log(oplog(spark, d).where("op != 'clear'"), "user_id", "seq", "op")


@query(f"with {OPLOG}, c as (select coalesce(max(seq), -1) as at from log where op = 'clear'), r as (select log.*, row_number() over (partition by user_id order by seq desc) as n from log, c where seq > c.at) select user_id, seq, value from r where n = 1 and op <> 'delete'")
def s2_replay_wal(spark, d):
    return S.replay_wal(oplog(spark, d), "user_id", "seq", "op")


@query("with x as (select doc_id, 'old' as origin from documents where doc_id % 3 <> 0), y as (select case when doc_id % 10 <> 0 then doc_id end as doc_id, 'new' as origin from documents where doc_id % 2 = 0) select * from x union all select * from y where doc_id is null or doc_id not in (select doc_id from x)")
def s5_import_append(spark, d):
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 3 != 0").select("doc_id", F.lit("old").alias("origin"))
    new = docs.where("doc_id % 2 = 0").select(F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")).alias("doc_id"), F.lit("new").alias("origin"))
    return S.import_append(old, new, "doc_id")


def two_stores(spark, d):
    docs = table(spark, d, "documents")
    named = lambda f: f.withColumn("doc_id", F.when(F.col("doc_id") % 10 != 7, F.col("doc_id")))
    return [named(docs.select("doc_id", F.col("n_chars").alias("updated"))), named(docs.where("doc_id % 2 = 0").select("doc_id", (F.col("n_chars") + F.col("doc_id") % 3 - 1).alias("updated")))]


STORES = "x as (select case when doc_id % 10 <> 7 then doc_id end as doc_id, n_chars as updated, 0 as source_no from documents union all select case when doc_id % 10 <> 7 then doc_id end, n_chars + doc_id % 3 - 1, 1 from documents where doc_id % 2 = 0), r as (select *, row_number() over (partition by doc_id order by updated desc, source_no) as n from x)"


@query(f"with {STORES} select doc_id, updated, source_no, false as given from r where doc_id is not null and n = 1 union all select null, updated, source_no, true from r where doc_id is null")
def s6_merge_sources(spark, d):
    """Rows of two stores; those that came without an id show a null one here, as ``given`` says that the merge gave them one."""
    stores = two_stores(spark, d)
    known = stores[0].select("doc_id").where("doc_id is not null").withColumn("mine", F.lit(True))
    merged = S.merge_sources(stores, "doc_id", "updated").join(known, "doc_id", "left")
    given = F.col("mine").isNull()
    return merged.select(F.when(~given, F.col("doc_id")).alias("doc_id"), "updated", "source_no", given.alias("given"))


@query(f"with {STORES} select source_no, count(*) as total, count(*) filter (where doc_id is null or n = 1) as added, count(*) filter (where doc_id is not null and n > 1) as duplicates, count(*) filter (where doc_id is null) as without_id from r group by 1")
def s6_merge_report(spark, d):
    return S.merge_report(two_stores(spark, d), "doc_id", "updated")


@query("select count(*) filter (where event_id % 9 = 4) as skipped, count(*) filter (where event_id % 9 <> 4) as read from events")
def s1_parse_log(spark, d):
    line = F.when(F.col("event_id") % 9 != 4, F.to_json(F.struct("user_id", F.col("event_id").alias("seq")))).otherwise(F.concat(F.lit('{"user_id": '), F.col("event_type")))
    rows, skipped = S.parse_log(table(spark, d, "events").select(line.alias("line")), "line", "user_id long, seq long")
    return skipped.join(F.broadcast(rows.where("seq is not null").agg(F.count("*").alias("read"))))


@query("select event_id, cast(user_id as varchar) as ts, event_type as operation, 'a | b' as details from events where event_id % 3 = 0 order by event_id desc limit 50")
def s10_parse_op_log(spark, d):
    line = F.when(F.col("event_id") % 3 == 0, F.concat_ws(" | ", F.col("user_id").cast("string"), "event_type", F.lit("a | b"))).otherwise(F.col("event_type"))
    return S.parse_op_log(table(spark, d, "events").select("event_id", line.alias("line")), "line", "event_id", 50)


@query(f"with {MEM} select id, importance from mem where memory_type = 'decision' and importance >= 4 and (tag in ('en', 'de') or project = 'src1') order by importance desc, id limit 25")
def f1_filter_records(spark, d):
    """By any of several tags of an array, the most important ones."""
    mem = memories(spark, d).withColumn("tags", F.array("tag", "project"))
    return S.filter_records(mem, memory_type="decision", tags=["en", "de", "src1"], min_importance=4, top_k=25).select("id", "importance")


@query(f"with {MEM}, r as (select id, importance from mem where not coalesce(ttl_days > 0 and {NOW} > age_minutes + ttl_days * 1440, false)) select id, importance, (select count(*) from r) as total, (select count(*) from r) > 30 as truncated from r order by importance desc, id limit 20 offset 10")
def f2_list_records(spark, d):
    return S.list_records(memories(spark, d), NOW, "importance", limit=20, offset=10).select("id", "importance", "total", "truncated")


@query(f"with {MEM}, r as (select id, session_id from mem where memory_type = 'fact') select id, session_id, (select count(*) from r) as total, (select count(*) from r) > 45 as truncated from r order by session_id nulls last, id limit 40 offset 5")
def f2_list_with_expired(spark, d):
    """Ascending by a column with nulls, rows past their time too."""
    return S.list_records(memories(spark, d), NOW, "session_id", descending=False, limit=40, offset=5, include_expired=True, memory_type="fact").select("id", "session_id", "total", "truncated")


@query(f"with {MEM} select id, privacy_level = 'global' or (privacy_level = 'user' and user_id is not distinct from 'u1') as for_user, privacy_level = 'global' or (privacy_level = 'session' and user_id is null and session_id is not distinct from 's0') as for_session from mem")
def f3_visible(spark, d):
    return memories(spark, d).select("id", S.visible("user", user="u1").alias("for_user"), S.visible("session", session="s0").alias("for_session"))


@query(f"with {MEM} select id, coalesce(ttl_days > 0 and {NOW} > age_minutes + ttl_days * 1440, false) as expired from mem")
def f5_expired(spark, d):
    return memories(spark, d).select("id", S.expired(F.col("age_minutes"), F.col("ttl_days"), NOW).alias("expired"))


LIFE = """ops as (select user_id as id, event_id as seq, case event_type when 'error' then 'suppressed' when 'signup' then 'clear' when 'purchase' then 'superseded' else 'touch' end as op from events),
 cl as (select id, max(case when op = 'clear' then seq end) as cleared from ops group by id),
 life as (select ops.id, coalesce(arg_max(op, case when op in ('superseded', 'suppressed') then seq end), 'active') as state, count(*) filter (where op = 'touch') as hits, max(case when op = 'touch' then seq end) as last_hit from ops join cl on ops.id = cl.id where cleared is null or seq > cleared group by ops.id)"""


def life_events(spark, d):
    op = F.when(F.col("event_type") == "error", "suppressed").when(F.col("event_type") == "signup", "clear").when(F.col("event_type") == "purchase", "superseded").otherwise("touch")
    return table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"))


@query(f"with {LIFE} select * from life")
def l11_lifecycle_apply(spark, d):
    return S.lifecycle_apply(life_events(spark, d))


@query(f"with {MEM}, {LIFE} select id from mem where id not in (select id from life where state <> 'active')")
def f6_exclude_inactive(spark, d):
    return S.exclude_inactive(memories(spark, d), S.lifecycle_apply(life_events(spark, d))).select("id")


@query(f"with {MEM}, alive as (select id from mem where memory_type <> 'synthesis'), e as (select doc_id as a, doc_id * 7 % 500 as b from documents) select a, b from e where a <> b and a in (select id from alive) and b in (select id from alive)")
def f15_stored_edge_guard(spark, d):
    links = table(spark, d, "documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") * 7 % 500).alias("b"))
    return S.stored_edge_guard(links, memories(spark, d).where("memory_type != 'synthesis'"))


@query(f"with {CONV} select x.id as a, y.id as b, x.event_id, 'pair' as linked_by from conv x join conv y on x.event_id = y.event_id and x.id < y.id")
def j2_same_event(spark, d):
    return A.same_event(turns(spark, d))


@query(f"with {CONV} select event_id, id, min(id) over (partition by event_id) as first, count(*) over (partition by event_id) as size from conv")
def j2_event_members(spark, d):
    return A.event_members(turns(spark, d))


MENTIONS = "m as (select l_orderkey as doc, l_returnflag as name, l_orderkey % 200 as grp from lineitem), g as (select grp, count(distinct doc) as size from m group by grp), f as (select grp, name, count(distinct doc) as df from m group by grp, name), h as (select f.grp, name, df, size from f join g on f.grp = g.grp where df >= 5 and df >= 0.35 * size)"


def mentions(spark, d, name="l_partkey", groups=200):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col(name).alias("name"), (F.col("l_orderkey") % groups).alias("grp"))


@query(f"with {MENTIONS} select * from h")
def a6_hubs(spark, d):
    """Return flags are in most orders: hubs by the published bounds."""
    return A.hubs(mentions(spark, d, "l_returnflag"), "name", "doc", "grp")


@query("with m as (select distinct l_orderkey as doc, l_partkey as name, l_orderkey % 1 as grp from lineitem), g as (select grp, count(distinct doc) as size from m group by grp), f as (select grp, name, count(*) as df from m group by grp, name), h as (select f.grp, name from f join g on f.grp = g.grp where df >= 5 and df >= 0.35 * size), u as (select * from m where not exists (select 1 from h where h.grp = m.grp and h.name = m.name)) select x.doc as a, y.doc as b, count(*) as shared from u x join u y on x.grp = y.grp and x.name = y.name and x.doc < y.doc group by 1, 2")
def j4_shared_entity(spark, d):
    """Orders that share a part, in one group: every pair there is."""
    return A.shared_names(mentions(spark, d, groups=1), "name", "doc", "grp")


EMB = "v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as vec, label from embeddings), c as (select q.vec_id as qid, v.id, round(list_dot_product(list_transform(q.embedding, lambda x: x::double), v.vec) / sqrt(list_dot_product(list_transform(q.embedding, lambda x: x::double), list_transform(q.embedding, lambda x: x::double))) / sqrt(list_dot_product(v.vec, v.vec)), 9) as score from embeddings q, v where q.vec_id % 50 = 0 and q.vec_id <> v.id), run as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from c) where rank <= 10)"


def vector_run(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return v, vector_topk(v.where("id % 50 = 0"), v, 10)


@query(f"with {EMB} select qid, id, round(score, 6) as score, rank from run")
def j8_vector_topk(spark, d):
    return vector_run(spark, d)[1].withColumn("score", F.round("score", 6))


@query(f"with {EMB}, rel as (select q.vec_id as qid, v.id from embeddings q join v on q.label = v.label and q.vec_id <> v.id where q.vec_id % 50 = 0), h as (select rel.qid, min(rank) as first, count(rank) as hits, count(*) as relevant from rel left join run on rel.qid = run.qid and rel.id = run.id group by 1) select qid, round(coalesce(1.0 / first, 0), 6) as rr, hits, round(hits / relevant, 6) as recall, coalesce(first, 11) as first from h")
def e3_rank_summary(spark, d):
    v, run = vector_run(spark, d)
    q = v.where("id % 50 = 0").select(F.col("id").alias("qid"), "label")
    qrels = v.join(q, "label").where("id != qid").select("qid", "id")
    return A.evaluate(run, qrels, 10).select("qid", F.round("rr", 6).alias("rr"), "hits", F.round("recall", 6).alias("recall"), "first")




@query(f"select doc_id as id, array_to_string({WORDS}, ' ') as tokens from documents")
def x1_tokenize(spark, d):
    return memories(spark, d).select("id", F.concat_ws(" ", X.tokenize(F.col("content"))).alias("tokens"))


@query(rf"with s as (select list_sort(list_distinct({WORDS})) as s, min(doc_id) as id from documents group by 1), w as (select id, unnest(s) as w from s), c as (select x.id as a, y.id as b, count(*) as common from w x join w y on x.w = y.w and x.id < y.id group by 1, 2), j as (select a, b, common / (len(x.s) + len(y.s) - common) as similarity from c join s x on x.id = a join s y on y.id = b) select a, b, round(similarity, 6) as similarity from j where similarity >= 0.85")
def j10_near_dup_pairs(spark, d):
    return A.near_dup_pairs(memories(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query(rf"with s as (select doc_id as id, list_sort(list_distinct({WORDS})) as s from documents) select id, min(id) over (partition by s) as representative from s where len(s) > 0")
def j10_copy_classes(spark, d):
    """Which documents the representatives of j10 and j11 stand for."""
    return A.copy_classes(memories(spark, d))


BM25 = bm25_sql("select doc_id as id, text as content from documents", 5)


def bm25_run(spark, d, k=5):
    queries_ = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("content"))
    return A.bm25(queries_, memories(spark, d), k)


@query(f"with {BM25} select * from run")
def r1_bm25(spark, d):
    return bm25_run(spark, d)


@query(f"with {BM25}, b as (select qid, id, rank from (select qid, id, row_number() over (partition by qid order by length(text) desc, id) as rank from run join documents on id = doc_id)), e as (select qid, id, 1.0 / (60 + rank) as part from run union all select qid, id, 0.5 / (60 + rank) from b) select qid, id, round(sum(part), 9) as score, count(*) as routes from e group by 1, 2")
def r5_rrf(spark, d):
    first = checkpointed(bm25_run(spark, d))  # both routes start from it
    second = first.select("qid", "id").join(memories(spark, d).select("id", F.length("content").alias("n")), "id")
    return A.rrf([first, A.topk(second, "qid", "n", "id", 5)], [1.0, 0.5]).withColumn("score", F.round("score", 9))


@query(f"""with {MEM} select count(*) as total, count(*) filter (where memory_type = 'synthesis') as synthesis, count(*) filter (where memory_type = 'code_context') as code_context, count(*) filter (where memory_type = 'experience') as experience,
 count(*) filter (where coalesce(ttl_days > 0 and {NOW} > age_minutes + ttl_days * 1440, false)) as expired, count(*) filter (where {NOW} - age_minutes * 40 <= 10080) as added_7_days, count(*) filter (where id % 3 = 0) as with_event, count(*) filter (where id % 4 = 0) as with_entity,
 count(distinct case when id % 3 = 0 then id % 40 end) as events, count(distinct lower(project)) as projects, greatest(count(*) - count(*) filter (where memory_type in ('synthesis', 'code_context')), 0) as incident_candidates from mem""".replace("> age_minutes + ttl_days * 1440", "> age_minutes * 40 + ttl_days * 1440"))
def a1_a3_stats(spark, d):
    """Records 40 minutes apart, so that some are of the last week."""
    event, entities = F.when(F.col("id") % 3 == 0, F.col("id") % 40), F.when(F.col("id") % 4 == 0, F.array("tag")).otherwise(F.array().cast("array<string>"))
    return T.stats(memories(spark, d).withColumn("age_minutes", F.col("age_minutes") * 40).withColumn("event_id", event).withColumn("entities", entities), NOW)


@query(f"with {MEM} select memory_type, lower(project) as project, count(*) as n from mem group by rollup (memory_type, lower(project))")
def a2_stats_rollup(spark, d):
    return T.stats_rollup(memories(spark, d))


@query(f"with {CONV} select event_id, count(*) as size from conv group by 1")
def a4_event_index(spark, d):
    return T.event_index(turns(spark, d))


@query(f"with {CONV}, a as (select event_id, min(id) as exclude from conv group by 1) select a.event_id, exclude, id from a join conv on conv.event_id = a.event_id where id <> exclude")
def a4_event_members(spark, d):
    rows = turns(spark, d)
    return T.event_members(rows, rows.groupBy("event_id").agg(F.min("id").alias("exclude")))


@query(f"with t as (select distinct doc_id, unnest({WORDS}) as term from documents) select term, count(*) as df from t group by 1")
def a5_document_frequency(spark, d):
    return A.document_frequency(memories(spark, d), X.tokenize(F.col("content")))


@query(f"with t as (select distinct doc_id, source, unnest({WORDS}) as term from documents) select source as project, term, count(*) as df from t group by 1, 2")
def a5_document_frequency_by_project(spark, d):
    return A.document_frequency(memories(spark, d), X.tokenize(F.col("content")), ["project"])


@query("with t as (select count(distinct user_id) as queries from events) select event_type, count(distinct user_id) as hits, round(least(count(distinct user_id) / greatest(any_value(queries), 1), 1.0), 6) as rate from events, t group by 1")
def a7_query_frequency(spark, d):
    return T.query_frequency(table(spark, d, "events"), "user_id", "event_type").withColumn("rate", F.round("rate", 6))


@query("with c as (select count(*) as n, sum(count(*)) over () as t from embeddings group by label % 8), e as (select round(-sum(n / t * log2(n / t)), 6) as entropy from c) select entropy, round(entropy / 3, 6) as balance from e")
def a8_bucket_entropy(spark, d):
    return A.entropy(table(spark, d, "embeddings").select((F.col("label") % 8).alias("bucket")), "bucket", 8)


@query(f"with {MEM} select project, round(count(*) filter (where memory_type = 'synthesis') / count(*), 6) as ratio, count(*) filter (where id % 5 <> 0) as active, count(*) filter (where id % 5 = 0) as archived from mem group by 1")
def a9_synthesis_ratio(spark, d):
    mem = memories(spark, d)
    return T.synthesis_ratio(mem.where("id % 5 != 0"), mem.where("id % 5 = 0")).withColumn("ratio", F.round("ratio", 6))


@query("select event_type, count(*) as n from events group by 1")
def a11_audit_type_stats(spark, d):
    return T.type_counts(table(spark, d, "events"))


@query(f"with {EDGE} select node, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree, count(*) as degree from (select a as node, 1 as o, 0 as i from edge union all select b, 0, 1 from edge) group by 1")
def a14_edge_stats(spark, d):
    return T.edge_stats(edges(spark, d))


@query(f"with {EDGE} select case when a % 3 = 0 then 'cause' else 'related' end as relation, count(*) as n from edge group by 1")
def a14_relation_counts(spark, d):
    return T.relation_counts(edges(spark, d).withColumn("relation", F.when(F.col("a") % 3 == 0, "cause").otherwise("related")))


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.5) < 500 and quantile_disc(value, 0.95) < 1000 as passes from events where value is not null group by 1")
def a17_latency_percentiles(spark, d):
    return T.latency_percentiles(table(spark, d, "events"), "event_type", "value")


@query(f"""with {CONV}, r as (select *, row_number() over (partition by event_id order by turn, id) as version, row_number() over (partition by event_id order by turn desc, id desc) as back from conv)
 select event_id, max(version) as version, arg_max(content, version) as content, array_to_string(list_sort(list(concat(version, ':', role, ':', md5(content))) filter (where back > 1)), ' ') as history from r where back <= 6 group by 1""")
def w1_version_history(spark, d):
    out = S.version_history(turns(spark, d), "event_id", "id", "content", "role")
    told = F.transform("history", lambda h: F.concat_ws(":", h["version"].cast("string"), h["reason"], F.md5(h["content"])))
    return out.select("event_id", "version", "content", F.array_join(F.array_sort(told), " ").alias("history"))


@query(f"with {MEM} select * from (select project, id, importance, row_number() over (partition by project order by importance desc, id) as rank from mem) where rank <= 3")
def w3_topk_per_group(spark, d):
    return A.topk(memories(spark, d).select("project", "id", "importance"), "project", "importance", "id", 3)


@query(rf"with {MEM} select id from (select id, row_number() over (partition by lower(regexp_replace(content, '[ \t\n\r]+', '', 'g')) order by id) as n from mem) where n = 1")
def w4_first_occurrence(spark, d):
    key = F.lower(F.regexp_replace("content", r"[ \t\n\r]+", ""))
    return memories(spark, d).withColumn("key", key).groupBy("key").agg(F.min("id").alias("id")).select("id")


@query("select user_id, event_id, case when gap < 120 then concat(cast(gap as varchar), 's') when gap is not null then concat(cast(gap // 60 as varchar), 'min') end as gap from (select user_id, event_id, cast(epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) as bigint) as gap from (select user_id, event_id, date_trunc('second', ts) as ts from events))")
def w8_event_gaps(spark, d):
    at = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    return T.event_gaps(table(spark, d, "events"), "user_id", at, "event_id")


@query(f"with {MEM} select id, rank, preview, total, truncated from (select id, case when length(content) > 100 then concat(substr(content, 1, 100), '…') else content end as preview, row_number() over (order by age_minutes desc, id) as rank, count(*) over () as total, count(*) over () > 20 as truncated from mem) where rank <= 20")
def t2_recent(spark, d):
    return S.recent(memories(spark, d), 500)


PAIRS = "e as (select doc_id % 50 as a, doc_id % 37 as b, case when doc_id % 4 = 0 then 'cause' else 'related' end as relation, doc_id / 500.0 - 0.2 as weight, 0 as n from documents union all select doc_id % 37, doc_id % 50, case when doc_id % 4 = 0 then 'cause' else 'related' end, 0.9, 1 from documents)"


@query(f"""with {PAIRS}, t as (select case when relation = 'cause' then a else least(a, b) end as a, case when relation = 'cause' then b else greatest(a, b) end as b, relation, least(greatest(weight, 0.0), 1.0) as weight, n from e where a <> b)
 select a, b, relation, round(arg_min(weight, {{'n': n, 'w': weight}}), 6) as weight from t group by 1, 2, 3""")
def u2_edge_union(spark, d):
    docs = table(spark, d, "documents")
    relation = F.when(F.col("doc_id") % 4 == 0, "cause").otherwise("related").alias("relation")
    x = docs.select((F.col("doc_id") % 50).alias("a"), (F.col("doc_id") % 37).alias("b"), relation, (F.col("doc_id") / 500.0 - 0.2).alias("weight"))
    y = docs.select((F.col("doc_id") % 37).alias("a"), (F.col("doc_id") % 50).alias("b"), relation, F.lit(0.9).alias("weight"))
    return S.edge_union(x, y).withColumn("weight", F.round("weight", 6))


@query(f"with {EDGE} select * from edge where a % 3 <> 0 and b % 3 <> 0")
def u3_remove_nodes(spark, d):
    e = edges(spark, d)
    ids = e.select(F.col("a").alias("id")).union(e.select("b")).where("id % 3 = 0").distinct()
    return S.remove_nodes(e, ids)


@query(f"""with recursive {EDGE}, near as (select a as u, b as v from edge union all select b, a from edge),
 t as (select u, u as label, 0 as round from (select distinct u from near) union all
   select u, label, round from (select t.u, least(t.label, min(t2.label)) as label, t.round + 1 as round, t.label as before from t join near on near.u = t.u join t t2 on t2.u = near.v group by t.u, t.label, t.round) where round <= 12)
 select u, min(label) as label from t group by 1""")
def g2_components(spark, d):
    return A.components(edges(spark, d))


@query(f"with {MEM}, o as (select project, count(*) filter (where privacy_level <> 'global') as owned, count(distinct case when privacy_level <> 'global' then coalesce(user_id, '') end) as users, count(distinct case when privacy_level <> 'global' then coalesce(session_id, '') end) as sessions, count(*) filter (where privacy_level = 'session') as in_session, max(case when privacy_level <> 'global' then user_id end) as owner from (select *, id // 2 as grp from mem) group by project, grp) select count(*) as n, case when owned = 0 then 'global' when users > 1 then 'rejected' when in_session = owned and sessions = 1 then 'session' else 'user' end as level from o group by 2")
def l15_inherit_scope(spark, d):
    pairs = memories(spark, d).withColumn("grp", F.concat_ws("/", "project", F.floor(F.col("id") / 2).cast("string")))
    return S.inherit_scope(pairs, "grp").groupBy("level").agg(F.count("*").alias("n"))


@query(rf"with {MEM} select id, round(least(greatest(exp(-0.05 * (({NOW} - age_minutes) // 60 / 24.0) / importance) * (1 - (id % 11) / 10.0 * 0.3), 0), 1), 6) as decay, case when length(content) > 80 then concat(substr(content, 1, 80), '…') else content end as preview, case when session_id is not null then 'session' when user_id is not null then 'user' else 'none' end as scope, cast(round(least(greatest(4 + id % 9, 3.0), 9.0)) as int) as from_score, concat(substr(sha256(trim(project)), 1, 32), '::', coalesce(user_id, '-')) as owner from mem")
def x_record_functions(spark, d):
    hours = F.floor((NOW - F.col("age_minutes")) / 60)
    return memories(spark, d).select(
        "id", F.round(X.decay(F.col("importance"), hours, F.col("id") % 11 / 10.0), 6).alias("decay"), X.preview(F.col("content"), 80).alias("preview"), X.scope_of(F.col("user_id"), F.col("session_id")).alias("scope"),
        X.importance_from_score(F.col("id") % 9).alias("from_score"), X.owner_key(F.col("project"), F.coalesce("user_id", F.lit("-"))).alias("owner"),
    )


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

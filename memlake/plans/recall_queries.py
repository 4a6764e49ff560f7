"""Queries on the retrieval flow, gates, affinities, association and exploring."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import embed as M
from memlake.functions import rules
from memlake.functions import text as X
from memlake.operators import analyse as A
from memlake.operators import graph as G
from memlake.operators import recall as Q
from memlake.operators import report as R
from memlake.operators import store as S
from memlake.operators import stored_index
from memlake.operators import vectors as V
from memlake.operators.substring import containing
from memlake.plans.common import MEM, NOW, WORDS, bm25_sql, keyword_sql, query, table
from memlake.schema import memories
from memlake.storage import scratch

LIVE = f"live as (select * from mem where privacy_level = 'global' and not coalesce(ttl_days > 0 and {NOW} > age_minutes + ttl_days * 1440, false))"
BM25 = bm25_sql("select doc_id as id, text as content from documents", 20)
CONTENT_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z0-9_]+'), lambda w: len(w) >= 2))"
#: Recorded relations among documents: stored edges, and neighbours by number.
LINKS = "link as (select least(a, b) as a, greatest(a, b) as b, arg_min(relation, n) as relation from (select doc_id as a, doc_id * 7 % 500 as b, 'stored' as relation, 0 as n from documents union all select doc_id, doc_id + 1, 'neighbour', 1 from documents) group by 1, 2)"


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("content"))


def live(spark, d):
    return memories(spark, d).where("privacy_level = 'global'").where(~S.expired(F.col("age_minutes"), F.col("ttl_days"), NOW))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def links(spark, d):
    docs = table(spark, d, "documents")
    pair = lambda b: docs.select(F.col("doc_id").alias("a"), b.alias("b"))
    return G.relations({"stored": pair(F.col("doc_id") * 7 % 500), "neighbour": pair(F.col("doc_id") + 1)})


FAST = f"with {MEM}, {LIVE}, {bm25_sql('select id, content from live', 5)}, w as (select qid, id, content, round(points * round(1 + 0.1 * ln(1 + importance * least(greatest(exp(-0.05 * (({NOW} - age_minutes) // 60 / 24.0) / importance), 0), 1)), 6))::bigint as points from sc join live using (id)), n as (select *, row_number() over (partition by qid, content order by points desc, id) as nth from w), r as (select qid, id, row_number() over (partition by qid order by points desc, id) as rank, points / 1e6 as score from n where nth = 1) select *, score / max(score) over (partition by qid) as normal from r where rank <= 5"


@query(FAST)
def r2_recall_fast(spark, d):
    return Q.recall_fast(asked(spark, d), live(spark, d), 5, NOW)


@query(FAST)
def r2_recall_stored(spark, d):
    """The same ranking from a stored index of two segments; texts are read only to tell copies."""
    rows, root = live(spark, d), scratch(spark, "recall-index")
    stored_index.create(rows.where("id % 2 = 0"), root)
    stored_index.append(rows.where("id % 2 = 1"), root)
    return Q.recall_fast(asked(spark, d), rows, 5, NOW, index=root)


def letters(texts):
    """A stand-in model: how often each of 64 classes of letter pairs occurs, less the mean."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * 64
        for i in range(len(t) - 1):
            v[zlib.crc32(t[i : i + 2].encode()) % 64] += 1.0
        out.append([x - sum(v) / 64 for x in v])
    return out


def windowed(spark, d):
    pieces = memories(spark, d).select("id", F.explode(X.windows(F.col("content"))).alias("content"))
    return M.embed(pieces, letters).where("vec is not null")


@query()
def r4_recall_deep(spark, d):
    q = M.embed(asked(spark, d).select((-1 - F.col("qid")).alias("id"), F.explode(X.windows(F.col("content"))).alias("content")), letters)
    return Q.recall_deep(q, windowed(spark, d), live(spark, d), 10, 64).select((-1 - F.col("qid")).alias("qid"), "id", "rank", "score")


@query(f"with {BM25}, b as (select qid, id, row_number() over (partition by qid order by length(text) desc, id) as rank from run join documents on id = doc_id where rank <= 10), e as (select qid, id, concat('fast:', rank) as path, 1.0::double / (60 + rank) as part from run union all select qid, id, concat('long:', rank), 0.5::double / (60 + rank) from b), g as (select qid, id, round(sum(part), 9) as score, string_agg(path, ' ' order by path) as paths from e group by 1, 2) select qid, id, row_number() over (partition by qid order by score desc, id) as rank, score, score / max(score) over (partition by qid) as normal, paths from g")
def r7_explain(spark, d):
    fast = A.bm25(asked(spark, d), memories(spark, d), 20)
    longest = fast.where("rank <= 10").select("qid", "id").join(memories(spark, d).select("id", F.length("content").alias("n")), "id")
    return Q.explain({"fast": fast, "long": A.topk(longest, "qid", "n", "id", 10)}, {"long": 0.5})


@query(f"with {BM25}, {LINKS} select x.qid, a, b, relation from link join run x on x.id = a join run y on y.id = b and y.qid = x.qid")
def r8_result_reasons(spark, d):
    return Q.result_reasons(A.bm25(asked(spark, d), memories(spark, d), 20), links(spark, d))


def deep_route(asked, vectors, mem):
    """The deep run of r9; 64 bands of 4 bits, as its cosines are low."""
    return Q.recall_deep(asked, vectors, mem, 20, 64, bands=64, bits=4)


@query()
def r9_recall(spark, d):
    """Three routes (words, windows by sign bands, vectors), fused, associated, folded."""
    mem, v, q = live(spark, d), vectors(spark, d), asked(spark, d)
    qv = v.join(q.select(F.col("qid").alias("id")), "id", "left_semi")
    runs = {"fast": Q.recall_fast(q, mem, 20, NOW), "deep": deep_route(qv, v, mem), "semantic": A.recall_semantic(qv, v, mem, 40)}
    return Q.recall(runs, {"deep": 0.8}, mem, links(spark, d), v, 10)


@query("with c as (select event_id, event_id % 5 // 4 as overlap, user_id % 4 as bridge_hits, event_id % 7 // 6 as tag_hits, case when event_id % 3 > 0 then value % 100 / 100 end as intent, case when event_id % 2 = 0 then value % 90 / 100 end as semantic from events), e as (select *, case when overlap > 0 then 'words' when bridge_hits >= 2 then 'bridge' when tag_hits > 0 then 'tags' when intent >= 0.5 then 'intent' when semantic >= 0.75 then 'semantic' else 'none' end as evidence from c) select event_id, evidence, evidence <> 'none' as keep from e")
def r11_recheck(spark, d):
    c = table(spark, d, "events").selectExpr("event_id", "event_id % 5 div 4 as overlap", "user_id % 4 as bridge_hits", "event_id % 7 div 6 as tag_hits", "case when event_id % 3 > 0 then value % 100 / 100 end as intent", "case when event_id % 2 = 0 then value % 90 / 100 end as semantic")
    return Q.recheck(c).select("event_id", "evidence", "keep")


GATE = f"""pool as (select qid, id, row_number() over (partition by qid order by id) as rank, case when qid % 2 = 0 then ((qid + id) % 100) / 100.0 end as similarity from run where id % 3 = qid % 3),
 gen as (select term from (select term, count(distinct id) as df from p group by 1), st where df >= 0.35 * docs), sp as (select * from q where term not in (select term from gen)), need as (select qid, least(count(*), 2) as need from sp group by 1),
 o as (select pool.qid, pool.id, count(distinct p.term) as overlap from pool join sp on sp.qid = pool.qid join p on p.id = pool.id and p.term = sp.term group by 1, 2),
 g as (select pool.*, memory_type = 'code_context' as code, case when overlap >= coalesce(need, 1) then 0 when similarity >= 0.55 then 1 end as route from pool join mem using (id) left join o on o.qid = pool.qid and o.id = pool.id left join need on need.qid = pool.qid where rank <= 8),
 b as (select qid, id, route, row_number() over (partition by qid order by route, case when route = 1 then code else false end, case when route = 1 then -similarity else rank end, id) as nth from g where route is not null)
 select item_id as qid, id, case route when 0 then 'words' when 1 then 'semantic' else 'weak' end as route from benchmark left join b on b.qid = item_id and nth = 1"""


@query(f"with {MEM}, {BM25}, {GATE}")
def r12_root_gate(spark, d):
    from pyspark.sql import Window as W

    run = A.bm25(asked(spark, d), memories(spark, d), 20).where("id % 3 = qid % 3")
    near = F.when(F.col("qid") % 2 == 0, (F.col("qid") + F.col("id")) % 100 / 100.0)
    pool = run.select("qid", "id", F.row_number().over(W.partitionBy("qid").orderBy("id")).alias("rank"), near.alias("similarity"))
    return Q.root_gate(asked(spark, d), pool, memories(spark, d))


@query(f"with {MEM}, c as (select user_id % 20 as state, event_id % 8 as class, count(*) as n from events group by 1, 2), dist as (select state, class, round(n / max(n) over (partition by state), 6) as score from c), r as (select id, age_minutes, label % 8 as class from mem join embeddings on vec_id = id where {NOW} - age_minutes >= 10080), m as (select state, id, score, row_number() over (partition by state order by score desc, age_minutes, id) as rank from dist join r using (class) where score >= 0.6) select * from m where rank <= 3")
def r13_state_affinity(spark, d):
    from pyspark.sql import Window as W

    n = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("state"), (F.col("event_id") % 8).alias("class")).count()
    weight = F.round(F.col("count") / F.max("count").over(W.partitionBy("state")), 6)
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 8).cast("long").alias("class"))
    return Q.state_affinity(memories(spark, d).select("id", "age_minutes").join(label, "id"), n.select("state", "class", weight.alias("weight")), NOW)


@query(f"with v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as vec from embeddings), m as (select list(a order by i) as mean from (select i, avg(vec[i]) as a from v, (select unnest(range(1, 65)) as i) group by i)), u as (select id, list_transform(range(1, 65), lambda i: vec[i] - mean[i]) as u from v, m), an as (select u as w from u where id = (select min(id) from v)), s as (select id, round(list_dot_product(u, w) / sqrt(list_dot_product(u, u)) / sqrt(list_dot_product(w, w)), 9) as score from u, an where {NOW} - id >= 10080), t as (select avg(score) as m, stddev_pop(score) as sd from s) select id, round(score, 6) as score from s, t where (score - m) / sd >= 0.35 order by score desc, id limit 3")
def r14_semantic_affinity(spark, d):
    v = vectors(spark, d)
    anchor = v.orderBy("id").head().vec
    return Q.semantic_affinity(v.withColumn("age_minutes", F.col("id")), anchor, NOW).withColumn("score", F.round("score", 6))


@query(f"with {MEM}, {LIVE}, c as (select event_id, user_id as id, case when event_id % 3 > 0 then event_id % 500 end as source from events where event_type = 'purchase'), r as (select * from c where id in (select id from live)) select event_id, 'activation' as log, id, null::bigint as source, 1 as value from r union all select event_id, 'audit', id, null, 0 from r union all select event_id, 'edge_feedback', id, source, 1 from r where source <> id")
def r17_confirm(spark, d):
    source = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 500)
    return Q.confirm(table(spark, d, "events").where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("id"), source.alias("source")), live(spark, d))


EXPAND = f"""seeds as (select qid, id, rank from run where rank <= 3), near as (select a, b, max(relation = 'stored') as stored from (select a, b, relation from link where a <> b union all select b, a, relation from link where a <> b) group by 1, 2),
 one as (select qid, id as seed, rank as seed_rank, b as id, stored, 1 as hop from seeds join near on a = id), two as (select qid, seed, seed_rank, b as id, false as stored, 2 as hop from one join near on a = one.id),
 fresh as (select * from (from one union all from two) x where not exists (select 1 from seeds s where s.qid = x.qid and s.id = x.id)), b as (select qid, id, unnest(min({{'hop': hop, 'seed_rank': seed_rank, 'seed': seed}})), max(stored) as stored from fresh group by 1, 2),
 cw as (select id, {CONTENT_WORDS} as words from mem), s as (select b.*, round(case when len(c.words) > 0 and len(e.words) > 0 then len(list_intersect(c.words, e.words)) / (len(c.words) + len(e.words) - len(list_intersect(c.words, e.words))) else 0 end, 6) as similarity from b join (select cw.* from cw join mem using (id) where privacy_level = 'global') c on c.id = b.id left join (select cw.* from cw join mem using (id) where privacy_level = 'global') e on e.id = seed),
 tn as (select *, row_number() over (partition by qid, seed order by hop, similarity, id) as turn from s), tp as (select *, row_number() over (partition by qid order by turn, seed_rank, id) as tp from tn), n as (select *, row_number() over (partition by qid, stored order by tp) as nth from tp),
 z as (select *, row_number() over (partition by qid order by case when stored and nth = 1 then least(tp, 2.5) else tp end, tp) as place from n) select qid, id, place, hop, seed, similarity from z where place <= 3"""


@query(f"with {MEM}, {BM25}, {LINKS}, {EXPAND}")
def g6_expand(spark, d):
    seen = memories(spark, d).where("privacy_level = 'global'").select("id", rules.content_words(F.col("content")).alias("words"))
    edges = links(spark, d).select("a", "b", (F.col("relation") == "stored").alias("stored"))
    return Q.expand(A.bm25(asked(spark, d), memories(spark, d), 3), edges, seen)


def nearest(vectors, width=3, least=0.3):
    """The exact width + 2 nearest rows of every row, cosine of ``least`` or more: a, b, score."""
    return V.vector_topk(vectors, vectors, width + 2).where(F.col("score") >= least).select(F.col("qid").alias("a"), F.col("id").alias("b"), "score")


@query()
def g7_explore(spark, d):
    """Walks over similar vectors from every 50th record, with the recorded relations on the way."""
    near = nearest(vectors(spark, d))
    about = memories(spark, d).select("id", rules.content_words(F.col("content")).alias("words"), (F.col("memory_type") == "code_context").alias("code"))
    liked = table(spark, d, "events").select((F.col("event_id") % 500).alias("a"), F.col("user_id").alias("b"), F.when(F.col("event_type") == "error", -1.0).otherwise(0.5).alias("adjust"))
    recorded = G.both_ways(links(spark, d).select("a", "b")).withColumn("weight", F.col("b") % 10 / 10.0)
    roots = about.where("id % 50 = 0").select("id")
    return Q.explore(near, recorded, roots, about, liked.groupBy("a", "b").agg(F.avg("adjust").alias("adjust")), 3, 3)


KEYWORD = keyword_sql("select id, content, importance, null as tag from mem", 5)


@query(rf"""with {BM25}, {MEM}, {KEYWORD}, every as (select 'words' as ranker, qid, id, rank from run where rank <= 5 union all select 'keyword', qid, id, rank from kr),
 rel as (select item_id as qid, doc_id as id from documents, benchmark where contains(documents.text, benchmark.text)),
 h as (select n.ranker, rel.qid, min(rank) as first, count(rank) as hits, count(*) as relevant from rel cross join (select distinct ranker from every) n left join every on every.ranker = n.ranker and every.qid = rel.qid and every.id = rel.id group by 1, 2)
 select ranker, qid, round(coalesce(1.0 / first, 0), 6) as rr, hits, round(hits / relevant, 6) as recall, coalesce(first, 6) as first from h""")
def p3_rankers(spark, d):
    """Rankers judged on all documents that hold an item's whole passage."""
    mem, q = memories(spark, d), asked(spark, d)
    held = containing(mem.select("id", F.col("content").alias("text")), q.select(F.col("content").alias("needle")))
    qrels = held.join(q.select("qid", F.col("content").alias("needle")), "needle").select("qid", "id")
    found = Q.evaluate_rankers({"words": A.bm25, "keyword": R.keyword_baseline}, q, mem, qrels, 5)
    return found.select("ranker", "qid", F.round("rr", 6).alias("rr"), "hits", F.round("recall", 6).alias("recall"), "first")


SAMPLE = " v1_api2 技术文档x"


@query(rf"with w as (select doc_id as id, {WORDS.replace('text', 'content')} as t from (select doc_id, concat(text, '{SAMPLE}') as content from documents where text is not null)), x as (select id, t, list_concat(flatten(list_transform(list_filter(t, lambda w: regexp_matches(w, '^[a-z0-9_-]+$') and regexp_matches(w, '[0-9]') and regexp_matches(w, '[a-z]')), lambda w: regexp_extract_all(w, '[0-9]+|[^0-9]+'))), ['技术', '术文', '文档']) as more from w) select id, array_to_string(list_sort(list_distinct(list_concat(t, more))), ' ') as terms from x")
def x2_index_terms(spark, d):
    content = F.concat("text", F.lit(SAMPLE))
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.array_join(F.array_sort(X.index_terms(content)), " ").alias("terms"))


@query(f"with {MEM}, w as (select id, {CONTENT_WORDS} as words from mem) select x.id, round(case when len(x.words) > 0 and len(y.words) > 0 then len(list_intersect(x.words, y.words)) / (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words))) else 0 end, 6) as similarity from w x join w y on y.id = x.id + 1")
def x5_word_jaccard(spark, d):
    words = memories(spark, d).select("id", rules.content_words(F.col("content")).alias("words"))
    after = words.select((F.col("id") - 1).alias("id"), F.col("words").alias("next"))
    return words.join(after, "id").select("id", F.round(X.word_jaccard(F.col("words"), F.col("next")), 6).alias("similarity"))

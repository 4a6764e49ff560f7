"""Queries on retrieval, absorbing and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import embed as M
from memlake.functions import rules
from memlake.operators import analyse as A
from memlake.operators import corpus as C
from memlake.operators import kmeans, stored_index, vector_index
from memlake.operators import report as R
from memlake.operators import write as L
from memlake.plans.common import MEM, NOW, bm25_sql, keyword_sql, query, table
from memlake.plans.corpus_queries import DISTILLED, WORDS_SQL, has, narration
from memlake.schema import marked_turns, memories
from memlake.storage import scratch

IDX = f"t as (select doc_id as id, {WORDS_SQL} as t from documents), ix as (select id, unnest(list_distinct(t)) as w from t), q as (select item_id as qid, unnest(list_distinct({WORDS_SQL})) as w from benchmark)"

DOCS = "select doc_id as id, text as content from documents"
VIEWS = "select item_id * 2 as qid, text from benchmark union all select item_id * 2 + 1, split_part(text, '. ', 1) from benchmark"


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("content"))


LIVE_ROWS = f"select id, content, importance, tag from mem where not coalesce(ttl_days > 0 and {NOW} > age_minutes + ttl_days * 1440, false)"


@query(f"with {MEM}, {keyword_sql(LIVE_ROWS, 5)} select qid, id, points, rank from kr")
def e7_keyword_baseline(spark, d):
    """With tags, without rows past their time, words found inside words too."""
    return R.keyword_baseline(asked(spark, d), memories(spark, d).withColumn("tags", F.array("tag")), 5, NOW)


@query(f"with p as (select doc_id as id, {WORDS_SQL} as ws from documents), t as (select id, len(ws) as length, unnest(ws) as term from p) select term, id, length::int as length, count(*) as tf from t group by 1, 2, 3")
def c10_postings(spark, d):
    return A.postings(memories(spark, d))


@query(f"with t as (select distinct doc_id as id, unnest({WORDS_SQL}) as term from documents) select term, count(*) as df from t group by 1")
def c10_term_stats(spark, d):
    """Of an index to which a third of the documents were appended, some of them for the second time."""
    mem = memories(spark, d)
    return A.term_stats(A.append_postings(A.postings(mem.where("id % 3 != 0")), mem.where("id % 3 != 1")))


@query(f"with {bm25_sql(DOCS, 5)} select qid, id, rank, score from run")
def r1_bm25_stored(spark, d):
    """BM25 over a stored index of three segments, the last of which brings some documents for the second time."""
    mem, root = memories(spark, d), scratch(spark, "index")
    stored_index.create(mem.where("id % 3 = 0"), root)
    stored_index.append(mem.where("id % 3 = 1"), root)
    stored_index.append(mem.where("id % 3 != 1"), root)
    return stored_index.search(asked(spark, d), root, 5)


def vectors_of(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query()
def j9_vector_index(spark, d):
    """Ids divisible by 50 against all rows, through a stored index."""
    root, v = scratch(spark, "vectors"), vectors_of(spark, d)
    vector_index.build(v, root, 64)
    return vector_index.search(v.where("id % 50 = 0"), root, 10)


@query()
def l12_kmeans(spark, d):
    """Every vector in one of 20 spherical clusters."""
    return kmeans.kmeans(vectors_of(spark, d), 20, 64)


@query(rf"""with b as (select doc_id as id, regexp_replace(text, '[\s!-/:-@\[-`{{-~]', '', 'g') as b from documents),
 g as (select id, list_sort(list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2)))) as g from b where length(b) >= 2), s as (select g, min(id) as id, len(g) as n from g group by g),
 e as (select id, n, unnest(g) as w from s), c as (select x.id as a, y.id as b, count(*) as common from e x join e y on x.w = y.w and x.id < y.id and least(x.n, y.n) >= 0.85 * greatest(x.n, y.n) - 1e-9 group by 1, 2)
 select a, b, round(common / (x.n + y.n - common), 6) as similarity from c join s x on x.id = a join s y on y.id = b where common / (x.n + y.n - common) >= 0.85""")
def j10_near_dup_char_pairs(spark, d):
    """The character form, over all documents."""
    return A.near_dup_char_pairs(memories(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query()
def j11_near_dup_pairs_lsh(spark, d):
    return A.near_dup_pairs_lsh(memories(spark, d))


@query(f"with v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as vec from embeddings), {MEM}, ok as (select id from mem where privacy_level = 'global'), c as (select q.id as qid, v.id, round(list_dot_product(q.vec, v.vec) / sqrt(list_dot_product(q.vec, q.vec)) / sqrt(list_dot_product(v.vec, v.vec)), 9) as score from v q, v where q.id % 50 = 0 and q.id <> v.id and v.id in (select id from ok)), r as (select *, row_number() over (partition by qid order by score desc, id) as rank from c) select qid, id, rank from r where rank <= 10")
def r3_recall_semantic(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return A.recall_semantic(v.where("id % 50 = 0"), v, memories(spark, d).where("privacy_level = 'global'"), 10).select("qid", "id", "rank")


CHUNKS = r"""select page_id * 100000 + unnest(range(len(c))) as id, unnest(c) as content from
 (select page_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(html, '<[^>]*>', chr(10) || chr(10), 'g'), '\n[ \t]*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as c from pages)"""


@query(f"with {bm25_sql(CHUNKS, 5)} select qid, id // 100000 as page_id, (id % 100000)::int as chunk_no, rank, score from run")
def r10_search_chunks(spark, d):
    """Chunks of all pages behind a stored index."""
    chunks = C.chunk_paragraphs(table(spark, d, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", "\n\n").alias("content")), "page_id")
    root = scratch(spark, "chunk-index")
    stored_index.create(chunks.select((F.col("page_id") * 100_000 + F.col("chunk_no")).alias("id"), "content"), root)
    found = stored_index.search(asked(spark, d), root, 5)
    return found.select("qid", F.expr("id div 100000").alias("page_id"), (F.col("id") % 100_000).cast("int").alias("chunk_no"), "rank", "score")


@query("select doc_id as id, row_number() over (order by doc_id desc) as rank from documents order by doc_id desc limit 20")
def r10_newest_chunks(spark, d):
    """Without keywords the newest chunks come first."""
    return A.newest_chunks(memories(spark, d).withColumn("at", F.col("age_minutes")), "at", 20).select("id", "rank")


CONTEXTS = "select item_id as qid, split_part(text, '. ', 1) as text from benchmark"


@query(f"""with {MEM}, old as (select id from mem where {NOW} - age_minutes >= 10080),
 one as (with {bm25_sql(DOCS, 10)} select qid, id, row_number() over (partition by qid order by points desc, id) as rank from sc where id in (select id from old)),
 two as (with {bm25_sql(DOCS, 10, CONTEXTS)} select qid, id, row_number() over (partition by qid order by points desc, id) as rank from sc where id in (select id from old)),
 f as (select qid, id, sum(round(1e9::double / (60 + rank))::bigint) as points from (select * from one where rank <= 50 union all select * from two where rank <= 50) group by 1, 2),
 n as (select qid, id, round(points / max(points) over (partition by qid), 9) as normal from f), z as (select *, row_number() over (partition by qid order by normal desc, id) as rank from n where normal >= 0.35)
 select * from z where rank <= 3""")
def r15_rediscover(spark, d):
    """Old rows for each benchmark text (trigger) and its first sentence (context)."""
    context = asked(spark, d).withColumn("content", F.element_at(F.split("content", r"\. "), 1))
    return A.rediscover(asked(spark, d), memories(spark, d), NOW, context)


@query(f"with {bm25_sql(DOCS, 5, VIEWS)}, fused as (select qid // 2 as qid, id, sum(round(1e9::double / (60 + rank))::bigint) as points from run group by 1, 2), z as (select *, row_number() over (partition by qid order by points desc, id) as rank from fused) select * from z where rank <= 5")
def r16_multi_view_recall(spark, d):
    whole = asked(spark, d).withColumn("view", F.lit(0))
    return A.multi_view_recall(whole.unionByName(whole.withColumn("view", F.lit(1)).withColumn("content", F.element_at(F.split("content", r"\. "), 1))), memories(spark, d), 5)


@query(rf"""with {DISTILLED}, j as (select d.*, case when conv_id in (select conv_id from marked where {has('content', rules.DELETION)}) then 'deletion' when {narration('sentence')} then 'narration' end as early from distilled d),
 o as (select *, regexp_replace(sentence, '[\s!-/:-@\[-`{{-~]', '', 'g') as b from j where early is null),
 g as (select *, case when length(b) < 2 then [] else list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) end as g from o),
 near as (select x.conv_id, x.turn, x.pos, x.kind from g x join g y on x.conv_id = y.conv_id and (y.turn, y.pos, y.kind) < (x.turn, x.pos, x.kind)
   where x.sentence = y.sentence or (len(x.g) > 0 and len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) >= 0.85) group by 1, 2, 3, 4),
 f as (select o.*, near.conv_id is not null as dup from o left join near on near.conv_id = o.conv_id and near.turn = o.turn and near.pos = o.pos and near.kind = o.kind),
 z as (select *, row_number() over (partition by conv_id, dup order by score desc, turn, pos, kind) as z from f),
 every as (select conv_id, turn, pos, kind, sentence, score, case when dup then 'duplicate' when z > 10 then 'over_limit' else 'kept' end as reason from z union all select conv_id, turn, pos, kind, sentence, score, early from j where early is not null)
 select conv_id, turn, pos, kind, sentence, least(round(least(greatest(4 + score, 3.0), 9.0))::int, 4) as importance, concat('session:', conv_id) as event_id, reason from every""")
def c6_absorb(spark, d):
    return C.absorb(marked_turns(spark, d), "conv_id", "turn")


@query(r"""with l as (select conv_id, arg_max(coalesce(text, ''), turn) as text, max(turn) as turn from conversations group by 1),
 f as (select *, regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g') as line from l)
 select conv_id, turn, 0 as pos, case when conv_id % 3 = 2 then null else 'decision' end as kind, case when conv_id % 3 = 0 then text else line end as item,
  concat('distilled model_declared', case when conv_id % 3 <> 2 then ' decision' else '' end, case when conv_id % 3 = 0 then concat(' supersedes:', substr(concat('turn ', turn - 1, ' of the conversation before this one'), 1, 40)) else '' end) as tags,
  case when conv_id % 3 = 2 then 'unknown_kind' when (case when conv_id % 3 = 0 then trim(text) else line end) = '' then 'empty' else 'ok' end as verdict from f
 union all select conv_id, turn, 1, 'preference', null, 'distilled model_declared preference', 'empty' from l where conv_id % 3 = 0""")
def c5_declared_items(spark, d):
    """Blocks that hold each turn's text, as JSON with what it supersedes, or its first line."""
    text = F.coalesce("text", F.lit(""))
    first, line = F.struct(F.lit("Decision").alias("type"), text.alias("content"), F.concat(F.lit("turn "), F.col("turn") - 1, F.lit(" of the conversation before this one")).alias("supersedes")), F.get(F.split(text, "\n"), F.lit(0))
    none = F.lit(None).cast("string")
    array = F.to_json(F.array(first, F.struct(F.lit("preference").alias("type"), none.alias("content"), none.alias("supersedes"))))
    block = F.when(F.col("conv_id") % 3 == 0, array).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("- decision: "), line, F.lit("\n# more: x"))).otherwise(F.concat(F.lit("gossip: "), line, F.lit("\n---\ndecision: d")))
    said = table(spark, d, "conversations").select("conv_id", "turn", F.concat(text, F.lit("\n@@memory\n"), block).alias("content"))
    return C.declared_items(said, "conv_id", "turn", "@@memory", {"decision": "decision", "preference": "preference"}).withColumn("tags", F.array_join("tags", " "))


@query(rf"""with {DISTILLED}, e as (select conv_id, sentence, min({{'turn': turn, 'pos': pos}}) as o, max(score)::int as importance, count(*) as n from distilled group by 1, 2),
 i as (select *, row_number() over (partition by conv_id order by o, sentence) as i, regexp_replace(sentence, '[\s!-/:-@\[-`{{-~]', '', 'g') as b from e),
 g as (select *, case when length(b) < 2 then [] else list_distinct(list_transform(range(1, length(b)), lambda k: substr(b, k, 2))) end as g from i),
 near as (select x.conv_id, x.i as x, y.i as y from g x join g y on x.conv_id is not distinct from y.conv_id and x.i < y.i where len(x.g) > 0 and len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) >= 0.85),
 h as (select conv_id, y, min(x) as head from near where not exists (select 1 from near z where z.conv_id is not distinct from near.conv_id and z.y = near.x) group by 1, 2),
 t as (select g.*, coalesce(h.head, g.i) as head from g left join h on h.conv_id is not distinct from g.conv_id and h.y = g.i),
 m as (select conv_id, head, max(importance) as importance, sum(n)::bigint as n from t group by 1, 2)
 select g.conv_id, g.o.turn as turn, g.o.pos as pos, g.sentence, m.importance, m.n from m join g on g.conv_id is not distinct from m.conv_id and g.i = m.head""")
def l4_dedupe_within(spark, d):
    items = C.distill(marked_turns(spark, d), "conv_id", "turn").withColumn("importance", F.col("score").cast("int"))
    return C.dedupe_within(items, "conv_id", ["turn", "pos"], "sentence", "importance")


@query()
def l16_synthesise(spark, d):
    """Groups of similar vectors with enough gain, digested from the documents of the same ids."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return L.synthesise(memories(spark, d), v, 0.4, 64, min_size=3)[0]


@query()
def l16_sources(spark, d):
    """The sources of the new rows."""
    return L.synthesise(memories(spark, d), vectors_of(spark, d), 0.4, 64, min_size=3)[1]


@query(f"""with w as (select doc_id as id, {WORDS_SQL} as t, regexp_replace(text, '[\\s!-/:-@\\[-`{{-~]', '', 'g') as b from documents), g as (select id, t, case when length(b) < 2 then [] else list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) end as g from w),
 e as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings)
 select g.id, len(g.t)::int as tokens, len(g.g)::int as pairs, round(list_dot_product(v, list_reverse(v)) / list_dot_product(v, v), 6) as cosine, array_to_string(list_sort(['你好', '好世', '世界', 'x1']), ' ') as wide from g left join e on e.id = g.id""")
def p2_sql_functions(spark, d):
    """Tokens, character pairs and cosines through SQL functions."""
    M.register_sql(spark)
    memories(spark, d).select("id", "content").createOrReplaceTempView("p2_texts")
    table(spark, d, "embeddings").select("vec_id", "embedding").createOrReplaceTempView("p2_vectors")
    return spark.sql("""select id, size(ml_tokens(content)) as tokens, size(ml_char_pairs(content)) as pairs, round(ml_cosine(embedding, reverse(embedding)), 6) as cosine, array_join(array_sort(ml_tokens('你好世界 x1')), ' ') as wide
      from p2_texts left join p2_vectors on vec_id = id""")


@query(r"select doc_id as id, length(text) % 97 as a, len(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda w: w <> ''))::int as words from documents")
def p1_p2_extensions(spark, d):
    """A stand-in model (text length) through ``embed``, and a word count through an SQL function."""
    M.register_sql(spark)
    mem = memories(spark, d)
    mem.select("id", "content").createOrReplaceTempView("p2_texts")
    vec = M.embed(mem, lambda texts: [[len(t) % 97] for t in texts]).select("id", F.col("vec")[0].cast("long").alias("a"))
    return vec.join(spark.sql("select id, size(ml_words(content)) as words from p2_texts"), "id")

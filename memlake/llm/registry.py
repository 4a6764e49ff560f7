"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, grouping, mixing, neardup, packing, quality, simple8b, spelling, tokencount, urlrules, vectors, warc
from .oracles import SPELLING, centroid_sql
from .tables import materialise, read_table, scratch_path

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
END, SEQUENCE, DIM = 2, 4096, 64


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return read_table(spark, sf_dir, "pages").select("page_id", "url").join(labels, F.col("page_id") == F.col("doc_id")).select("url", (F.col("quality") == 0).alias("blocked"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = materialise(urlrules.mine_rules(labelled_urls(spark, sf_dir)), "url-rules")
    return urlrules.judge(read_table(spark, sf_dir, "pages"), rules, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def quality_model(spark: SparkSession, documents: DataFrame, sf_dir: str) -> quality.Model | None:
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    return quality.fit(documents, labels)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    scores = quality.score(documents, quality_model(spark, documents, sf_dir))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    simple8b.write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END)
    return simple8b.read_token_files(spark, path)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return vectors.exact_topk(rows, rows.where("vec_id % 50 = 0"), 5, DIM)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END, SEQUENCE, drops_space=True, numbered=True)
    packed = packing.pack(pieces, SEQUENCE)  # with the ids; the digest is taken of what comes out
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return vectors.inverted_multi_index(rows, rows.where("vec_id % 20 = 0"), 20, DIM)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), width=4)


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.derive(warc.responses(read_table(spark, sf_dir, "pages"))), path)
    return warc.derived_rows(warc.read_warc(spark, path))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = grouping.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, 2048)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.centroid_clusters(read_table(spark, sf_dir, "embeddings"), dim=DIM)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_url_filters, op2_token_counts, op3_quality, op4_token_files, op5_exact_topk, op6_mixing, op7_packing, op8_inverted_multi_index, op9_near_dedup, op10_warc_derivatives, op11_best_fit_packing, op12_spelling_variants, op13_centroid_clusters, pipeline]
    return {f.__name__: f for f in found}


ORACLES = {
    "op5_exact_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as t from embeddings
           where embedding is not null and len(embedding) = 64 and vec_id is not null
             and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.t, c.t)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op6_mixing": r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
p as (select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) as place from d group by source),
w as (select *, ((place - 1) % 3 + 1)::bigint as weight, 3 * source_size as most from p),
o as (select *, row_number() over t as turn,
        (sum(source_size) over () - coalesce(sum(most) over (t rows between unbounded preceding and 1 preceding), 0))::hugeint as left_size,
        (sum(weight) over () - coalesce(sum(weight) over (t rows between unbounded preceding and 1 preceding), 0))::hugeint as left_weight
      from w window t as (order by most / weight, place)),
f as (select arg_min({'turn': turn, 's': left_size, 'w': left_weight}, turn) as free from o where most::hugeint * left_weight >= weight * left_size),
g as (select o.source, o.source_size, case when o.turn < f.free.turn then o.most::double else (o.weight * f.free.s)::double / f.free.w::double end as target from o, f),
r as (select *, case when source_size > 0 then target / source_size else 1.0 end as rate from g),
m as (select d.doc_id, d.size, r.source_size, r.target, r.rate, ('0x' || substr(md5(coalesce(d.doc_id::varchar, '') || ':17'), 1, 12))::bigint::double / 281474976710656.0 as u
      from d join r on d.source is not distinct from r.source)
select doc_id, size, source_size, target, ((floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) * size)::bigint as taken from m""",
    "op9_near_dedup": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g from d),
n as (select doc_id, len(g)::bigint as n_shingles, md5(array_to_string(list_sort(g), '|')) as k from s),
h as (select k, min(doc_id) as rep from n where n_shingles > 0 group by k),
e as (select s.doc_id, unnest(s.g) as x from s join h on s.doc_id = h.rep),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
b as (select a, b from l union all select b, a from l),
r as (select distinct a as doc_id, a as seen from b union select r.doc_id, b.b from r join b on r.seen = b.a),
m as (select doc_id, min(seen) as component_id from r group by 1)
select n.doc_id, n.n_shingles, coalesce(m.component_id, h.rep, n.doc_id) as component_id, n.doc_id = coalesce(m.component_id, h.rep, n.doc_id) as kept
from n left join h on n.k = h.k and n.n_shingles > 0 left join m on m.doc_id = h.rep""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLES | {"op12_spelling_variants": SPELLING, "op13_centroid_clusters": centroid_sql()}

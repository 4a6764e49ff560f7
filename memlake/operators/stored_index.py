"""A stored inverted index: postings in tables bucketed by term, in segments that appends add and merges fold.

A segment has three Parquet tables: ``postings`` (term, id, length, tf) and
``df`` (term, df), bucketed and sorted by term, and ``docs`` (id, length),
bucketed by id.  A manifest lists the segments with their numbers of documents
and words.  A search joins its words with the postings where these lie: small
query sets are broadcast by Spark's own size check, large ones are shuffled to
the buckets; the postings never move, and no text is read again.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.operators.analyse import postings, topk
from memlake.storage import delete, file_names, read_text, write_text

#: Buckets of a new index.
BUCKETS = 32


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in file_names(spark, f"{root}/manifests") if n.isdigit())


def manifest(spark: SparkSession, root: str) -> dict:
    known = _versions(spark, root)
    if not known:
        raise ValueError(f"no index at {root}")
    return json.loads(read_text(spark, f"{root}/manifests/{known[-1]}"))


def _commit(spark: SparkSession, root: str, info: dict) -> None:
    write_text(spark, f"{root}/manifests/{info['version']}", json.dumps(info))


def _name(root: str, segment: int, kind: str) -> str:
    return f"memlake_{hashlib.sha256(root.encode()).hexdigest()[:16]}_{segment}_{kind}"


def _table(spark: SparkSession, root: str, info: dict, segment: int, kind: str) -> DataFrame:
    """One table of a segment; its bucketing is declared anew where this session's catalog lacks it."""
    name, key = _name(root, segment, kind), "id" if kind == "docs" else "term"
    columns = {"postings": f"term string, id {info['id']}, length int, tf long", "df": "term string, df long", "docs": f"id {info['id']}, length int"}[kind]
    spark.sql(f"create table if not exists {name} ({columns}) using parquet clustered by ({key}) sorted by ({key}) into {info['buckets']} buckets location '{root}/segments/{segment}/{kind}'")
    return spark.table(name)


def _put(df: DataFrame, root: str, info: dict, segment: int, kind: str) -> None:
    key = "id" if kind == "docs" else "term"
    # Dealt by the bucket itself, so a bucket is one file, or several where adaptive execution splits a large one.
    dealt = df.withColumn("__bucket", F.pmod(F.hash(key), F.lit(info["buckets"]))).hint("rebalance", "__bucket").drop("__bucket")
    dealt.write.format("parquet").mode("overwrite").bucketBy(info["buckets"], key).sortBy(key).option("path", f"{root}/segments/{segment}/{kind}").saveAsTable(_name(root, segment, kind))


def _segment(found: DataFrame, lengths: DataFrame, root: str, info: dict, segment: int) -> dict:
    """Write a segment from its postings (term, id, length, tf) and documents (id, length)."""
    spark = found.sparkSession
    _put(found.select("term", "id", "length", "tf"), root, info, segment, "postings")
    held = _table(spark, root, info, segment, "postings")
    _put(held.groupBy("term").agg(F.count("*").alias("df")), root, info, segment, "df")
    _put(lengths.select("id", "length"), root, info, segment, "docs")
    total = _table(spark, root, info, segment, "docs").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return {"segment": segment, "docs": total[0], "words": total[1]}


def _lengths(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.coalesce(F.size(X.tokenize(F.col("content"))), F.lit(0)).cast("int").alias("length"))


def _every(spark: SparkSession, root: str, info: dict, kind: str) -> list[DataFrame]:
    return [_table(spark, root, info, s["segment"], kind) for s in info["segments"]]


def create(docs: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """An index of docs (id, content) at ``root``.

    Ids are not null; the first row (by content) of a repeated id counts.
    Null and empty texts have no words, but count as documents.
    """
    if _versions(docs.sparkSession, root):
        raise ValueError(f"there is an index at {root}")
    _commit(docs.sparkSession, root, {"version": 0, "buckets": buckets, "id": docs.schema["id"].dataType.simpleString(), "segments": []})
    append(docs, root)


def append(docs: DataFrame, root: str) -> int:
    """Add the documents that the index lacks, as a segment of their own; returns how many.

    A batch that dies leaves files that no manifest names, and the next one
    overwrites them.
    """
    spark, info = docs.sparkSession, manifest(docs.sparkSession, root)
    fresh = docs.where("id is not null").groupBy("id").agg(F.min("content").alias("content"))
    for held in _every(spark, root, info, "docs"):
        fresh = fresh.join(held, "id", "left_anti")
    segment = info["version"] + 1
    told = _segment(postings(fresh), _lengths(fresh), root, info, segment)
    _commit(spark, root, info | {"version": segment, "segments": [*info["segments"], *([told] if told["docs"] else [])]})
    return told["docs"]


def merge(spark: SparkSession, root: str) -> None:
    """Fold all segments into one; the old ones are deleted once the new manifest stands."""
    info = manifest(spark, root)
    if len(info["segments"]) < 2:
        return
    found, lengths = _every(spark, root, info, "postings"), _every(spark, root, info, "docs")
    for i in range(1, len(found)):
        found[0], lengths[0] = found[0].unionByName(found[i]), lengths[0].unionByName(lengths[i])
    segment = info["version"] + 1
    told = _segment(found[0], lengths[0], root, info, segment)
    _commit(spark, root, info | {"version": segment, "segments": [told]})
    for s in info["segments"]:
        for kind in ("postings", "df", "docs"):
            spark.sql(f"drop table if exists {_name(root, s['segment'], kind)}")
        delete(spark, f"{root}/segments/{s['segment']}")


def statistics(spark: SparkSession, root: str) -> tuple[int, float]:
    """Documents and their average length, from the manifest alone."""
    segments = manifest(spark, root)["segments"]
    docs = sum(s["docs"] for s in segments)
    return docs, sum(s["words"] for s in segments) / docs if docs else 0.0


def points(queries: DataFrame, root: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """qid, id, points (BM25 in millionths, as ``analyse.bm25_points``) for queries (qid, content) over the index."""
    spark, info = queries.sparkSession, manifest(queries.sparkSession, root)
    docs, average = statistics(spark, root)
    wanted = queries.select("qid", F.explode(F.array_distinct(X.tokenize(F.col("content")))).alias("term"))
    if not info["segments"]:
        return wanted.select("qid", F.lit(None).cast(info["id"]).alias("id"), F.lit(0).cast("long").alias("points")).where("false")
    terms, df = wanted.select("term").distinct(), None
    for held in _every(spark, root, info, "df"):
        part = terms.join(held, "term")
        df = part if df is None else df.unionByName(part)
    df = df.groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = wanted.join(df, "term").select("qid", "term", idf.alias("idf"))
    hits = None
    for held in _every(spark, root, info, "postings"):
        part = held.join(weighed, "term").select("qid", "id", "idf", "tf", "length")
        hits = part if hits is None else hits.unionByName(part)
    value = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average))
    return hits.groupBy("qid", "id").agg(F.sum(F.round(value * 1e6).cast("long")).alias("points"))


def search(queries: DataFrame, root: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents of each query: qid, id, rank, score; a query without words has none."""
    return topk(points(queries, root, k1, b), "qid", "points", "id", k).select("qid", "id", "rank", (F.col("points") / 1e6).alias("score"))

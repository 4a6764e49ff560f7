"""Stored indexes and k-means: equal to what they replace, over appends, merges, odd rows and restarts."""

import numpy as np
import pytest
from memlake.operators import analyse as A
from memlake.operators import kmeans as K
from memlake.operators import recall as R
from memlake.operators import stored_index as S
from memlake.operators import vector_index as VI
from memlake.operators import vectors as V
from memlake.schema import memories
from memlake.storage import scratch
from pyspark.sql import functions as F

TEXTS = ["red fox runs", "red red hen", "", None, "a fox and a hen", "你好世界 你好", "red fox runs"]


def found(df):
    return sorted((r.qid, r.id, r.rank, r.score) for r in df.collect())


def test_appends_and_a_merge_rank_like_one_pass(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, content string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "hen hen a"), (3, "你好"), (4, ""), (5, None), (6, "nothing here")], "qid long, content string")
    root = scratch(spark, "index")
    S.create(docs.where("id < 3"), root, buckets=4)
    assert S.append(docs.where("id >= 1"), root) == 4 and S.append(docs, root) == 0
    want = found(A.bm25(asked, docs.fillna({"content": ""}), 3))
    assert want and found(S.search(asked, root, 3)) == want
    assert S.statistics(spark, root) == (7, pytest.approx(18 / 7))
    S.merge(spark, root)
    for kind in ("postings", "df", "docs"):
        folder = f"{root}/segments/{S.manifest(spark, root)['segments'][0]['segment']}/{kind}"
        assert sum(n.startswith("part-") for n in S.file_names(spark, folder)) <= 4  # a file a bucket
    assert len(S.manifest(spark, root)["segments"]) == 1 and found(S.search(asked, root, 3)) == want
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("memlake_")]:
        spark.sql(f"drop table {name}")  # another session knows no tables of the index
    assert found(S.search(asked, root, 3)) == want


def test_an_index_without_documents(spark):
    root = scratch(spark, "index")
    S.create(spark.createDataFrame([], "id long, content string"), root, buckets=2)
    asked = spark.createDataFrame([(1, "red fox")], "qid long, content string")
    assert S.search(asked, root, 3).collect() == []
    assert S.append(spark.createDataFrame([(1, "red"), (None, "red"), (1, "blue")], "id long, content string"), root) == 1
    assert [r.id for r in S.search(asked.withColumn("content", F.lit("blue")), root, 3).collect()] == [1]


def test_postings_are_joined_where_they_lie(spark, sf):
    root = scratch(spark, "index")
    S.create(memories(spark, sf), root)
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("content"))
    for threshold in ("10m", "-1"):  # broadcast and sort-merge
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            plan = S.points(asked, root)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        lines = plan.split("\n")
        scans = [i for i, x in enumerate(lines) if "FileScan parquet" in x and "length" in x and "tf#" in x]
        assert scans and (threshold != "-1" or all("Bucketed: true" in lines[i] for i in scans))
        for i in scans:  # between the scan and its join there is no exchange
            depth, above = len(lines[i]) - len(lines[i].lstrip(" :+-")), []
            for x in reversed(lines[:i]):
                d = len(x) - len(x.lstrip(" :+-"))
                if d < depth:
                    depth = d
                    above.append(x)
                if "Join" in x and d <= depth:
                    break
            assert above and not any("Exchange" in x for x in above)


def plain_kmeans(x, k, rounds, seed):
    """Lloyd rounds without Spark from the same start."""
    u = K.units(x)
    centres = seed
    for _ in range(rounds):
        which = K.nearest(u, centres)[0]
        after = centres.copy()
        for c in range(len(centres)):
            if (which == c).any():
                after[c] = K.units((u[which == c] >> 10).sum(axis=0)[None].astype(float))[0]
        if (after == centres).all():
            break
        centres = after
    return K.nearest(u, centres)[0]


def test_kmeans_equals_plain_rounds_however_rows_are_dealt(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    rows = K.usable(v, 64)
    start = K.seeds(rows, 20, 64)
    assert len(start) == 20 and (K.seeds(rows.repartition(7), 20, 64) == start).all()
    local = v.orderBy("id").toPandas()
    want = plain_kmeans(np.stack(local["vec"]).astype(float), 20, 10, start)
    got = {r.id: r.cluster for r in K.kmeans(v.repartition(5), 20, 64).collect()}
    assert [got[i] for i in local["id"]] == want.tolist() and len(set(want)) > 10


def test_kmeans_finds_planted_clusters_and_skips_odd_rows(spark):
    r = np.random.default_rng(5)
    means = np.eye(6) * 10
    x = np.concatenate([m + r.normal(size=(50, 6)) for m in means])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [0.0] * 6), (903, [float("nan")] * 6), (None, [1.0] * 6), (904, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = K.kmeans(df, 6, 6).collect()
    assert len(got) == 300 and len({(q.id // 50, q.cluster) for q in got}) == 6
    assert K.kmeans(df.limit(0), 6, 6).collect() == []
    assert {q.cluster for q in K.kmeans(df.where("id = 3 or id = 4"), 6, 6).collect()} <= {0, 1}


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_vector_index_recall_and_share(spark, table):
    v = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q, root = v.where("id % 50 = 0"), scratch(spark, "vectors")
    VI.build(v, root, 64)
    exact = {(r.qid, r.id): r.score for r in V.vector_topk(q, v, 10).collect()}
    got = {(r.qid, r.id): r.score for r in VI.search(q, root, 10).collect()}
    assert len(got.keys() & exact.keys()) >= 0.9 * len(exact) and all(abs(got[k] - exact[k]) < 1e-8 for k in got.keys() & exact.keys())
    import json

    info = json.loads(VI.read_text(spark, f"{root}/cells"))
    sizes = np.array([info["sizes"].get(str(c), 0) for c in range(len(info["centres"]))])
    who, cell = VI.visits(np.stack(q.toPandas()["vec"]), np.array(info["centres"]), sizes, 0.25)
    assert sizes.sum() == info["rows"] and np.bincount(who, weights=sizes[cell]).max() < 0.3 * info["rows"]


def test_vector_index_with_share_one_is_exact_over_parts(spark, monkeypatch):
    monkeypatch.setattr(VI, "PART", 20)
    monkeypatch.setattr(VI, "GROUP", 7)
    r = np.random.default_rng(8)
    rows = [(i, x.tolist()) for i, x in enumerate(r.normal(size=(200, 5)))] + [(300 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(90)]  # a hot vector
    rows += [(7, [0.5, 0.5, 0.0, 0.0, 0.0]), (400, None), (401, [0.0] * 5), (None, [1.0] * 5), (402, [float("inf")] * 5)]
    v, root = spark.createDataFrame(rows, "id long, vec array<double>"), scratch(spark, "vectors")
    VI.build(v, root, 5, cells=9)
    q = v.where("id in (1, 7, 300, 400)").dropDuplicates(["id"])
    want = sorted((x.qid, x.rank, x.id) for x in V.vector_topk(q, v.where("id not in (402)"), 6).collect())
    assert sorted((x.qid, x.rank, x.id) for x in VI.search(q, root, 6, share=1).collect()) == want
    VI.build(v.limit(0), root, 5)
    assert VI.search(q, root, 6).collect() == []


def test_one_pass_counts_every_document_and_every_length(spark):
    """A text of asked words only, empty and null texts, and a repeated row count as the plain formula has it."""
    texts = [(1, "red fox"), (2, "red hen hen"), (3, ""), (4, None), (5, "owl sees owl"), (5, "owl sees owl"), (6, "Fox\tred fox")]
    docs = spark.createDataFrame(texts, "id long, content string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "hen red red"), (3, None), (4, "")], "qid long, content string")
    words = {(n, i): (t or "").lower().split() for n, (i, t) in enumerate(texts)}
    average = sum(len(w) for w in words.values()) / sum(t is not None for _, t in texts)
    want = {}
    for q, content in ((1, "red fox"), (2, "hen red")):
        for w in content.split():
            df = sum(w in ws for ws in words.values())
            for (_, i), ws in words.items():
                if tf := ws.count(w):
                    score = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / average))
                    want[q, i] = want.get((q, i), 0) + int(score * 1e6 + 0.5)
    assert {(r.qid, r.id): r.points for r in A.bm25_points(asked, docs).collect()} == want
    assert A.bm25_points(asked, docs.limit(0)).count() == 0 and A.bm25_points(asked.limit(0), docs).count() == 0


def test_recall_from_an_index_leaves_out_what_may_not_be_seen(spark):
    rows = [(i, t, 5, i * 60) for i, t in enumerate(["red fox", "red hen", "red fox", "blue fox runs"])]
    mem, root = spark.createDataFrame(rows, "id long, content string, importance int, age_minutes long"), scratch(spark, "recall")
    asked = spark.createDataFrame([(1, "red fox")], "qid long, content string")
    S.create(mem, root, buckets=2)
    told = lambda df: [tuple(r) for r in df.orderBy("rank").collect()]
    assert told(R.recall_fast(asked, mem, 5, 1000, index=root)) == told(R.recall_fast(asked, mem, 5, 1000))
    seen = told(R.recall_fast(asked, mem.where("id != 3"), 5, 1000, index=root))
    assert seen and 3 not in [r[1] for r in seen]

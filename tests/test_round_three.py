"""Upserts over JDBC, united sketches, filters and pages, typed indirect paths, mixed files."""

import random

import numpy as np
import pytest
from memlake.operators import analyse as A
from memlake.operators import chunks as K
from memlake.operators import corpus as C
from memlake.operators import graph as G
from memlake.operators import stats as T
from memlake.operators import store as S
from memlake.operators import write as L
from memlake.sources import files
from pyspark.sql import functions as F


@pytest.fixture
def derby(tmp_path):
    return f"jdbc:derby:{tmp_path}/db;create=true"


OPTIONS = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def held(spark, url):
    return sorted((r.id, r.content, r.seq) for r in files.jdbc_load(spark, url, "records", **OPTIONS).collect())


def test_upsert_by_key_and_again(spark, derby):
    schema = "id long, content string, seq int"
    one = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "x", 1)], schema)
    two = spark.createDataFrame([(2, "B", 5), (2, "older", 3), (3, "c", 1)], schema).repartition(3)
    assert files.jdbc_upsert(one, derby, "records", "id", **OPTIONS) == 2
    assert files.jdbc_upsert(two, derby, "records", "id", "seq", batch=1, **OPTIONS) == 2
    want = [(1, "a", 1), (2, "B", 5), (3, "c", 1)]
    assert held(spark, derby) == want
    files.jdbc_upsert(two, derby, "records", "id", "seq", **OPTIONS)
    assert held(spark, derby) == want
    assert files.jdbc_upsert(one.where("false"), derby, "records", "id", **OPTIONS) == 0


def test_a_failed_merge_changes_nothing(spark, derby):
    rows = spark.createDataFrame([(1, "a", 1)], "id long, content string, seq int")
    files.jdbc_upsert(rows, derby, "records", "id", **OPTIONS)
    with pytest.raises(Exception):
        files.jdbc_upsert(rows.withColumn("content", F.lit("z")), derby, "records", "id", statement="update {table} set nothing = 1", **OPTIONS)
    assert held(spark, derby) == [(1, "a", 1)]


def test_united_sketches_estimate_the_whole(spark):
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("v"), (F.col("id") % 7).alias("day"), F.when(F.col("id") % 2 == 0, "x").alias("w"))
    sketches = T.distinct_sketches(rows, ["day"], ["v", "w"])
    got = {r["name"]: (r.sketches, r.distinct) for r in T.united_distinct(sketches).collect()}
    assert got["w"] == (7, 1) and got["v"][0] == 7 and abs(got["v"][1] - 20_000) <= 0.03 * 20_000
    parts = T.united_distinct(sketches.where("day < 3")).unionByName(T.united_distinct(sketches.where("day >= 3")))
    assert parts.count() == 4 and {r.day: r.distinct for r in T.united_distinct(sketches, ["day"]).where("name = 'w'").collect()} == dict.fromkeys(range(7), 1)


def test_filters_by_any_tag_and_pages(spark):
    mem = spark.createDataFrame(
        [(1, "fact", "p", ["a", "b"], 5, 0, 0), (2, "fact", "p", ["c"], 9, 0, 0), (3, "fact", "q", None, 9, 0, 0), (4, "note", "p", ["a"], 7, None, 0), (5, "fact", "p", ["b", None], 5, 1, 0)],
        "id int, memory_type string, project string, tags array<string>, importance int, ttl_days int, age_minutes long",
    )
    assert [r.id for r in S.filter_records(mem, tags=["a", "b"], top_k=2).collect()] == [4, 1]
    assert {r.id for r in S.filter_records(mem, "fact", "p", ["b"], 5).collect()} == {1, 5}
    assert [(r.id, r.total, r.truncated) for r in S.list_records(mem, 10_000, "importance", limit=2, offset=1).collect()] == [(3, 4, True), (4, 4, True)]
    assert [r.id for r in S.list_records(mem, 10_000, "ttl_days", descending=False, include_expired=True, limit=9).collect()] == [1, 2, 3, 5, 4]
    assert S.list_records(mem, 10_000, limit=-1).collect() == []


def test_indirect_paths_are_not_merely_one_event(spark):
    e = spark.createDataFrame(
        [(1, 2, "same_event"), (2, 3, "same_event"), (1, 3, "same_event"), (3, 4, "shared_entity"), (2, 5, "same_event"), (1, 6, "shared_entity"), (6, 4, "cause"), (6, 4, "derived_from"), (7, 7, "cause")], "a int, b int, relation string"
    )
    got = {r.node: r for r in G.indirect_paths(e, spark.createDataFrame([(1,), (7,), (99,)], "id int")).collect()}
    assert set(got) == {4} and (got[4].paths, got[4].path, got[4].via) == (2, [1, 3, 4], "same_event → shared_entity")
    assert got[4].why == "1 and 3 (same_event), 3 and 4 (shared_entity)"
    report = G.ego_report(e.withColumn("weight", F.lit(1.0)), spark.createDataFrame([(1,)], "id int"), 50).first()
    assert (report["nodes"], report.indirect, report.truncated) == (6, 1, False) and report.direct == 8


def test_mixed_files_are_routed(spark):
    rows = [
        ("a.py", "python", "# note\ndef f(x):\n    return x\n"), ("b.md", "markdown", "lead\n# One\ntext\n## Two\nmore"), ("c.txt", "text", "User: hi\nAssistant: yes\nindeed"), ("d.txt", None, "one\ntwo\n\n  \nthree"),
        ("e.rs", "rust", "let x = 1;\n\n// nothing else"), ("f.go", "go", "func Run(a int) int {\n\treturn a\n}"), ("g.ts", "typescript", "export class A {\n  x = 1\n}"), ("h.yaml", "yaml", "k: v"), ("i.txt", "text", None), ("j.txt", "text", " \n"),
    ]
    got = K.chunk_corpus(spark.createDataFrame(rows, "path string, language string, content string")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.path, r.start_line)):
        by.setdefault(r.path, []).append((r.chunk_type, r.name, r.start_line, r.end_line))
    assert by == {
        "a.py": [("def", "f", 2, 4)], "b.md": [("section", None, 1, 1), ("section", "One", 2, 3), ("section", "Two", 4, 5)],
        "c.txt": [("turn", "User", 1, 1), ("turn", "Assistant", 2, 3)], "d.txt": [("paragraph", None, 1, 2), ("paragraph", None, 5, 5)], "e.rs": [("paragraph", None, 1, 1), ("paragraph", None, 3, 3)],
        "f.go": [("func", "Run", 1, 3)], "g.ts": [("class", "A", 1, 3)], "h.yaml": [("paragraph", None, 1, 1)],
    }


def test_synthesis_equals_plain_groups(spark):
    """Groups, gain, scope and digest worked out without Spark; the same groups give the same ids."""
    rng = np.random.default_rng(3)
    means = np.eye(8)[:4]
    x = np.concatenate([m + rng.normal(scale=0.12, size=(6, 8)) for m in means] + [rng.normal(size=(2, 8))])
    owner = lambda i: {0: (None, "global"), 1: ("u", "user"), 2: (f"v{i % 2}", "user"), 3: ("w", "user")}.get(i // 6, (None, "global"))
    mem = spark.createDataFrame([(i, f"text {i} " + "x" * 200, owner(i)[0], None, owner(i)[1]) for i in range(len(x))], "id long, content string, user_id string, session_id string, privacy_level string")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = list(range(len(x)))
    for _ in x:
        label = [min(label[j] for j in range(len(x)) if u[i] @ u[j] >= 0.6) for i in range(len(x))]
    want = {}
    for c in set(label):
        group = [i for i in range(len(x)) if label[i] == c]
        owners = {owner(i)[0] for i in group if owner(i)[1] != "global"}
        if len(group) >= 5 and len(owners) < 2:
            pairs = [u[i] @ u[j] for i in group for j in group if i < j]
            want[c] = (len(group), round(1 - sum(pairs) / len(pairs), 6), "user" if owners else "global", "\n".join(f"text {i} {'x' * 200}"[:100] for i in group[:5]), group)
    rows, sources = L.synthesise(mem, vectors, 0.6, 8)
    got = {r.cluster: r for r in rows.collect()}
    assert len(want) == 3 and {c: (r.total, round(r.gain, 6), r.level, r.digest) for c, r in got.items()} == {c: w[:4] for c, w in want.items()}
    held = {}
    for r in sources.collect():
        held.setdefault(r.id, []).append(r.source)
    assert {r.id: w[4] for c, w in want.items() for r in [got[c]]} == {i: sorted(s) for i, s in held.items()}
    again = L.synthesise(mem.repartition(3), vectors.repartition(3), 0.6, 8)[0]
    assert {r.id for r in again.collect()} == {r.id for r in got.values()} and all((r.importance, r.confidence) == (7, 0.65) for r in got.values())


def test_declared_items_name_what_they_supersede(spark):
    block = '[{"type": "decision", "content": "use B", "supersedes": "  we use A ' + "x" * 60 + '"}, {"type": "fact", "content": "c", "supersedes": " "}]'
    said = spark.createDataFrame([(1, 1, "@@m\n" + block), (None, 1, "@@m\ndecision: d")], "conv int, turn int, content string")
    got = {(r.conv, r.pos): (r["item"], r.tags) for r in C.declared_items(said, "conv", "turn", "@@m", {"decision": "decision", "fact": "fact"}).collect()}
    assert got == {
        (1, 0): ("use B", ["distilled", "model_declared", "decision", "supersedes:" + ("we use A " + "x" * 60)[:40]]), (1, 1): ("c", ["distilled", "model_declared", "fact"]), (None, 0): ("d", ["distilled", "model_declared", "decision"]),
    }


def test_character_pairs_equal_brute_force(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abcde fg") for _ in range(60)) for _ in range(12)]
    texts = [t[: r.randrange(50, 60)] + r.choice(["", "x", "yz!"]) for t in base for _ in range(8)] + ["", None, "a", "..", "ab", "ab", "a b", "的的的", "的的"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    grams = {}
    for i, t in enumerate(texts):
        bare = "".join(c for c in t or "" if not c.isspace() and not (c.isascii() and not c.isalnum()))
        grams.setdefault(frozenset(bare[k : k + 2] for k in range(len(bare) - 1)), i)
    grams.pop(frozenset())
    for t in (0.5, 0.85, 1.0):
        want = {(a, b) for x, a in grams.items() for y, b in grams.items() if a < b and len(x & y) / len(x | y) >= t}
        assert {(p.a, p.b) for p in A.near_dup_char_pairs(docs, t).collect()} == want and (want or t == 1.0)

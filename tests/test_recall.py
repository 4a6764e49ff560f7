"""Retrieval flows on small cases, and those without SQL against plain Python."""

import numpy as np
from memlake.functions import text as X
from memlake.operators import recall as Q
from memlake.plans import recall_queries, registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_index_terms_and_word_jaccard(spark):
    row = spark.createDataFrame([("abc123 技术文档 plain words here too", "")], "t string, e string").select(X.index_terms(F.col("t")).alias("t"), X.index_terms(F.col("e")).alias("e")).first()
    assert {"abc123", "abc", "123", "技术", "术文", "文档", "plain"} <= set(row.t) and row.e == []
    pairs = [([], [], 0.0), ([], ["x"], 0.0), (["x"], ["x"], 1.0), (["x", "y"], ["y", "z"], 1 / 3), (None, ["x"], 0.0)]
    got = spark.createDataFrame([p[:2] for p in pairs], "a array<string>, b array<string>").select(X.word_jaccard(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == [p[2] for p in pairs]


def test_recheck_takes_the_first_evidence(spark):
    rows = [(1, 2, 1, 0.9, 0.9), (0, 2, 1, 0.9, 0.9), (0, 1, 1, 0.9, 0.9), (0, 0, 0, 0.5, 0.9), (0, 0, 0, None, 0.75), (0, 0, 0, 0.4, 0.7), (0, 0, 0, None, None)]
    got = Q.recheck(spark.createDataFrame(rows, "overlap int, bridge_hits int, tag_hits int, intent double, semantic double")).collect()
    assert [r.evidence for r in got] == ["words", "bridge", "tags", "intent", "semantic", "none", "none"]
    assert [r.keep for r in got] == [True] * 5 + [False] * 2


def test_expand_reserves_a_seat_for_stored_edges(spark):
    edges = [(1, i, False) for i in range(10, 16)] + [(2, 20, True), (2, 21, False)]
    words = {1: ["a"], 2: ["b"], 20: ["b"], 21: ["z"], **{i: ["q", "r"] for i in range(10, 16)}}
    seeds = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid int, id int, rank int")
    contents = spark.createDataFrame(list(words.items()), "id int, words array<string>")
    got = Q.expand(seeds, spark.createDataFrame(edges, "a int, b int, stored boolean"), contents, 3).orderBy("place").collect()
    assert [r.id for r in got] == [10, 21, 20]  # 20 is the least different of its seed, yet stored
    assert Q.expand(seeds.where("false"), spark.createDataFrame(edges, "a int, b int, stored boolean"), contents, 3).count() == 0


def test_fast_recall_shows_copies_once(spark):
    mem = spark.createDataFrame([(1, "red fox", 1, 0), (2, "red fox", 9, 0), (3, "blue fox den", 1, 0)], "id int, content string, importance int, age_minutes int")
    q = spark.createDataFrame([(7, "red fox"), (8, "zebra"), (9, None)], "qid int, content string")
    assert [(r.qid, r.id, r["rank"]) for r in Q.recall_fast(q, mem, 5, 60).orderBy("rank").collect()] == [(7, 2, 1), (7, 3, 2)]


def test_gate_falls_back_to_similarity(spark):
    mem = spark.createDataFrame([(1, "alpha beta", "code_context"), (2, "gamma", "fact"), (3, "delta", "fact")], "id int, content string, memory_type string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "zeta eta"), (3, "zeta eta")], "qid int, content string")
    pool = spark.createDataFrame([(1, 1, 1, None), (2, 1, 1, 0.99), (2, 2, 2, 0.6), (3, 3, 1, 0.5)], "qid int, id int, rank int, similarity double")
    got = {r.qid: (r.id, r.route) for r in Q.root_gate(q, pool, mem, general=0.9).collect()}
    assert got == {1: (1, "words"), 2: (2, "semantic"), 3: (None, "weak")}


def test_relative_state_affinity(spark):
    states = spark.createDataFrame([("s", 0, 0.1), ("s", 1, 0.1), ("s", 2, 0.8)], "state string, class int, weight double")
    mem = spark.createDataFrame([(1, 2, 50), (2, 2, 10), (3, 0, 0), (4, 2, 99_999), (5, None, 0)], "id int, class int, age_minutes int")
    assert [r.id for r in Q.state_affinity(mem, states, 100_000, relative=True).orderBy("rank").collect()] == [2, 1]


def test_deep_recall_against_all_windows(spark):
    """At least nine in ten of the exact best rows, by any of the query's own windows, are found."""
    found = registry.queries()["r4_recall_deep"](spark, SF).collect()
    mem = {r.id for r in recall_queries.live(spark, SF).select("id").collect()}
    rows = [(r.id, np.array(r.vec, dtype=np.float64)) for r in recall_queries.windowed(spark, SF).collect() if r.id in mem and np.any(r.vec)]
    texts = [(r.qid, r.content) for r in recall_queries.asked(spark, SF).collect()]
    exact = set()
    for qid, text in texts:
        n, best = len(text), {}
        for part in {text[:160], text[max((n - 160) // 2, 0) :][:160], text[max(n - 160, 0) :]}:
            q = np.array(recall_queries.letters([part])[0], dtype=np.float32).astype(np.float64)
            for i, v in rows:
                best[i] = max(best.get(i, -1), round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 9))
        exact |= {(qid, i) for i, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10]}
    assert len(exact & {(r.qid, r.id) for r in found}) >= 0.9 * len(exact)


def walk(candidates, root, words, code, adjust, depth, width):
    pool = {}
    for a, b, s in sorted(candidates, key=lambda x: (-x[2], x[1])):
        if len(pool.setdefault(a, [])) < width + 2:
            pool[a].append((b, s))
    seen, frontier, out = {root}, [root], set()
    for level in range(1, depth + 1):
        best = {}
        for parent in sorted(frontier):
            for b, s in pool.get(parent, []):
                if b in seen or (code[b] and not code[root]):
                    continue
                hits = len(words[root] & words[b])
                s = round(s + (0.1 if hits >= 2 else -0.2 if hits == 0 else 0) + 0.3 * adjust.get((parent, b), 0), 6)
                if b not in best or s > best[b][0]:
                    best[b] = (s, parent)
        frontier = []
        for parent in {p for _, p in best.values()}:
            mine = sorted(((-s, b) for b, (s, p) in best.items() if p == parent))[:width]
            out |= {(root, level, parent, b, -s) for s, b in mine}
            frontier += [b for _, b in mine]
        seen |= set(frontier)
    return out


def test_explore_against_a_plain_walk(spark):
    rng = np.random.default_rng(5)
    edges = {(int(a), int(b)): round(float(s), 3) for a, b, s in zip(rng.integers(0, 60, 500), rng.integers(0, 60, 500), rng.random(500), strict=True) if a != b}
    candidates = [(a, b, s) for (a, b), s in edges.items()]
    words = {i: {str(x) for x in rng.integers(0, 8, 3)} for i in range(60)}
    code = {i: i % 6 == 0 for i in range(60)}
    adjust = {e: 0.5 for e in list(edges)[::7]}
    about = spark.createDataFrame([(i, sorted(words[i]), code[i]) for i in range(60)], "id int, words array<string>, code boolean")
    frame = spark.createDataFrame(candidates, "a int, b int, score double")
    liked = spark.createDataFrame([(*e, x) for e, x in adjust.items()], "a int, b int, adjust double")
    recorded = spark.createDataFrame([(i, (i + 1) % 60, 0.5) for i in range(60)] + [(3, 3, 1.0)], "a int, b int, weight double")
    got = Q.explore(frame, recorded, about.where("id in (0, 7, 13)").select("id"), about, liked, 9, 9).collect()
    recall = {(r.root, r.level, r.parent, r.id, r.score) for r in got if r.kind == "recall"}
    assert recall == set().union(*(walk(candidates, root, words, code, adjust, 4, 3) for root in (0, 7, 13)))
    nodes = {(r[0], r[3]) for r in recall} | {(0, 0), (7, 7), (13, 13)}
    assert {(r.root, r.parent, r.id) for r in got if r.kind == "recorded"} == {(root, n, (n + 1) % 60) for root, n in nodes}


def test_whole_recall_keeps_its_promises(spark):
    rows = registry.queries()["r9_recall"](spark, SF).collect()
    visible = {r.id for r in recall_queries.live(spark, SF).select("id").collect()}
    per = {}
    for r in rows:
        per.setdefault(r.qid, []).append(r)
    assert rows and {r.id for r in rows} <= visible
    for page in per.values():
        page.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in page] == list(range(1, len(page) + 1)) and len(page) <= 10
        assert page[0].normal == 1.0 and sum(r.paths == "associated" for r in page) <= 2
        assert len({r.id for r in page}) == len(page)


def test_exploring_query_runs(spark):
    assert registry.queries()["g7_explore"](spark, SF).count() > 0

"""Searches and joins that must not grow past their input: what is made once, what is no longer shuffled, and their results by brute force."""

import numpy as np
from memlake.operators import analyse as A
from memlake.operators import close_sets as C
from memlake.operators import recall as Q
from memlake.operators import report as R
from memlake.operators import substring as S
from memlake.operators import vectors as V
from memlake.operators import write as L
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def seen(spark, df, by):
    """``df`` and an accumulator that counts how often its rows are made."""
    n = spark.sparkContext.accumulator(0)

    def passed(parts):
        for p in parts:
            n.add(len(p))
            yield p

    return df.mapInPandas(passed, df.schema).where(F.col(by).isNotNull()), n


def vectors_of(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "id long, vec array<double>")


def test_explore_makes_its_candidates_once(spark):
    near, n = seen(spark, spark.createDataFrame([(a, b, 0.5 + b / 100) for a in range(6) for b in range(6) if a != b], "a long, b long, score double"), "a")
    about = spark.createDataFrame([(i, ["one", "two"], False) for i in range(6)], "id long, words array<string>, code boolean")
    none = "a long, b long, {} double"
    got = Q.explore(near, spark.createDataFrame([], none.format("weight")), about.where("id = 0").select("id"), about, spark.createDataFrame([], none.format("adjust")), 3, 2)
    assert {(r.level, r.parent, r.id) for r in got.collect()} == {(1, 0, 5), (1, 0, 4), (2, 4, 3), (2, 4, 2), (3, 2, 1)} and n.value == 30


def test_topk_in_blocks_keeps_ties_and_the_best_of_several_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "AT_ONCE", 3)
    rng = np.random.default_rng(1)
    x = rng.integers(-1, 2, (60, 4)).astype(float)  # many equal cosines, some zero vectors
    ids = [i // 2 for i in range(60)]
    unit = np.where((x == 0).all(1)[:, None], np.nan, x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None])
    best = {}
    for i, a in zip(ids, unit, strict=True):
        for j, b in zip(ids, unit, strict=True):
            if i != j and not np.isnan(s := a @ b):
                best[i, j] = max(best.get((i, j), -2), round(float(np.clip(s, -1, 1)), 9))
    want = set()
    for q in set(ids):
        ranked = sorted((-s, j) for (i, j), s in best.items() if i == q)[:4]
        want |= {(q, j, n + 1) for n, (_, j) in enumerate(ranked)}
    v = vectors_of(spark, x, ids)
    assert {(r.qid, r.id, r["rank"]) for r in V.vector_topk(v, v, 4).collect()} == want


def test_lsh_search_makes_no_row_for_a_band_or_pair(spark):
    x = np.random.default_rng(2).standard_normal((40, 8))
    v = vectors_of(spark, x, range(40))
    found = V.vector_topk_lsh(v.where("id % 5 = 0"), v, 3, 8, 6, 3)
    assert "Join" not in plan(found)
    planes = np.random.default_rng(3).standard_normal((18, 8))
    codes = ((x @ planes.T > 0).reshape(40, 6, 3) * [1, 2, 4]).sum(2)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for q in range(0, 40, 5):
        met = [j for j in range(40) if j != q and (codes[q] == codes[j]).any()]
        want |= {(q, j) for j in sorted(met, key=lambda j: -(unit[q] @ unit[j]))[:3]}
    assert {(r.qid, r.id) for r in found.collect()} == want


def test_deep_recall_embeds_each_window_once(spark):
    x = np.random.default_rng(4).standard_normal((30, 8))
    windows, n = seen(spark, vectors_of(spark, x, [i // 3 for i in range(30)]), "vec")
    asked = vectors_of(spark, x[:2] + 0.01, [-1, -1])
    got = Q.recall_deep(asked, windows, spark.range(10), 2, 8, 12, 2).collect()
    assert got[0].id == 0 and len({(r.qid, r.id) for r in got}) == len(got) == 2 and n.value == 30


def jaccard(a, b):
    return len(a & b) / len(a | b)


def near_texts(seed, n):
    """Word sets of 1 to 400 words, with copies and changed copies."""
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(n):
        if sets and rng.random() < 0.6:
            s = set(sets[rng.integers(len(sets))])
            for _ in range(int(rng.integers(0, max(2, len(s) // 2)))):
                s.discard(sorted(s)[rng.integers(len(s))]) if rng.random() < 0.5 and len(s) > 1 else s.add(f"w{rng.integers(900)}")
        else:
            s = {f"w{i}" for i in rng.integers(0, 900, int(rng.choice([1, 2, 3, 8, 30, 120, 400])))}
        sets.append(frozenset(s))
    return sets


def test_near_pairs_need_no_row_for_a_word(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARD", 7)
    sets = near_texts(5, 90)
    docs = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)] + [(900, ""), (901, None)], "id long, content string")
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    want = {(a, b): jaccard(s, r) for s, a in first.items() for r, b in first.items() if a < b and jaccard(s, r) >= 0.85}
    found = A.near_dup_pairs(docs)
    assert "Generate" not in plan(found) and want
    assert {(r.a, r.b): r.similarity for r in found.collect()} == want


def test_char_pairs_meet_by_their_sketches(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcde"), int(rng.integers(2, 60)))) for _ in range(60)]
    texts += [t[:-1] for t in texts[:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(frozenset(x + y for x, y in zip(t, t[1:], strict=False)), i)
    first.pop(frozenset(), None)
    want = {(a, b) for s, a in first.items() for r, b in first.items() if a < b and jaccard(s, r) >= 0.85}
    found = A.near_dup_char_pairs(docs)
    assert "Generate" not in plan(found) and want
    assert {(r.a, r.b) for r in found.collect()} == want


def test_best_match_needs_no_row_for_a_word_and_stays_in_its_scope(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARD", 5)
    sets = near_texts(7, 100)
    rows = [(i, " ".join(sorted(s)), [None, "u1", ""][i // 7 % 3]) for i, s in enumerate(sets)]
    docs = spark.createDataFrame(rows, "id long, content string, user_id string")
    want = {}
    for i, _, u in rows[1::2]:
        near = [(-jaccard(sets[i], sets[j]), j) for j, _, v in rows[::2] if u == v and jaccard(sets[i], sets[j]) >= 0.5]
        if near:
            want[i] = min(near)[::-1]
    found = L.best_match(docs.where("id % 2 = 1"), docs.where("id % 2 = 0"), 0.5, ["user_id"])
    assert "Generate" not in plan(found) and len(want) > 10
    assert {r.id: (r.target, -r.similarity) for r in found.collect()} == want


TEXTS = ["The Cat sat on the mat", "a  b\tcat", None, "", "concat enate", "the end", "x" * 30 + " y", "cats and the\nmat the cat"]


def test_targets_are_looked_up_without_a_row_for_a_word(spark):
    mem = spark.createDataFrame([(i, t, [None, "u1", "u2"][i % 3]) for i, t in enumerate(TEXTS * 2)], "id long, content string, user_id string")
    asked = [(None, "The c"), ("u1", "cat"), ("u2", "E\nM"), ("u2", " "), ("u1", None), (None, "x" * 20 + " Y"), ("u2", "the")]
    found = L.suppress_matching(mem, spark.createDataFrame(asked, "user_id string, target string"))
    assert "Generate" not in plan(found) and "Join" not in plan(found)
    want = {i for i, t in enumerate(TEXTS * 2) for o, n in asked if t is not None and n and n.strip() and o == [None, "u1", "u2"][i % 3] and n.lower() in t.lower()}
    assert sorted(r.id for r in found.collect()) == sorted(want) and want


def test_keyword_points_are_summed_in_the_task(spark, monkeypatch):
    monkeypatch.setattr(R, "ASKED", 2)
    tags = [["Cat", "the mat"], None, ["", None, "cat"], ["cat", "cat"]]
    rows = [(i, t, i % 4 + 1 if i else None, tags[i % 4]) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "id long, content string, importance int, tags array<string>")
    asked = {1: "the cat", 2: "Cat cat nothing", 3: " ", 4: "zzz", 5: None}
    found = R.keyword_baseline(spark.createDataFrame(list(asked.items()), "qid long, content string"), docs, 4)
    assert "Generate" not in plan(found) and "Join" not in plan(found)
    want = set()
    for q, whole in asked.items():
        points = []
        for i, t, weight, some in rows:
            n = sum(100 * (w in (t or "").lower()) + 150 * sum(w in (x or "").lower() for x in some or []) for w in (whole or "").lower().split())
            n += 400 * (whole is not None and t is not None and whole.lower() in t.lower())
            points.append((weight is None, -(n + 10 * (weight or 0)), i))
        want |= {(q, i, n + 1) for n, (_, _, i) in enumerate(sorted(points)[:4])}
    assert {(r.qid, r.id, r["rank"]) for r in found.collect()} == want


def test_passages_are_found_without_a_row_for_a_word(spark, monkeypatch):
    monkeypatch.setattr(S, "AT_ONCE", 2)
    needles = ["The Cat", "cat", "x y", " ", "", None, "the\nmat", "at", "x" * 20 + " y"]
    found = S.containing(spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert "Generate" not in plan(found) and "Join" not in plan(found)
    assert {(r.id, r.needle) for r in found.collect()} == {(i, n) for i, t in enumerate(TEXTS) for n in needles if t is not None and n and n.strip() and n in t}


def test_bm25_counts_the_words_asked_for_in_passes(spark, monkeypatch):
    monkeypatch.setattr(A, "TERMS", 2)
    texts = ["a b b c", "a", None, "c c d e", "", "x y z", "b a d"]
    asked = {1: "a b b", 2: "c q d", 3: "", 4: "z a"}
    n, words = len(texts), [None if t is None else t.split() for t in texts]
    mean = sum(len(w) for w in words if w is not None) / sum(w is not None for w in words)
    want = {}
    for q, text in asked.items():
        for i, w in enumerate(words):
            for term in set(text.split()) & set(w or []):
                df, tf = sum(term in (x or []) for x in words), w.count(term)
                value = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
                want[q, i] = want.get((q, i), 0) + round(value * 1e6)
    frame = lambda rows: spark.createDataFrame(list(rows), "n long, content string")
    found = A.bm25_points(frame(asked.items()).withColumnRenamed("n", "qid"), frame(enumerate(texts)).withColumnRenamed("n", "id"))
    assert {(r.qid, r.id): r.points for r in found.collect()} == want


def test_a_batch_is_judged_without_shuffling_texts(spark):
    rows = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b c d", "x"), (3, "a b c e", "x"), (4, "q", "x"), (5, "q", "x"), (6, "q", "y"), (7, "a b c f", None)], "id long, content string, tag string")
    judged = L.remember_batch(rows.where("id > 1"), rows.where("id = 1"), 0.5, ["tag"])
    above = [line for line in plan(judged).split("\n") if "Window" in line]
    assert above and not any("content#" in line for line in above)
    assert {tuple(r) for r in judged.collect()} == {(2, 1, "no_op"), (3, 1, "merge"), (4, None, "new"), (5, 4, "no_op"), (6, None, "new"), (7, None, "new")}

"""Candidates of g7 and the deep route of r9 against brute force over all vectors."""

import numpy as np
import pytest
from memlake.operators import recall as Q
from memlake.plans import recall_queries as P
from memlake.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def cosines(spark):
    rows = sorted(P.vectors(spark, SF).collect())
    m = np.array([r.vec for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return [r.id for r in rows], np.round(np.clip(m @ m.T, -1, 1), 9)


def best(ids, row, me, k, allowed, least=-2.0):
    found = sorted((-s, i) for i, s in zip(ids, row, strict=True) if i != me and i in allowed and s >= least)
    return [i for _, i in found[:k]]


def test_g7_walks_over_the_nearest_rows(spark, cosines, monkeypatch):
    seen = {}

    def explore(candidates, *a, **b):
        for r in candidates.collect():
            seen.setdefault(r.a, []).append((-round(r.score, 9), r.b))

    monkeypatch.setattr(Q, "explore", explore)
    registry.queries()["g7_explore"](spark, SF)
    ids, scores = cosines
    want = {me: best(ids, row, me, 5, set(ids), 0.3) for me, row in zip(ids, scores, strict=True)}
    total = sum(map(len, want.values()))
    held = sum(len(set(v) & {b for _, b in sorted(seen.get(me, []))[:5]}) for me, v in want.items())
    assert total > 100 and held == total, f"{held} of {total}"


def test_r9_deep_route_finds_most(spark, cosines, monkeypatch):
    runs = {}
    monkeypatch.setattr(Q, "recall", lambda routes, *a: runs.update(routes))
    registry.queries()["r9_recall"](spark, SF)
    found = {}
    for r in runs["deep"].collect():
        found.setdefault(r.qid, set()).add(r.id)
    ids, scores = cosines
    mem = {r.id for r in P.live(spark, SF).select("id").collect()}
    asked = {r.qid for r in P.asked(spark, SF).collect()} & set(ids)
    want = {me: best(ids, row, me, 20, mem) for me, row in zip(ids, scores, strict=True) if me in asked}
    total = sum(map(len, want.values()))
    held = sum(len(set(v) & found.get(me, set())) for me, v in want.items())
    print(f"deep {held} of {total}")
    assert total > 100 and held >= 0.98 * total, f"{held} of {total}"

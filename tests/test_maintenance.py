"""Quarantine with its observation period, and backfilling in batches."""

import datetime

from pyspark.sql import functions as F

from memlake.operators import write as L

DAY = datetime.datetime(2024, 5, 1)


def test_quarantine_moves_poor_rows_and_purges_them_after_the_observation(spark):
    mem = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "id long, content string")
    hits = spark.createDataFrame([(1, 0.1)] * 3 + [(2, 0.1)] * 2 + [(3, 0.3)] * 4, "id long, quality double")
    poor = L.quarantine(mem, hits)
    stay, moved = L.quarantine_move(mem, poor, F.lit(DAY))
    assert sorted(r["content"] for r in stay.collect()) == ["b", "c", "d"]
    assert [(r["id"], r["content"], r["hits"], r["quarantined_at"]) for r in moved.collect()] == [(1, "a", 3, DAY)]
    archive = moved.select("id", "quarantined_at").unionByName(spark.createDataFrame([(9, None)], "id long, quarantined_at timestamp"))
    after = lambda days: sorted(r["id"] for r in L.purge_observed(archive, F.lit(DAY + datetime.timedelta(days=days))).collect())
    assert after(29) == [1, 9] and after(30) == [9]


def test_backfill_batches_add_up_to_the_full_run(spark):
    rows = spark.createDataFrame([(i, "x" * i, -1, 2 if i % 3 == 0 else None) for i in (5, 1, 4, 2, 3, 6, 6)], "id long, content string, n int, derived_version int")
    derive = {"n": F.length("content")}
    seen = lambda df: sorted(map(tuple, df.select("id", "n", "derived_version").collect()))
    full = L.backfill_derived(rows, 2, derive)
    first = L.backfill_derived(rows, 2, derive, 0, 4)
    assert {i: n for i, n, _ in seen(first)} == {1: 1, 2: 2, 3: -1, 4: 4, 5: -1, 6: -1}
    assert L.backfill_progress(first, 2).first().asDict() == {"total": 7, "done": 6}
    both = L.backfill_derived(first, 2, derive, 4, 4)
    assert seen(both) == seen(full) == seen(L.backfill_derived(both, 2, derive))
    assert seen(L.backfill_derived(rows, 2, derive, 10, 5)) == seen(rows)
    assert L.backfill_derived(rows.where("false"), 2, derive, 0, 5).count() == 0

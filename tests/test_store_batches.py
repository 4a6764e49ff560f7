"""The write path over several batches: all columns, versions, ids of others, null scopes, untouched files."""

import os

import pytest
from memlake.operators import scoped_store as P
from memlake.operators import write as L
from pyspark.sql import functions as F

SCHEMA = "id int, content string, tags array<string>, scope string, user_id string, importance int, privacy_level string, created int, updated int, colour string, event_id string"


def row(i, content, user="u", scope="s", updated=1, importance=1, colour=None, tags=(), event=None):
    return (i, content, list(tags), scope, user, importance, "user", updated, updated, colour, event)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.fixture
def root(spark, tmp_path):
    rows = frame(
        spark, row(1, "alpha beta gamma delta", colour="red", tags=["a"], event="e1"), row(2, "one two three four", user="v"), row(3, "alpha beta gamma delta", user=None, scope=None)
    )
    path = f"file://{tmp_path}/store"
    P.create(rows, path, ["scope", "user_id"], buckets=16)
    return path


def held(spark, root, version=None):
    return {r.id: r for r in P.read(spark, root, version).collect()}


def test_three_batches_keep_columns_version_and_history(spark, root):
    wordings = ["alpha beta gamma delta x", "alpha beta gamma delta y", "alpha beta gamma delta z"]
    for k, text in enumerate(wordings):
        counts = P.remember(frame(spark, row(10 + k, text, updated=5 + k, importance=3 + k, colour="blue", tags=[f"t{k}"])), root, 0.5)
        assert counts.first().asDict() == {"written": 0, "merged": 1, "unchanged": 0, "failed": 0}
    got = held(spark, root)
    assert set(got) == {1, 2, 3}
    r = got[1]
    assert (r.content, r.version, r.merged, r.history) == (wordings[2], 4, 3, [wordings[1], wordings[0], "alpha beta gamma delta"])
    assert (r.colour, r.scope, r.user_id, r.importance, r.tags, r.created, r.updated, r.event_id) == ("red", "s", "u", 5, ["a", "t0", "t1", "t2"], 1, 7, "e1")
    assert (got[2].version, got[2].history, got[2].colour) == (1, [], None)


def test_history_keeps_five(spark, root):
    for k in range(7):
        P.remember(frame(spark, row(20 + k, f"alpha beta gamma delta w{k}", updated=5 + k)), root, 0.5)
    r = held(spark, root)[1]
    assert r.version == 8 and r.history == [f"alpha beta gamma delta w{k}" for k in (5, 4, 3, 2, 1)]


def test_an_id_of_another_owner_is_never_overwritten(spark, root):
    before = held(spark, root)[1]
    counts = P.remember(frame(spark, row(1, "wholly different words here", user="v"), row(2, "new words of another kind", user="u"), row(7, "seven is free", user="v")), root, 0.5)
    assert counts.first().asDict() == {"written": 1, "merged": 0, "unchanged": 0, "failed": 2}
    after = held(spark, root)
    assert after[1] == before and after[2].content == "one two three four" and after[7].user_id == "v"
    # A row that merges into its own scope may carry any id.
    assert P.remember(frame(spark, row(2, "alpha beta gamma delta more", updated=9)), root, 0.5).first()["merged"] == 1
    assert held(spark, root)[1].content == "alpha beta gamma delta more" and held(spark, root)[2].user_id == "v"


def test_null_scopes_match_each_other_only(spark, root):
    new = frame(spark, row(30, "alpha beta gamma delta", user=None, scope=None), row(31, "alpha beta gamma delta q", user="u", scope=None))
    got = {r.id: (r.outcome, r.target) for r in L.remember_batch(new, P.read(spark, root), 0.5, ["scope", "user_id"]).collect()}
    assert got == {30: ("no_op", 3), 31: ("new", None)}


def test_equal_rows_of_one_batch_and_rows_that_cannot_be_written(spark, root):
    batch = frame(
        spark, row(41, "brand new text", updated=3), row(40, "brand new text", updated=4), row(42, None), row(None, "text"), row(43, "  "), row(44, "some words", updated=1), row(44, "other words", updated=2)
    )
    assert P.remember(batch, root, 0.5).first().asDict() == {"written": 2, "merged": 0, "unchanged": 1, "failed": 4}
    assert {i: r.content for i, r in held(spark, root).items() if i > 3} == {41: "brand new text", 44: "some words"}
    assert P.remember(batch, root, 0.5).first().asDict() == {"written": 0, "merged": 0, "unchanged": 3, "failed": 4}


def test_only_met_buckets_are_written_and_versions_stay_readable(spark, root):
    first = P.manifest(spark, root)
    folder = root.removeprefix("file://")
    old = {p: os.path.getmtime(f"{d}/{p}") for d, _, names in os.walk(f"{folder}/rows/version=1") for p in names}
    P.remember(frame(spark, row(50, "five six seven", user="v", updated=4)), root, 0.5)
    second = P.manifest(spark, root)
    changed = [b for b, v in second["held"].items() if first["held"].get(b) != v]
    assert len(changed) == 1 and second["version"] == 2
    assert old == {p: os.path.getmtime(f"{d}/{p}") for d, _, names in os.walk(f"{folder}/rows/version=1") for p in names}
    assert set(held(spark, root, 1)) == {1, 2, 3} and set(held(spark, root)) == {1, 2, 3, 50}
    # Nothing new: no version.
    P.remember(frame(spark, row(51, "five six seven", user="v", updated=9)), root, 0.5)
    assert P.manifest(spark, root)["version"] == 2
    for k in range(3):
        P.remember(frame(spark, row(60 + k, f"number {k} of many", user="v", updated=4)), root, 0.9)
    assert P.vacuum(spark, root, keep=1) >= 1 and set(held(spark, root)) == {1, 2, 3, 50, 60, 61, 62}


def test_a_batch_that_dies_leaves_the_version_before(spark, root, monkeypatch):
    def no(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(P, "write_text", no)
        with pytest.raises(OSError):
            P.remember(frame(spark, row(70, "will not last", updated=4)), root, 0.5)
    assert set(held(spark, root)) == {1, 2, 3}
    assert P.remember(frame(spark, row(70, "will last", updated=4)), root, 0.5).first()["written"] == 1
    assert held(spark, root)[70].content == "will last"


def test_new_columns_of_a_batch_are_added(spark, root):
    P.remember(frame(spark, row(80, "a row with more", updated=4)).withColumn("mood", F.lit("good")), root, 0.5)
    got = held(spark, root)
    assert got[80].mood == "good" and got[1].mood is None

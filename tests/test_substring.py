"""Needles inside texts against plain search; the keyword baseline; null groups; events of any size."""

import random

from memlake.operators import analyse as A
from memlake.operators import corpus as C
from memlake.operators import report as R
from memlake.operators import write as L
from memlake.operators.substring import containing
from pyspark.sql import functions as F


def test_containing_equals_plain_search(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab c\nédß中") for _ in range(r.randint(0, 40))) for _ in range(150)] + [None, "", " ", "x" * 5000 + "needle" + "y" * 5000]
    needles = ["".join(r.choice("ab c\nédß中") for _ in range(r.randint(1, 6))) for _ in range(80)] + ["needle", "xneedley", "zzz", "", "  ", "a", "xy"]
    rows = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, "abc")], "id long, text string")
    got = {(x.id, x.needle) for x in containing(rows, spark.createDataFrame([(n,) for n in [*needles, "a"]] + [(None,)], "needle string")).collect()}
    want = {(i, n) for i, t in enumerate(texts) for n in needles if t is not None and n.strip() and n in t}
    assert want and got == want


def test_keyword_baseline_finds_part_words_tags_and_fills(spark):
    docs = spark.createDataFrame(
        [(1, "Running shoes", 1, ["sport"], 0, 0), (2, "a run", 5, None, 0, 0), (3, "nothing", 9, ["Runner", "run"], 0, 0), (4, "old run", 9, [], 0, 1), (5, None, 7, None, 0, 0), (6, "x", 8, [None, ""], 0, 0)],
        "id long, content string, importance int, tags array<string>, age_minutes long, ttl_days int",
    )
    asked = spark.createDataFrame([(1, "run run"), (2, "Running shoes"), (3, ""), (4, None)], "qid long, content string")
    got = R.keyword_baseline(asked, docs, 4, 10_000).collect()
    by = {q: [(x.id, x.points) for x in sorted(got, key=lambda x: x.rank) if x.qid == q] for q in (1, 2, 3)}
    # Twice the word: 2 x 0.15 for each of two tags; whole query only where it stands.
    assert by[1] == [(3, 690), (2, 250), (1, 210), (6, 80)]
    assert by[2] == [(1, 610), (3, 90), (6, 80), (5, 70)] and [i for i, _ in by[3]] == [3, 6, 2, 1]


def test_forgetting_stays_with_the_owner(spark):
    mem = spark.createDataFrame([(1, "u", "My Old Address is"), (2, "v", "my old address"), (3, None, "my old address"), (4, "u", None)], "id long, user_id string, content string")
    asked = spark.createDataFrame([("u", "old ADDRESS"), (None, "y old a"), ("v", " "), ("v", None)], "user_id string, target string")
    assert {r.id for r in L.suppress_matching(mem, asked).collect()} == {1, 3}


def test_items_without_a_conversation_are_kept(spark):
    rows = [(None, 1, "we decided to use it", 3), (None, 2, "we decided to use it!", 5), (1, 1, "we decided to use it", 2), (None, 3, "wholly other words", 1)]
    got = C.dedupe_within(spark.createDataFrame(rows, "conv int, pos int, t string, importance int"), "conv", ["pos"], "t", "importance").collect()
    assert {(r.conv, r.pos, r.importance, r.n) for r in got} == {(None, 1, 5, 2), (None, 3, 1, 1), (1, 1, 2, 1)}
    said = spark.createDataFrame([(None, 1, "We decided to use Rust for the core."), (None, 2, "We decided to use Rust for the core!"), (2, 1, "We decided to use Rust for the core.")], "conv int, turn int, content string")
    assert sorted((str(r.conv), r.turn, r.reason) for r in C.absorb(said, "conv", "turn").collect()) == [("2", 1, "kept"), ("None", 1, "kept"), ("None", 2, "duplicate")]
    told = said.unionByName(spark.createDataFrame([(None, 3, "@@memory\n- decision: the core is written in Rust")], said.schema))
    found = C.absorb(told, "conv", "turn", marker="@@memory", kinds={"decision": "decision"}).collect()
    assert sorted((str(r.conv), r.turn, r.reason) for r in found) == [("2", 1, "kept"), ("None", 3, "kept")]


def test_an_event_of_any_size_is_told_in_full(spark):
    rows = spark.createDataFrame([(i, 1) for i in range(50)] + [(100, 2), (101, 2), (102, None), (103, 3)], "id int, event_id int")
    got = [(r.a, r.b, r.linked_by) for r in A.same_event(rows, most=10).collect()]
    assert sorted(got) == sorted([(0, i, "first") for i in range(1, 50)] + [(100, 101, "pair")])
    members = A.event_members(rows)
    assert members.count() == 53 and members.where(F.col("first") == 0).count() == 50

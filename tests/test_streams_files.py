"""Streams over several micro-batches, and files."""

import random

import pytest
from memlake.functions.embed import embed
from memlake.sources import files
from memlake.streaming import late, pending, stateful
from memlake.streaming import operators as K
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F


def stream_of(spark, tmp_path, schema, *batches):
    """One micro-batch per list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_ttl_timer_fires_once(spark, tmp_path):
    rows = stream_of(spark, tmp_path, "id long, s long, expires_ms long", [(1, 10, 20000)], [(2, 100, 10**9)], [(3, 200, 10**9)])
    due = stateful.ttl_sweep_stream(rows.select("id", F.timestamp_seconds("s").alias("at"), "expires_ms"))
    assert [r.id for r in K.run_available(due, "ttl", "append").collect()] == [1]


def test_daily_cap_mutes_and_lifts(spark, tmp_path):
    schema = "user_id long, seq long, day string, category string, kind string"
    one = [(1, i, "d1", "a", "candidate") for i in range(5)]
    two = [(1, 5 + i, "d2", "a", "ignored") for i in range(3)] + [(1, 8, "d2", "a", "candidate"), (1, 9, "d2", "b", "candidate"), (1, 10, "d2", "a", "clicked"), (1, 11, "d2", "a", "candidate")]
    out = K.run_available(stateful.daily_cap_stream(stream_of(spark, tmp_path, schema, one, two)), "cap", "append")
    assert sorted(r.seq for r in out.collect()) == [0, 1, 2, 9, 11]


def test_activation_fades_and_caps(spark, tmp_path):
    schema = "user_id long, seq long, item string, relevance double"
    rows = K.run_available(stateful.activation_stream(stream_of(spark, tmp_path, schema, [(1, 1, "a", 0.8), (1, 2, "b", 0.5)], [(1, 3, "b", 2.0)])), "act")
    last = {r["item"]: (round(r.activation, 6), r.stable) for r in rows.where("batch_no = 1").collect()}
    assert last == {"a": (round(0.8 * 0.85 * 0.85, 6), 1), "b": (1.0, 1)}


def test_lifecycle_over_batches(spark, tmp_path):
    rows = K.lifecycle_stream(stream_of(spark, tmp_path, "id long, seq long, op string", [(1, 1, "touch"), (1, 2, "suppressed"), (2, 1, "touch")], [(1, 3, "clear"), (1, 4, "touch")]))
    got = K.latest(K.run_available(rows, "life"), ["id"]).collect()
    assert {r.id: (r.state, r.hits, r.last_hit) for r in got} == {1: ("active", 1, 4), 2: ("active", 1, 1)}


def test_scan_reads_known_kinds_only(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.py", "deep/b.md", "c.bin"):
        (tmp_path / name).write_text("x " + name)
    got = files.scan_corpus(spark, str(tmp_path)).select("language", "content").collect()
    assert sorted(map(tuple, got)) == [("markdown", "x deep/b.md"), ("python", "x a.py")]


def test_transcript_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"message":{"content":"one"}}\n\n{"message":{"content":[{"text":"two"},{"text":"three"}]}}\n{broken\nplain\n')
    got = files.read_transcripts(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.text for r in got] == ["one", "two\nthree", "{broken", "plain"]


def test_embed_survives_bad_texts(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad")
        return [[len(t)] for t in texts]

    rows = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, None), (4, "")], "id long, content string")
    assert {r.id: r.vec for r in embed(rows, model).collect()} == {1: [2.0], 2: None, 3: None, 4: [0.0]}


def test_sweep_waits_for_the_latest_time_of_an_id(spark, tmp_path):
    rows = stream_of(spark, tmp_path, "id long, s long, expires_ms long", [(1, 10, 20_000), (2, 10, 30_000), (3, 10, None)], [(1, 12, 90_000)], [(4, 60, 10**9)], [(5, 200, 10**9)])
    due = stateful.ttl_sweep_stream(rows.select("id", F.timestamp_seconds("s").alias("at"), "expires_ms"))
    assert [(r.id, r.expires_ms) for r in K.run_available(due, "ttl", "append").orderBy("batch_no").collect()] == [(2, 30_000), (1, 90_000)]


def fold(hits):
    """The working set by plain steps: strengths, stable, trail."""
    active, trail, stable = {}, [], 0
    for item, relevance in hits:
        active = {k: v * 0.85 for k, v in active.items()}
        active[item] = min(active.get(item, 0.0) + relevance, 1.0)
        active = dict(sorted(active.items(), key=lambda kv: (-kv[1], kv[0]))[:32])
        stable, trail = (stable + 1 if trail and trail[-1] == item else 0), [*trail, item][-16:]
    return {k: round(v, 9) for k, v in active.items()}, stable, trail


def test_a_restart_in_mid_stream_equals_one_run(spark, tmp_path):
    r, schema = random.Random(2), "user_id long, seq long, item string, relevance double"
    hits = [(u, k, f"i{r.randrange(60)}", r.choice([0.1, 0.5, 0.9])) for k in range(120) for u in (1, 2)]
    parts = [hits[:80], hits[80:150], hits[150:]]
    for part in parts[:2]:
        r.shuffle(part)
        stream = stateful.activation_stream(stream_of(spark, tmp_path, schema, part))
        K.run_available(stream, "act", path=f"file://{tmp_path}/out")  # ends; the next one goes on from its checkpoint
    rows = K.run_available(stateful.activation_stream(stream_of(spark, tmp_path, schema, parts[2])), "act", path=f"file://{tmp_path}/out")
    for user in (1, 2):
        mine = rows.where(F.col("user_id") == user)
        last = mine.agg(F.max("batch_no")).first()[0]
        got = mine.where(F.col("batch_no") == last).collect()
        want = fold([(h[2], h[3]) for h in sorted(hits, key=lambda h: h[1]) if h[0] == user])
        assert ({x["item"]: round(x.activation, 9) for x in got}, got[0].stable, got[0].trail) == want


def test_a_restart_keeps_the_cap_and_the_muting(spark, tmp_path):
    schema = "user_id long, seq long, day string, category string, kind string"
    one = [(1, i, "d1", "a", "candidate") for i in range(2)] + [(1, 2 + i, "d1", "b", "ignored") for i in range(3)]
    two = [(1, 6, "d1", "a", "candidate"), (1, 7, "d1", "a", "candidate"), (1, 8, "d2", "b", "candidate"), (1, 9, "d2", "a", "candidate")]
    for part in (one, two):
        out = K.run_available(stateful.daily_cap_stream(stream_of(spark, tmp_path, schema, part)), "cap", "append", path=f"file://{tmp_path}/out")
    assert sorted(r.seq for r in out.collect()) == [0, 1, 6, 9]


def test_counters_of_days_long_over_leave_the_state(spark, tmp_path):
    schema, day = "user_id long, seq long, day string, category string, kind string, s long", 86_400
    one, two = [(1, i, "d1", "a", "candidate", 10 + i) for i in range(5)], [(2, 9, "d5", "a", "candidate", 5 * day)]
    between = [(2, 9, "d5", "a", "ignored", 5 * day)]  # the timer fires after a batch's rows
    three = [(1, 10, "d1", "a", "candidate", 6 * day), (1, 11, "d1", "a", "candidate", 20)]  # the counter is gone, and a late row is dropped
    rows = stream_of(spark, tmp_path, schema, one, two, between, three).withColumn("at", F.timestamp_seconds("s"))
    out = K.run_available(stateful.daily_cap_stream(rows, "1 hour"), "cap", "append")
    assert sorted(r.seq for r in out.collect()) == [0, 1, 2, 9, 10]


def late_stream(spark, tmp_path, *batches):
    rows = stream_of(spark, tmp_path, "user_id long, s long", *batches)
    return rows.select("user_id", F.timestamp_seconds("s").alias("at"))


def test_late_rows_have_a_table_and_windows_match_the_watermark(spark, tmp_path):
    hour = 3600
    batches = [[(1, 10), (1, 5 * hour)], [(1, 20), (1, 4 * hour + 5), (2, 7 * hour)], [(1, 5 * hour + 1), (2, 6 * hour + 1), (1, None)]]
    rows, root = late_stream(spark, tmp_path, *batches), f"file://{tmp_path}/split"
    late.split_late(rows, root, "user_id", "at", "1 hour", "1 hour").awaitTermination()
    gone = {(r.user_id, r.at and int(r.at.timestamp()), r.batch_no) for r in late.late_rows(spark, root, rows.schema).collect()}
    # After batch 0 the watermark is 4:00, after batch 1 it is 6:00.
    assert gone == {(1, 20, 1), (1, 5 * hour + 1, 2), (1, None, 2)}
    kept = late.windows(spark, root, rows.schema["user_id"]).collect()
    assert sum(r["size"] for r in kept) == 5 and {(r.user_id, r.bucket.hour, r["size"], r.closed) for r in kept} == {(1, 0, 1, True), (1, 5, 1, True), (1, 4, 1, True), (2, 7, 1, False), (2, 6, 1, False)}


def test_a_batch_that_runs_again_tells_nothing_twice(spark, tmp_path, monkeypatch):
    hour, root = 3600, f"file://{tmp_path}/split"
    rows = late_stream(spark, tmp_path, [(1, 5 * hour)], [(1, 20), (1, 6 * hour)], [(1, 30)])
    real, failed = late.write_text, []

    def once(s, path, text):
        if path.endswith("/2") and not failed:
            failed.append(path)
            raise OSError("lost")
        real(s, path, text)

    monkeypatch.setattr(late, "write_text", once)
    with pytest.raises(StreamingQueryException):
        late.split_late(rows, root, "user_id", "at").awaitTermination()
    late.split_late(rows, root, "user_id", "at").awaitTermination()
    assert sorted(int(r.at.timestamp()) for r in late.late_rows(spark, root, rows.schema).collect()) == [20, 30]
    assert late.windows(spark, root, rows.schema["user_id"]).agg(F.sum("size")).first()[0] == 2


def test_a_failed_synthesis_gives_its_flag_back_and_runs_once(spark, tmp_path):
    root, calls, written = f"file://{tmp_path}/p", [], []

    def synthesise(number):
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("killed")
        written.append(number)

    rows = stream_of(spark, tmp_path, "id long", [(1,)], [(2,)], [(3,)])
    pending.ingest_and_synthesise(rows, root, lambda b, n: b.write.mode("overwrite").parquet(f"{root}/rows/{n}"), synthesise).awaitTermination()
    # The second run fails; the third covers both batches, once.
    assert calls == [0, 1, 2] and written == [0, 2] and pending.pending(spark, root) == []
    assert not pending.synthesise_pending(spark, root, synthesise) and calls == [0, 1, 2]


def test_what_a_dead_process_took_is_pending_again(spark, tmp_path):
    root = f"file://{tmp_path}/p"

    def dies(number):
        raise KeyboardInterrupt

    pending.write_text(spark, f"{root}/pending/4", "")
    with pytest.raises(KeyboardInterrupt):
        pending.synthesise_pending(spark, root, dies)
    assert pending.pending(spark, root) == []
    pending.recover(spark, root)
    got = []
    assert pending.synthesise_pending(spark, root, got.append) and got == [4] and pending.pending(spark, root) == []

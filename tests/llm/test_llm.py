"""Operators against brute force, exact round trips and held-out accuracy, with their edge cases."""

import collections
import gzip
import hashlib
import itertools
import json
import random
import re
import time
import tracemalloc
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from memlake.llm import mixing, neardup, packing, quality, registry, simple8b, tokencount, tokens, urlrules, vectors, warc
from memlake.llm import wordbatch as wb
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["a", "B", "é", " ", " ", "  ", "\n", "\t", "1", "23", "!", "'s", "Σ", "\u0301", "中", "😀", "\x1c", "\x85", "\u2003", "İ", ".", "_", "▁", "\u00a0"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, label string, size int"


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["", " ", "   a", "a   "]


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, clashing extra columns."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen"
    texts = ["", None, " ", "one", "One two", base, base.upper(), base + " x", "y " + base, " ".join(f"w{i}" for i in range(30_000)), "x" * 200_000, base, base]
    rows = [(i, t, "en", "s" if i % 2 else None, None, "k", "l", 1) for i, t in enumerate(texts)]
    rows += [(5, base, None, "t", 3, None, None, None), (5, base, None, "t", 3, None, None, None), (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_follow_words():
    texts = odd_texts(500)
    data, offsets = wb.column_bytes(pa.array(texts))
    s, e, d = wb.word_spans(data, offsets, 0, len(texts))
    words = [[x.decode() for x in re.findall(rb"[^\x20\x09-\x0d]+", t.encode())] for t in texts]
    got = collections.defaultdict(list)
    for a, b, i in zip(s, e, d, strict=True):
        got[i].append(data[a:b].tobytes().decode())
    assert [got[i] for i in range(len(texts))] == words
    names = collections.defaultdict(set)
    for h, a, b in zip(wb.hash_spans(data, s, e), s, e, strict=True):
        names[h].add(data[a:b].tobytes())
    assert max(map(len, names.values())) == 1


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_chunked_encoding_equals_the_library(name, drops):
    texts = [*odd_texts(2000), None]
    path = public_tokenizers.path(name)
    got = []
    for ids, n in tokens.ChunkEncoder(path, drops).encode(pa.array(texts)):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_simple8b_round_trip():
    r = np.random.default_rng(0)
    for t in range(60):
        n, width = int(r.integers(0, 6000)), int(r.integers(0, 64))
        ids = (r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) >> np.uint64(63 - width)
        ids[r.random(n) < 0.3] = 0
        if t % 3 == 0:
            ids = np.where(np.arange(n) % 700 < 500, 0, ids).astype(np.uint64)
        payload = simple8b.encode_segment([7, None], np.array([n, 0]), ids)
        names, counts, back = simple8b.decode_segment(payload)
        assert names == [7, None] and counts.tolist() == [n, 0] and (back == ids).all()
        for b in range(-(-n // simple8b.BLOCK)):
            assert (simple8b.decode_block(payload, b) == ids[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()


def brute_ids(rows, name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [(r.doc_id, np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")) for r in rows]


def check_token_files(rows, got):
    got, at = sorted(got, key=lambda r: r.start), 0
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = collections.Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in brute_ids(rows, "byte_bpe_50k.json"))
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_op4(spark, sf):
    check_token_files(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), registry.op4_token_files(spark, sf).collect())


def test_op4_odd_and_empty(spark, odd_documents, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for name, table in (("odd", odd_documents), ("none", none)):
        simple8b.write_token_files(table, f"file://{tmp_path}/{name}", path, 2)
        check_token_files(table.collect(), simple8b.read_token_files(spark, f"file://{tmp_path}/{name}").collect())


def check_packing(rows, got, size=4096):
    whole = collections.Counter((i, len(x)) for i, x in brute_ids(rows, "word_bpe_49k.json"))
    first = collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert first == whole
    by_doc = collections.defaultdict(list)
    for i, x in brute_ids(rows, "word_bpe_49k.json"):
        by_doc[i].append(x)
    for r in got:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in by_doc[r.doc_id])
    assert sum(r.length for r in got) == sum(n * c for (_, n), c in whole.items())
    packs = collections.defaultdict(list)
    for r in got:
        packs[r.sequence_id].append((r.offset, r.length))
    for held in packs.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(packs)


def test_op7(spark, sf):
    got = registry.op7_packing(spark, sf).collect()
    packs = check_packing(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), got)
    assert sum(r.length for r in got) / (4096 * packs) > 0.95


def test_op7_odd_and_empty(odd_documents, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    for table in (odd_documents, none):
        got = packing.pack(packing.token_pieces(table, path, 2, 4096, True).withColumn("offset", F.lit("x")), 4096)
        check_packing(table.collect(), got.withColumn("ids_crc32", F.crc32("ids")).collect())


def test_packing_rules_cover_the_histogram():
    r = random.Random(3)
    for size in (16, 64):
        histogram = {x: r.randint(1, 40) for x in range(1, size + 1) if r.random() < 0.7}
        rules = packing.plan_packs(histogram, size)
        assert rules.groupby("length")["count"].sum().to_dict() == histogram
        fill = collections.defaultdict(list)
        for length, _, count, base, offset in rules.itertuples(index=False):
            for q in range(base, base + count):
                fill[q].append((offset, length))
        for held in fill.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= size


def brute_components(rows, width, percent=80):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(i, s) for i, s in sets if i is not None and s]
    inverted = collections.defaultdict(list)
    for k, (i, s) in enumerate(named):
        common = collections.Counter(j for g in s for j in inverted[g])
        for j, c in common.items():
            if 100 * c >= percent * len(s | named[j][1]):
                a, b = find(i), find(named[j][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            inverted[g].append(k)
    return collections.Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)


def test_op9(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, registry.op9_near_dedup(spark, sf).collect())) == brute_components(rows, 4)


def test_op9_odd_and_empty(odd_documents, none):
    for table in (odd_documents, none):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        assert collections.Counter(map(tuple, neardup.near_duplicates(table, 4).collect())) == brute_components(rows, 4)


def test_op9_chain_and_star(spark):
    """A chain of edits whose ends differ, and a star whose leaves are no neighbours."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    rows, now = [], list(base)
    for i in range(40):
        rows.append((1000 - i, " ".join(now)))
        now[r.randrange(150)] = word()
    for i in range(300):
        leaf = list(base)
        for _ in range(3):
            leaf[r.randrange(150)] = word()
        rows.append((2000 + i, " ".join(leaf)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert collections.Counter(map(tuple, got.collect())) == brute_components(rows, 4)


def brute_vectors(frame, every, k, whole):
    frame = frame.dropna(subset=["vec_id"])
    x = np.stack([np.floor(256 * np.asarray(v, np.float64)) if whole else np.asarray(v, np.float64) for v in frame["embedding"]])
    ids, out = frame["vec_id"].to_numpy().astype(np.int64), []
    for p in np.flatnonzero(ids % every == 0):
        score = (x * x[p]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[p]][:k]
        out += [(int(ids[p]), n + 1, int(ids[j]), score[j]) for n, j in enumerate(order)]
    return out


def test_op5(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    frame["embedding"] = [np.asarray(v) for v in frame["embedding"]]
    assert sorted(map(tuple, registry.op5_exact_topk(spark, sf).collect())) == sorted(brute_vectors(frame, 50, 5, True))


def recall(frame, got, every, k):
    want = brute_vectors(frame, every, k, False)
    score = {(q, v): s for q, _, v, s in want}
    assert len(got) == len(want)
    for r in got:
        assert (r.query_id, r.vec_id) not in score or r.score == pytest.approx(score[r.query_id, r.vec_id])
    return sum((r.query_id, r.vec_id) in score for r in got) / len(want)


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_op8_recall(spark, table):
    """No size is searched in full: the same share of the index is visited on every table."""
    frame = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").toPandas()
    assert recall(frame, registry.op8_inverted_multi_index(spark, f"/root/testdata/{table}").collect(), 20, 20) >= 0.9


def test_op8_recall_on_many_rows(spark, monkeypatch):
    """Seeded directions without any structure, the hardest case, and over several shards."""
    monkeypatch.setattr(vectors, "SHARD", 3000)
    x = np.random.default_rng(11).normal(size=(20_000, 64)).astype(np.float32)
    frame = pd.DataFrame({"vec_id": np.arange(20_000), "embedding": list(x / np.linalg.norm(x, axis=1, keepdims=True))})
    table = spark.createDataFrame(frame.assign(embedding=[v.tolist() for v in frame["embedding"]]), "vec_id long, embedding array<float>")
    got = vectors.inverted_multi_index(table, table.where("vec_id % 100 = 0"), 20, 64).collect()
    assert recall(frame, got, 100, 20) >= 0.9


def test_op5_over_several_shards(spark, monkeypatch):
    """Shards beyond the first start at the kth score found before; hot ids are spread."""
    monkeypatch.setattr(vectors, "SHARD", 2000)
    monkeypatch.setattr(vectors, "BUNDLE", 2)
    r = np.random.default_rng(12)
    x = (r.normal(size=(9_000, 8)) * np.exp(r.normal(size=(9_000, 1)))).astype(np.float32)
    ids = np.where(np.arange(9_000) < 3_000, 50, np.arange(9_000))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True) if i % 500 == 0 or i == 50]
    got = vectors.exact_topk(table, spark.createDataFrame(asked, table.schema), 5, 8).collect()
    whole, queries = np.floor(256 * x.astype(np.float64)), {}
    for i, v in asked:
        v = np.floor(256 * np.array(v, np.float64)).tolist()
        queries[i] = min(queries.get(i, v), v)
    want = []
    for i, v in queries.items():
        score = (whole * np.array(v)).sum(1)
        best = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:5]
        want += [(i, n + 1, int(ids[j]), int(score[j])) for n, j in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_vectors_odd_and_empty(spark):
    r = np.random.default_rng(2)
    good = [(int(i), [float(x) for x in r.normal(size=4)]) for i in range(0, 120)]
    good[7] = (7, good[3][1])
    bad = [(200, None), (250, [1.0, None, 2.0, 3.0]), (300, [1.0, float("nan"), 0.0, 0.0]), (350, [float("inf"), 0.0, 0.0, 0.0]), (400, [1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(*x, "q") for x in good + bad], "vec_id long, embedding array<float>, query_id string")
    frame = pd.DataFrame({"vec_id": [i for i, _ in good], "embedding": [np.array(v, np.float32) for _, v in good]})
    got = vectors.exact_topk(table, table.where("vec_id % 50 = 0"), 5, 4)
    assert sorted(map(tuple, got.collect())) == sorted(brute_vectors(frame, 50, 5, True))
    got = vectors.inverted_multi_index(table, table.where("vec_id % 20 = 0"), 20, 4, centroids=4, share=1.0)
    want = brute_vectors(frame, 20, 20, False)
    assert sorted(map(tuple, got.collect())) == [(a, b, c, pytest.approx(d)) for a, b, c, d in sorted(want)]  # all cells visited
    again = table.union(table.where("vec_id = 40")).union(table.where("vec_id = 41"))  # repeated rows, as query and as candidates
    got = vectors.inverted_multi_index(again, again.where("vec_id % 20 = 0"), 20, 4, centroids=4, share=1.0)
    twice = [i for i in range(len(good)) for _ in range(1 + (good[i][0] in (40, 41)))]
    want = {(q, n, v) for q, n, v, _ in brute_vectors(frame.iloc[twice].reset_index(drop=True), 20, 20, False)}
    assert {(r.query_id, r.rank, r.vec_id) for r in got.collect()} == want
    empty = table.where("false")
    assert vectors.exact_topk(empty, empty, 5, 4).count() == vectors.inverted_multi_index(empty, empty, 5, 4).count() == 0
    few = table.where("vec_id < 3")
    assert vectors.exact_topk(few, few.where("vec_id = 0"), 5, 4).count() == 2


def test_traverse_visits_by_summed_distance():
    r = np.random.default_rng(4)
    for _ in range(50):
        a, b, sizes = r.normal(size=6), r.normal(size=9), r.integers(0, 5, (6, 9))
        wanted = int(r.integers(1, sizes.sum()))
        sums = (a[:, None] + b[None, :]).ravel()
        order = np.argsort(sums)
        last = order[np.searchsorted(np.cumsum(sizes.ravel()[order]), wanted)]
        assert vectors.traverse(a, b, sizes, wanted) == pytest.approx(sums[last])
        assert wanted <= sizes.ravel()[sums <= vectors.traverse(a, b, sizes, wanted, 3) + 1e-9].sum() <= wanted + 5 * 6 * 3


def test_op6(spark, sf):
    got = registry.op6_mixing(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    size = {i: len(WORD.findall(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == size and (got.taken <= 3 * got["size"]).all()
    of = dict(zip(docs.doc_id, docs.source, strict=True))
    total = collections.Counter()
    for i, n in size.items():
        total[of[i]] += n
    names = sorted(total)
    target = water_fill([total[s] for s in names], [1 + k % 3 for k in range(len(names))])
    want = dict(zip(names, target, strict=True))
    for i, t, s in zip(got.doc_id, got.target, got.source_size, strict=True):
        assert t == pytest.approx(want[of[i]]) and s == total[of[i]]


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_op6_comes_near_its_targets_and_reruns_agree(spark, table):
    """Within five standard deviations of independent draws for every source, and within 2 % over all."""
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, keep=["doc_id", "source"]).selectExpr("doc.doc_id", "doc.source", "size", "source_size", "target", "copies").toPandas()
    rate = mixed["target"] / mixed["source_size"]
    odd = rate % 1
    mixed = mixed.assign(taken=mixed["copies"] * mixed["size"], spread=mixed["size"] ** 2 * odd * (1 - odd))
    per = mixed.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), spread=("spread", "sum"))
    assert ((per["taken"] - per["target"]).abs() <= 5 * per["spread"] ** 0.5 + 1).all()
    assert abs(per["taken"].sum() / per["target"].sum() - 1) < 0.05
    again = mixing.mix(docs.repartition(7), keep=["doc_id"]).selectExpr("doc.doc_id", "copies").toPandas()
    assert dict(zip(again.doc_id, again.copies, strict=True)) == dict(zip(mixed.doc_id, mixed.copies, strict=True))


def test_mixing_stage_equals_brute_force(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("source is not null")
    rows = docs.collect()
    total = collections.Counter()
    for r in rows:
        total[r.source] += len(WORD.findall(r.text or ""))
    names = sorted(total)
    target = dict(zip(names, water_fill([total[s] for s in names], [1 + k % 3 for k in range(len(names))]), strict=True))
    want = collections.Counter()
    for r in rows:
        rate = target[r.source] / total[r.source]
        uniform = int(hashlib.md5(f"{r.doc_id}:17".encode()).hexdigest()[:12], 16) / 16**12
        want[tuple(r)] += int(rate) + (uniform < rate - int(rate))
    assert collections.Counter(map(tuple, p.mix_sources(spark, docs, sf).collect())) == +want


def test_pipeline_runs_on_empty_tables(spark, sf, tmp_path):
    import corpus_pipeline as p

    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    out = p.run(spark, f"file://{tmp_path}")
    assert out.count() == 0 and "ids" in out.columns


def water_fill(sizes, weights, cap=3):
    target, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        above = {i for i in open_ if share[i] > cap * sizes[i]}
        for i in above or open_:
            target[i] = float(cap * sizes[i]) if above else share[i]
        left -= sum(target[i] for i in above)
        open_ -= above or set(open_)
    return target


def test_op6_caps_odd_and_empty(spark, odd_documents, none):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1), ("b", 2), ("c", 3), ("d", 500), ("e", 9), (None, 4)])]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc.source: r.target for r in mixing.mix(table).collect()}
    want = water_fill([1, 2, 3, 500, 9, 4], [1, 2, 3, 1, 2, 3])
    assert [got[s] for s in ("a", "b", "c", "d", "e", None)] == pytest.approx(want)
    mixed = mixing.mix(odd_documents)
    assert mixed.count() == odd_documents.count() and mixing.mix(none).count() == 0
    assert mixing.repeat(mixed).columns == odd_documents.columns
    assert mixing.repeat(mixed).count() == mixed.agg(F.sum("copies")).first()[0]
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert [r.copies for r in mixing.mix(blank).collect()] == [1, 1]


def test_op3_held_out(spark, sf):
    got = registry.op3_quality(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert ((got.score >= 0.3).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert held[held.quality == 1].predicted.mean() > 0.98


def test_op3_odd_and_empty(odd_documents, none, spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (9, None), (None, 1), (10, 1)], "doc_id long, label int")
    model = quality.fit(odd_documents, labels)
    got = quality.score(odd_documents, model).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.fit(none, labels) is None and quality.fit(odd_documents, labels.where("false")) is None
    assert {r.score for r in quality.score(odd_documents, None).collect()} == {0.5} and quality.score(none, model).count() == 0


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def test_op1(spark, sf):
    got = {r.page_id: r for r in registry.op1_url_filters(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r, (host, path) = got[p.page_id], brute_url(p.url)
        fits = [(len(rule), what, rule) for what, rule in registry.URL_RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.partition("/")[2])]
        assert (r.host, r.path) == (host, path)
        if fits:
            assert (r.verdict, r.rule) == max(fits)[1:]
        else:
            assert r.rule is None and r.verdict in ("allow", "block")


def brute_tokens(url):
    host, path = brute_url(url)
    query = re.search(r"\?([^#]*)", url)
    keys = re.findall(r"([^&=]+)=", query[1]) if query else []
    parts = [re.sub("[0-9]+", "0", x) for x in path.split("/") if x]
    return frozenset(["scheme:" + url.split("://")[0], *("label:." + x for x in host.split(".")), *("path:" + x for x in parts), *("key:" + x for x in keys)])


def test_op1_mined_verdicts_equal_brute_force(spark, sf):
    """Every subset of every blocked page's tokens is a candidate rule here."""
    labelled = [(brute_tokens(r.url), r.blocked) for r in registry.labelled_urls(spark, sf).collect() if r.url is not None and r.blocked is not None]
    least, good = -(-len(labelled) * 2 // 1000), set()
    subsets = {frozenset(c) for t, blocked in labelled if blocked for n in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), n)}
    for rule in subsets:
        hits = [blocked for t, blocked in labelled if rule <= t]
        if sum(hits) >= least and sum(hits) >= 0.6 * len(hits):
            good.add(rule)
    assert good
    smallest = [r for r in good if not any(o < r for o in good)]
    got = {r.page_id: r for r in registry.op1_url_filters(spark, sf).collect()}
    judged = 0
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        if got[p.page_id].rule is None:
            judged += 1
            blocked = p.url is not None and any(rule <= brute_tokens(p.url) for rule in smallest)
            assert got[p.page_id].verdict == ("block" if blocked else "allow"), p.url
    assert judged > 100
    kept = {frozenset(r.antecedent): r.confidence for r in urlrules.mine_rules(registry.labelled_urls(spark, sf)).collect()}
    assert set(kept) <= good and not any(a < b and kept[a] >= kept[b] for a in kept for b in kept)


def test_op1_mines_planted_rules(spark):
    rows = [(f"https://{h}.example.com/{p}/{i}?ref=x", h == "spam" and p == "buy") for i in range(50) for h in ("spam", "good") for p in ("buy", "read")]
    rules = urlrules.mine_rules(spark.createDataFrame([*rows, (None, True), ("x", None)], "url string, blocked boolean"), 0.05, 0.9)
    strings = {tuple(r.antecedent) for r in rules.collect()}
    assert ("label:.spam", "path:buy") in strings and ("label:.spam",) not in strings
    urls = [("https://spam.example.com/buy/7?ref=x",), ("https://spam.example.com/read/7",), (None,), ("",), ("no scheme",), ("a://H.De?x/",), ("https://spam.example.com/buy/7?ref=x",)]
    pages = spark.createDataFrame([(i, *u, "k") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlrules.judge(pages, rules, [("block", "de/")]).collect()}
    assert [got[i].verdict for i in range(7)] == ["block", "allow", "allow", "allow", "allow", "allow", "block"] and got[5].host == "h.de"
    assert urlrules.judge(pages.where("false"), rules, []).count() == 0
    empty = urlrules.mine_rules(spark.createDataFrame([], "url string, blocked boolean"))
    assert {r.verdict for r in urlrules.judge(pages, empty, []).collect()} == {"allow"}


def unigram(vocabulary, byte_fallback):
    """The library's own unigram model over the same pieces."""
    vocab = [("<unk>", 0.0), *vocabulary] + ([(f"<0x{b:02X}>", -1e9) for b in range(256)] if byte_fallback else [])
    lowest = min(s for _, s in vocabulary)
    vocab = [(p, s if not p.startswith("<0x") else lowest) for p, s in vocab]
    vocab[0] = ("<unk>", lowest)
    return Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=byte_fallback))


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_counts_equal_the_library(byte_fallback):
    vocabulary = tokencount.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [*odd_texts(400), None, "the quick brown fox  jumps", "x" * 3000]
    model = unigram(vocabulary, byte_fallback)
    marked = [("▁" + t.replace(" ", "▁")) if t else "" for t in texts]
    want = [len(model.encode(t).ids) for t in marked]
    got = np.concatenate(list(tokencount.UnigramCounter(vocabulary, byte_fallback).counts(pa.array(texts)))).tolist()
    assert got == want


def test_unigram_ties():
    vocabulary = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -1.0), ("bc", -2.0), ("abc", -3.0), ("▁", 0.0)]
    model = unigram(vocabulary, False)
    for text in ("abc", "ab", "abcabc", "cab", "zzabzz"):
        got = next(tokencount.UnigramCounter(vocabulary, False).counts(pa.array([text])))
        assert got.tolist() == [len(model.encode("▁" + text).ids)]


def test_op2_equals_the_library_on_whole_texts(spark):
    vocabulary = tokencount.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = unigram(vocabulary, True)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = registry.op2_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_tokens == len(model.encode("▁" + texts[r.doc_id].replace(" ", "▁")).ids if texts[r.doc_id] else [])


def test_op2_long_words_need_no_memory():
    vocabulary = tokencount.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    counter = tokencount.UnigramCounter(vocabulary, True)
    word = "▁" + "abcdefghij中" * 30_000
    tracemalloc.start()
    counter.count(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20


def test_op2_odd_and_empty(odd_documents, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = tokencount.token_counts(odd_documents, path).collect()
    assert len(got) == odd_documents.count() and all(r.n_tokens >= 0 for r in got)
    assert tokencount.token_counts(none, path).count() == 0


def test_op10_records_round_trip(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = registry.op10_warc_derivatives(spark, sf).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        headers, block = warc.parse_record(bytes(r.record))
        assert block.decode() == r.content and len(block) == r.content_length
        assert headers["WARC-Refers-To"] == r.response_id == r.refers_to and headers["WARC-Block-Digest"] == warc.digest(block) == r.block_digest
        assert r.source_digest == warc.digest(pages[r.page_id].html.encode()) and headers["WARC-Type"] == r.record_type
        assert "text/html" in r.source_headers
        if r.record_type == "conversion":
            assert "<p>" not in r.content and "track(0)" not in r.content
    both = collections.Counter(r.concurrent_to for r in rows if r.record_type == "metadata")
    assert set(both) == {r.record_id for r in rows if r.record_type == "conversion"}


class Reader(HTMLParser):
    """An independent reading of pages: the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], None

    def handle_starttag(self, tag, attrs):
        if self.hidden is None and tag in ("script", "style", "noscript", "template"):
            self.hidden = tag
        self.out.append("\n" if tag in warc._LINES else "")

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = None
        elif self.hidden is None:
            self.out.append("\n" if tag in warc._LINES else "")

    def handle_data(self, data):
        if self.hidden is None:
            self.out.append(data)


def test_op10_text_equals_another_parser(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        reader = Reader()
        reader.feed(r.html)
        reader.close()
        lines = (re.sub(r"[^\S\n]+", " ", x).strip() for x in "".join(reader.out).split("\n"))
        assert warc.plain_text(r.html) == "\n".join(x for x in lines if x)


def test_op10_plain_text_odd_and_empty(spark):
    page = "<html lang='de'><head><title>A &amp; B</title><script>var t='</p>';</script></head><body><!-- x --><p>1 &lt; 2<br>b  c</p><a href='/q?a=1&amp;b'>l</a></body>"
    assert warc.plain_text(page) == "A & B\n1 < 2\nb c\nl"
    assert warc.page_fields(page) == [("title", "A & B"), ("language", "de"), ("outlink", "/q?a=1&b")]
    assert warc.plain_text("a < b <3 c <p>d<!-- never closed <p>e") == "a < b <3 c\nd" and warc.plain_text("x<script>y") == "x" and warc.plain_text("a <b") == "a <b"
    assert warc.plain_text("&#" + "9" * 5000 + "; &#65;") == "\ufffd A"
    table = spark.createDataFrame([(1, None, None, "c"), (None, "http://a/ b\nc", "", "c"), (2, "u", "<p", "c"), (2, "u", "<p", "c")], "page_id long, url string, html string, record_id string")
    assert warc.derive(warc.responses(table)).count() == 8 and warc.derive(warc.responses(table.where("false"))).count() == 0
    assert all(bytes(r.member)[:2] == b"\x1f\x8b" for r in warc.members(warc.derive(warc.responses(table))).collect())


def test_op10_hostile_pages_take_linear_time():
    for part in ("<script>", "<a href=", "<!--", "<", "<title>", "</p", "&#", "<a href='", "</script "):
        began = time.process_time()
        warc.read_page(part * (5_000_000 // len(part)))
        assert time.process_time() - began < 20


def test_op10_files_round_trip(spark, sf, tmp_path):
    """Responses through a WARC file give the same derivatives; files of single members and plain ones are read too."""
    odd = [(1, "http://a/", "<p>é\r\n\r\nx", "c"), (None, None, None, "c"), (3, "http://b/", "WARC/1.1\r\n\r\n\r\n\r\n", "c")]
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(60).union(spark.createDataFrame([r[:3] for r in odd], "page_id long, url string, html string"))
    rows = warc.responses(pages)
    warc.write_warc(warc.response_records(rows), f"file://{tmp_path}/responses")
    back = warc.responses_in(warc.read_warc(spark, f"file://{tmp_path}/responses"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.select(F.col("page_id").cast("long").alias("page_id"), "record_id", "target_uri", "date", "http_headers", "body").collect()), key=repr)
    want = sorted(bytes(r.record) for r in warc.derive(rows).collect())
    warc.write_warc(warc.derive(back), f"file://{tmp_path}/derived")
    assert sorted(bytes(r.record) for r in warc.read_warc(spark, f"file://{tmp_path}/derived").collect()) == want
    whole = b"".join(want)
    for data in (whole, b"".join(gzip.compress(r) for r in want), gzip.compress(whole)):
        assert list(warc.split_records(data)) == want
    for bad in (whole[:-9], gzip.compress(whole)[:-20], b"x" + whole):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.split_records(bad))
    warc.write_warc(warc.derive(rows.where("false")), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_pipeline_against_brute_force(spark, sf, odd_documents, none, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = p.keep_good(spark, docs, sf)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert all(i in kept for i, q in labels.items() if q == 1) and sum(i in kept for i, q in labels.items() if q == 0) < 0.2 * sum(q == 0 for q in labels.values())
    rows = [(r.doc_id, r.text) for r in good.collect()]
    want = {i for i, _, _, k in brute_components(rows, 5) if k}
    single = p.drop_near_copies(spark, good, sf)
    assert {r.doc_id for r in single.collect()} == want and single.columns == docs.columns
    mixed = p.mix_sources(spark, single, sf)
    assert mixed.columns == docs.columns
    check_packing(mixed.select("doc_id", "text").collect(), p.pack_sequences(spark, mixed, sf).collect())
    for table in (odd_documents, none):
        at = table
        for _, stage in p.STAGES[:-1]:
            at = stage(spark, at, sf)
            assert at.columns == table.columns
        check_packing(at.collect(), p.pack_sequences(spark, at, sf).collect())


def test_pipeline_stages_row_by_row(spark, sf, odd_documents, monkeypatch):
    """Null and repeated ids: decisions hold for rows, not for ids."""
    import corpus_pipeline as p

    text = " ".join(f"alpha{i} beta{i}" for i in range(60))
    near, other = text + " omega", " ".join(f"gamma{i} delta{i}" for i in range(60))
    rows = [(1, text), (5, text), (1, text), (5, other), (7, other + " omega"), (None, near), (None, "short"), (None, "short"), (3, ""), (3, ""), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(map(tuple, p.drop_near_copies(spark, docs, sf).collect()))
    assert got == collections.Counter([(1, text), (5, other), (None, "short"), (3, ""), (3, ""), (2, None)])

    model = quality.fit(*(spark.read.parquet(f"{sf}/{t}.parquet") if t == "documents" else spark.read.parquet(f"{sf}/{t}.parquet").withColumnRenamed("quality", "label") for t in ("documents", "labels")))
    monkeypatch.setattr(p, "quality_model", lambda *_: model)
    table = odd_documents.union(odd_documents.withColumn("doc_id", F.lit(None).cast("long"))).withColumn("score", F.lit("kept"))
    want = collections.Counter()
    for r in table.collect():
        x = np.concatenate(list(quality.pool(pa.array([r.text], pa.string()), model.table, model.vectors)))
        want[tuple(r)] += model.score(x.astype(np.float64))[0] >= 0.3
    judged = p.keep_good(spark, table, sf)
    assert collections.Counter(map(tuple, judged.collect())) == +want and judged.columns == table.columns
    assert "Exchange" not in judged._jdf.queryExecution().executedPlan().toString()


def test_queries_have_names_and_json_schemas(spark, sf):
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert json.loads(spark.read.parquet(f"{sf}/documents.parquet").schema.json())

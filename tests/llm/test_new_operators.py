"""Best-fit packing, spelling variants and centroid clusters against plain forms, with their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from memlake.llm import centroids, grouping, registry, spelling
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, part int, row string, word string, n long, length string, sequence_id string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns of clashing names."""
    base = "Straße élève ÉLÈVE colour color colours colour Überall"
    texts = ["", None, " ", "x", base, base, base + " " + base, "word " * 9000, "y" * 50_000, "中文 color 😀colour"]
    rows = [(i, t, 1, "r", "w", None, "l", "s") for i, t in enumerate(texts)]
    rows += [(4, base, None, None, None, None, None, None), (4, base, None, None, None, None, None, None), (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_match(df, sql, view, path):
    duck = duckdb.connect()
    duck.sql(f"create view {view} as select * from '{path}'")
    want = duck.sql(sql)
    got = [tuple(r[c] for c in want.columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr) and got


# Best-fit packing


def check_packing(documents, packed, size, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in documents.select("doc_id", "text").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [end]
        first = len(ids) - (math.ceil(len(ids) / size) - 1) * size
        cuts = [0, *range(first, len(ids) + 1, size)]
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[r.doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = packed.withColumn("crc", F.crc32("ids")).drop("ids").collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.crc) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= size
    return len(sequences), math.ceil(sum(r.length for r in rows) / size)


def test_packing_of_all_documents_is_nearly_least(spark, sf):
    documents = registry.read_table(spark, sf, "documents")
    used, least = check_packing(documents, grouping.pack_documents(documents, public_tokenizers.path("byte_bpe_50k.json"), 0, 2048), 2048, 0)
    assert used <= least + 1
    assert registry.op11_best_fit_packing(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_packing_over_many_districts_and_levels(spark, sf, monkeypatch):
    monkeypatch.setattr(grouping, "DISTRICT", 64)
    documents = registry.read_table(spark, sf, "documents")
    used, least = check_packing(documents, grouping.pack_documents(documents, public_tokenizers.path("byte_bpe_50k.json"), 0, 2048), 2048, 0)
    assert used <= least + 2


def test_packing_odd_and_empty(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    used, least = check_packing(odd, grouping.pack_documents(odd, path, 0, 256), 256, 0)
    assert used <= least + 1
    assert grouping.pack_documents(none, path, 0, 256).count() == 0


def test_crossover_keeps_every_piece_once():
    draw = random.Random(3)
    lengths = [draw.randint(1, 100) for _ in range(300)]
    one, other = (grouping.place_best_fit([], draw.sample(range(300), 300), lengths, 100) for _ in range(2))
    for _ in range(20):
        before = [list(x) for x in one], [list(x) for x in other]
        child = grouping.cross(one, other, lengths, 100, draw)
        assert sorted(i for held in child for i in held) == list(range(300))
        assert all(sum(lengths[i] for i in held) <= 100 for held in child)
        assert (one, other) == before
        one = child


def test_evolution_beats_best_fit_decreasing():
    hard = [51] * 6 + [27] * 6 + [26] * 6 + [23] * 12  # 51+26+23 and 27+27+23+23
    plain = grouping.place_best_fit([], list(range(len(hard))), hard, 100)
    found = grouping.evolve([plain], hard, 100, 9, "a", crossovers=200)
    assert len(plain) > 9 and len(found) == 9


def test_islands_improve_written_districts(spark):
    hard = [51] * 6 + [27] * 6 + [26] * 6 + [23] * 12
    pieces = spark.createDataFrame([(0, i, n) for i, n in enumerate(hard)], "part int, row long, length long")
    packed = grouping.pack(grouping.materialise(pieces.withColumn("name", F.col("row")), "p"), 100)
    assert packed.select("sequence_id").distinct().count() == 9 and packed.count() == 30


class Counted(list):
    """Lengths that count how often they are read."""

    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return super().__getitem__(i)


def test_a_crossover_does_not_sum_up_whole_packings():
    draw = random.Random(5)
    lengths = Counted(draw.randint(1, 100) for _ in range(2000))
    plain = grouping.place_best_fit([], list(range(2000)), lengths, 100)
    before = Counted.reads
    grouping.evolve([plain], lengths, 100, 0, "a", crossovers=0)
    began = Counted.reads
    grouping.evolve([plain], lengths, 100, 0, "a", crossovers=20)
    assert (Counted.reads - began) - (began - before) < 20 * 3 * 2000


def test_fills_stay_those_of_the_sequences():
    draw = random.Random(4)
    lengths = [draw.randint(1, 100) for _ in range(300)]
    one, other = (grouping.filled(grouping.place_best_fit([], draw.sample(range(300), 300), lengths, 100), lengths) for _ in range(2))
    for _ in range(20):
        bins, fills = one = grouping.cross_filled(one, other, lengths, 100, draw)
        assert fills == [sum(lengths[i] for i in held) for held in bins] and max(fills) <= 100
        assert sorted(i for held in bins for i in held) == list(range(300))


def test_best_fit_against_a_plain_search():
    draw = random.Random(6)
    lengths = [draw.randint(1, 100) for _ in range(300)]
    want = []
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        room = [(100 - sum(lengths[j] for j in held), b) for b, held in enumerate(want)]
        fits = [(gap, b) for gap, b in room if gap >= lengths[i]]
        if fits:
            want[min(fits)[1]].append(i)
        else:
            want.append([i])
    assert grouping.place_best_fit([], list(range(300)), lengths, 100) == want


def test_every_epoch_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(grouping, "DISTRICT", 8)
    plain, spread = grouping.materialise, []

    def noted(df, name):
        out = plain(df, name)
        if name == "islands":
            spread.append(len(out.inputFiles()))  # a file a task that had rows
        return out

    monkeypatch.setattr(grouping, "materialise", noted)
    pieces = spark.createDataFrame([(0, i, 60) for i in range(64)], "part int, row long, length long")  # never at the bound
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as at size
    try:
        packed = grouping.pack(plain(pieces, "p"), 100)
        assert packed.select("sequence_id").distinct().count() == 64
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert len(spread) >= grouping.EPOCHS and min(spread[: grouping.EPOCHS]) > 1


# Spelling variants


def brute_words(texts):
    n = collections.Counter()
    for name, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            word = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
            n[word] += len(word) >= 5
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: best[w] if best[w] and n[best[w]] >= 2 * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n)


def told(df):
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect())


def random_words(letters, n, longest, seed=5):
    r = random.Random(seed)
    found = {"".join(r.choice(letters) for _ in range(r.randint(1, longest))): r.choice([1, 2, 3, 5, 8, 21, 55]) for _ in range(n)}
    return found | {"a" * k: 3**k % 1000 + 1 for k in range(1, longest)}


@pytest.mark.parametrize("part", [1 << 15, 40])
def test_variants_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART", part)  # the small one deals most blocks into several parts
    n = random_words("abéÿ", 700, 9)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert told(spelling.variants(words)) == brute_variants(n)


def test_variants_of_very_long_words(spark):
    long = "ab" * 30_000
    n = {long: 9, long[:-1]: 4, long[:100] + "x" + long[101:]: 3, long + "aa": 50, "x" * 60_000: 3}
    got = told(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute_variants(n) and sum(r[2] for r in got) == 4


def test_whole_query_equals_sql(spark, sf):
    rows_match(registry.op12_spelling_variants(spark, sf), registry.oracle_sql()["op12_spelling_variants"], "documents", f"{sf}/documents.parquet")


def test_words_odd_and_empty(odd, none, monkeypatch):
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = brute_variants(brute_words(texts))
    assert told(spelling.spelling_variants(odd)) == want and any(r[3] for r in want)
    assert spelling.spelling_variants(none).collect() == []
    pieces = list(spelling._slices(b"abc \xc3\xa9x" * 3))
    monkeypatch.setattr(spelling, "SLICE", 4)
    cut = list(spelling._slices(b"abc \xc3\xa9x" * 3))
    runs = [x for p in cut for x in spelling._RUN.findall(p)]
    assert len(pieces) == 1 < len(cut) and runs == spelling._RUN.findall(pieces[0])


def test_damage_is_met(spark):
    texts = [(i, f"wording number{'x' * (i % 7)} letters") for i in range(400)]
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute_words(texts) and got["wording"] < 400


# Centroid clusters


def brute_clusters(rows, k=40, rounds=5, dim=64):
    kept = []
    for name, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((name, [math.floor(256 * x) for x in v]))
    named = sorted((hashlib.sha256(f"2:{name}".encode()).hexdigest(), v) for name, v in kept if name is not None)
    centres = [v for _, v in named[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        held = collections.defaultdict(list)
        for (_, v), (_, i) in zip(kept, assign(), strict=True):
            held[i].append(v)
        centres = [[sum(x) // len(held[i]) for x in zip(*held[i], strict=True)] if held[i] else c for i, c in enumerate(centres)]
    found, total = assign(), collections.Counter()
    for d, i in found:
        total[i] += d
    most = 2**63 - 1
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((name, i, min(d, most), min(total[i], most), min(sum(total.values()), most), digest[i]) for (name, _), (d, i) in zip(kept, found, strict=True)), key=repr)


def clustered(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=repr)


def test_clusters_equal_sql(spark, sf):
    rows_match(registry.op13_centroid_clusters(spark, sf), registry.oracle_sql()["op13_centroid_clusters"], "embeddings", f"{sf}/embeddings.parquet")


def test_clusters_odd_and_empty(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, [0.5, 0.5, 0.5, 0.5]), (90, None), (91, []), (92, [1.0, 2.0]), (93, [1.0, None, 0.0, 0.0]), (94, [float("nan"), 0.0, 0.0, 0.0]), (95, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(100 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(80)]  # a hot vector
    schema = "vec_id long, embedding array<double>, cluster string, distance int, id int, vec string"
    df = spark.createDataFrame([(*x, "c", None, 1, "v") for x in rows], schema).repartition(5)
    assert clustered(centroids.centroid_clusters(df, clusters=12, rounds=3, dim=4)) == brute_clusters(rows, 12, 3, 4)
    few = spark.createDataFrame([(*x, None, None, None, None) for x in rows[:3]], schema)
    assert clustered(centroids.centroid_clusters(few, clusters=12, dim=4)) == brute_clusters(rows[:3], 12, 5, 4)
    same = spark.createDataFrame([(i, [0.5] * 4, None, None, None, None) for i in range(9)], schema)
    assert {x.cluster for x in centroids.centroid_clusters(same, clusters=5, dim=4).collect()} == {0}
    assert centroids.centroid_clusters(df.limit(0), dim=4).collect() == []


def test_clusters_of_large_components(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) * 10 ** r.choice([0, 5, 9, 12]) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clustered(centroids.centroid_clusters(df, clusters=6, dim=3)) == brute_clusters(rows, 6, 5, 3)


def test_bounds_hold_and_rule_out():
    r = np.random.default_rng(4)
    centres = r.integers(-300, 300, (40, 8))
    rows = centres[r.integers(0, 40, 500)] + r.integers(-20, 20, (500, 8))
    pivots = centres[::5]
    pairs = centroids.pivot_pairs(pivots)
    cached = np.sqrt(np.stack([centroids._squared(rows, p) for p in pivots], axis=1).astype(float))
    far = np.sqrt(np.stack([centroids._squared(centres, p) for p in pivots], axis=1).astype(float))
    real = np.sqrt(((rows[:, None] - centres[None]) ** 2).sum(axis=2))
    assert (centroids.lower_bounds(cached, far, pairs) <= real).all()
    which, best, computed = centroids.nearest(rows, cached, centres, pivots, pairs)
    assert (which == real.argmin(axis=1)).all() and (best == np.rint(real.min(axis=1) ** 2)).all()
    assert computed < 0.5 * 500 * 40

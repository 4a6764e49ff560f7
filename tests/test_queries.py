"""Every registered query with SQL against DuckDB on the same tables; text functions on small cases."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest
from memlake.functions import text as X
from memlake.operators import analyse as A
from memlake.operators import store as S
from memlake.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df, sql = registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)
    assert got and got == want


def values(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_tokenize_scripts(spark):
    assert values(spark, X.tokenize, "Hello  World\nx") == ["hello", "world", "x"]
    assert values(spark, X.tokenize, "你好世界 use_it") == ["use_it", "你好", "好世", "世界"]
    assert values(spark, X.tokenize, "") == []


def test_word_bounds(spark):
    assert values(spark, lambda c: X.count_word(c, "art"), "art start art. ART") == 3
    assert values(spark, lambda c: X.count_word(c, "ab"), "abab cab") == 3


def test_small_functions(spark):
    assert values(spark, lambda c: X.detect_language(c), "src/a.TSX") == "text"
    assert values(spark, lambda c: X.detect_language(c), "src/a.tsx") == "typescript"
    assert values(spark, lambda c: X.normalise_content(c), " - a \n b ") == "a b"
    assert values(spark, lambda c: F.size(X.windows(c, 3)), "abcdefgh") == 3
    assert values(spark, lambda c: X.jaccard(X.char_bigrams(c), X.char_bigrams(F.lit("ab c!"))), "abc") == 1.0
    assert values(spark, lambda c: X.hit_decay(F.lit(60), F.lit(False)), "") == 0.25
    assert values(spark, lambda c: X.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0))), "") is None


def test_compaction_is_idempotent_on_what_is_left(spark):
    log = spark.createDataFrame([(1, 1, "upsert", "a"), (1, 2, "delete", None), (2, 1, "upsert", "b"), (1, 3, "upsert", "c"), (3, 1, "delete", None)], "id int, seq int, op string, v string")
    once = S.compact_log(log, "id", "seq", "op")
    again = S.compact_log(once.withColumn("op", F.lit("upsert")), "id", "seq", "op")
    assert sorted(once.collect()) == sorted(again.collect()) == [(1, 3, "c"), (2, 1, "b")]


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    assert {r.u: r.label for r in A.components(chain).collect()} == {**{i: 0 for i in range(101)}, 500: 500, 501: 500}


def test_round_robin_over_seeds(spark):
    rows = [("x", 0.9, 1), ("x", 0.8, 2), ("x", 0.7, 3), ("y", 0.1, 4)]
    got = S.rotate_seeds(spark.createDataFrame(rows, "seed string, score double, id int"), "seed", "score", "id", 3).collect()
    assert [r.id for r in got] == [1, 4, 2]


@pytest.mark.parametrize("name", ["g2_components", "k4_activation_stream", "l12_cluster_vectors", "a19_approx_distinct", "r10_search_chunks", "l4_dedupe_within", "l16_synthesise"])
def test_queries_without_sql_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_lsh_pairs_are_true_and_many(spark):
    q = registry.queries()
    every, found = ({(r.a, r.b) for r in q[n](spark, SF).select("a", "b").collect()} for n in ("j10_near_dup_pairs", "j11_near_dup_pairs_lsh"))
    assert found <= every and len(found) >= 0.95 * len(every)
    near, approx = ({(r.qid, r.id) for r in q[n](spark, SF).collect()} for n in ("j8_vector_topk", "j9_vector_topk_lsh"))
    assert len(near & approx) >= 0.9 * len(near)

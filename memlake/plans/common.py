"""What the query modules share: the collection of queries and SQL, and the views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from memlake.schema import CONV_SQL, EDGE_SQL, MARKED_SQL, MEM_SQL

QUERIES, SQL = {}, {}
NOW = 44640  # minutes from the first record to the as-of time
MEM, CONV, EDGE, MARKED = f"mem as ({MEM_SQL})", f"conv as ({CONV_SQL})", f"edge as ({EDGE_SQL})", f"marked as ({MARKED_SQL})"

WORDS = r"list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda w: w <> '')"


def bm25_sql(rows: str, k: int, asked: str = "select item_id as qid, text from benchmark") -> str:
    """Tables of the BM25 oracle over ``rows`` (id, content): sc has all points, run the k best of each query in ``asked`` (qid, text)."""
    return rf"""t as (select id, {WORDS.replace("text", "content")} as t from ({rows})), p as (select id, len(t) as length, unnest(t) as term from t), i as (select term, id, length, count(*) as tf from p group by all),
 q as (select qid, unnest(list_distinct({WORDS})) as term from ({asked})), f as (select term, count(*) as df from i group by term), st as (select count(*) as docs, avg(len(t)) as avgl from t),
 sc as (select q.qid, i.id, sum(round(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgl)) * 1e6)::bigint) as points from q join i on q.term = i.term join f on f.term = i.term, st group by 1, 2),
 run as (select * from (select qid, id, row_number() over (partition by qid order by points desc, id) as rank, points / 1e6 as score from sc) where rank <= {k})"""


def keyword_sql(rows: str, k: int) -> str:
    """Tables of the keyword baseline over ``rows`` (id, content, importance, tag, which may be null): every word against every row, kr the k best."""
    return rf"""kd as (select id, lower(content) as text, importance, lower(tag) as tag from ({rows})), ka as (select item_id as qid, lower(text) as whole from benchmark),
 kw as (select qid, word, count(*) as times from (select qid, unnest(list_filter(regexp_split_to_array(whole, '[ 	
]+'), lambda w: w <> '')) as word from ka) group by 1, 2),
 kx as (select qid, id, sum(times * (case when contains(text, word) then 100 else 0 end + case when contains(tag, word) then 150 else 0 end)) as n from kw, kd group by 1, 2),
 kr as (select * from (select kx.qid, kx.id, (n + case when contains(text, whole) then 400 else 0 end + 10 * importance)::bigint as points, row_number() over (partition by kx.qid order by n + case when contains(text, whole) then 400 else 0 end + 10 * importance desc, kx.id) as rank
   from kx join kd on kd.id = kx.id join ka on ka.qid = kx.qid) where rank <= {k})"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")

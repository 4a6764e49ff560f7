"""The record model, and views of the test tables in that shape (the same text in Spark and in the oracle)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-02-01 00:00:00"
#: Kinds of records and privacy levels.
MEMORY_TYPES = ("fact", "preference", "decision", "code_context", "conversation", "experience", "synthesis")
PRIVACY_LEVELS = ("session", "user", "global")


def _pick(values: tuple, key: str) -> str:
    cases = " ".join(f"when {i} then {'null' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"case {key} % {len(values)} {cases} end"


MEM_SQL = f"""select doc_id as id, text as content, source as project, {_pick(MEMORY_TYPES, "doc_id")} as memory_type,
 cast(1 + doc_id % 10 as int) as importance, {_pick((0, None, 1, 7, 30), "doc_id")} as ttl_days, doc_id as age_minutes,
 {_pick((None, "u1", "u2"), "floor(doc_id / 3)")} as user_id, case when doc_id % 4 = 0 then concat('s', cast(doc_id % 8 as varchar(9))) end as session_id,
 {_pick(PRIVACY_LEVELS, "doc_id")} as privacy_level, lang as tag from documents"""
CONV_SQL = "select conv_id * 1000 + turn as id, conv_id as event_id, turn, role, text as content from conversations"
#: Turns with a phrase in front, so that the distilling rules have something to find.
MARKED_SQL = """select conv_id * 1000 + turn as id, conv_id, turn, concat(case (conv_id + turn) % 8 when 0 then 'We decided to use ' when 1 then 'You must never ' when 2 then 'I prefer ' when 3 then case when conv_id % 2 = 0 then 'Therefore ' else '- 约束： ' end
 when 4 then 'trace follows\nerror: at `src/main.rs` ' when 5 then '我平时用 Vim，这次改用 ' when 6 then 'why? how? no! please forget ' else '| a | b |\n' end, text, case when conv_id % 9 = 0 and turn = 1 then '\n\n已忘记' else '' end) as content from conversations"""
EDGE_SQL = "select distinct l_orderkey as a, 10000000 + l_partkey as b from lineitem"


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "documents")
    return spark.sql(MEM_SQL)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "conversations")
    return spark.sql(CONV_SQL)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return spark.sql(EDGE_SQL)


def marked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "conversations")
    return spark.sql(MARKED_SQL)

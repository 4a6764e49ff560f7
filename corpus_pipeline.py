"""A training corpus from the document table: good texts, without near copies, mixed and packed.

Each stage takes what the one before kept; ``run`` writes every stage as
Parquet in the shared folder and reads it again.  Nothing here, nor in the
operators, hides a failing import.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import mixing, neardup, packing, quality
from memlake.llm.registry import END, SEQUENCE, quality_model
from memlake.llm.tables import materialise, read_table, release, release_since, written

#: A random-indexing model and a tokeniser have no SQL form; tests hold ``run`` against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a quality score of 0.3 or more.

    Every row is judged by its own text and filtered where it lies: null and
    repeated ids need no care, equal rows share their fate, an empty or null
    text gets the model's answer for empty texts.  An empty table, or one
    without labels, keeps all it has.  Columns of any name pass through.
    """
    model = quality_model(spark, docs, sf_dir)
    return quality.with_score(docs, model, name="__score").where("__score >= 0.3").drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity 0.8): that of the smallest id.

    Rows are told apart by a number of their own, so ids may repeat or be
    null (a null id counts as the largest; among equal ids the first row
    stays).  Exact repeats of a row are copies like others.  Rows without
    words are copies of nothing and all stay.
    """
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = neardup.near_duplicates(rows, id_col="__row")
    named = rows.select("__row", "doc_id").join(found.select(F.col("doc_id").alias("__row"), "component_id"), "__row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    kept = named.groupBy("component_id").agg(F.min_by("__row", order).alias("__row")).select("__row")
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says (``mixing.mix``).

    Rows that repeat an id get equal numbers of copies; a null source is a
    source of its own, a null or empty text has no words and is taken as its
    source's rate says.  Texts of any length count whole.  An empty table
    gives an empty one, and columns of any name pass through.
    """
    return mixing.repeat(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces: doc_id, start, length, doc_tokens, ids, sequence_id, offset and ids_crc32.

    A null text is empty and holds the end id alone; longer texts than a
    sequence make several pieces.  Rows that repeat an id, or have none, make
    their own pieces each.  An empty table gives an empty one.  Columns but
    doc_id and text are not read: the pieces are what training reads.
    """
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), END, SEQUENCE, drops_space=True, numbered=True)
    return packing.pack(pieces, SEQUENCE).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", keep_good), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, others = docs, written()
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
        release_since(others, docs)
    return docs

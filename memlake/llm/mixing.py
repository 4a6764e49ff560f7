"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str):
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source of ``sizes(source, size)``: source, source_size, target, rate.

    Sources in code point order, null last, weigh ``weights``, repeating, and
    share the sum of all sizes.  A target stops at ``cap`` times its source's
    size; the excess goes to the others by weight until none is above.  With
    sources sorted by cap / weight those that stop are a prefix, found with
    running sums: nothing is iterated.  The windows run over one row a source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = per_source.selectExpr("*", "row_number() over (order by source asc nulls last) as place")
    weighed = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)).withColumn("most", F.col("source_size") * cap)
    ordered = weighed.selectExpr(
        "*",
        "row_number() over (order by most / weight, place) as turn",
        "cast(sum(source_size) over () - coalesce(sum(most) over (order by most / weight, place rows between unbounded preceding and 1 preceding), 0) as decimal(38,0)) as left_size",
        "cast(sum(weight) over () - coalesce(sum(weight) over (order by most / weight, place rows between unbounded preceding and 1 preceding), 0) as decimal(38,0)) as left_weight",
    )
    first_free = ordered.selectExpr("*", "min(case when cast(most as decimal(38,0)) * left_weight >= weight * left_size then struct(turn, left_size, left_weight) end) over () as free")
    target = F.expr("case when turn < free.turn then cast(most as double) else cast(weight * free.left_size as double) / cast(free.left_weight as double) end")
    return first_free.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0)))


def copies_of(rate, doc_id, seed: int):
    """floor(rate), and one more with probability equal to the fraction, by a hash of doc_id and the seed."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    uniform = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)
    return (F.floor(rate) + F.when(uniform < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix(documents: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc (a struct of its columns, or of ``keep``), size, source_size, target, copies.

    A null text has size 0; a null source is a source of its own.  Where all
    texts of a source are empty, its target is 0 and each document is taken
    once.  Rows that repeat a doc_id get the same number of copies, as do
    reruns.  An empty table gives an empty one.  Columns of any name pass
    through inside ``doc``.  The rates (one row a source) are joined back;
    Spark broadcasts them only below its size threshold.
    """
    sized = documents.select(F.struct(*(keep or documents.columns)).alias("doc"), F.col(id_col).alias("name"), F.col(source_col).alias("source"), size_of(text_col).alias("size"))
    rates = source_rates(sized.select("source", "size"), weights, cap).withColumnRenamed("source", "of")
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc", "size", "source_size", "target", copies_of(F.col("rate"), F.col("name"), seed).alias("copies"))


def repeat(mixed: DataFrame) -> DataFrame:
    """Each document as often as ``mix`` takes it, in its own columns."""
    return mixed.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")

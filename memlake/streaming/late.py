"""Splitting a stream at its watermark: windows of what came in time, and a table of what came late.

Spark's own window aggregate drops late rows without a trace.  Here every
micro-batch is judged by the watermark that the batches before it left, which
is written down under the number of the batch that it holds for.  A batch that
runs again finds the same watermark and overwrites its own folders, so nothing
is told twice or lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from memlake.storage import file_names, read_text, write_text


def _mark(spark: SparkSession, root: str, number: int) -> int | None:
    """The watermark (microseconds) that holds for a batch; None before any row."""
    known = [int(n) for n in file_names(spark, f"{root}/marks") if n.isdigit() and int(n) <= number]
    return int(read_text(spark, f"{root}/marks/{max(known)}")) if known else None


def split_late(rows: DataFrame, root: str, group: str, at: str, window: str = "1 hour", delay: str = "1 hour", every: str | None = None):
    """Start the stream that fills ``root``: partial windows, late rows and marks; ``windows`` and ``late_rows`` read them.

    A row is late if its window ended at or before the watermark, the latest
    time of the batches before less ``delay``.  Rows without a time are late.
    Without ``every`` the stream takes what is there and ends.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark, mark = batch.sparkSession, _mark(batch.sparkSession, root, number)
        over = F.unix_micros(F.window(at, window)["end"]) <= (mark if mark is not None else -(1 << 62))
        timed = batch.where(F.col(at).isNotNull()).withColumn("__late", over)
        held = timed.unionByName(batch.where(F.col(at).isNull()).withColumn("__late", F.lit(True))).persist()
        held.where("__late").drop("__late").write.mode("overwrite").parquet(f"{root}/late/batch_no={number}")
        per = held.where("not __late").groupBy(group, F.window(at, window).alias("w")).agg(F.count("*").alias("size"), F.min(at).alias("first"), F.max(at).alias("last"))
        per.select(group, F.col("w.start").alias("bucket"), F.col("w.end").alias("until"), "size", "first", "last").write.mode("overwrite").parquet(f"{root}/windows/batch_no={number}")
        newest = held.agg(F.unix_micros(F.max(at) - F.expr(f"interval {delay}"))).first()[0]
        held.unpersist()
        after = max((x for x in (mark, newest) if x is not None), default=None)
        if after is not None:
            write_text(spark, f"{root}/marks/{number + 1}", str(after))

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return rows.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger).foreachBatch(handle).start()


def _read(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    full = StructType([*schema.fields, StructField("batch_no", IntegerType())])
    if not file_names(spark, f"{root}/{name}"):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/batch_no=*")


def late_rows(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """Late rows as they came, and the batch that brought them."""
    return _read(spark, root, "late", schema)


def windows(spark: SparkSession, root: str, group: StructField) -> DataFrame:
    """group, bucket, size, span (seconds) and closed: whether the watermark has passed the window's end."""
    fields = StructType.fromDDL("bucket timestamp, until timestamp, size long, first timestamp, last timestamp")
    parts = _read(spark, root, "windows", StructType([group, *fields.fields]))
    mark = _mark(spark, root, 1 << 62)
    span = F.unix_timestamp(F.max("last")) - F.unix_timestamp(F.min("first"))
    per = parts.groupBy(group.name, "bucket", "until").agg(F.sum("size").alias("size"), span.alias("span"))
    closed = F.unix_micros("until") <= mark if mark is not None else F.lit(False)
    return per.select(group.name, "bucket", "size", "span", closed.alias("closed"))

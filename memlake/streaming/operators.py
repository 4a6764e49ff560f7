"""Streaming forms: intake, deduplication, live lifecycle, windows and sessions (``stateful`` has processors with timers)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from memlake.storage import scratch


def run_available(stream: DataFrame, name: str, mode: str = "update", path: str | None = None) -> DataFrame:
    """Process what is there, write each micro-batch under its number, and read all of them.

    A batch that runs again overwrites its own folder, so restarts repeat nothing.
    """
    spark, root = stream.sparkSession, path or scratch(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch_no={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch_no", IntegerType())])).option("basePath", f"{root}/rows").parquet(f"{root}/rows/batch_no=*")


def latest(rows: DataFrame, keys: list[str], order: str = "batch_no") -> DataFrame:
    """The last update of each key."""
    rest = [c for c in rows.columns if c not in keys and c != "batch_no"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def ingest_stream(source: DataFrame, path: str, write: Callable[[DataFrame, int], None], every: str | None = None):
    """Hand each batch of new rows to ``write(batch, number)``; empty ones are skipped.

    The checkpoint remembers what was taken; a batch that failed comes again
    under the same number.  Without ``every`` it takes what is there and ends.
    """

    def handle(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write(batch, number)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return source.writeStream.option("checkpointLocation", path).trigger(**trigger).foreachBatch(handle).start()


def dedupe_stream(rows: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def auto_events_stream(rows: DataFrame, group: str, at: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Inferred events as tumbling windows with a watermark: group, bucket, size, span."""
    seconds = F.unix_timestamp(F.max(at)) - F.unix_timestamp(F.min(at))
    per = rows.withWatermark(at, delay).groupBy(group, F.window(at, window)).agg(F.count("*").alias("size"), seconds.alias("span"))
    return per.select(group, F.col("window.start").alias("bucket"), "size", "span")


def session_events(rows: DataFrame, group: str, at: str, gap: str) -> DataFrame:
    """Sessions with at most ``gap`` between rows; the same call serves batches and streams (with a watermark)."""
    per = rows.groupBy(group, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("size"))
    return per.select(group, F.col("w.start").alias("start"), "size")


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """State, hits and last hit per id from events (id, seq, op), kept live.

    Counts need no order, so a key's rows are reduced batch by batch: the last
    clear, the last mark, and the places of touches that no clear seen so far
    undoes (whole numbers, within one micro-batch).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, hits, last, marked_at, cleared = state.get if state.exists else ("active", 0, None, -1, -1)
        touched = np.zeros(0, np.int64)
        for b in batches:
            seq, op = b["seq"].to_numpy(np.int64), b["op"].to_numpy()
            clear, touch = op == "clear", op == "touch"
            last_clear = int(seq[clear].max(initial=-1))
            if last_clear > cleared:
                cleared, hits, last = last_clear, 0, None
                mark, marked_at = ("active", -1) if marked_at <= cleared else (mark, marked_at)
            touched = np.concatenate([touched, seq[touch]])
            touched = touched[touched > cleared]
            own = np.flatnonzero(~clear & ~touch & (seq > max(cleared, marked_at)))
            if len(own):
                at = own[np.argmax(seq[own])]
                mark, marked_at = str(op[at]), int(seq[at])
        if len(touched):
            hits, last = hits + len(touched), max(int(touched.max()), last or -1)
        state.update((mark, hits, last, marked_at, cleared))
        known = mark != "active" or hits > 0
        yield pd.DataFrame({"id": [key[0]], "state": [mark], "hits": [hits], "last_hit": pd.array([last], dtype="Int64"), "known": [known]})

    out, held = "id long, state string, hits long, last_hit long, known boolean", "state string, hits long, last_hit long, marked_at long, cleared long"
    return events.groupBy("id").applyInPandasWithState(step, out, held, "update", GroupStateTimeout.NoTimeout)

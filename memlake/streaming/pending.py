"""Synthesis on demand: a flag that intake sets with each batch, that one run takes, and that a failed run gives back.

Flags are small files named after their batch.  A run takes the flags that are
there by renaming them, so no two runs work on the same ones; it deletes them
when it is done and renames them back if it fails.  Flags that come meanwhile
stay for the next run.  What a process that died had taken counts as pending
again when the stream starts.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memlake.storage import delete, file_names, move, write_text

log = logging.getLogger(__name__)


def pending(spark: SparkSession, root: str) -> list[int]:
    """Numbers of batches that no synthesis has covered."""
    return sorted(int(n) for n in file_names(spark, f"{root}/pending") if n.isdigit())


def recover(spark: SparkSession, root: str) -> None:
    for name in file_names(spark, f"{root}/taken"):
        move(spark, f"{root}/taken/{name}", f"{root}/pending/{name}")


def synthesise_pending(spark: SparkSession, root: str, synthesise: Callable[[int], None]) -> bool:
    """Run ``synthesise(number of the newest pending batch)`` if anything is pending; whether it ran to its end.

    It is called again with the same number after a failure, so it should
    write under that number.
    """
    taken = [n for n in pending(spark, root) if move(spark, f"{root}/pending/{n}", f"{root}/taken/{n}")]
    if not taken:
        return False
    try:
        synthesise(taken[-1])
    except Exception:
        log.exception("synthesis failed; batches %s are pending again", taken)
        for n in taken:
            move(spark, f"{root}/taken/{n}", f"{root}/pending/{n}")
        return False
    for n in taken:
        delete(spark, f"{root}/taken/{n}")
    return True


def ingest_and_synthesise(source: DataFrame, root: str, write: Callable[[DataFrame, int], None], synthesise: Callable[[int], None], every: str | None = None):
    """Write each batch of new rows, then synthesise what is pending; a failing synthesis doesn't stop the intake.

    A batch that comes again is written again under its number and flagged
    again.  Empty batches set no flag, but let a pending synthesis run.
    """
    recover(source.sparkSession, root)

    def handle(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write(batch, number)
            write_text(batch.sparkSession, f"{root}/pending/{number}", "")
        synthesise_pending(batch.sparkSession, root, synthesise)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return source.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger).foreachBatch(handle).start()

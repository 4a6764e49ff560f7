"""Shortest-pack-first packing of token pieces over their length histogram.

The packer sees lengths only.  It places them longest first; each goes to the
pack that is shortest so far if it fits there, and opens packs otherwise.
Packs with equal contents are one pattern with a count, and a pattern is a run
of consecutive sequence ids, so a placement is a rule "pieces of length L with
ranks lo.. go to sequences base.. at this offset".  Pieces get their rank among
those of their length and follow the rules.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .tables import materialise, tidy
from .tokens import encoder


def plan_packs(histogram: dict[int, int], size: int) -> pd.DataFrame:
    """Rules (length, lo, count, base, offset) that place every piece of the histogram.

    Work and rules depend on ``size`` (the histogram has at most that many
    entries), not on how many pieces there are.
    """
    rules, open_packs, sequences, tie = [], [], 0, 0
    for length in sorted(histogram, reverse=True):
        left, lo = histogram[length], 0
        while left:
            if open_packs and open_packs[0][0] + length <= size:
                filled, _, base, count = heapq.heappop(open_packs)
                if count > left:
                    heapq.heappush(open_packs, (filled, tie := tie + 1, base + left, count - left))
                    count = left
            else:
                filled, base, count = 0, sequences, -(-left // (size // length))  # each will take several, if they fit
                sequences += count
            rules.append((length, lo, count, base, filled))
            if filled + length < size:
                heapq.heappush(open_packs, (filled + length, tie := tie + 1, base, count))
            left, lo = left - count, lo + count
    return pd.DataFrame(rules, columns=["length", "lo", "count", "base", "offset"]).astype("int64")


def _number(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Adds each piece's task and its rank among the task's pieces of that length."""
    part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
    for batch in batches:
        length = batch.column("length").to_numpy(zero_copy_only=False)
        order = np.argsort(length, kind="stable")
        ordered, rank = length[order], np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
        seen += np.bincount(length, minlength=size + 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(rank)], [*batch.schema.names, *_NUMBERED])


_NUMBERED = ("__part", "__rank")


def token_pieces(documents: DataFrame, tokenizer: str, end_id: int, size: int, drops_space: bool, numbered: bool = False) -> DataFrame:
    """Every whole text's ids, then the end id, cut into pieces of at most ``size``.

    Returns doc_id, start, length, doc_tokens and ids (uint32, little-endian).
    A null text is empty and makes one piece that holds the end id.  Rows that
    repeat a doc_id make their own pieces each.  ``numbered`` also counts them
    in the same pass, for ``pack``, which then must get all of them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(tokenizer, drops_space)
        for batch in batches:
            doc_ids, row = batch.column("doc_id"), 0
            for ids, n in work.encode(batch.column("text")):
                ids = np.insert(ids, np.cumsum(n), np.uint32(end_id)).astype("<u4")
                n = n + 1
                pieces = -(-n // size)
                which = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                length = np.minimum(size, n[which] - start)
                values = pa.py_buffer(ids.tobytes())
                bounds = pa.py_buffer(np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row + which)), pa.array(start), pa.array(length), pa.array(n[which]), pa.Array.from_buffers(pa.binary(), len(which), [None, bounds, values])], ["doc_id", "start", "length", "doc_tokens", "ids"])
                row += len(n)

    schema = "doc_id long, start long, length long, doc_tokens long, ids binary" + (", __part int, __rank long" if numbered else "")
    run = (lambda batches: _number(cut(batches), size)) if numbered else cut
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), schema)


#: Parts into which the pieces of one length and written partition are dealt when they meet their first rank.
SALT = 16


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` from 1 to ``size``.

    All other columns pass through (one of those two names is replaced).
    Equal rows are different pieces.  An empty table gives an empty one.
    Each task counts its pieces of every length as they stream by; the counts
    of the partitions before raise these ranks, so a length that most pieces
    share is spread over all partitions, and no partition is sorted.
    """
    pieces = pieces.drop("sequence_id", "offset")
    if set(_NUMBERED) <= set(pieces.columns):
        held = materialise(pieces, "pieces")
    else:
        fields = [*pieces.schema.fields, StructField("__part", IntegerType()), StructField("__rank", LongType())]
        held = materialise(pieces.mapInArrow(lambda batches: _number(batches, size), StructType(fields)), "pieces")
    schema = pieces.drop(*_NUMBERED).schema
    counts = held.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most `size` rows
    rules = plan_packs(histogram, size).sort_values(["length", "lo"])
    keys = rules["length"].to_numpy() * (1 << 48) + rules["lo"].to_numpy()
    base, low, offset = (rules[c].to_numpy() for c in ("base", "lo", "offset"))

    before = W.partitionBy("length").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    salted = firsts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    ranked = held.withColumn("__salt", F.pmod("__rank", F.lit(SALT)).cast("int")).join(salted, ["length", "__part", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            at = np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1
            columns = [batch.column(c) for c in schema.names] + [pa.array(base[at] + rank - low[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, [*schema.names, "sequence_id", "offset"])

    placed = StructType([*schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.select(*schema.names, "__rank").mapInArrow(tidy(place), placed)

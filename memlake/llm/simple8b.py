"""Simple-8b word-aligned coding of token ids, and token files made of it.

A 64-bit word holds a 4-bit selector above 60 bits of payload; the selector
says how many ids of which width are packed, lowest first.  Selector 0 stands
for 240 zeros; selector 1 is the escape: the whole next word is one raw value
that needs more than 60 bits.  Ids are coded in blocks of ``BLOCK``; a segment
holds the word offset of each block, so a reader can decode any block alone,
and all words of one selector together.

A token file is a folder of segments (rows with a binary ``payload``), written
by Spark's own committer: shards are ranges of doc_id, segments follow each
other inside a shard, documents inside a segment, all ascending.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import shuffle_width, tidy
from .tokens import encoder

#: Fixed values of the code: how many ids of how many bits each selector packs.
PACKED = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
ZEROS, ESCAPE, RUN = 0, 1, 240
BLOCK = 4096
#: Ids after which a segment is closed (at the end of a document).
SEGMENT = 1 << 18
_HEADER = struct.Struct("<4sIIII")
_MAGIC = b"S8B1"


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    width = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    wide = np.flatnonzero(width > 53)  # doubles may have been rounded up
    width[wide] = [int(x).bit_length() for x in ids[wide].tolist()]
    return width


def _steps(width: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """At each id the selector that packs most ids without leaving its block, and how many those are."""
    n, blocks = len(width), -(-len(width) // block)
    runs = [count for count, _ in PACKED.values()] + [RUN] * bool((width == 0).any())
    held = np.full((blocks, block), 255, np.uint8)
    held.ravel()[:n] = width
    highest = {1: np.concatenate([held, np.full((blocks, max(runs)), 255, np.uint8)], axis=1)}  # of the next p ids
    for p in (1, 2, 4, 8, 16, 32, 64):
        highest[2 * p] = np.maximum(highest[p][:, :-p], highest[p][:, p:])
    selector = np.where(held > 60, np.uint8(ESCAPE), np.uint8(15))
    step = np.ones((blocks, block), np.int64)
    for sel, (count, bits) in [*sorted(PACKED.items(), reverse=True)[1:], (ZEROS, (RUN, 0))]:
        if count in runs:
            p = 1 << (count.bit_length() - 1)
            fits = np.maximum(highest[p][:, :block], highest[p][:, count - p : count - p + block]) <= bits
            selector[fits], step[fits] = sel, count
    return selector.ravel()[:n], step.ravel()[:n]


def encode_blocks(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The Simple-8b words of blocks of ids, each coded alone, and where each block's words begin (and the end)."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    selector, step = _steps(_bit_lengths(ids), block)
    chain, following, i = [], step.tolist(), 0
    while i < n:  # no word leaves its block, so one walk goes through all of them
        chain.append(i)
        i += following[i]
    at = np.array(chain, np.int64)
    chosen = selector[at]
    size = np.where(chosen == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    for sel, (count, bits) in PACKED.items():
        here = np.flatnonzero(chosen == sel)
        if len(here):
            first, packed = at[here], np.zeros(len(here), np.uint64)
            for k in range(count):
                packed |= ids[first + k] << np.uint64(bits * k)
            words[place[here]] |= packed
    here = chosen == ESCAPE
    words[place[here] + 1] = ids[at[here]]
    begins = place[np.searchsorted(at, np.arange(0, n, block))]
    return words, np.append(begins, len(words))


def encode_words(ids: np.ndarray) -> np.ndarray:
    """The words of one run of ids."""
    return encode_blocks(ids, max(len(ids), 1))[0]


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids of a run of whole words, all words of a selector together."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    if (selector == ESCAPE).any():  # a raw word may look like any selector: walk the escapes in order
        raw, i = np.zeros(len(words), bool), 0
        for i in np.flatnonzero(selector == ESCAPE).tolist():
            if not raw[i]:
                raw[i + 1] = True
    else:
        raw = np.zeros(len(words), bool)
    counts = np.array([RUN, 1] + [PACKED[s][0] for s in range(2, 16)])[selector]
    counts[raw] = 0
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for sel, (count, bits) in PACKED.items():
        here = np.flatnonzero((selector == sel) & ~raw)
        mask = np.uint64((1 << bits) - 1)
        for k in range(count if len(here) else 0):
            out[at[here] + k] = (words[here] >> np.uint64(bits * k)) & mask
    here = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[at[here]] = words[here + 1]
    return out


def encode_segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Header, document index, block offsets, words."""
    words, offsets = encode_blocks(ids, BLOCK)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([x if x is not None else 0 for x in doc_ids], "<i8")
    head = _HEADER.pack(_MAGIC, len(doc_ids), len(ids), len(offsets) - 1, len(words))
    return b"".join([head, names.tobytes(), known.tobytes(), np.asarray(counts, "<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def decode_segment(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc ids, counts and ids of a segment written by ``encode_segment``."""
    magic, docs, n, blocks, words = _HEADER.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a Simple-8b segment")
    at = _HEADER.size
    names = np.frombuffer(payload, "<i8", docs, at)
    known = np.frombuffer(payload, np.uint8, docs, at := at + 8 * docs)
    counts = np.frombuffer(payload, "<u4", docs, at := at + docs)
    at += 4 * docs + 4 * (blocks + 1)
    ids = decode_words(np.frombuffer(payload, "<u8", words, at))
    if len(ids) != n:
        raise ValueError("damaged Simple-8b segment")
    return [int(x) if k else None for x, k in zip(names, known, strict=True)], counts.astype(np.int64), ids


def decode_block(payload: bytes, block: int) -> np.ndarray:
    """The ids of one block alone, found by its offset."""
    _, docs, _, blocks, _ = _HEADER.unpack_from(payload)
    at = _HEADER.size + 13 * docs
    lo, hi = np.frombuffer(payload, "<u4", 2, at + 4 * block)
    return decode_words(np.frombuffer(payload, "<u8", hi - lo, at + 4 * (blocks + 1) + 8 * int(lo)))


SEGMENTS = "shard int, segment int, first_id long, n_ids long, n_docs int, payload binary"


def write_token_files(documents: DataFrame, path: str, tokenizer: str, end_id: int, drops_space: bool = False) -> None:
    """Encode every whole text and write the ids in ascending doc_id order under ``path``.

    ``documents`` needs ``doc_id`` and ``text``; other columns are not read.
    A null text counts as empty and holds only the end id; rows with a null
    doc_id come first; rows that repeat a doc_id follow each other by a hash of
    their text, then by text.
    An empty table writes no segment.  Texts are dealt by ranges of doc_id
    (one shuffle) and each task encodes its range as it streams by.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        names: list = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def close():
            nonlocal segment, first, names, counts, parts, held
            ids = np.concatenate(parts)
            payload = encode_segment(names, np.concatenate(counts), ids)
            out = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()), "first_id": [first], "n_ids": [len(ids)], "n_docs": pa.array([len(names)], pa.int32()), "payload": pa.array([payload], pa.binary())})
            segment, first = segment + 1, first + len(ids)
            names, counts, parts, held = [], [], [], 0
            return out

        work = encoder(tokenizer, drops_space)
        for batch in batches:
            doc_ids, row = batch.column("doc_id").to_pylist(), 0
            for ids, n in work.encode(batch.column("text")):
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, np.uint32(end_id))
                n = n + 1
                ends = np.cumsum(n)
                lo = 0
                while lo < len(n):  # whole documents until the segment is full
                    room = (ends[lo - 1] if lo else 0) + SEGMENT - held
                    hi = max(int(np.searchsorted(ends, room, "right")), lo + 1)
                    names += doc_ids[row + lo : row + hi]
                    counts.append(n[lo:hi])
                    parts.append(ids[(ends[lo - 1] if lo else 0) : ends[hi - 1]])
                    held += len(parts[-1])
                    lo = hi
                    if held >= SEGMENT:
                        yield close()
                row += len(n)
        if names:
            yield close()

    (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("spot"))
        .repartitionByRange(shuffle_width(documents.sparkSession), "doc_id", "spot")  # rows of one id may fill several ranges
        .sortWithinPartitions("doc_id", "spot", "text")
        .mapInArrow(tidy(encode), SEGMENTS)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def read_token_files(spark, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, and ``ids`` (uint32, little-endian) if asked for.

    The starts of shards come from their sizes: one row a shard (as many as
    the writer had partitions), summed up and joined back.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sizes.selectExpr("shard", "sum(n) over (order by shard rows between unbounded preceding and current row) - n as base")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, first, payload in zip(*(batch.column(c).to_pylist() for c in ("base", "first_id", "payload")), strict=True):
                names, counts, ids = decode_segment(payload)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(counts)
                spans = [raw[4 * (e - c) : 4 * e] for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(names, pa.int64()), pa.array(base + first + ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(spans, pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return segments.join(F.broadcast(before), "shard").select("base", "first_id", "payload").mapInArrow(decode, schema)

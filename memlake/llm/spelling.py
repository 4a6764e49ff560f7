"""Spelling variants: words one edit apart, found by comparing dense tiles of padded code points.

Two words of lengths n and n, or n - 1 and n, are one edit apart exactly if
their common prefix and common suffix together reach n - 1.  The n places are
cut into ``WINDOWS`` windows; an edit lies in one of them, so two such words
agree on all code points before it and all behind it.  Words that agree like
this form a block, and each block is compared with itself in dense tiles: the
words stand left-aligned and right-aligned in two padded matrices, and prefix
and suffix lengths of whole diagonals of pairs come out of array comparisons.
Blocks too large for one tile are dealt into parts, and every pair of parts is
a tile of its own, so no task holds more than two parts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise, release, tidy
from .wordbatch import column_bytes, lower_ascii

#: Windows that a word's places are cut into.
WINDOWS = 4
#: Code points in one part of a block (words times length), and of pairs compared at once.
PART, TOGETHER = 1 << 15, 1 << 20
#: Different words that a task counts before it sends them on, and bytes of a text read at once.
HELD, SLICE = 200_000, 1 << 22
#: Every run of a document is changed if the crc32 of ``<doc_id>:<run>`` is divisible by this.
DAMAGE = 97

# UTF-8: U+00C0 to U+00FF are 0xC3 and any continuation byte.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_BETWEEN = re.compile(rb"[\x00-\x60\x7b-\x7f\xc2\xc4-\xff]")


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in slices that end between runs."""
    at = 0
    while len(text) - at > SLICE:
        between = _BETWEEN.search(text, at + SLICE)
        cut = between.start() if between else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def damaged(run: bytes, digest: int) -> bytes:
    """``run`` without its code point ``digest`` % length."""
    word = run.decode()
    at = digest % len(word)
    return (word[:at] + word[at + 1 :]).encode()


def word_counts(documents: DataFrame, least_length: int = 5, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all words of ``least_length`` code points or more that occur ``least`` times or more.

    Words are the lower-cased (A-Z only) maximal runs of ASCII letters and
    U+00C0 to U+00FF of whole texts, after the damage that ``DAMAGE`` states;
    a null doc_id counts as an empty string there.  Tasks send words with
    counts, so a frequent word is added up where it occurs.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            names = batch.column("name").to_pylist()
            for i, name in enumerate(names):
                start = zlib.crc32(f"{'' if name is None else name}:".encode())
                for piece in _slices(lower_ascii(data[offsets[i] : offsets[i + 1]]).tobytes()):
                    for run, n in Counter(_RUN.findall(piece)).items():
                        digest = zlib.crc32(run, start)
                        word = run if digest % DAMAGE else damaged(run, digest)
                        if len(word) - word.count(0xC3) >= least_length:
                            total[word] += n
                if len(total) > HELD:
                    yield flush()
        yield flush()

    rows = documents.select(F.col(id_col).alias("name"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _blocks(words: DataFrame) -> DataFrame:
    """word, n, size (the longer length), at (the window's first place) and key: what surrounds the window."""
    sized = words.withColumn("size", F.explode(F.expr("array(char_length(word), char_length(word) + 1)")))
    width = F.ceil(F.col("size") / WINDOWS).cast("int")
    windows = sized.withColumn("width", width).withColumn("at", F.explode(F.expr("sequence(0, size - 1, width)")))
    around = F.expr("xxhash64(substring(word, 1, at), right(word, size - width - at))")  # right(word, 0 or less) is empty
    return windows.withColumn("key", around).drop("width")


def _aligned(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points left-aligned and right-aligned in ``size`` columns (0 elsewhere), and the lengths."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), lengths)
    column = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    head, tail = np.zeros((2, len(words), size), np.uint32)
    head[row, column] = points
    tail[row, column + np.repeat(size - lengths, lengths)] = points
    return head, tail, lengths


def _run_length(equal: np.ndarray) -> np.ndarray:
    """How many leading columns are true."""
    stop = equal.argmin(axis=1)
    stop[equal[np.arange(len(equal)), stop]] = equal.shape[1]
    return stop


def tile_pairs(words: list[str], tile: np.ndarray, part: np.ndarray, crossed: np.ndarray, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs one edit apart within runs of equal ``tile``; the longer length is ``size``.

    Rows of a ``crossed`` tile, one of two parts, are compared across them
    only.  A pair that meets in several windows is told in the first of them.
    """
    n = len(words)
    head, tail, lengths = _aligned(words, size)
    start = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    run = np.diff(np.append(start, n))
    left = np.repeat(start + run, run) - np.arange(n) - 1  # rows of the tile behind each
    width, found = -(-size // WINDOWS), []
    step = max(1, TOGETHER // size)
    for gap in range(1, int(run.max())):
        rows = np.flatnonzero(left >= gap)
        rows = rows[(lengths[rows] == size) | (lengths[rows + gap] == size)]
        rows = rows[~crossed[rows] | (part[rows] != part[rows + gap])]
        for lo in range(0, len(rows), step):
            i = rows[lo : lo + step]
            j, most = i + gap, np.minimum(lengths[i], lengths[i + gap])
            prefix = np.minimum(_run_length(head[i] == head[j]), most)
            suffix = np.minimum(_run_length((tail[i] == tail[j])[:, ::-1]), most)
            first = np.maximum(0, -(-(size - width - suffix) // width) * width)
            hit = (prefix + suffix >= size - 1) & (first == at[i])
            found.append((i[hit], j[hit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_TILE = ["size", "at", "key", "one", "two"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of rows sorted by tile; the tile at a batch's end waits for the next batch."""

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        sizes = table.column("size").to_numpy()
        columns = [table.column(c).to_numpy() for c in _TILE]
        change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        tile = np.concatenate([[0], np.cumsum(change)])
        starts = np.append(np.flatnonzero(np.concatenate([[True], change])), len(tile))
        lo = 0
        while lo < len(tile):  # whole tiles of one length, as many as fit
            k = np.searchsorted(starts, lo)
            most = lo + max(1, 32 * PART // int(sizes[lo]))
            stop = min(int(np.searchsorted(sizes, sizes[lo], "right")), len(tile))
            hi = min(int(starts[max(k + 1, np.searchsorted(starts, most, "right") - 1)]), stop)
            part = table.slice(lo, hi - lo)
            words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
            a, b = tile_pairs(words, tile[lo:hi], part.column("part").to_numpy(), (columns[3] != columns[4])[lo:hi], int(sizes[lo]), columns[1][lo:hi])
            if len(a):
                names = part.column("word").combine_chunks()
                one, two = np.concatenate([a, b]), np.concatenate([b, a])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(one)), names.take(pa.array(two)), pa.array(n[two])], ["word", "near", "near_n"])
            lo = hi

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = held.slice(held.num_rows - 1)
        same = np.ones(held.num_rows, bool)
        for c in _TILE:
            same &= held.column(c).to_numpy() == last.column(c)[0].as_py()
        keep = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if keep:
            yield from pairs(held.slice(0, keep))
            held = held.slice(keep)
    if held is not None and held.num_rows:
        yield from pairs(held)


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n in both directions: all words that are one inserted, deleted or replaced code point apart.

    ``words`` has different words with their n.  Blocks of one word go at once;
    the others are cut by ``PART``.
    """
    blocks = _blocks(words)
    sizes = blocks.groupBy("size", "at", "key").agg(F.count("*").alias("members")).where("members > 1")
    parts = F.ceil(F.col("members") * F.col("size") / PART).cast("int")
    dealt = blocks.join(sizes, ["size", "at", "key"]).withColumn("parts", parts).withColumn("part", F.expr("cast(pmod(xxhash64(word), parts) as int)"))
    other = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    tiles = other.select("size", "at", "key", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "word", "n")
    return tiles.repartition(*_TILE).sortWithinPartitions(*_TILE, "part").mapInArrow(tidy(_compare), "word string, near string, near_n long")


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every row of ``words(word, n)``.

    A word's form is its near word of largest n (ties: the smallest in code
    point order) if that is at least twice the word's own; its root is the
    last word that forms lead to, itself if it has none.  A form's n doubles
    at every step, so with pointers doubling too, a few joins reach all roots.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    told = F.col("best.less") <= -2 * F.col("n")
    held = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(told, F.col("best.near")).alias("form"), F.when(told, -F.col("best.less")).alias("form_n")), "forms")
    up = held.where("form is not null").select("word", F.col("form").alias("up"))
    while True:
        after = up.select(F.col("word").alias("of"), F.col("up").alias("above"))
        joined = up.join(after, F.col("up") == F.col("of"), "left")
        step = materialise(joined.select("word", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")), "roots")
        release(up)
        up = step
        if not step.where("moved").head(1):
            break
    return held.join(up.select("word", "up"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("up", "word").alias("root"))


def spelling_variants(documents: DataFrame, least_length: int = 5, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of all texts (``word_counts``) with their forms and roots (``variants``).

    Null and empty texts have no words, rows that repeat count each; a text or
    a word may be of any length.  An empty table gives an empty one; other
    columns are not read.
    """
    return variants(materialise(word_counts(documents, least_length, least, id_col, text_col), "words"))

"""Near duplicates by MinHash bands, odd sketches and full-set confirmation.

1. Every text becomes the set of its distinct word shingles (64-bit hashes).
   Equal sets are one class; the work below sees one representative a class.
2. A representative has ``BANDS`` keys of ``ROWS`` MinHash samples each, and an
   odd sketch: each sample toggles one bit of a parity bitmap, so the XOR of
   two bitmaps has about as many ones as the samples differ, which estimates
   high similarities precisely.
3. Round one links each member of a band bucket with the bucket's smallest
   member (a linear number of pairs).  Round two looks at buckets that still
   hold several components and compares, by sketches in blocks of bounded
   size, exactly the members that round one left apart.  Pairs that the
   sketches let through are confirmed on the full sets.
4. Components of confirmed links, by alternating large and small stars.

No pair is skipped because a bucket is large: only pairs already known to be in
one component, or that the sketch rules out by over five standard deviations,
stay unconfirmed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbatch as wb
from .tables import materialise, release, tidy

#: A pair of similarity 0.8 shares no key with probability (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch.
BITS = 1024
#: Standard deviations of the estimate that a pair may fall short by.
MARGIN = 5.5
#: Members that meet in one block of round two, and the shingles of all of them (8 bytes each).
BLOCK, BLOCK_SHINGLES = 512, 1 << 19

_FACTORS = (wb.mix64(np.arange(SAMPLES)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADDENDS = (wb.mix64(np.arange(SAMPLES) + 1_000_003) >> np.uint64(32)).astype(np.uint32)
_PLACES = wb.mix64(np.arange(SAMPLES) + 2_000_003)


def largest_difference(threshold: float) -> int:
    """Most differing sketch bits with which a pair may still have the threshold's similarity."""
    least = max(0.0, threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / SAMPLES))
    ones = BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - least) / BITS))
    return math.ceil(ones + 3 * math.sqrt(ones))


def shingles(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows, in order: sorted distinct shingle hashes of all of them, and each row's count."""
    data, offsets = wb.column_bytes(column)
    mixers = wb.mix64(np.arange(width) + 77) | np.uint64(1)
    for first, last in wb.document_windows(offsets):
        lo = int(offsets[first])
        part = wb.lower_ascii(data[lo : int(offsets[last])])
        starts, ends, docs = wb.word_spans(part, offsets[first : last + 1] - lo, 0, last - first)
        words = wb.hash_spans(part, starts, ends)
        n_words = np.bincount(docs, minlength=last - first)
        if len(words) >= width:
            rolled = np.zeros(len(words) - width + 1, np.uint64)
            for j in range(width):
                rolled += words[j : len(rolled) + j] * mixers[j]
            whole = docs[: len(rolled)] == docs[width - 1 :]
            values, owner = wb.mix64(rolled[whole]), docs[: len(rolled)][whole]
        else:
            values, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((n_words > 0) & (n_words < width))  # fewer words: the whole sequence is one shingle
        at = np.cumsum(n_words) - n_words
        few = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = n_words[short] > j
            few[has] += words[at[short[has]] + j] * mixers[j]
        values = np.concatenate([values, wb.mix64(few + n_words[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        yield values[fresh], np.bincount(owner[fresh], minlength=last - first)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(counts * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _views(column: pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def _signature(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of the sets that begin at ``starts``."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(starts), SAMPLES), np.uint32)
    for j in range(SAMPLES):
        least[:, j] = np.minimum.reduceat(x * _FACTORS[j] + _ADDENDS[j], starts)
    rows = wb.mix64(least.astype(np.uint64) + _PLACES)
    odd = np.zeros((len(starts), BITS), np.uint8)
    np.add.at(odd, (np.arange(len(starts))[:, None], (rows >> np.uint64(54)).astype(np.int64)), 1)  # BITS = 2**10
    keys = wb.mix64(np.add.reduce(rows.reshape(len(starts), BANDS, ROWS), axis=2) + np.arange(BANDS, dtype=np.uint64))
    return keys.view(np.int64), np.packbits(odd & 1, axis=1)


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes that name the set), keys (array<long>, one a band) and sketch.

    An empty set has a null set_key, keys and sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = batch.column("doc_id"), 0
            for values, counts in shingles(batch.column("text"), width):
                n, some = len(counts), np.flatnonzero(counts)
                at = (np.cumsum(counts) - counts)[some]
                name = np.zeros((n, 2), np.uint64)
                keys, sketch = np.zeros((n, BANDS), np.int64), np.zeros((n, BITS // 8), np.uint8)
                for half in range(2 if len(some) else 0):
                    name[some, half] = np.add.reduceat(wb.mix64(values + np.uint64(half * 0x51ED2701)), at)
                for lo in range(0, len(some), 256):
                    part = some[lo : lo + 256]
                    stop = at[lo + 256] if lo + 256 < len(some) else len(values)
                    keys[part], sketch[part] = _signature(values[at[lo] : stop], at[lo : lo + 256] - at[lo])
                empty = pa.array(counts == 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS), pa.int32()), pa.array(keys.ravel()))
                columns = [_binary(name.ravel(), np.full(n, 2)), lists, _binary(sketch.ravel(), np.full(n, BITS // 8))]
                columns = [pc.if_else(empty, pa.scalar(None, c.type), c) for c in columns]
                yield pa.RecordBatch.from_arrays([ids.slice(row, n), pa.array(counts.astype(np.int64)), *columns], ["doc_id", "n_shingles", "set_key", "keys", "sketch"])
                row += n

    return documents.mapInArrow(tidy(run), "doc_id long, n_shingles long, set_key binary, keys array<long>, sketch binary")


#: Bits of the filter that spares documents outside all pairs; its megabyte is all that is broadcast.
FILTER_BITS = 1 << 23


def shingle_sets(documents: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """doc_id, n_shingles and shingles (uint64, ascending) of at least the documents in ``wanted(doc_id)``.

    Ids are looked up in a bitmap of fixed size, so no text is shuffled; other
    documents may pass where it is full, which costs time and changes nothing.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) + 1  # Spark's bitmaps count from 1
    chunks = wanted.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    filled = np.zeros(FILTER_BITS, bool)
    for r in chunks.collect():  # FILTER_BITS / 32768 rows of 4 KB
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        filled[(r["chunk"] - 1) * len(bits) : r["chunk"] * len(bits)] = bits
    held = documents.sparkSession.sparkContext.broadcast(np.packbits(filled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column("spot").to_numpy() - 1]))
            ids, row = batch.column("doc_id"), 0
            for values, counts in shingles(batch.column("text"), width):
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(counts)), pa.array(counts.astype(np.int64)), _binary(values, counts)], ["doc_id", "n_shingles", "shingles"])
                row += len(counts)

    some = documents.where("doc_id is not null").select("doc_id", "text", spot.alias("spot"))
    return some.mapInArrow(tidy(run), "doc_id long, n_shingles long, shingles binary").where("n_shingles > 0")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union| on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_views(batch.column("x"), np.uint64), _views(batch.column("y"), np.uint64), strict=True):
                place = np.searchsorted(x, y)
                common = int((x[np.minimum(place, len(x) - 1)] == y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    slim = sets.select("doc_id", "shingles", "n_shingles")
    x = slim.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"), F.col("n_shingles").alias("nx"))
    y = slim.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"), F.col("n_shingles").alias("ny"))
    both = pairs.join(x, "a").join(y, "b").where((100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")))
    return both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def _linked(near: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs of ``near`` that their full sets confirm; only texts of those pairs are read into sets."""
    pairs = materialise(near, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sets = materialise(shingle_sets(texts, width, wanted), "sets")
    linked = materialise(_confirm(pairs, sets, percent).distinct(), "star-links")
    release(pairs, sets)
    return linked


def _near(pairs: DataFrame, marks: DataFrame, most: int) -> DataFrame:
    """Pairs whose sketches differ in at most ``most`` bits."""
    x = marks.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x"))
    y = marks.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("x", "y"))
            keep = np.bitwise_count(x ^ y).sum(axis=1) <= most
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def _apart(buckets: DataFrame, marks: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Bucket members, by cells, with a member of another label whose sketch is near.

    Members that share the label of the bucket's centre are never compared with
    each other; all others meet in cells of about BLOCK x BLOCK members and
    BLOCK_SHINGLES shingles a side.
    """
    named = buckets.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    open_ = named.groupBy("key").agg(F.min("label").alias("home"), F.max("label").alias("other"), F.count("*").alias("n"), F.min("doc_id").alias("centre")).where("home != other")
    with_home = named.join(open_.select("key", "centre"), "key")
    centre_label = labels.select(F.col("doc_id").alias("centre"), F.col("label").alias("home"))
    with_home = with_home.join(centre_label, "centre", "left").withColumn("inside", F.coalesce("home", "centre") == F.col("label"))


    def parts(here):  # as many as keep both bounds, on average: members are dealt by a hash
        held = F.coalesce(F.sum(F.when(here, F.col("n_shingles"))), F.lit(0))
        return F.ceil(F.greatest(F.count_if(here) / BLOCK, F.when(held > 0, held / BLOCK_SHINGLES).otherwise(0.0))).cast("int")

    sizes = with_home.groupBy("key").agg(parts(F.col("inside")).alias("inner"), parts(~F.col("inside")).alias("outer"))
    spot = F.xxhash64("doc_id", "key")
    # A cell is (key, p, q): p an outer part, q an inner part (below 0) or an outer part from p on.
    outer = F.flatten(F.array(
        F.transform(F.sequence(F.lit(1), F.col("inner")), lambda i: F.struct(F.col("part").alias("p"), (-i).alias("q"))),
        F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda i: F.struct(F.least(F.col("part"), i).alias("p"), F.greatest(F.col("part"), i).alias("q"))),
    ))
    outer_only = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda i: F.struct(F.least(F.col("part"), i).alias("p"), F.greatest(F.col("part"), i).alias("q")))
    inner = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda i: F.struct(i.alias("p"), (-F.col("part") - 1).alias("q")))
    members = (
        with_home.join(sizes, "key")
        .withColumn("part", F.pmod(spot, F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
        .withColumn("cell", F.explode(F.when(F.col("inside"), inner).when(F.col("inner") > 0, outer).otherwise(outer_only)))
        .select("key", "cell.p", "cell.q", "doc_id", "label", F.when(F.col("inside"), F.lit(-1)).otherwise(F.col("part")).alias("side"))
        .join(marks.select("doc_id", "sketch"), "doc_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            side, label = cell.column("side").to_numpy(), cell.column("label").to_numpy()
            left, right = _sides(cell, side)
            sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            near = np.zeros(cell.num_rows, bool)
            for i in range(0, len(left), 64):
                some = left[i : i + 64]
                for j in range(0, len(right), 1024):
                    others = right[j : j + 1024]
                    apart = np.bitwise_count(sketch[some][:, None, :] ^ sketch[others][None, :, :]).sum(axis=2, dtype=np.int64)
                    found = (apart <= most) & (label[some][:, None] != label[others][None, :])
                    near[some] |= found.any(axis=1)
                    near[others] |= found.any(axis=0)
            if near.any():
                yield from cell.select(["key", "p", "q", "doc_id", "label", "side"]).filter(pa.array(near)).combine_chunks().to_batches()

    return _by_cell(members).mapInArrow(tidy(run), _MEMBER)


_MEMBER = "key long, p int, q int, doc_id long, label long, side int"


def _by_cell(members: DataFrame) -> DataFrame:
    return members.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "doc_id")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, p, q) of sorted batches; cells of one row are left out."""
    rest: pa.Table | None = None
    for batch in _with_end(batches):
        table = rest if batch is None else pa.Table.from_batches([*(rest.to_batches() if rest is not None else []), batch])
        if table is None or not table.num_rows:
            continue
        key, p, q = (table.column(c).to_numpy() for c in ("key", "p", "q"))
        bounds = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1, [len(key)]])
        stop = len(bounds) - 1 if batch is None else len(bounds) - 2
        for lo, hi in zip(bounds[:stop], bounds[1 : stop + 1], strict=True):
            if hi - lo > 1:
                yield table.slice(int(lo), int(hi - lo))
        rest = table.slice(int(bounds[stop]))


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sides(cell: pa.Table, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = cell.column("p")[0].as_py(), cell.column("q")[0].as_py()
    return np.flatnonzero(side == p), np.flatnonzero(side == q) if q >= 0 else np.flatnonzero(side < 0)


#: Up to so many sets a shingle's pairs are counted one by one.
RARE = 16


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each left with each right set.

    Shingles of many sets are counted as products of 0/1 matrices, those of a
    few sets pair by pair.
    """
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    bounds = wb.group_bounds(values)
    times = np.diff(bounds)
    each = np.repeat(times, times)
    out = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2**24 are exact
    dense = np.cumsum(times > RARE) - 1
    column, many = np.repeat(dense, times), each > RARE
    wide = max(256, (1 << 22) // len(sets))
    for lo in range(0, int((times > RARE).sum()), wide):
        here = many & (column >= lo) & (column < lo + wide)
        matrix = np.zeros((len(sets), min(wide, int(dense[-1]) + 1 - lo)), np.float32)
        matrix[owner[here], column[here] - lo] = 1
        out += matrix[left] @ matrix[right].T
    few = (each > 1) & ~many
    values, owner = values[few], owner[few]
    pairs = np.zeros((len(sets), len(sets)), np.float32)
    for step in range(1, min(RARE, len(values))):
        same = values[step:] == values[:-step]
        np.add.at(pairs, (owner[:-step][same], owner[step:][same]), 1)
    return out + pairs[np.ix_(left, right)] + pairs.T[np.ix_(left, right)]


def _bridges(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between labels, confirmed on full sets inside each cell.

    A cell returns links only until its labels hang together: at most one less
    than it has labels, whatever the number of linked pairs.
    """
    near = materialise(members, "near")
    sets = materialise(shingle_sets(texts, width, near.select("doc_id").distinct()), "near-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            left, right = _sides(cell, cell.column("side").to_numpy())
            if not len(left) or not len(right):
                continue
            ids, label = cell.column("doc_id").to_numpy(), cell.column("label").to_numpy()
            held = [np.frombuffer(x, np.uint64) for x in cell.column("shingles").to_pylist()]
            n = np.array([len(x) for x in held])
            common = _common(held, left, right).astype(np.int64)
            linked = (100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)) & (label[left][:, None] != label[right][None, :])
            group = {x: x for x in label.tolist()}

            def root(x, group=group):
                while group[x] != x:
                    x = group[x]
                return x

            out = []
            for i, j in zip(*np.nonzero(linked), strict=True):
                a, b = left[i], right[j]
                x, y = root(label[a]), root(label[b])
                if x != y:
                    group[max(x, y)] = min(x, y)
                    out.append((ids[a], ids[b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    met = _by_cell(near.join(sets.select("doc_id", "shingles"), "doc_id").select("key", "p", "q", "doc_id", "label", "side", "shingles"))
    links = materialise(met.mapInArrow(tidy(run), "a long, b long"), "bridges")
    release(near, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest id reachable) of every end of a link (a, b).

    Alternating large-star and small-star rounds until nothing moves; each
    round is two grouped minima over the links and is written to the shared
    folder.
    """
    edges = materialise(links.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
    before = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        small_min = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_min, "hi").select(F.explode(F.array("lo", "hi")).alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        last, edges = edges, materialise(small, "stars")
        release(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    grown = edges.groupBy("hi").agg(F.min("lo").alias("component_id")).select(F.col("hi").alias("doc_id"), "component_id")
    return grown.union(grown.select(F.col("component_id").alias("doc_id"), "component_id").distinct())


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A
    document's set is its distinct ``width``-word shingles; with fewer words
    the whole sequence is one shingle; without words, and for a null text, the
    set is empty and linked with nothing.  Documents with ``100 * intersection
    >= percent * union`` are linked; component_id is the smallest doc_id
    reachable.  ``kept`` marks the document whose id that is.

    Rows that repeat a doc_id are one node each time with their own set; they
    share a component if their sets are linked with each other, and all rows
    that carry the component's id are kept.  A row with a null doc_id keeps a
    null component and is kept.  An empty table gives an empty one; other
    columns are not read.
    """
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialise(signatures(texts, width).withColumn("row", F.monotonically_increasing_id()), "signatures")
    filled = marked.where("n_shingles > 0 and doc_id is not null")
    heads = materialise(filled.groupBy("set_key").agg(F.min(F.struct("doc_id", "row")).alias("head")).select("set_key", F.col("head.doc_id").alias("rep"), "head.row"), "classes")
    reps = materialise(filled.select("row", "doc_id", "n_shingles", "keys", "sketch").join(heads.select("row"), "row", "left_semi").drop("row"), "representatives")
    marks = reps.select("doc_id", "sketch")
    rows = reps.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last")).where("centre != last")
    buckets = materialise(rows.join(shared.select("key", "centre"), "key"), "buckets")
    most = largest_difference(percent / 100)
    stars = buckets.where("doc_id != centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    starred = _linked(_near(stars, marks, most), texts, width, percent)
    labels = materialise(components(starred).withColumnRenamed("component_id", "label"), "labels")
    release(starred)
    others = _bridges(_apart(buckets.select("key", "doc_id", "n_shingles"), marks, labels, most), texts, width, percent)
    linked = components(labels.select(F.col("label").alias("a"), F.col("doc_id").alias("b")).union(others))
    release(others, labels, buckets, reps)
    classes = heads.join(linked.withColumnRenamed("doc_id", "rep"), "rep", "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    out = marked.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

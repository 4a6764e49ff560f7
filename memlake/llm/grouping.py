"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces shorter than a sequence are dealt into districts of a bounded number of
pieces.  A district is first packed best-fit, longest piece first; if that
takes more sequences than its tokens need at least, islands evolve packings of
it: a crossover injects whole well-filled sequences of one parent into the
other, dissolves the sequences that hold an injected piece too, lets displaced
pieces trade places with shorter ones, and places the rest best-fit.  After each epoch every island's best packing
migrates to the next island.  A packing that reaches the bound is optimal and
ends the search.  The emptiest sequences of all districts are packed again in
districts of their own, level by level, so what districts waste adds up to
little.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise, release, shuffle_width, tidy
from .tokens import encoder

#: Pieces in a district; sequences of a district that go to the next level.
DISTRICT, RELEASED = 4096, 4
#: Islands of a district, epochs, packings on an island, crossovers in an epoch.
ISLANDS, EPOCHS, PACKINGS, CROSSOVERS = 3, 2, 5, 40

Packing = list[list[int]]
#: A packing and the tokens that each of its sequences holds.
Filled = tuple[Packing, list[int]]


def filled(bins: Packing, lengths: list[int]) -> Filled:
    """``bins`` with what each of them holds, which the steps below keep up to date."""
    return bins, [sum([lengths[i] for i in held]) for held in bins]


def place_best_fit(bins: Packing, pieces: list[int], lengths: list[int], size: int, fills: list[int] | None = None) -> Packing:
    """``bins`` with ``pieces`` added, longest first, each where the least room is left; opens bins as needed."""
    fills = filled(bins, lengths)[1] if fills is None else fills
    many = len(bins) + len(pieces) + 1  # a pair (room, sequence) is one number, room * many + sequence
    gaps = sorted([(size - fill) * many + b for b, fill in enumerate(fills)])
    for i in sorted(pieces, key=lengths.__getitem__, reverse=True):
        length = lengths[i]
        k = bisect_left(gaps, length * many)
        if k < len(gaps):
            gap = gaps.pop(k)
            b = gap % many
            bins[b].append(i)
            fills[b] += length
        else:
            gap = size * many + len(bins)
            bins.append([i])
            fills.append(length)
        gap -= length * many
        if gap >= many:
            insort(gaps, gap)
    return bins


def rank(fills: list[int], size: int) -> tuple[int, float]:
    """Smaller is better: fewer sequences, then fuller ones beside emptier ones."""
    return len(fills), -sum([(fill / size) ** 2 for fill in fills])


def trade(bins: Packing, displaced: list[int], lengths: list[int], size: int, fills: list[int]) -> list[int]:
    """Fill sequences further: in each, the displaced piece that gains most takes a shorter one's place; returns what is displaced then."""
    many = len(lengths)  # a pair (-length, piece) is one number, piece - length * many
    out = sorted([i - lengths[i] * many for i in displaced])
    for b, held in enumerate(bins):
        gap, gain = size - fills[b], 0
        if not gap:
            continue
        for at, i in enumerate(held):
            length = lengths[i]
            k = bisect_left(out, -(length + gap) * many)
            if k < len(out) and lengths[out[k] % many] - length > gain:
                gain, best = lengths[out[k] % many] - length, (at, k)
                if gain == gap:  # no other fills it further
                    break
        if gain:
            at, k = best
            i, held[at] = held[at], out.pop(k) % many
            insort(out, i - lengths[i] * many)
            fills[b] += gain
    return [pair % many for pair in out]


def cross(one: Packing, other: Packing, lengths: list[int], size: int, draw: random.Random) -> Packing:
    """``one`` with half of the well-filled sequences of ``other`` injected; its emptiest and a few others are packed anew."""
    return cross_filled(filled(one, lengths), filled(other, lengths), lengths, size, draw)[0]


def cross_filled(one: Filled, other: Filled, lengths: list[int], size: int, draw: random.Random) -> Filled:
    """``cross`` for packings whose fills are known, so that none is summed up again."""
    order = sorted(range(len(other[0])), key=other[1].__getitem__, reverse=True)
    full = order[: max(1, len(order) // 2)]
    injected = draw.sample(full, max(1, len(full) // 2))
    bins, fills = [list(other[0][b]) for b in injected], [other[1][b] for b in injected]
    taken = {i for held in bins for i in held}
    displaced = []
    for held, fill in zip(*one, strict=True):
        if taken.isdisjoint(held):
            bins.append(list(held))
            fills.append(fill)
        else:
            displaced += [i for i in held if i not in taken]
    order = sorted(range(len(bins)), key=fills.__getitem__)
    few = max(2, len(bins) // 32)
    displaced += [i for b in order[:few] for i in bins[b]]
    order = order[few:]
    for _ in range(min(few, len(order) - 1)):
        displaced += bins[order.pop(draw.randrange(len(order)))]
    bins, fills = [bins[b] for b in order], [fills[b] for b in order]
    rest = trade(bins, displaced, lengths, size, fills)
    return place_best_fit(bins, rest, lengths, size, fills), fills


def evolve(packings: list[Packing], lengths: list[int], size: int, bound: int, seed: str, crossovers: int = CROSSOVERS) -> Packing:
    """The best packing of an island after an epoch; it begins with ``packings`` and random ones."""
    draw = random.Random(seed)
    held = [filled(list(map(list, p)), lengths) for p in packings]
    while len(held) < PACKINGS:
        pieces, fills = list(range(len(lengths))), []
        draw.shuffle(pieces)
        early = place_best_fit([], pieces[: len(pieces) // 4], lengths, size, fills)  # some pieces at random, then the rest
        held.append((place_best_fit(early, pieces[len(pieces) // 4 :], lengths, size, fills), fills))
    ranked = sorted(((rank(p[1], size), k, p) for k, p in enumerate(held)), key=lambda x: x[:2])
    for k in range(crossovers):
        if ranked[0][0][0] <= bound:
            break
        one, other = draw.sample(ranked, 2)
        child = cross_filled(one[2], other[2], lengths, size, draw)
        ranked[-1] = (rank(child[1], size), len(held) + k, child)
        ranked.sort(key=lambda x: x[:2])
    return ranked[0][2][0]


def _bins_of(assigned: bytes) -> Packing:
    found: dict[int, list[int]] = {}
    for i, b in enumerate(np.frombuffer(assigned, "<i4").tolist()):
        found.setdefault(b, []).append(i)
    return list(found.values())


def _assigned(bins: Packing, n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for b, held in enumerate(bins):
        out[held] = b
    return out.tobytes()


#: One row a district: which pieces it has (binary int32, int64, int32) and each one's sequence there.
_SOLVED = "district long, parts binary, rows binary, lengths binary, bound int, bins binary, n_bins int"
_ELITE = "district long, lengths binary, bound int, island int, bins binary, n_bins int, waste double"


def _solve(pool: DataFrame, districts: int, size: int) -> DataFrame:
    """Every district's packing as a row of ``_SOLVED``, written."""

    def begin(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["part", "row"])
        lengths = held["length"].tolist()
        bins = place_best_fit([], list(range(len(lengths))), lengths, size)
        columns = [held["district"].iloc[0], held["part"].to_numpy("<i4").tobytes(), held["row"].to_numpy("<i8").tobytes(), held["length"].to_numpy("<i4").tobytes()]
        return pd.DataFrame([[*columns, -(-sum(lengths) // size), _assigned(bins, len(lengths)), len(bins)]], columns=[c.split()[0] for c in _SOLVED.split(", ")])

    solved = materialise(pool.groupBy("district").applyInPandas(begin, _SOLVED), "districts")
    elite = solved.where("n_bins > bound").selectExpr("district", "lengths", "bound", "bins", "cast(null as binary) as guest")
    if not elite.head(1):
        return solved
    elite = elite.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    for epoch in range(EPOCHS):

        def work(batches: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.itertuples(index=False):
                    lengths = np.frombuffer(r.lengths, "<i4").tolist()
                    start = [_bins_of(b) for b in (r.bins, r.guest) if b is not None]
                    best = evolve(start, lengths, size, r.bound, f"{r.district}:{r.island}:{epoch}")
                    n, waste = rank(filled(best, lengths)[1], size)
                    out.append((r.district, r.lengths, r.bound, r.island, _assigned(best, len(lengths)), n, waste))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _ELITE.split(", ")])

        # A number of its own: by their bytes, hours of work would be one task's.  The key is another than the join's, whose exchange would else do for both.
        spread = elite.repartition(min(districts * ISLANDS, max(shuffle_width(pool.sparkSession), districts * ISLANDS // 32)), F.xxhash64("district", "island"))
        evolved = materialise(spread.mapInPandas(work, _ELITE), "islands")
        done = evolved.where("n_bins <= bound").select("district").distinct()
        guests = evolved.select("district", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("bins").alias("guest"))
        elite = evolved.join(done, "district", "left_anti").join(guests, ["district", "island"]).select("district", "lengths", "bound", "bins", "guest", "island")
        better = evolved.groupBy("district").agg(F.min_by(F.struct("bins", "n_bins"), F.struct("n_bins", "waste", "island")).alias("best"))
        joined = solved.join(better, "district", "left")
        took = F.col("best").isNotNull() & (F.col("best.n_bins") < F.col("n_bins"))
        after = joined.select("district", "parts", "rows", "lengths", "bound", F.when(took, F.col("best.bins")).otherwise(F.col("bins")).alias("bins"), F.when(took, F.col("best.n_bins")).otherwise(F.col("n_bins")).alias("n_bins"))
        after = materialise(after, "districts")
        release(solved)
        solved = after
        if not elite.head(1):
            break
    return solved


def _unfold(solved: DataFrame, size: int, released: int) -> DataFrame:
    """One row a piece: part, row, length, district, bin, offset, and whether it goes to the next level."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                parts, rows, lengths, bins = (np.frombuffer(r[c], t) for c, t in (("parts", "<i4"), ("rows", "<i8"), ("lengths", "<i4"), ("bins", "<i4")))
                fill = np.bincount(bins, weights=lengths)
                emptiest = np.argsort(fill, kind="stable")[:released]
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order], dtype=np.int64)
                first = np.flatnonzero(np.concatenate([[True], bins[order][1:] != bins[order][:-1]]))
                began = (ends - lengths[order])[first]
                offset = np.zeros(len(bins), np.int64)
                offset[order] = ends - lengths[order] - np.repeat(began, np.diff(np.append(first, len(bins))))
                again = np.isin(bins, emptiest[fill[emptiest] < size])
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(rows), pa.array(lengths), pa.array(np.full(len(bins), r["district"])), pa.array(bins), pa.array(offset), pa.array(again)], ["part", "row", "length", "district", "bin", "offset", "again"])

    return solved.mapInArrow(each, "part int, row long, length int, district long, bin int, offset long, again boolean")


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to written pieces with ``part``, ``row`` (together unique) and ``length`` (1 to ``size``).

    Pieces as long as a sequence are sequences already.  Districts are packed
    in tasks of their own; driver and tasks see ``DISTRICT`` pieces at most at
    a time (more by the unevenness of a hash).  Levels end with one district,
    or where the next would not have half as many.
    """
    pool = pieces.where(F.col("length") < size).select("part", "row", F.col("length").cast("int").alias("length"))
    n, before, placed = pool.count(), 0, None
    districts = -(-n // DISTRICT)
    spot = F.xxhash64("part") + F.col("row")  # in turn
    while n:
        dealt = pool.withColumn("district", F.pmod(spot, F.lit(districts)))
        solved = _solve(dealt, districts, size)
        rows = _unfold(solved, size, RELEASED if districts > 1 else 0)
        n, further = 0, 0
        if districts > 1:
            rows = materialise(rows, "placements")
            n = rows.where("again").count()
            further = -(-n // DISTRICT)
        ended = n == 0 or 2 * further > districts
        kept = rows if ended else rows.where("not again")
        kept = kept.select("part", "row", (((F.col("district") + before) * (1 << 20) + F.col("bin")) * 2 + 1).alias("sequence_id"), "offset")
        placed = kept if placed is None else placed.unionByName(kept)
        if ended:
            break
        pool, before, districts = rows.where("again").select("part", "row", "length"), before + districts, further
        spot = F.xxhash64("part", "row", F.lit(before))
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", (F.col("part").cast("long") * (1 << 36) + F.col("row")) * 2).withColumn("offset", F.lit(0).cast("long"))
    if placed is not None:
        # Joined alike at every size: a broadcast would do for small tables only.
        full = full.unionByName(pieces.where(F.col("length") < size).join(placed.hint("shuffle_merge"), ["part", "row"]))
    return full.drop("part", "row")


def document_pieces(documents: DataFrame, tokenizer: str, end_id: int, size: int, drops_space: bool = False) -> DataFrame:
    """Every whole text's ids and the end id, longer ones cut into pieces of ``size``; a first piece may be shorter.

    Returns doc_id, piece, start, length, ids (uint32, little-endian) and the
    place of the row (part, row), which ``pack`` needs written.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, part, seen = encoder(tokenizer, drops_space), TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, row = batch.column("doc_id"), 0
            for ids, n in work.encode(batch.column("text")):
                ids = np.insert(ids, np.cumsum(n), np.uint32(end_id)).astype("<u4")
                n = n + 1
                many = -(-n // size)
                which = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                short = (n - (many - 1) * size)[which]
                start = np.where(piece == 0, 0, short + (piece - 1) * size)
                length = np.where(piece == 0, short, size)
                bounds = pa.py_buffer(np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32).tobytes())
                values = pa.Array.from_buffers(pa.binary(), len(which), [None, bounds, pa.py_buffer(ids.tobytes())])
                columns = [doc_ids.take(pa.array(row + which)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), values, pa.array(np.full(len(which), part, np.int32)), pa.array(np.arange(seen, seen + len(which)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "part", "row"])
                row, seen = row + len(n), seen + len(which)

    schema = "doc_id long, piece int, start long, length long, ids binary, part int, row long"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(cut), schema)


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id and offset of all documents' pieces.

    A null text is empty and makes one piece that holds the end id; rows that
    repeat an id, or have none, make their own pieces each.  Texts may be of
    any length.  An empty table gives an empty one; other columns are not read.
    """
    return pack(materialise(document_pieces(documents, tokenizer, end_id, size), "pieces"), size)

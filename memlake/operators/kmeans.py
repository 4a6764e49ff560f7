"""Spherical k-means: k-means|| seeding and Lloyd rounds as sums that each task makes for itself.

Vectors count by their direction, in whole multiples of 2**-30, so sums are
exact and the result does not depend on how rows are dealt.  The driver holds
the centres (k rows) and, while seeding, the candidates (about ``OVER`` * k a
round).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.storage import checkpointed

#: Fixed-point scale of unit vectors; seeding rounds, and candidates a round as a multiple of k.
SCALE, SEEDING, OVER = 1 << 30, 4, 2
#: Rows that a task looks at together.
CHUNK = 4096


def units(values: np.ndarray) -> np.ndarray:
    """Rows of length ``SCALE``, as integers."""
    x = values.astype(np.float64)
    return np.rint(x / np.sqrt((x * x).sum(axis=1))[:, None] * SCALE).astype(np.int64)


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centre of largest cosine (ties: the smaller number), and 1 - cosine in multiples of 2**-20."""
    score = np.rint((rows / SCALE) @ (centres / np.maximum(np.linalg.norm(centres.astype(np.float64), axis=1), 1e-300)[:, None]).T * (1 << 20)).astype(np.int64)
    which = score.argmax(axis=1)
    return which, np.maximum((1 << 20) - score[np.arange(len(rows)), which], 0)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """id, vec of rows with an id and a finite vector of this dimension that isn't zero."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("id").isNotNull() & (F.size("vec") == dim) & finite & F.exists("vec", lambda x: x != 0)).select("id", F.col("vec").cast("array<double>").alias("vec"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield part, units(_matrix(part.column("vec"), dim))


def _sums(rows: DataFrame, centres: np.ndarray, dim: int) -> dict[int, tuple[int, int, list[int]]]:
    """For each centre with rows: how many, their summed distance, and the sum of their units."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, total = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64), np.zeros((len(centres), dim), np.int64)
        for _, x in _blocks(batches, dim):
            which, far = nearest(x, centres)
            n += np.bincount(which, minlength=len(centres))
            np.add.at(cost, which, far)
            np.add.at(total, which, x >> 10)  # sums of a task fit 64 bits up to 2**43 rows
        for c in np.flatnonzero(n):
            yield pa.RecordBatch.from_pydict({"c": pa.array([c], pa.int32()), "n": [int(n[c])], "cost": [int(cost[c])], "i": pa.array([list(range(dim))], pa.list_(pa.int32())), "x": [total[c].tolist()]})

    parts = rows.mapInArrow(part, "c int, n long, cost long, i array<int>, x array<long>")
    head = parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    axes = parts.select("c", F.explode(F.arrays_zip("i", "x")).alias("p")).groupBy("c", "p.i").agg(F.sum("p.x").alias("x"))
    per = axes.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("x"))
    return {r["c"]: (r["n"], r["cost"], r["x"]) for r in head.join(per, "c").collect()}  # one row a centre


def reduce_candidates(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the candidates by weighted k-means++ (all, if there are no more)."""
    draw, chosen = np.random.default_rng(seed), [int(weights.argmax())]
    far = nearest(points, points[chosen])[1]
    while len(chosen) < min(k, len(points)):
        mass = far * weights
        mass[chosen] = 0
        if not mass.sum():
            break
        chosen.append(int(np.searchsorted(np.cumsum(mass), draw.integers(mass.sum()), "right")))
        far = np.minimum(far, nearest(points, points[chosen[-1:]])[1])
    return points[chosen]


def seeds(rows: DataFrame, k: int, dim: int, seed: int = 0) -> np.ndarray:
    """Starting centres by k-means||: rows far from all candidates so far become candidates with a probability that grows with their distance."""
    first = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).collect()
    if not first:
        return np.zeros((0, dim), np.int64)
    centres = units(np.array([first[0]["vec"]]))
    for turn in range(SEEDING):
        held = _sums(rows, centres, dim)
        cost = sum(v[1] for v in held.values())
        if not cost:
            break
        now = centres

        def draw(batches: Iterator[pa.RecordBatch], now: np.ndarray = now, cost: int = cost) -> Iterator[pa.RecordBatch]:
            for part, x in _blocks(batches, dim):
                chance = OVER * k * nearest(x, now)[1] / cost
                yield part.filter(pa.array(part.column("u").to_numpy() < chance)).select(["id", "vec"])

        uniform = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(turn + 1)), F.lit(1 << 40)) / float(1 << 40)
        found = rows.withColumn("u", uniform).mapInArrow(draw, rows.schema).orderBy("id").collect()  # about OVER * k rows
        if found:
            centres = np.concatenate([centres, units(np.array([r["vec"] for r in found]))])
    weight = _sums(rows, centres, dim)
    return reduce_candidates(centres, np.array([weight.get(c, (0,))[0] for c in range(len(centres))]), k, seed)


def moved(centres: np.ndarray, held: dict[int, tuple]) -> np.ndarray:
    """Centres at the summed directions of their rows; those without rows stay."""
    out = centres.copy()
    for c, (_, _, x) in held.items():
        if any(x):
            out[c] = units(np.array([x], np.float64))[0]
    return out


def fit(rows: DataFrame, k: int, rounds: int, dim: int, seed: int = 0) -> np.ndarray:
    """Centres after so many Lloyd rounds, fewer if nothing moves any more."""
    centres = seeds(rows, k, dim, seed)
    for _ in range(rounds if len(centres) else 0):
        after = moved(centres, _sums(rows, centres, dim))
        if (after == centres).all():
            break
        centres = after
    return centres


def assign(rows: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """id, vec, cluster, cosine of each row and its centre."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dim):
            which, far = nearest(x, centres)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), pa.array(which.astype(np.int32)), pa.array(1 - far / (1 << 20))], ["id", "vec", "cluster", "cosine"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(place, f"id {kind}, vec array<double>, cluster int, cosine double")


def kmeans(vectors: DataFrame, k: int, dim: int, rounds: int = 10, seed: int = 0) -> DataFrame:
    """id, cluster, cosine (to the cluster's centre, to 2**-20) of every usable vector (``usable``).

    Fewer different directions than ``k`` give fewer clusters; an empty table
    gives an empty result.  Rows that repeat an id are rows each.
    """
    rows = checkpointed(usable(vectors, dim))
    return assign(rows, fit(rows, k, rounds, dim, seed), dim).drop("vec") if rows.head(1) else rows.selectExpr("id", "cast(null as int) as cluster", "cast(null as double) as cosine")

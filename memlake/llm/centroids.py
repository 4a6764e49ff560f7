"""Exact centroid clustering (Lloyd rounds) in which Ptolemaic pivots rule centroids out.

Ptolemy's inequality holds for Euclidean distances: for a vector q, a centroid
o and pivots p, s

    d(q, o) * d(p, s) >= |d(q, p) * d(o, s) - d(q, s) * d(o, p)|.

The distances from vectors to pivots never change and are kept beside the
vectors; those from centroids to pivots are computed once a round.  A vector is
first compared with the centroid of its smallest bound; only centroids whose
bound, rounded down, does not exceed that distance are compared as well, in
integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise

#: Pivots (all their pairs serve), and rows looked at together.
PIVOTS, CHUNK = 8, 2048
#: Integer components are clamped to this magnitude; up to EXACT all squared distances fit 64 bits.
CLAMP, EXACT = 2**62, 2**27
#: Largest distance that the result's long columns can state.
LONG = 2**63 - 1
#: Share by which a bound is lowered against rounding; double arithmetic here errs by less than 2e-15.
SLACK = 1e-12


def _integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) as int64, or as Python integers where squares would not fit."""
    scaled = np.floor(values.astype(np.float64) * 256)
    if np.abs(scaled).max(initial=0) < EXACT:
        return scaled.astype(np.int64)
    clamped = [max(-CLAMP, min(CLAMP, int(x))) if np.isfinite(x) else int(np.sign(x)) * CLAMP for x in scaled.ravel()]
    return np.array(clamped, object).reshape(scaled.shape)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one point, or to a point each."""
    gap = rows - point
    return (gap * gap).sum(axis=1)


def pivot_pairs(pivots: np.ndarray) -> list[tuple[int, int, float]]:
    """All pairs of different pivots, with their distance."""
    pairs = ((p, s, float(_squared(pivots[p : p + 1], pivots[s])[0]) ** 0.5) for p, s in combinations(range(len(pivots)), 2))
    return [(p, s, d) for p, s, d in pairs if d > 0]


def lower_bounds(cached: np.ndarray, centres: np.ndarray, pairs: list[tuple[int, int, float]]) -> np.ndarray:
    """A lower bound of each vector's distance to each centroid, from both sides' distances to the pivots."""
    bound = np.zeros((len(cached), len(centres)))
    for p, s, apart in pairs:
        one, other = np.outer(cached[:, p], centres[:, s]), np.outer(cached[:, s], centres[:, p])
        np.maximum(bound, (np.abs(one - other) - SLACK * (one + other)) / apart, out=bound)
    return bound * (1 - SLACK)


def nearest(rows: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: np.ndarray, pairs: list) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), the squared distance, and how many distances were computed."""
    centres = np.stack([np.sqrt(_squared(centroids, p).astype(np.float64)) for p in pivots], axis=1)
    bound = lower_bounds(cached, centres, pairs)
    which = bound.argmin(axis=1)
    best = _squared(rows, centroids[which])
    reach = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    open_ = bound <= reach[:, None]
    open_[np.arange(len(rows)), which] = False
    for c in range(len(centroids)):
        at = np.flatnonzero(open_[:, c])
        if len(at):
            far = _squared(rows[at], centroids[c])
            better = (far < best[at]) | ((far == best[at]) & (c < which[at]))
            best[at[better]], which[at[better]] = far[better], c
    return which, best, len(rows) + int(open_.sum())


def _chunks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, CHUNK):
        part = batch.slice(at, CHUNK)
        yield part, _integers(_matrix(part.column("vec"), dim)), _matrix(part.column("cached"), len(part.column("cached")[0]))


def _objects(points: list[list[int]]) -> np.ndarray:
    """Points as int64 where all are small, else as Python integers."""
    small = all(abs(x) < EXACT for p in points for x in p)
    return np.array(points, np.int64 if small else object).reshape(len(points), -1)


def centroid_clusters(rows: DataFrame, clusters: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and n_compared of every usable vector.

    A component x counts as ``floor(256 * x)``.  Centroids start as the rows
    whose id has the smallest sha256 of ``<seed>:<id>``; each of the rounds
    assigns all rows and moves centroids to the floor of their rows' means;
    then rows are assigned once more.  ``n_compared`` is the number of exact
    distances that the row's chunk took in that last pass, a row.

    Vectors that are null, of another dimension, or hold null or non-finite
    components take no part.  Rows that repeat an id or a vector are rows
    each; a null id never starts a centroid.  Fewer rows with ids than
    ``clusters`` give fewer centroids; none, or an empty table, gives an empty
    result.  Integer components beyond 2**62 are clamped, distances beyond
    2**63 - 1 stated as that.  Other columns are not read.

    Every task sends at most one sum a cluster and dimension, so a round
    shuffles nothing that grows with the rows of a task, and a cluster that
    holds most rows is summed where they lie.  The driver sees ``clusters``
    points of ``dim`` integers.
    """
    spark, out = rows.sparkSession, "long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_compared double"
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & finite).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.where("id is not null").orderBy(draw, "vec").limit(clusters).collect()  # `clusters` rows
    if not first:
        return spark.createDataFrame([], f"{id_col} {out}")
    centroids = _objects(_integers(np.array([r["vec"] for r in first], np.float64)).tolist())
    pivots = centroids[:: max(1, len(centroids) // PIVOTS)][:PIVOTS]
    pairs = pivot_pairs(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.zeros((batch.num_rows, len(pivots)))
            for at in range(0, batch.num_rows, CHUNK):
                points = _integers(_matrix(batch.column("vec").slice(at, CHUNK), dim))
                for i, p in enumerate(pivots):
                    far[at : at + CHUNK, i] = np.sqrt(_squared(points, p).astype(np.float64))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(pivots))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(far.ravel()))], ["id", "vec", "cached"])

    held = materialise(kept.mapInArrow(measure, f"id long, vec {kept.schema['vec'].dataType.simpleString()}, cached array<double>"), "pivot-distances")

    def moved(centroids: np.ndarray) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = [[0] * dim for _ in centroids], np.zeros(len(centroids), np.int64)
            for batch in batches:
                for _, points, cached in _chunks(batch, dim):
                    which, _, _ = nearest(points, cached, centroids, pivots, pairs)
                    for c in np.unique(which):
                        total[c] = [a + int(b) for a, b in zip(total[c], points[which == c].sum(axis=0), strict=True)]
                    n += np.bincount(which, minlength=len(centroids))
            used = np.flatnonzero(n)
            values = [str(x) for c in used for x in total[c]]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, dim).astype(np.int32)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(used))), pa.array(values, pa.string()), pa.array(np.repeat(n[used], dim))], ["cluster", "axis", "total", "n"])

        parts = held.mapInArrow(sums, "cluster int, axis int, total string, n long")
        found = parts.groupBy("cluster", "axis").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        points = centroids.tolist()
        for r in found.collect():  # clusters * dim rows
            points[r["cluster"]][r["axis"]] = int(r["total"]) // r["n"]
        return _objects(points)

    for _ in range(rounds):
        centroids = moved(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, points, cached in _chunks(batch, dim):
                which, best, computed = nearest(points, cached, centroids, pivots, pairs)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(which.astype(np.int32)), pa.array(np.minimum(best, LONG).astype(np.int64)), pa.array(np.full(len(which), computed / len(which)))], ["id", "cluster", "distance", "n_compared"])

    assigned = materialise(held.mapInArrow(assign, "id long, cluster int, distance long, n_compared double"), "assigned")
    per = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # at most `clusters` rows
    capped = {r["cluster"]: int(r["total"]) for r in per}
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in centroids.tolist()]
    told = [(c, min(n, LONG), min(sum(capped.values()), LONG), digest[c]) for c, n in capped.items()]
    sums = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = assigned.join(F.broadcast(sums), "cluster")  # one row a cluster
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_compared")

"""Quality classifier: random-indexing word vectors and a small numpy network.

Random indexing gives each unit (a word, or the shape of a word) a sparse
random index vector that follows from its hash; a unit's vector is the sum of
the index vectors around its occurrences.  Documents pool the vectors of their
units; a two-layer network with a temperature fitted on a part kept aside
turns the pool into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import wordbatch as wb
from .tables import materialise, tidy

DIM = 64
#: Units with a vector: the most frequent of the fitting sample.
UNITS = 20_000
#: Labelled rows that the model is fitted on at most (those of the smallest id hashes).
SAMPLE = 12_000
EXTRA = 6
_PIECE = 1 << 18

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[0x80:] = ord("a")


def units(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of their shapes (runs of one character class as one), and the words' documents."""
    starts, ends, docs = wb.word_spans(data, offsets, first, last)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), docs
    lo, hi = int(starts[0]), int(ends[-1])
    kinds = _CLASS[data[lo:hi]]
    keep = np.ones(hi - lo, bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[starts - lo] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes = wb.hash_spans(kinds[keep], place[starts - lo], place[ends - lo])
    return wb.hash_spans(data, starts, ends), shapes ^ np.uint64(0xA5A5A5A5), docs


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """Sparse ternary vectors: four places of each half get plus or minus one."""
    out = np.zeros((len(hashes), DIM), np.float32)
    rows = np.arange(len(hashes))
    for j in range(8):
        r = wb.mix64(hashes + np.uint64(j))
        out[rows, (r % np.uint64(DIM)).astype(np.int64)] += np.where(r >> np.uint64(63), 1, -1)
    return out


def _pieces(column: pa.Array):
    data, offsets = wb.column_bytes(column)
    for first, last in wb.document_windows(offsets, _PIECE):
        yield (first, last, *units(data, offsets, first, last))


def _lookup(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in the sorted table; its length for what it lacks."""
    if not len(table):
        return np.zeros(len(hashes), np.int64)
    at = np.searchsorted(table, hashes)
    at[at == len(table)] = 0
    return np.where(table[at] == hashes, at, len(table))


@dataclass
class Model:
    """What scoring needs; its size is bounded by UNITS and DIM."""

    table: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_logits(self.layers, (pooled - self.mean) / self.scale) / self.temperature))


def pool(column: pa.Array, table: np.ndarray, vectors: np.ndarray) -> Iterator[np.ndarray]:
    """For runs of rows, in order: mean vector of words, of shapes, and six figures about them."""
    padded = np.vstack([vectors, np.zeros((1, DIM), np.float32)])
    for first, last, words, shapes, docs in _pieces(column):
        n = np.bincount(docs - first, minlength=last - first)
        out = np.zeros((last - first, 2 * DIM + EXTRA), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            at = (np.cumsum(n) - n)[some]
            for part, hashes in enumerate((words, shapes)):
                place = _lookup(table, hashes)
                for lo in range(0, len(some), 512):  # keeps the gathered rows small
                    hi = min(lo + 512, len(some))
                    stop = at[hi] if hi < len(some) else len(place)
                    out[some[lo:hi], part * DIM : (part + 1) * DIM] = np.add.reduceat(padded[place[at[lo] : stop]], at[lo:hi] - at[lo]) / n[some[lo:hi], None]
                known = np.add.reduceat((place < len(table)).astype(np.float32), at)
                out[some, 2 * DIM + 2 * part] = known / n[some]
                out[some, 2 * DIM + 2 * part + 1] = np.linalg.norm(out[some, part * DIM : (part + 1) * DIM], axis=1)
            order = np.lexsort((words, docs))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (words[order][1:] != words[order][:-1]) | (docs[order][1:] != docs[order][:-1])
            out[some, -2] = np.add.reduceat(fresh.astype(np.float32), at) / n[some]
            out[:, -1] = np.log1p(n)
        yield out


def _logits(layers, x):
    w1, b1, w2, b2 = layers
    return np.maximum(x @ w1 + b1, 0) @ w2 + b2


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, decay: float = 1e-3, seed: int = 3):
    """Two layers, Adam on the mean log loss."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.array(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    size = min(256, max(16, len(x) // 16))
    for _ in range(max(epochs, -(-600 * size // len(x)))):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), size):
            some = order[lo : lo + size]
            h = np.maximum(x[some] @ p[0] + p[1], 0)
            e = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[some]) / len(some)
            back = np.outer(e, p[2]) * (h > 0)
            grads = [x[some].T @ back + decay * p[0], back.sum(0), h.T @ e + decay * p[2], e.sum()]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on rows that the network has not seen."""
    grid = np.exp(np.linspace(np.log(0.5), np.log(10), 60))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -logits, logits) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on at most SAMPLE labelled documents; None if there is no label.

    ``labels`` holds doc_id and label (0 or 1); null labels and null ids are
    left out, a doc_id that repeats counts once (largest label, smallest text).
    Units beyond the UNITS most frequent of the sample, and those seen once,
    have no vector; documents meet them through their shapes and shares.
    """
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(SAMPLE)
    known = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most SAMPLE ids
    sample = materialise(known.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "quality-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, shapes, _ in _pieces(batch.column("text")):
                keys, n = np.unique(np.concatenate([words, shapes]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["unit", "n"])

    top = sample.select("text").mapInArrow(count, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "unit").limit(UNITS)
    table = np.sort(np.array([r["unit"] for r in top.select("unit").collect()], np.int64).view(np.uint64))  # at most UNITS rows
    own = index_vectors(table)
    blank = np.vstack([own, np.zeros((1, DIM), np.float32)])

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(table) + 1, DIM), np.float32)
        for batch in batches:
            for _, _, words, shapes, docs in _pieces(batch.column("text")):
                at, form = _lookup(table, words), _lookup(table, shapes)
                order = np.argsort(at, kind="stable")
                around = blank[form]
                for step in (1, 2):
                    near = np.zeros_like(around)
                    same = docs[step:] == docs[:-step]
                    near[step:][same] += blank[at[:-step][same]]
                    near[:-step][same] += blank[at[step:][same]]
                    around += near / step
                for unit in (at, form):
                    order = np.argsort(unit, kind="stable")
                    bounds = wb.group_bounds(unit[order])[:-1]
                    if len(order):
                        total[unit[order][bounds]] += np.add.reduceat(around[order], bounds)
        for lo in range(0, len(table), 1000):
            yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([total[lo : min(lo + 1000, len(table))].tobytes()], pa.binary())], ["lo", "total"])

    vectors = np.zeros((len(table), DIM), np.float32)
    for r in sample.select("text").coalesce(12).mapInArrow(context, "lo long, total binary").toLocalIterator():  # 12 tables of at most UNITS x DIM
        part = np.frombuffer(r["total"], np.float32).reshape(-1, DIM)
        vectors[r["lo"] : r["lo"] + len(part)] += part
    vectors += own
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.zeros((0, 2 * DIM + EXTRA), np.float32), *pool(batch.column("text"), table, vectors)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "label", "x"])

    rows = sorted(sample.select("doc_id", F.col("label").cast("long").alias("label"), "text").mapInArrow(features, "doc_id long, label long, x binary").collect(), key=lambda r: r["doc_id"])  # at most SAMPLE rows
    if not rows:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(np.float64)
    y = np.array([r["label"] for r in rows], np.float64)
    aside = wb.mix64(np.array([r["doc_id"] for r in rows], np.int64).view(np.uint64)) % np.uint64(5) == 0
    if len(np.unique(y[~aside])) < 2 or not aside.any():
        aside = np.zeros(len(y), bool)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    layers = train_network(z[~aside], y[~aside])
    temperature = fit_temperature(_logits(layers, z[aside]), y[aside]) if aside.any() else 1.0
    return Model(table, vectors, mean, scale, layers, temperature)


def with_score(documents: DataFrame, model: Model | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of each document, and the score of its whole text alone as ``name`` (a column of that name is replaced).

    The score estimates the probability of label 1.  Empty and null texts pool
    to zeros and get the network's answer for those; without a model (no label
    at all) every score is 0.5.  Rows are scored where they are, each on its
    own: null and repeated ids change nothing, and nothing is shuffled.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)  # bounded by UNITS x DIM
    rest = documents.drop(name)
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            if m is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = np.concatenate([np.zeros(0), *(m.score(x.astype(np.float64)) for x in pool(batch.column(text_col), m.table, m.vectors))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*names, name])

    return rest.mapInArrow(tidy(run), StructType([*rest.schema.fields, StructField(name, DoubleType())]))


def score(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document; ``with_score`` says how odd rows fare.  Other columns are not read."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_score(rows, model).select("doc_id", "score")

"""Vector search in blocks: exact block-at-a-time pruning, and an inverted multi-index.

Both searches lay the work out as a grid: candidates are dealt into shards of
bounded size, queries into groups of bounded size, and one task handles one
(group, shard) cell that some query needs.  A cell returns each query's best k
of the shard; a window over the few survivors picks the best k of all.  No list
of pairs is ever made.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import materialise, shuffle_width

#: Candidates in a shard, queries in a group, rows in a block, shards whose bounds are computed together.
SHARD, GROUP, BLOCK, BUNDLE = 32_768, 2048, 256, 64
#: Cells of one first half that a search visits together.
STEP = 4
#: Queries of a group that are scored at once.
_CHUNK = 256


def usable(rows: DataFrame, id_col: str, vec_col: str, dim: int, nonzero: bool = False) -> DataFrame:
    """``id`` and ``vec`` of the rows whose vector has ``dim`` finite components and whose id is known."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    keep = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & finite
    if nonzero:
        keep = keep & F.exists(vec_col, lambda x: x != 0)
    return rows.where(keep).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))


def _grouped(queries: DataFrame, n_queries: int) -> DataFrame:
    return queries.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n_queries // GROUP)))).cast("int"))


def _grid(asked: DataFrame, shards: DataFrame, cell, schema: str) -> DataFrame:
    """``cell(query rows, shard rows)`` for each (group, shard) that occurs among the queries."""
    pairs = asked.select(F.col("group").alias("team"), F.col("shard").alias("place")).distinct()
    needed = shards.join(pairs, F.col("shard") == F.col("place"))
    return asked.groupBy("group", "shard").cogroup(needed.groupBy("team", "place")).applyInPandas(cell, schema)


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores, who))
    named = who[order]
    return order[np.arange(len(named)) - np.searchsorted(named, named) < k]


def _matrix(column: pd.Series, dtype, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(dtype) if len(column) else np.zeros((0, dim), dtype)


def _edges(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest value of each dimension in each block of rows."""
    starts = np.arange(0, len(docs), BLOCK)
    return np.maximum.reduceat(docs, starts), np.minimum.reduceat(docs, starts)


def _bounds(query: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What each query can score at most in each block: the sum of its terms' maxima."""
    return np.maximum(query, 0) @ high.T + np.minimum(query, 0) @ low.T


def _exact(*parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The integer matrices as doubles where every product and sum is exact in them."""
    largest = np.prod([float(np.abs(x).max(initial=0)) for x in parts[:2]]) * parts[0].shape[1]
    return tuple(x.astype(np.float64) for x in parts) if largest < 2**52 else parts


def exact_topk(rows: DataFrame, queries: DataFrame, k: int, dim: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Each query's k highest integer inner products, exactly.

    A component x counts as ``floor(scale * x)``; positive and negative
    components are separate terms.  Candidates lie in blocks of consecutive
    ids; a block keeps its largest and smallest value of each dimension and
    its rows (the forward index).  A query's bound for a block is the sum of
    its terms' maxima; blocks are scored in order of their bounds until none
    reaches the query's kth best score.  The shard with a query's best block
    is scored first; its kth score there is where all other shards start, and
    shards whose bounds stay below it never see the query.

    Rows with an unusable vector (null, of another dimension, or with a null
    or non-finite component) or a null id take no part.  Rows that share the
    query's id are never its answers; a query id that repeats is one query
    (with the smallest vector), and rows that repeat an id are candidates
    each, spread over shards.  Ties go to the smaller id.  Products are
    64-bit; magnitudes from 2**62 up are not supported.  An empty table gives
    an empty one; other columns are not read.
    """
    spark = rows.sparkSession
    terms = F.transform("vec", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    candidates = usable(rows, id_col, vec_col, dim).select("id", terms.alias("vec"))
    asked = usable(queries, id_col, vec_col, dim).select("id", terms.alias("vec")).groupBy("id").agg(F.min("vec").alias("vec"))
    n, q = candidates.count(), asked.count()
    if not n or not q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_shards = -(-n // SHARD)
    ranges = candidates.withColumn("spot", F.xxhash64("vec")).repartitionByRange(n_shards, "id", "spot")
    shards = materialise(ranges.select("id", "vec", F.spark_partition_id().alias("shard")), "shards")
    asked = materialise(_grouped(asked, q), "queries")
    bundles = -(-n_shards // BUNDLE)

    def summarise(held: pd.DataFrame) -> pd.DataFrame:
        high, low = _edges(_matrix(held.sort_values("id", kind="stable")["vec"], np.int64, dim))
        return pd.DataFrame({"of": [held["shard"].iloc[0]], "high": [high.tobytes()], "low": [low.tobytes()]})

    def bound(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out, query = [], _matrix(asked["vec"], np.int64, dim)
        for of, high, low in zip(held["of"], held["high"], held["low"], strict=True):
            x, h, lo = _exact(query, *(np.frombuffer(e, np.int64).reshape(-1, dim) for e in (high, low)))
            out.append(pd.DataFrame({"query_id": asked["id"], "shard": of, "bound": _bounds(x, h, lo).max(axis=1).astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "shard": [], "bound": []}, dtype="int64")

    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        held = held.sort_values("id", kind="stable")
        ids, names = held["id"].to_numpy(), asked["id"].to_numpy()
        docs, query = _exact(_matrix(held["vec"], np.int64, dim), _matrix(asked["vec"], np.int64, dim))
        bounds = _bounds(query, *_edges(docs))
        order = np.argsort(-bounds, axis=1, kind="stable")
        start = asked["start"].to_numpy(np.float64, na_value=-np.inf)  # whole numbers; a lower bound may be rounded down
        best = np.full((len(names), k), -np.inf)  # scores so far, worst first
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for turn in range(order.shape[1]):
            block = order[:, turn]
            least = np.maximum(best[:, 0], start)
            open_ = np.flatnonzero(bounds[np.arange(len(names)), block] >= least)
            if not len(open_):
                break
            for b in np.unique(block[open_]):
                who = open_[block[open_] == b]
                at = slice(b * BLOCK, (b + 1) * BLOCK)
                points, mine = query[who] @ docs[at].T, ids[at]
                good = (points >= least[who, None]) & (mine[None, :] != names[who, None])
                r, c = np.nonzero(good)
                found.append((who[r], mine[c], points[r, c]))
                best[who] = np.sort(np.concatenate([best[who], np.where(good, points, -np.inf)], axis=1), axis=1)[:, -k:]
        who, mine, points = (np.concatenate(x) for x in zip(*found, strict=True))
        top = _top(who, mine, points, k)
        return pd.DataFrame({"query_id": names[who[top]], "vec_id": mine[top], "score": points[top].astype(np.int64)})

    hit = "query_id long, vec_id long, score long"
    summaries = shards.groupBy("shard").applyInPandas(summarise, "of int, high binary, low binary").withColumn("shard", F.floor(F.col("of") / BUNDLE).cast("int"))
    everywhere = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
    limits = materialise(_grid(everywhere, summaries, bound, "query_id long, shard int, bound long"), "bounds")
    first = limits.groupBy("query_id").agg(F.max_by("shard", F.struct("bound", -F.col("shard"))).alias("shard"))
    seats = first.select(F.col("query_id").alias("id"), "shard")
    begun = materialise(_grid(asked.join(seats, "id").withColumn("start", F.lit(None).cast("double")), shards, score, hit), "first-hits")
    kth = begun.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("start"))
    later = limits.join(first.withColumnRenamed("shard", "seat"), "query_id").where("shard != seat").join(kth, "query_id", "left").where("start is null or bound >= start")
    later = later.select(F.col("query_id").alias("id"), "shard", F.col("start").cast("double").alias("start"))
    return _best(begun.unionByName(_grid(asked.join(later, "id"), shards, score, hit)), k)


def _kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = points[np.random.default_rng(7).choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.argmin((centres**2).sum(1)[None, :] - 2 * points @ centres.T, axis=1)
        count = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, points)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int, step: int = 1) -> float:
    """Visit pairs of half-centroids by ascending summed distance, with a heap, until their cells hold ``wanted`` entries.

    ``sizes`` counts the entries of each pair; empty cells are passed over.
    The heap keeps each first half's nearest unvisited cells, ``step`` of them
    at a time under the sum of the last.  Returns the sum of the last pair
    visited: all cells up to it hold ``wanted`` entries or (with more than one
    a step) some more.
    """
    near = np.argsort(second, kind="stable")
    table = sizes[:, near]
    cells = np.flatnonzero(table > 0)
    if not len(cells):
        return -np.inf
    rows, columns = np.divmod(cells, len(second))
    sums, held = first[rows] + second[near][columns], table.ravel()[cells]
    begins = np.flatnonzero(np.diff(rows, prepend=-1))
    place = np.arange(len(cells)) - np.repeat(begins, np.diff(np.append(begins, len(cells))))
    starts = np.flatnonzero(place % step == 0)
    held = np.add.reduceat(held, starts).tolist()
    sums = sums[np.append(starts[1:], len(cells)) - 1].tolist()
    begins = np.flatnonzero(place[starts] == 0).tolist()
    ends = bytearray(len(sums))
    for b in [*begins[1:], len(sums)]:
        ends[b - 1] = 1
    heap, seen, last = [(sums[b], b) for b in begins], 0, -np.inf
    heapq.heapify(heap)
    while heap and seen < wanted:
        last, at = heap[0]
        seen += held[at]
        if ends[at]:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, (sums[at + 1], at + 1))
    return last


def inverted_multi_index(
    rows: DataFrame, queries: DataFrame, k: int, dim: int, id_col: str = "vec_id", vec_col: str = "embedding", centroids: int = 512, share: float = 0.3, sample: int = 16384
) -> DataFrame:
    """Each query's k nearest found by largest inner product.

    The two halves of a vector are quantised separately, each by ``centroids``
    means fitted on at most ``sample`` rows (those of the smallest id hashes);
    every row is indexed under its pair.  A query visits pairs in order of
    their summed distance (the negative inner product of each half) until the
    visited cells hold ``share`` of all entries, and reranks all entries of
    those cells.  The same rule holds at every size; README gives the recall.

    The index lies in shards of neighbouring first halves; a query goes only
    to shards that hold a cell it visits.  Cells of any size are split over
    shards by a hash of the id.

    Rows with an unusable vector (null, zero, of another dimension, or with a
    null or non-finite component) or a null id take no part.  Rows that share
    the query's id are never its answers; a query id that repeats is one query
    (with the smallest vector), rows that repeat an id are candidates each.
    Ties go to the smaller id; an empty table gives an empty one; other
    columns are not read.
    """
    spark = rows.sparkSession
    candidates = usable(rows, id_col, vec_col, dim, nonzero=True)
    asked = usable(queries, id_col, vec_col, dim, nonzero=True).groupBy("id").agg(F.min("vec").alias("vec"))
    some = candidates.orderBy(F.xxhash64("id"), "id", "vec").limit(sample).toPandas()  # bounded by `sample`
    if some.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points, half = _matrix(some["vec"], np.float64, dim), dim // 2
    halves = [_kmeans(points[:, :half], centroids), _kmeans(points[:, half:], centroids)]
    wide = len(halves[1])

    @F.pandas_udf("int")
    def cell_of(vec: pd.Series) -> pd.Series:
        x = _matrix(vec, np.float64, dim)
        if not len(x):
            return pd.Series([], dtype="int32")
        a, b = (np.argmin((c**2).sum(1)[None, :] - 2 * part @ c.T, axis=1) for part, c in zip((x[:, :half], x[:, half:]), halves, strict=True))
        return pd.Series((a * wide + b).astype(np.int32))

    index = materialise(candidates.withColumn("cell", cell_of("vec")), "multi-index")
    counted = index.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").toArrow()  # at most centroids**2 rows
    cells, sizes = (counted.column(c).to_numpy() for c in ("cell", "n"))
    across, down = cells // wide, cells % wide
    table = np.zeros((len(halves[0]), wide), np.int32)
    table[across, down] = sizes
    wanted = max(int(np.ceil(share * sizes.sum())), k + 1)
    # Shards: neighbouring first halves until one has SHARD entries; more parts for a larger one.
    total = np.bincount(across, weights=sizes, minlength=len(halves[0])).astype(np.int64)
    bundle = (np.cumsum(total) - total) // SHARD
    parts = np.maximum(1, -(-np.bincount(bundle, weights=total).astype(np.int64) // SHARD))
    base = np.cumsum(parts) - parts
    layout = spark.createDataFrame([(i, int(base[b]), int(parts[b])) for i, b in enumerate(bundle)], "half int, base int, parts int")
    q = asked.count()

    @F.pandas_udf("reach double, shards array<int>")
    def route(vec: pd.Series) -> pd.DataFrame:
        out = []
        for v in _matrix(vec, np.float64, dim):
            first, second = -(halves[0] @ v[:half]), -(halves[1] @ v[half:])
            limit = traverse(first, second, table, wanted, STEP)
            limit += 1e-9 * (1 + abs(limit))  # sums of the same cell may differ in their last bits
            near = np.unique(bundle[across[first[across] + second[down] <= limit]])
            out.append((limit, np.concatenate([np.arange(base[b], base[b] + parts[b]) for b in near])))
        return pd.DataFrame(out, columns=["reach", "shards"])

    def rerank(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})]
        if not asked.empty and not held.empty:
            ids, docs, cells = held["id"].to_numpy(), _matrix(held["vec"], np.float64, dim), held["cell"].to_numpy()
            names, query, reach = asked["id"].to_numpy(), _matrix(asked["vec"], np.float64, dim), asked["reach"].to_numpy()
            for lo in range(0, len(names), _CHUNK):
                x, name = query[lo : lo + _CHUNK], names[lo : lo + _CHUNK]
                sums = -(x[:, :half] @ halves[0].T)[:, cells // wide] - (x[:, half:] @ halves[1].T)[:, cells % wide]
                open_ = (sums <= reach[lo : lo + _CHUNK, None]) & (ids[None, :] != name[:, None])
                score = np.where(open_, x @ docs.T, -np.inf)
                least = np.partition(score, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(name), -np.inf)
                r, c = np.nonzero(open_ & (score >= least[:, None] - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))[:, None]))
                exact = np.einsum("ij,ij->i", x[r], docs[c])  # equal vectors get equal scores
                top = _top(r, ids[c], exact, k)
                out.append(pd.DataFrame({"query_id": name[r[top]], "vec_id": ids[c[top]], "score": exact[top]}))
        return pd.concat(out)

    dealt = index.withColumn("half", F.floor(F.col("cell") / wide).cast("int")).join(F.broadcast(layout), "half")  # one row a first half
    shards = dealt.select("id", "vec", "cell", (F.col("base") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))).cast("int").alias("shard"))
    spread = asked.repartition(max(1, min(shuffle_width(spark), q // 64)), F.xxhash64("id"))
    routed = spread.withColumn("route", route("vec"))
    left = materialise(_grouped(routed, q).select("id", "vec", "group", F.col("route.reach").alias("reach"), F.explode("route.shards").alias("shard")), "routes")
    return _best(_grid(left, shards, rerank, "query_id long, vec_id long, score double"), k)

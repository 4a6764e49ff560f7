"""A stored vector index: cells around k-means centres, probed in the order of each query.

The centres are fitted on a bounded sample of rows (``SAMPLE``); every row is
put into the cell of its nearest centre, and a cell's rows are dealt into parts
of bounded size, so a cell that holds most rows is many tasks' work.  A search
visits the cells nearest to the query until they hold ``share`` of all rows and
scores their rows exactly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators import kmeans
from memlake.operators.analyse import topk
from memlake.storage import checkpointed, read_text, write_text

#: Rows that the centres are fitted on at most, rows in a part of a cell, queries that meet a part together.
SAMPLE, PART, GROUP = 100_000, 8192, 1024


def build(vectors: DataFrame, root: str, dim: int, cells: int | None = None, rounds: int = 6) -> None:
    """Write an index of all usable vectors (id, vec); ``cells`` defaults to two fifths of their number, at most 4096.

    Many small cells order the rows finely for each query, which vectors
    without clusters need: on such, 0.4 n cells reach a recall of 0.95 where
    sqrt(n) cells reach 0.7, with a quarter of the rows visited.

    Rows without an id or with an unusable vector (``kmeans.usable``) are left out.
    """
    rows = checkpointed(kmeans.usable(vectors, dim))
    n = rows.count()
    k = cells or max(1, min(4096, 2 * n // 5))
    chance = min(1.0, SAMPLE / max(n, 1))
    sample = rows if chance == 1.0 else checkpointed(rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40)) < int(chance * (1 << 40))))
    centres = kmeans.fit(sample, k, rounds, dim)
    placed = checkpointed(kmeans.assign(rows, centres, dim)) if n else rows.withColumn("cluster", F.lit(0))
    sizes = {r["cluster"]: r["count"] for r in placed.groupBy("cluster").count().collect()}  # one row a cell
    parts = rows.sparkSession.createDataFrame([(c, -(-m // PART)) for c, m in sizes.items()], "cluster int, parts int")
    dealt = placed.join(F.broadcast(parts), "cluster")  # one row a cell
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int"))
    dealt.select(F.col("cluster").alias("cell"), "part", "id", "vec").write.mode("overwrite").parquet(f"{root}/rows")
    write_text(rows.sparkSession, f"{root}/cells", json.dumps({"dim": dim, "rows": n, "centres": centres.tolist(), "sizes": sizes}))


def visits(queries: np.ndarray, centres: np.ndarray, sizes: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Query places and cells: each query's nearest cells, until they hold ``share`` of all rows."""
    score = kmeans.units(queries) @ (centres / np.linalg.norm(centres.astype(np.float64), axis=1)[:, None]).T
    order = np.argsort(-score, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    use = (before < share * sizes.sum()) & (sizes[order] > 0)
    who, place = np.nonzero(use)
    return who, order[who, place]


def search(queries: DataFrame, root: str, k: int, share: float = 0.25) -> DataFrame:
    """The k rows of largest cosine among those visited, without the query's own id: qid, id, score, rank.

    ``queries`` has id and vec; unusable ones have no result.  The last cell
    that a query visits is looked at whole, so a little more than ``share`` of
    the rows is scored; with share 1 the result is exact.
    """
    spark = queries.sparkSession
    info = json.loads(read_text(spark, f"{root}/cells"))
    dim, centres = info["dim"], np.array(info["centres"], np.int64).reshape(-1, info["dim"])
    sizes = np.array([info["sizes"].get(str(c), 0) for c in range(len(centres))], np.int64)
    asked = kmeans.usable(queries, dim).dropDuplicates(["id"])
    kind = asked.schema["id"].dataType.simpleString()
    held = spark.read.parquet(f"{root}/rows")
    if not sizes.sum():
        return asked.selectExpr("id as qid", "id", "cast(0 as double) as score", "1 as rank").where("false")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                who, cell = visits(kmeans._matrix(part.column("vec"), dim), centres, sizes, share)
                named = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([named.column("id"), named.column("vec"), pa.array(cell.astype(np.int32)), pa.array((-(-sizes[cell] // PART)).astype(np.int32))], ["id", "vec", "cell", "parts"])

    groups = max(1, -(-asked.count() // GROUP))
    routed = asked.mapInArrow(route, f"id {kind}, vec array<double>, cell int, parts int")
    left = routed.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = checkpointed(left.select("cell", "part", "group", "id", "vec"))
    needed = left.select(F.col("cell").alias("in_cell"), F.col("part").alias("in_part"), F.col("group").alias("team")).distinct()
    right = held.join(needed, (F.col("cell") == F.col("in_cell")) & (F.col("part") == F.col("in_part"))).select("in_cell", "in_part", "team", "id", "vec")

    def cell(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = {"qid": [], "id": [], "score": []}
        if len(asked) and len(held):
            unit = lambda c: (x := np.stack(c.to_numpy())) / np.sqrt((x * x).sum(1))[:, None]
            ids, score = held["id"].to_numpy(), np.round(np.clip(unit(asked["vec"]) @ unit(held["vec"]).T, -1, 1), 9)
            for name, s in zip(asked["id"].to_numpy(), score, strict=True):
                order = np.lexsort((ids, -s))
                order = order[ids[order] != name]
                order = order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]  # an id counts by its best vector
                out["qid"] += [name] * len(order)
                out["id"] += ids[order].tolist()
                out["score"] += s[order].tolist()
        return pd.DataFrame(out)

    hits = left.groupBy("cell", "part", "group").cogroup(right.groupBy("in_cell", "in_part", "team")).applyInPandas(cell, f"qid {kind}, id {kind}, score double")
    return topk(hits.groupBy("qid", "id").agg(F.max("score").alias("score")), "qid", "score", "id", k)

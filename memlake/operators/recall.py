"""Retrieval flows: weighted ranking, routes fused with their reasons, gates, affinities, association and exploring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.functions.rules import content_words
from memlake.operators import analyse as A
from memlake.operators import graph as G
from memlake.operators import report as R
from memlake.operators import stored_index
from memlake.operators import vectors as V

# Bounds of the checks on candidates, bonus and penalty of exploring.
INTENT, SEMANTIC, ROOT_SIMILARITY, ROOT_CENTRED = 0.5, 0.75, 0.55, 0.18
ON_TOPIC, DRIFT, FEEDBACK = 0.10, 0.20, 0.30


def recall_fast(queries: DataFrame, mem: DataFrame, k: int, now_minutes: int, index: str | None = None) -> DataFrame:
    """BM25 times 1 + 0.1 ln(1 + decayed importance), each content once a query: qid, id, rank, score, normal.

    ``mem`` holds the rows a caller may see (id, content, importance,
    age_minutes); nothing is written back.  Copies are told by a digest, so
    texts don't travel with the scores.  With the path of a stored ``index``
    the words are looked up there and weighed by its statistics; what it holds
    beyond ``mem`` is left out of the ranking.
    """
    hours = F.floor((now_minutes - F.col("age_minutes")) / 60)
    prior = F.round(1 + 0.1 * F.log1p(F.col("importance") * X.decay(F.col("importance"), hours, F.lit(0.0))), 6)
    about = mem.select("id", prior.alias("prior"), F.sha2("content", 256).alias("digest"))
    found = A.bm25_points(queries, mem) if index is None else stored_index.points(queries, index)
    weighed = found.join(about, "id").withColumn("points", F.round(F.col("points") * F.col("prior")).cast("long"))
    first = F.row_number().over(W.partitionBy("qid", "digest").orderBy(F.desc("points"), "id"))
    best = A.topk(weighed.withColumn("nth", first).where("nth = 1"), "qid", "points", "id", k)
    return A.rank_normalise(best.select("qid", "id", "rank", (F.col("points") / 1e6).alias("score")), "score", "qid")


def recall_deep(queries: DataFrame, windows: DataFrame, visible: DataFrame, k: int, dim: int, bands: int = 24, bits: int = 8) -> DataFrame:
    """Rows whose text windows (several vectors an id) come nearest to a query vector, found through sign bands.

    An id counts by its best window that shares a band with the query;
    vectors of another dimension, and zero ones, never meet.
    """
    usable = A.checkpointed(windows.join(visible.select("id"), "id", "left_semi").select("id", "vec"))
    return V.vector_topk_lsh(queries, usable, k, dim, bands, bits)


def explain(runs: dict[str, DataFrame], weights: dict[str, float], k: int = 60) -> DataFrame:
    """Routes fused by reciprocal ranks: qid, id, rank, score, normal (best = 1), paths (``route:rank`` in order of name)."""
    every = None
    for name, run in runs.items():
        part = run.select("qid", "id", F.concat(F.lit(name + ":"), F.col("rank").cast("string")).alias("path"), (F.lit(weights.get(name, 1.0)) / (k + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("qid", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.array_join(F.array_sort(F.collect_list("path")), " ").alias("paths"))
    ranked = fused.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id")))
    return A.rank_normalise(ranked, "score", "qid").select("qid", "id", "rank", "score", "normal", "paths")


def result_reasons(results: DataFrame, relations: DataFrame) -> DataFrame:
    """Why two results (qid, id) of one query belong together: qid, a, b, relation for recorded pairs only.

    ``relations`` holds one row a pair (``graph.relations``), so the strongest
    kind explains it; a query with one result has no reasons.
    """
    left, right = (results.select("qid", F.col("id").alias(x)).distinct() for x in "ab")
    return relations.select("a", "b", "relation").join(left, "a").join(right, ["qid", "b"]).select("qid", "a", "b", "relation")


def recheck(candidates: DataFrame) -> DataFrame:
    """keep and evidence for candidates(overlap, bridge_hits, tag_hits, intent, semantic); null scores are no evidence."""
    evidence = (
        F.when(F.col("overlap") > 0, "words").when(F.col("bridge_hits") >= 2, "bridge").when(F.col("tag_hits") > 0, "tags").when(F.col("intent") >= INTENT, "intent").when(F.col("semantic") >= SEMANTIC, "semantic").otherwise("none")
    )
    return candidates.withColumn("evidence", evidence).withColumn("keep", F.col("evidence") != "none")


def root_gate(queries: DataFrame, pool: DataFrame, mem: DataFrame, centred: bool = False, most: int = 8, general: float = 0.35) -> DataFrame:
    """The record from which each query(qid, content) may start: qid, id, route (words, semantic or weak).

    ``pool`` holds ranked candidates (qid, id, rank, similarity or null), of
    which the first ``most`` count.  A record passes by min(2, n) of the
    query's n tokens (at least one); tokens in a share ``general`` of all
    records don't count.  Where none passes, similarity decides (0.55, or 0.18
    for centred vectors), records that aren't code first.  Else the route is
    weak and id null.
    """
    tokens = mem.select("id", F.explode(F.array_distinct(X.tokenize(F.col("content")))).alias("term"))
    wanted = queries.select("qid", F.explode(F.array_distinct(X.tokenize(F.col("content")))).alias("term"))
    of_query = tokens.join(wanted.select("term").distinct(), "term", "left_semi")
    total = mem.agg(F.count("*").alias("total"))
    common = of_query.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total)).where(F.col("df") >= general * F.col("total")).select("term")
    special = wanted.join(common, "term", "left_anti")
    need = special.groupBy("qid").agg(F.least(F.count("*"), F.lit(2)).alias("need"))
    first = pool.where(F.col("rank") <= most).select("qid", "id", "rank", "similarity")
    overlap = first.select("qid", "id").join(special, "qid").join(of_query, ["id", "term"]).groupBy("qid", "id").agg(F.count("*").alias("overlap"))
    seen = first.join(overlap, ["qid", "id"], "left").join(need, "qid", "left").join(mem.select("id", (F.col("memory_type") == "code_context").alias("code")), "id")
    by_words = F.col("overlap") >= F.coalesce("need", F.lit(1))
    by_vector = F.col("similarity") >= (ROOT_CENTRED if centred else ROOT_SIMILARITY)
    route = F.when(by_words, 0).when(by_vector, 1)
    order = F.struct("route", F.when(F.col("route") == 1, F.col("code")).otherwise(F.lit(False)).alias("code"), F.when(F.col("route") == 1, -F.col("similarity")).otherwise(F.col("rank").cast("double")).alias("key"), F.col("id"))
    best = seen.withColumn("route", route).where("route is not null").groupBy("qid").agg(F.min(order).alias("best"))
    named = F.when(F.col("best.route") == 0, "words").when(F.col("best.route") == 1, "semantic").otherwise("weak")
    return queries.select("qid").distinct().join(best, "qid", "left").select("qid", F.col("best.id").alias("id"), named.alias("route"))


def state_affinity(mem: DataFrame, distribution: DataFrame, now_minutes: int, least: float = 0.6, relative: bool = False, most: int = 3, stale_days: int = 7) -> DataFrame:
    """Old rows whose class weighs much in a state: state, id, score, rank; ties go to the older row.

    ``distribution`` has state, class, weight; ``mem`` id, class, age_minutes.
    ``relative`` takes the classes of positive z among the top three instead of
    those of weight ``least``.  All rows of a class score alike, so the
    ``most`` oldest of each class are enough, and only they meet the states.
    """
    old = mem.where((now_minutes - F.col("age_minutes") >= stale_days * 1440) & F.col("class").isNotNull())
    oldest = old.withColumn("nth", F.row_number().over(W.partitionBy("class").orderBy("age_minutes", "id"))).where(F.col("nth") <= most)
    if relative:
        scored = R.positive_topk_z(distribution, "state", "class", "weight", 3).withColumnRenamed("z", "score")
    else:
        scored = distribution.where(F.col("weight") >= least).withColumnRenamed("weight", "score")
    met = scored.select("state", "class", "score").join(oldest, "class")
    rank = F.row_number().over(W.partitionBy("state").orderBy(F.desc("score"), "age_minutes", "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= most).select("state", "id", "score", "rank")


def semantic_affinity(mem: DataFrame, anchor: list[float], now_minutes: int, most: int = 3, stale_days: int = 7) -> DataFrame:
    """Old rows (id, vec, age_minutes) that stand out by their cosine with ``anchor``, the common mean taken off: id, score."""
    dim = len(anchor)
    mean = V.mean_vector(mem, dim).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda x: x["mean"]).alias("mean"))
    off = lambda v: F.zip_with(v, F.col("mean"), lambda x, y: x.cast("double") - y)
    old = mem.where((F.size("vec") == dim) & (now_minutes - F.col("age_minutes") >= stale_days * 1440))
    score = X.cosine(off(F.col("vec")), off(F.array(*[F.lit(float(x)) for x in anchor])))
    rows = old.join(F.broadcast(mean)).select("id", F.lit(0).alias("all"), F.round(score, 9).alias("score")).where("score is not null")
    return R.zscore_threshold(rows, "all", "score").orderBy(F.desc("score"), "id").limit(most).select("id", "score")


def confirm(confirmations: DataFrame, live: DataFrame) -> DataFrame:
    """What a confirmed hit (event_id, id, source or null) sets off: event_id, log, id, source, value.

    Only rows in ``live`` (visible, not expired) count.  Each gives an
    activation and an audit row; one that came over an edge from another
    record also gives that edge positive feedback.
    """
    real = confirmations.join(live.select("id"), "id", "left_semi")
    entry = lambda name, source, value: F.struct(F.lit(name).alias("log"), source.alias("source"), F.lit(value).alias("value"))
    none = F.lit(None).cast(confirmations.schema["source"].dataType)
    rows = F.array(entry("activation", none, 1), entry("audit", none, 0), F.when(F.col("source").isNotNull() & (F.col("source") != F.col("id")), entry("edge_feedback", F.col("source"), 1)))
    return real.select("event_id", "id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("e")).select("event_id", "e.log", "id", "e.source", "e.value")


def expand(seeds: DataFrame, edges: DataFrame, contents: DataFrame, quota: int = 3) -> DataFrame:
    """Associated rows of each query that its ranking lacks: qid, id, place, hop, seed, similarity.

    ``seeds`` is the ranking (qid, id, rank), ``edges`` recorded relations (a,
    b, stored), ``contents`` the content words of the rows a caller may see.
    One hop goes before two and the lexically least similar row first; seeds
    take turns.  A stored edge's best row gets the last seat if it has none.
    """
    near = G.both_ways(edges.where("a != b").select("a", "b", "stored")).groupBy("a", "b").agg(F.max("stored").alias("stored"))
    start = seeds.select("qid", F.col("id").alias("seed"), F.col("rank").alias("seed_rank"))
    one = start.join(near, F.col("seed") == F.col("a")).select("qid", "seed", "seed_rank", F.col("b").alias("id"), "stored", F.lit(1).alias("hop"))
    two = one.select("qid", "seed", "seed_rank", F.col("id").alias("via")).join(near, F.col("via") == F.col("a")).select("qid", "seed", "seed_rank", F.col("b").alias("id"), F.lit(False).alias("stored"), F.lit(2).alias("hop"))
    fresh = one.unionByName(two).join(seeds.select("qid", "id"), ["qid", "id"], "left_anti")
    best = fresh.groupBy("qid", "id").agg(F.min(F.struct("hop", "seed_rank", "seed")).alias("best"), F.max("stored").alias("stored")).select("qid", "id", "stored", "best.*")
    words = contents.select("id", "words")
    scored = best.join(words, "id").join(words.select(F.col("id").alias("seed"), F.col("words").alias("of_seed")), "seed", "left")
    scored = scored.select("qid", "id", "stored", "hop", "seed_rank", "seed", F.round(X.word_jaccard(F.col("words"), F.col("of_seed")), 6).alias("similarity"))
    turn = F.row_number().over(W.partitionBy("qid", "seed").orderBy("hop", "similarity", "id"))
    turns = scored.withColumn("turn", turn).withColumn("turn_place", F.row_number().over(W.partitionBy("qid").orderBy("turn", "seed_rank", "id")))
    nth_stored = F.row_number().over(W.partitionBy("qid", "stored").orderBy("turn_place"))
    key = F.when(F.col("stored") & (F.col("nth") == 1), F.least(F.col("turn_place"), F.lit(quota - 0.5))).otherwise(F.col("turn_place"))
    seated = turns.withColumn("nth", nth_stored).withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(key, "turn_place")))
    return seated.where(F.col("place") <= quota).select("qid", "id", "place", "hop", "seed", "similarity")


def explore(candidates: DataFrame, recorded: DataFrame, roots: DataFrame, contents: DataFrame, feedback: DataFrame, depth: int = 4, width: int = 3, per_node: int = 6) -> DataFrame:
    """A beam walk from each root: root, level, parent, id, score, kind (recall or recorded).

    Each node's best width + 2 ``candidates`` (a, b, score) are scored again:
    + 0.10 for two content words or more in common with the root, - 0.20 for
    none, and 0.30 of the edge's ``feedback`` (a, b, adjust).  Rows that are
    code are left out unless the root is.  A node is reached once, from the
    parent where it scores best; each parent keeps ``width``.  Nodes on the
    way show up to ``per_node`` ``recorded`` edges (a, b, weight).  Levels
    (four at most) go through a reliable checkpoint, as do the candidates.
    """
    depth, width = min(max(depth, 1), 4), min(max(width, 1), 3)
    pool = A.checkpointed(A.topk(candidates.select("a", "b", "score"), "a", "score", "b", width + 2).drop("rank"))
    tuned = feedback.groupBy("a", "b").agg(F.sum("adjust").alias("adjust"))
    # Every level asks for the candidates and for the words of what they lead to: both are made once.
    met = roots.select("id").unionByName(pool.select(F.col("b").alias("id"))).distinct()
    about = A.checkpointed(contents.select("id", "words", "code").join(met, "id", "left_semi"))
    start = about.join(roots.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("root"), F.col("words").alias("root_words"), F.col("code").alias("root_code"))
    frontier = start.select("root", F.col("root").alias("node"))
    visited, walked = frontier, None
    for level in range(1, depth + 1):
        step = frontier.join(pool, F.col("node") == F.col("a")).select("root", "a", "b", "score").join(visited.select("root", F.col("node").alias("b")), ["root", "b"], "left_anti")
        known = step.join(tuned, ["a", "b"], "left").join(start, "root").join(about, F.col("b") == F.col("id")).where("root_code or not code")
        hits = F.size(F.array_intersect("root_words", "words"))
        score = F.col("score") + F.when(hits >= 2, ON_TOPIC).when(hits == 0, -DRIFT).otherwise(0.0) + FEEDBACK * F.coalesce("adjust", F.lit(0.0))
        scored = known.select("root", F.lit(level).alias("level"), F.col("a").alias("parent"), "id", F.round(score, 6).alias("score"))
        once = scored.withColumn("nth", F.row_number().over(W.partitionBy("root", "id").orderBy(F.desc("score"), "parent"))).where("nth = 1")
        kept = A.checkpointed(once.withColumn("nth", F.row_number().over(W.partitionBy("root", "parent").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= width).drop("nth"))
        walked = kept if walked is None else walked.unionByName(kept)
        frontier = kept.select("root", F.col("id").alias("node"))
        visited = visited.unionByName(frontier)
    nodes = start.select("root", F.lit(0).alias("level"), F.col("root").alias("parent")).unionByName(walked.select("root", "level", F.col("id").alias("parent")))
    best = A.topk(recorded.where("a != b").select("a", "b", "weight"), "a", "weight", "b", per_node).drop("rank")
    shown = nodes.join(best, F.col("parent") == F.col("a")).select("root", (F.col("level") + 1).alias("level"), "parent", F.col("b").alias("id"), F.round(F.col("weight").cast("double"), 6).alias("score"), F.lit("recorded").alias("kind"))
    return walked.withColumn("kind", F.lit("recall")).unionByName(shown)


def recall(runs: dict[str, DataFrame], weights: dict[str, float], mem: DataFrame, relations: DataFrame, vectors: DataFrame, k: int, quota: int = 3, fold: float = 0.90) -> DataFrame:
    """The whole flow from ranked routes to a result page: qid, id, rank, score, normal, paths, reasons.

    Routes are fused and cut to k; associated rows take seats at the end, and
    rows that resemble a better one are folded.  ``paths`` says which route
    found a row at which rank (associated rows have ``associated``),
    ``reasons`` counts the other results it is related to.  ``mem`` holds the
    rows a caller may see: all others drop out of the routes first.
    """
    ids = mem.select("id")
    fused = explain({n: run.join(ids, "id", "left_semi") for n, run in runs.items()}, weights)
    page = A.checkpointed(fused.where(F.col("rank") <= k))
    related = relations.select("a", "b", "relation", (F.col("relation") == "stored").alias("stored"))
    found = expand(page, related, mem.select("id", content_words(F.col("content")).alias("words")), quota)
    seated = R.slot_inject(page, found.select("qid", "id", "place"), k, quota)
    folded = G.fold_similar(seated.select("qid", "id", "rank"), vectors, fold).join(seated.select("qid", "id", "score"), ["qid", "id"])
    final = A.rank_normalise(folded, "score", "qid").withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank", "id")))
    pairs = result_reasons(final, relations)
    reasons = pairs.select("qid", F.col("a").alias("id")).unionByName(pairs.select("qid", F.col("b").alias("id"))).groupBy("qid", "id").agg(F.count("*").alias("reasons"))
    told = final.join(page.select("qid", "id", "paths"), ["qid", "id"], "left").join(reasons, ["qid", "id"], "left")
    return told.select("qid", "id", "rank", "score", "normal", F.coalesce("paths", F.lit("associated")).alias("paths"), F.coalesce("reasons", F.lit(0)).alias("reasons"))


#: A ranker takes queries(qid, content), a corpus and k, and returns qid, id, rank.
Ranker = Callable[[DataFrame, DataFrame, int], DataFrame]


def evaluate_rankers(rankers: dict[str, Ranker], queries: DataFrame, corpus: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Each ranker's result on each judged query: ranker and the columns of ``analyse.evaluate``."""
    every = None
    for name, ranker in rankers.items():
        part = A.evaluate(ranker(queries, corpus, k).select("qid", "id", "rank"), qrels, k).withColumn("ranker", F.lit(name))
        every = part if every is None else every.unionByName(part)
    return every


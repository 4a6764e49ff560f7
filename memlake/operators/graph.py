"""Recorded relations as edge tables (a, b, and more columns): neighbours, hops, indirect links, edge intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Edge types that may come from outside, and the loss of weight a hop.
LOGICAL = ("cause", "temporal", "constraint", "facilitate", "coordinate")
HOP_LOSS = 0.7


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select("a", "b", *rest).union(edges.select("b", "a", *rest))


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch an id, by relation: id, relation, sorted neighbours."""
    near = both_ways(edges.select("a", "b", "relation")).join(ids.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    return near.groupBy(F.col("a").alias("id"), "relation").agg(F.array_sort(F.collect_set("b")).alias("neighbours"))


def khop(edges: DataFrame, roots: DataFrame, hops: int, relations: list[str] | None = None) -> DataFrame:
    """Nodes within 1 to 3 hops of each root, at their first hop: root, node, hop, weight, relation, path.

    A node's weight is its best last edge, times 0.7 for each further hop;
    relation and path (root to node) are those of that edge, the smallest path
    among equals.  ``relations`` filters what is returned, not what is walked.
    Each hop is one join of the frontier; nodes already reached drop out, so
    no path has a loop.  A root without edges gives nothing.
    """
    near = both_ways(edges.select("a", "b", "weight", "relation"))
    frontier = roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct().withColumn("path", F.array("root"))
    seen, found = frontier.select("root", "node"), None
    for hop in range(1, min(max(hops, 1), 3) + 1):
        reached = frontier.join(near, frontier["node"] == near["a"]).select("root", F.col("b").alias("node"), "weight", "relation", F.concat("path", F.array("b")).alias("path"))
        best = F.min(F.struct((-F.col("weight")).alias("loss"), "path", "relation")).alias("best")
        step = reached.join(seen, ["root", "node"], "left_anti").groupBy("root", "node").agg(best)
        fresh = step.select("root", "node", F.lit(hop).alias("hop"), (-F.col("best.loss") * HOP_LOSS ** (hop - 1)).alias("weight"), "best.relation", "best.path")
        found = fresh if found is None else found.unionByName(fresh)
        frontier = fresh.select("root", "node", "path")
        seen = seen.unionByName(fresh.select("root", "node"))
    return found.where(F.col("relation").isin(*relations)) if relations else found


def indirect(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node two steps away that isn't a direct neighbour, how many nodes lie between, and the smallest of them."""
    near = both_ways(edges.select("a", "b")).distinct()
    first = roots.select(F.col("id").alias("root")).distinct().join(near, F.col("root") == near["a"]).select("root", F.col("b").alias("via"))
    second = first.join(near.withColumnRenamed("b", "node"), F.col("via") == F.col("a")).where("node != root").select("root", "node", "via")
    direct = first.withColumnRenamed("via", "node")
    return second.join(direct, ["root", "node"], "left_anti").groupBy("root", "node").agg(F.count("*").alias("paths"), F.min("via").alias("via"))


def indirect_paths(edges: DataFrame, roots: DataFrame, events: tuple[str, ...] = ("same_event", "same_event_auto")) -> DataFrame:
    """root, node, paths, path, via, why: nodes two typed steps away that are no direct neighbours.

    Two steps that are both membership in an event (``events``) are no path:
    they only say that all three share it.  ``path`` is root, the smallest
    node between and the node, ``via`` the two relations of that path (the
    smallest names), ``why`` says it in words; ``paths`` counts the nodes
    between.
    """
    near = both_ways(edges.select("a", "b", "relation")).where("a != b").distinct()
    first = roots.select(F.col("id").alias("root")).distinct().join(near, F.col("root") == near["a"]).select("root", F.col("b").alias("mid"), F.col("relation").alias("one"))
    then = near.select(F.col("a").alias("mid"), F.col("b").alias("node"), F.col("relation").alias("two"))
    merely = F.col("one").isin(*events) & F.col("two").isin(*events)
    second = first.join(then, "mid").where((F.col("node") != F.col("root")) & ~merely)
    direct = first.select("root", F.col("mid").alias("node")).distinct()
    best = F.min(F.struct("mid", "one", "two")).alias("best")
    found = second.join(direct, ["root", "node"], "left_anti").groupBy("root", "node").agg(F.count_distinct("mid").alias("paths"), best)
    why = F.format_string("%s and %s (%s), %s and %s (%s)", "root", "best.mid", "best.one", "best.mid", "node", "best.two")
    return found.select("root", "node", "paths", F.array("root", "best.mid", "node").alias("path"), F.concat_ws(" → ", "best.one", "best.two").alias("via"), why.alias("why"))


def ego_graph(edges: DataFrame, roots: DataFrame, max_nodes: int = 50) -> DataFrame:
    """The nearest nodes of each root (2 to 500 with it; nearest hop and highest weight first) with total and truncated."""
    most, mine = min(max(max_nodes, 2), 500), W.partitionBy("root")
    place = F.row_number().over(mine.orderBy("hop", F.desc("weight"), "node"))
    ranked = khop(edges, roots, 2).select("root", "node", "hop", "weight").withColumn("rank", place).withColumn("total", F.count("*").over(mine))
    return ranked.where(F.col("rank") < most).withColumn("truncated", F.col("total") >= most)


def ego_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The recorded edges among the nodes of each ego graph (root included): root, a, b, relation, direct (touches the root)."""
    held = nodes.select("root", "node").unionByName(nodes.select("root", F.col("root").alias("node"))).distinct()
    a, b = held.withColumnRenamed("node", "a"), held.withColumnRenamed("node", "b")
    met = edges.select("a", "b", "relation").join(a, "a").join(b, ["root", "b"])
    return met.select("root", "a", "b", "relation", ((F.col("a") == F.col("root")) | (F.col("b") == F.col("root"))).alias("direct"))


def ego_report(edges: DataFrame, roots: DataFrame, max_nodes: int = 50, events: tuple[str, ...] = ("same_event", "same_event_auto")) -> DataFrame:
    """root, nodes (with it), direct and indirect edges among them, total and truncated: the counts of an ego graph.

    Direct edges are recorded ones between two of its nodes, indirect ones
    lead from the root by ``indirect_paths`` to one of its nodes.
    """
    nodes = ego_graph(edges, roots, max_nodes)
    held = nodes.select("root", "node")
    sizes = nodes.groupBy("root").agg((F.count("*") + 1).alias("nodes"), F.max("total").alias("total"), F.max("truncated").alias("truncated"))
    direct = ego_edges(edges, held).groupBy("root").agg(F.count("*").alias("direct"))
    far = indirect_paths(edges, roots, events).join(held, ["root", "node"], "left_semi").groupBy("root").agg(F.count("*").alias("indirect"))
    joined = sizes.join(direct, "root", "left").join(far, "root", "left")
    return joined.select("root", "nodes", F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("indirect", F.lit(0)).alias("indirect"), "total", "truncated")


def ingest_edges(edges: DataFrame, alive: DataFrame, allowed: tuple[str, ...] = LOGICAL) -> DataFrame:
    """Edges from outside with their verdict: ok, loop, unknown_type or missing_end; types in either case."""
    ids = alive.select("id").distinct()
    a, b = (ids.select(F.col("id").alias(c), F.lit(True).alias("has_" + c)) for c in "ab")
    known = edges.withColumn("relation", F.lower("relation")).join(a, "a", "left").join(b, "b", "left")
    verdict = F.when(F.col("a") == F.col("b"), "loop").when(~F.col("relation").isin(*allowed), "unknown_type").when(F.col("has_a").isNull() | F.col("has_b").isNull(), "missing_end").otherwise("ok")
    return known.select("a", "b", "relation", verdict.alias("verdict"))


def decide_branch(scores: DataFrame, by: str, score: str) -> DataFrame:
    """contract, single or branch per group, and how many to follow.

    contract: the top is 0.85 or more and leads by 0.20; single: it leads by
    0.15; else branch on those of the top three with 80 % of the top, two at least.
    """
    ranked = scores.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score)))).where("r <= 3")
    top = F.max(F.when(F.col("r") == 1, F.col(score)))
    per = ranked.groupBy(by).agg(top.alias("top"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col(score))), F.lit(0.0)).alias("next"), F.collect_list(score).alias("s"))
    lead = F.round(F.col("top") - F.col("next"), 9)
    choice = F.when((F.col("top") >= 0.85) & (lead >= 0.20), "contract").when(lead >= 0.15, "single").otherwise("branch")
    wide = F.greatest(F.size(F.filter("s", lambda x: x >= 0.8 * F.col("top"))), F.lit(2))
    return per.withColumn("decision", choice).select(by, "decision", F.when(F.col("decision") == "branch", wide).otherwise(1).alias("width"))


def derived_from(mem: DataFrame) -> DataFrame:
    """Edges from a derived row to its sources that exist, and back as crystallized_into."""
    links = mem.select(F.col("id").alias("a"), F.explode("source_ids").alias("b")).distinct()
    real = links.join(mem.select(F.col("id").alias("b")), "b", "left_semi")
    return real.select("a", "b", F.lit("derived_from").alias("relation")).unionByName(real.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("crystallized_into").alias("relation")))


#: Why two rows are related, by kind of relation.
WHY = {"stored": "a recorded edge", "same_event": "the same event", "same_event_auto": "close in time", "shared_entity": "a shared name", "shared_artifact": "a shared file", "derived_from": "one was made from the other"}


def relations(parts: dict[str, DataFrame], mem: DataFrame | None = None, chars: int = 80) -> DataFrame:
    """Pairs of several kinds as one table: a, b, relation, kinds, why.

    The kind that comes first in ``parts`` explains a pair.  With ``mem`` (id,
    content) each pair also shows the head of its second row, ``preview``.
    """
    from memlake.functions.text import preview

    every = None
    for i, (name, f) in enumerate(parts.items()):
        part = f.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(name).alias("relation"), F.lit(i).alias("__i"))
        every = part if every is None else every.unionByName(part)
    told = F.create_map(*[F.lit(x) for kv in WHY.items() for x in kv])
    out = every.groupBy("a", "b").agg(F.min_by("relation", "__i").alias("relation"), F.count_distinct("relation").alias("kinds"))
    out = out.withColumn("why", F.coalesce(F.try_element_at(told, F.col("relation")), F.col("relation")))
    return out if mem is None else out.join(mem.select(F.col("id").alias("b"), preview(F.col("content"), chars).alias("preview")), "b", "left")


def unlinked(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    return candidates.join(both_ways(edges.select("a", "b")).distinct(), ["a", "b"], "left_anti")


def inferred_events(mem: DataFrame, group: str, at: str, window: str = "1 hour", least_span: int = 60) -> DataFrame:
    """Rows of one group in one time bucket as an event: two or more of them, ``least_span`` seconds each on average (faster ones are bulk loads)."""
    bucket = F.window(at, window)["start"].alias("bucket")
    seconds = F.unix_timestamp(F.max(at)) - F.unix_timestamp(F.min(at))
    events = mem.groupBy(group, bucket).agg(F.count("*").alias("size"), seconds.alias("span"))
    return events.where((F.col("size") >= 2) & (F.col("span") / F.col("size") >= least_span))


def gap_text(seconds: Column) -> Column:
    """A gap in words: seconds below two minutes, then whole minutes."""
    return F.when(seconds < 120, F.concat(seconds.cast("string"), F.lit("s"))).when(seconds.isNotNull(), F.concat(F.floor(seconds / 60).cast("string"), F.lit("min")))


def inferred_links(mem: DataFrame, group: str, at: str, window: str = "1 hour", least_span: int = 60, explicit: DataFrame | None = None) -> DataFrame:
    """Neighbours in time within each inferred event: a, b, bucket, gap; pairs in ``explicit`` (a, b) are left out.

    Each row is linked with the one before it, so an event of n rows has n - 1
    links; the bucket says what belongs together.
    """
    rows = mem.select("id", group, at, F.window(at, window)["start"].alias("bucket"))
    events = inferred_events(mem, group, at, window, least_span).select(group, "bucket")
    mine = W.partitionBy(group, "bucket").orderBy(at, "id")
    met = rows.join(events, [group, "bucket"])
    gap = F.unix_timestamp(F.col(at)) - F.unix_timestamp(F.lag(at).over(mine))
    linked = met.select(F.lag("id").over(mine).alias("p"), F.col("id").alias("q"), "bucket", gap_text(gap).alias("gap")).where("p is not null")
    pairs = linked.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "bucket", "gap")
    return pairs if explicit is None else pairs.join(explicit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")


def fold_similar(ranked: DataFrame, vectors: DataFrame, t: float) -> DataFrame:
    """Each query's ranking without rows that resemble a better kept one; rows without a vector stay.

    The walk is a fold over the ranking of one query, a result page that the
    ranker has cut to its k.
    """
    from memlake.functions.text import cosine

    rows = ranked.join(vectors.select("id", "vec"), "id", "left")
    page = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "vec"))).alias("rows"))
    none = F.slice(F.col("rows"), F.lit(1), F.lit(0))
    near = lambda y, x: F.coalesce(cosine(y["vec"], x["vec"]) >= t, F.lit(False))
    kept = F.aggregate("rows", none, lambda kept, x: F.when(F.exists(kept, lambda y: near(y, x)), kept).otherwise(F.concat(kept, F.array(x))))
    return page.select("qid", F.explode(kept).alias("r")).select("qid", "r.id", "r.rank")


def write_back(relations: DataFrame, weight: float = 1.0) -> DataFrame:
    """Relations of the record layer (a, b, relation) as edges: symmetric ones once, directed ones as they are."""
    from memlake.operators.store import edge_union

    return edge_union(relations.select("a", "b", "relation", F.lit(weight).alias("weight")))


def accept_edges(verdicts: DataFrame, stored: DataFrame | None = None, weight: float = 1.0) -> DataFrame:
    """The edges that ``ingest_edges`` found good, united with those stored (which keep their weight)."""
    from memlake.operators.store import edge_union

    good = verdicts.where("verdict = 'ok'").select("a", "b", "relation", F.lit(weight).alias("weight"))
    return edge_union(stored.select("a", "b", "relation", "weight"), good) if stored is not None else edge_union(good)

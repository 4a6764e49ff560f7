"""Statistics and reports over records, logs, edges, chunks and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.operators.analyse import entropy, evaluate, hubs
from memlake.operators.graph import gap_text
from memlake.operators.store import expired, visible

# Kinds of rows that are no incident, and the bounds of the health bands and latencies.
NO_INCIDENT = ("code_context", "synthesis")
POOR, FAIR = 30, 50
P50_MS, P95_MS = 500, 1000


def stats(mem: DataFrame, now_minutes: int) -> DataFrame:
    """One row of totals: all, by kind, expired, added in 7 days, with an event, with entities, projects, events, incident candidates."""
    of = lambda *t: F.count_if(F.col("memory_type").isin(*t))
    gone = expired(F.col("age_minutes"), F.col("ttl_days"), now_minutes)
    out = mem.agg(
        F.count("*").alias("total"), of("synthesis").alias("synthesis"), of("code_context").alias("code_context"), of("experience").alias("experience"), F.count_if(gone).alias("expired"),
        F.count_if(now_minutes - F.col("age_minutes") <= 7 * 1440).alias("added_7_days"), F.count("event_id").alias("with_event"), F.count_if(F.size("entities") > 0).alias("with_entity"),
        F.count_distinct("event_id").alias("events"), F.count_distinct(F.lower("project")).alias("projects"),
    )
    return out.withColumn("incident_candidates", F.greatest(F.expr("total - synthesis - code_context"), F.lit(0)))


def stats_rollup(mem: DataFrame) -> DataFrame:
    """Counts by kind and project (lower-cased), by kind, and in all."""
    return mem.select("memory_type", F.lower("project").alias("project")).rollup("memory_type", "project").agg(F.count("*").alias("n"))


def event_index(rows: DataFrame, event: str = "event_id") -> DataFrame:
    """Events with their sizes, the largest first, then by id."""
    return rows.where(F.col(event).isNotNull()).groupBy(event).agg(F.count("*").alias("size")).orderBy(F.desc("size"), event)


def event_members(rows: DataFrame, asked: DataFrame, event: str = "event_id") -> DataFrame:
    """The other rows of each asked row's event: asked(event, exclude) -> event, exclude, id."""
    return rows.select(event, "id").join(asked.select(event, "exclude"), event).where("id != exclude").select(event, "exclude", "id")


def query_frequency(pool: DataFrame, query: str, content: str) -> DataFrame:
    """In how many queries each content was found (once a query), and their share of all queries."""
    each = pool.select(query, content).distinct()
    total = each.agg(F.count_distinct(query).alias("queries"))
    rate = F.least(F.col("hits") / F.greatest("queries", F.lit(1)), F.lit(1.0))
    return each.groupBy(content).agg(F.count("*").alias("hits")).join(F.broadcast(total)).select(content, "hits", rate.alias("rate"))


def synthesis_ratio(mem: DataFrame, archive: DataFrame, by: str = "project") -> DataFrame:
    """Share of synthesis rows, and how many rows are active and archived, by group."""
    tagged = mem.select(by, "memory_type", F.lit(True).alias("active")).unionByName(archive.select(by, "memory_type", F.lit(False).alias("active")))
    made = F.col("memory_type") == "synthesis"
    return tagged.groupBy(by).agg((F.count_if(made) / F.count("*")).alias("ratio"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("archived"))


def type_counts(log: DataFrame, kind: str = "event_type") -> DataFrame:
    return log.groupBy(kind).agg(F.count("*").alias("n"))


def codebase_stats(chunks: DataFrame, by: str = "language") -> DataFrame:
    """Files, chunks, mean lines of a chunk, and chunks per type (``type:count`` in order of type)."""
    types = chunks.groupBy(by, "chunk_type").agg(F.count("*").alias("n")).groupBy(by)
    told = types.agg(F.array_join(F.array_sort(F.collect_list(F.concat("chunk_type", F.lit(":"), F.col("n").cast("string")))), " ").alias("types"))
    lines = F.col("end_line") - F.col("start_line") + 1
    return chunks.groupBy(by).agg(F.count_distinct("file").alias("files"), F.count("*").alias("chunks"), F.avg(lines).alias("mean_lines")).join(told, by)


def edge_stats(edges: DataFrame) -> DataFrame:
    """In- and out-degree of every node: node, out_degree, in_degree, degree."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n"))


def suggestions(rows: DataFrame, mentions: DataFrame, n: int = 4, chars: int = 40) -> DataFrame:
    """What to ask next: place, kind, key, support, text; at most n.

    Events of two rows or more by size (text: the head of the longest row),
    then names that are no hubs and that two rows or more hold.  ``rows`` has
    event_id, id, content; ``mentions`` has name, doc, grp.
    """
    longest = F.max_by("content", F.struct(F.length("content"), -F.col("id")))
    events = rows.groupBy("event_id").agg(F.count("*").alias("support"), F.substring(longest, 1, chars).alias("text")).where("event_id is not null and support >= 2")
    too_general = hubs(mentions, "name", "doc", "grp").select("name", "grp")
    names = mentions.join(too_general, ["name", "grp"], "left_anti").groupBy("name").agg(F.count_distinct("doc").alias("support")).where("support >= 2")
    # n of each kind are enough; the final order looks at no more.
    first = events.select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("key"), "support", "text").orderBy(F.desc("support"), "event_id").limit(n)
    second = names.select(F.lit("name").alias("kind"), F.col("name").cast("string").alias("key"), "support", F.col("name").cast("string").alias("text")).orderBy(F.desc("support"), "key").limit(n)
    place = F.row_number().over(W.orderBy("kind", F.desc("support"), F.length("key"), "key"))
    return first.unionByName(second).withColumn("place", place).where(F.col("place") <= n)


def latency_percentiles(log: DataFrame, by: str, value: str) -> DataFrame:
    """p50 and p95 (the value at that place of the sorted ones) of each group, and whether both keep their bounds."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    out = log.where(F.col(value).isNotNull()).groupBy(by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    return out.withColumn("passes", (F.col("p50") < P50_MS) & (F.col("p95") < P95_MS))


def corpus_report(mem: DataFrame, log: DataFrame, classes: DataFrame, archive: DataFrame, now_minutes: int) -> DataFrame:
    """One report as (section, key, value): kinds, projects, log, expired, entropy of eight classes, synthesis share, health.

    Health is the balance of the classes in percent: poor below 30, fair below
    50, else good.
    """
    part = lambda f, name, key: f.groupBy(key.alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("section"), "key", "value")
    row = lambda f, name, key, value: f.select(F.lit(name).alias("section"), F.lit(key).alias("key"), value.cast("double").alias("value"))
    gone = mem.agg(F.count_if(expired(F.col("age_minutes"), F.col("ttl_days"), now_minutes)).alias("n"))
    spread = entropy(classes, "bucket", 8)
    made = mem.unionByName(archive).agg((F.count_if(F.col("memory_type") == "synthesis") / F.count("*")).alias("r"))
    percent = F.col("balance") * 100
    health = spread.select(F.lit("health").alias("section"), F.when(percent < POOR, "poor").when(percent < FAIR, "fair").otherwise("good").alias("key"), percent.cast("double").alias("value"))
    out = part(mem, "memory_type", F.col("memory_type")).unionByName(part(mem, "project", F.lower("project"))).unionByName(part(log, "events", F.col("event_type")))
    out = out.unionByName(row(gone, "total", "expired", F.col("n"))).unionByName(row(spread, "classes", "entropy", F.col("entropy")))
    return out.unionByName(row(made, "synthesis", "ratio", F.round("r", 6))).unionByName(health)


def event_gaps(rows: DataFrame, group: str, at: Column, name: str) -> DataFrame:
    """Each row's gap to the one before it in its group, in words (null for the first)."""
    gap = at - F.lag(at).over(W.partitionBy(group).orderBy(at, name))
    return rows.select(group, name, gap_text(gap).alias("gap"))


def metrics_by(runs: DataFrame, qrels: DataFrame, dims: DataFrame, dim: str, top_k: int) -> DataFrame:
    """Queries, MRR and recall by a dimension of the queries (``dims``: qid and it), and in all (null)."""
    per = evaluate(runs, qrels, top_k).join(dims.select("qid", dim), "qid")
    return per.rollup(dim).agg(F.count("*").alias("queries"), F.avg("rr").alias("mrr"), F.avg("recall").alias("recall"))


def isolation_check(runs: DataFrame, mem: DataFrame, callers: DataFrame) -> DataFrame:
    """Rows of runs (qid, id) that the query's caller (qid, level, user_id, session_id) may not see; must be empty."""
    who = callers.select("qid", "level", F.col("user_id").alias("cu"), F.col("session_id").alias("cs"))
    met = runs.select("qid", "id").join(who, "qid").join(mem.select("id", "privacy_level", "user_id", "session_id"), "id")
    same = F.col("user_id").eqNullSafe(F.col("cu"))
    mine = F.when(F.col("level") == "user", same).otherwise(same & F.col("session_id").eqNullSafe(F.col("cs")))
    allowed = F.col("level").isNull() | (F.col("privacy_level") == "global") | ((F.col("privacy_level") == F.col("level")) & mine)
    return met.where(~allowed).select("qid", "id", "privacy_level")


def noise_check(runs: DataFrame, noise: DataFrame, top: int = 5) -> DataFrame:
    """Noise rows among each query's first ``top``: qid, id, rank; must be empty."""
    return runs.where(F.col("rank") <= top).join(noise.select("id"), "id", "left_semi").select("qid", "id", "rank")


def text_stats(docs: DataFrame, content: str = "content") -> DataFrame:
    """id, length in tokens and lower-cased text of each document, for scoring."""
    return docs.select("id", F.size(X.tokenize(F.col(content))).alias("length"), F.lower(content).alias("lowered"))


def incidents(mem: DataFrame, now_minutes: int, level: str | None, session: str | None = None, user: str | None = None) -> DataFrame:
    """Rows a caller may see that are neither expired, code nor synthesis."""
    gone = expired(F.col("age_minutes"), F.col("ttl_days"), now_minutes)
    return mem.where(~gone & ~F.col("memory_type").isin(*NO_INCIDENT) & visible(level, session, user))


def archive_list(archive: DataFrame, now_minutes: int, level: str | None, session: str | None = None, user: str | None = None) -> DataFrame:
    """Archived rows that a caller may see, each with ``expired``."""
    return archive.where(visible(level, session, user)).withColumn("expired", expired(F.col("age_minutes"), F.col("ttl_days"), now_minutes))


def distilled_index(mem: DataFrame, limit: int, project: str | None = None, tag: str = "distilled") -> DataFrame:
    """The newest rows with a tag (``tags`` is an array): id, preview of 100 characters, total; 1 to 50 of them."""
    from memlake.operators.store import page

    kept = mem.where(F.array_contains("tags", tag))
    kept = kept.where(F.col("project") == project) if project is not None else kept
    return page(kept, [F.desc("age_minutes"), "id"], min(max(limit, 1), 50), 0).select("id", X.preview(F.col("content"), 100).alias("preview"), "total")


def association_records(log: DataFrame, seen: DataFrame, gone: DataFrame, limit: int, offset: int = 0, multi_hop: bool = False, evidence_only: bool = False) -> DataFrame:
    """Retrieval events as a caller may see them, the newest first, with total and truncated.

    ``log`` has event_id, ts, ids and trail (arrays of ids), evidence (text or
    null); ids and steps that ``seen`` lacks are taken out, and an event with
    no id left is dropped.  ``multi_hop`` keeps events with a trail of two
    steps or more, ``evidence_only`` those with evidence.  ``expired`` says
    whether one of the ids is in ``gone``.
    """
    from memlake.operators.store import page

    def allowed(column: str) -> DataFrame:
        steps = log.select("event_id", F.posexplode(column).alias("pos", "id")).join(seen.select("id"), "id", "left_semi")
        steps = steps.join(gone.select("id", F.lit(True).alias("gone")), "id", "left")
        held = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
        return steps.groupBy("event_id").agg(held.alias(column), F.coalesce(F.max("gone"), F.lit(False)).alias("gone_" + column))

    rows = log.select("event_id", "ts", "evidence").join(allowed("ids"), "event_id").join(allowed("trail").drop("gone_trail"), "event_id", "left")
    rows = rows.withColumn("trail", F.coalesce("trail", F.slice("ids", F.lit(1), F.lit(0)))).withColumnRenamed("gone_ids", "expired")
    rows = rows.withColumn("multi_hop", F.size("trail") > 1)
    keep = (F.col("multi_hop") if multi_hop else F.lit(True)) & (F.col("evidence").isNotNull() if evidence_only else F.lit(True))
    return page(rows.where(keep), [F.desc("ts"), F.desc("event_id")], limit, offset)


def distinct_sketches(mem: DataFrame, by: list[str], columns: list[str], lg_k: int = 12) -> DataFrame:
    """by, name, sketch: for each group and column a HyperLogLog sketch of its distinct values, to be stored and united later.

    A sketch has a fixed size whatever it has seen; nulls are not counted.
    """
    each = mem.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v"))
    return each.groupBy(*by, F.col("v.name").alias("name")).agg(F.hll_sketch_agg("v.value", F.lit(lg_k)).alias("sketch"))


def united_distinct(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, name, sketches, distinct: stored sketches united (groups, days, stores in any order), and what they estimate."""
    united = sketches.groupBy(*(by or []), "name").agg(F.hll_union_agg("sketch").alias("u"), F.count("*").alias("sketches"))
    return united.select(*(by or []), "name", "sketches", F.hll_sketch_estimate("u").alias("distinct"))

"""Reports on logs and records, thresholds by distribution, chains, feedback, run comparison."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegralType, LongType, StringType, StructField, StructType

#: Queries that a pass over the documents scores at once.
ASKED = 1000


def visible_join(mem: DataFrame, callers: DataFrame) -> DataFrame:
    """caller, id for all rows each caller (caller, level, session_id, user_id) may see.

    Owned rows meet callers by owner (and session), null meeting null.  A
    global row stands once, with a null caller: everyone sees it.  A caller
    without a level sees everything and stands once, with a null id.
    """
    c = callers.select("caller", "level", F.col("user_id").alias("cu"), F.col("session_id").alias("cs"))
    user = mem.where("privacy_level = 'user'").join(c.where("level = 'user'"), F.col("user_id").eqNullSafe(F.col("cu")))
    session = mem.where("privacy_level = 'session'").join(c.where("level = 'session'"), F.col("user_id").eqNullSafe(F.col("cu")) & F.col("session_id").eqNullSafe(F.col("cs")))
    nobody, nothing = F.lit(None).cast(callers.schema["caller"].dataType), F.lit(None).cast(mem.schema["id"].dataType)
    everyone = mem.where("privacy_level = 'global'").select(nobody.alias("caller"), "id")
    unbound = c.where("level is null").select("caller", nothing.alias("id"))
    return user.select("caller", "id").unionByName(session.select("caller", "id")).unionByName(everyone).unionByName(unbound)


def audit_query(log: DataFrame, since: str | None = None, until: str | None = None, types: list[str] | None = None, record: int | None = None, limit: int | None = None) -> DataFrame:
    """Events of a time range, of some types, that touch a record; the newest ``limit``."""
    out = log
    for given, cond in ((since, F.col("ts") >= F.lit(since)), (until, F.col("ts") < F.lit(until)), (types, F.col("event_type").isin(types or [])), (record, F.array_contains("ids", F.lit(record)))):
        out = out.where(cond) if given is not None else out
    return out.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit) if limit is not None else out


def classify_feedback(kind: Column) -> Column:
    k = F.lower(F.trim(kind))
    return F.when(k.isin("positive", "purchase", "click"), "positive").when(k.isin("negative", "error"), "negative").otherwise("neutral")


#: What feedback may be about, by the name that callers send; anything else is about a result.
TARGETS = {"synthesis": "synthesis_quality", "quarantine_override": "quarantine_override", "isolate": "isolate_memory", "confirm_action": "confirm_action", "cancel_action": "cancel_action", "association": "association_relevance"}


def feedback_target(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), F.lit("retrieval_result"))


def association_feedback(log: DataFrame, by: str, kind: str) -> DataFrame:
    """Counts per edge or record, and (positive - negative) / n."""
    k = classify_feedback(F.col(kind))
    agg = log.groupBy(by).agg(F.count_if(k == "positive").alias("positive"), F.count_if(k == "negative").alias("negative"), F.count("*").alias("n"))
    return agg.withColumn("score", (F.col("positive") - F.col("negative")) / F.col("n"))


def _hits(name: str) -> Column:
    return F.try_element_at("metadata", F.lit(name)).try_cast("bigint")


def association_activity(log: DataFrame) -> DataFrame:
    """Executions, mean candidates, fast-only, deep-only and both, the last time; metadata that isn't a number is ignored."""
    fast, deep = _hits("fast_hits"), _hits("deep_hits")
    return log.where(fast.isNotNull() & deep.isNotNull()).agg(
        F.count("*").alias("executions"), F.avg(fast + deep).alias("mean_candidates"), F.count_if((fast > 0) & (deep == 0)).alias("fast_only"),
        F.count_if((fast == 0) & (deep > 0)).alias("deep_only"), F.count_if((fast > 0) & (deep > 0)).alias("both"), F.max("ts").alias("last_at"),
    )


def newest_associations(log: DataFrame, n: int = 10) -> DataFrame:
    """The n newest executions: event_id, ts, candidates."""
    fast, deep = _hits("fast_hits"), _hits("deep_hits")
    return log.where(fast.isNotNull() & deep.isNotNull()).select("event_id", "ts", (fast + deep).alias("candidates")).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def zscore_threshold(rows: DataFrame, by: str, x: str, z: float = 0.35, least: int = 4, plain: float = 0.62) -> DataFrame:
    """Rows that stand out of their group: (x - mean) / sigma of z or more; in small or flat groups x of ``plain`` or more."""
    stats = rows.groupBy(by).agg(F.count(x).alias("__n"), F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s"))
    enough = (F.col("__n") >= least) & (F.col("__s") > 1e-6)
    keep = F.when(enough, (F.col(x) - F.col("__m")) / F.col("__s") >= z).otherwise(F.col(x) >= plain)
    return rows.join(stats, by).where(keep).drop("__n", "__m", "__s")


def concentration(rows: DataFrame, by: str, x: str, gate: float = 0.3151) -> DataFrame:
    agg = rows.groupBy(by).agg((F.stddev_pop(x) / F.avg(x)).alias("concentration"))
    return agg.withColumn("passes", F.col("concentration") >= gate)


def positive_topk_z(rows: DataFrame, by: str, bucket: str, x: str, k: int = 3) -> DataFrame:
    """The k buckets of each group with the highest positive z; groups are distributions of a few classes."""
    mine = W.partitionBy(by)
    z = (F.col(x) - F.avg(x).over(mine)) / F.stddev_pop(x).over(mine)
    ranked = rows.withColumn("z", z).where("z > 0").withColumn("rank", F.row_number().over(mine.orderBy(F.desc("z"), bucket)))
    return ranked.where(F.col("rank") <= k)


def seal_chain(log: DataFrame, by: str, seq: str, payload: Column) -> DataFrame:
    """Adds ``prev`` and ``hash`` to each log's rows in the order of ``seq``: hash = sha256(prev, payload), prev the hash before ("" at first).

    A chain is sequential by nature: each log is sorted within one partition
    and hashed as it streams by; nothing of it is held but the last hash.
    """
    schema = log.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, last = object(), ""
        for batch in batches:
            before, own = [], []
            for name, text in zip(batch.column(by).to_pylist(), batch.column("__payload").to_pylist(), strict=True):
                if name != owner:
                    owner, last = name, ""
                before.append(last)
                last = hashlib.sha256((last + (text or "")).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names), pa.array(before, pa.string()), pa.array(own, pa.string())], [*schema.names, "prev", "hash"])

    ordered = log.withColumn("__payload", payload).repartition(by).sortWithinPartitions(by, seq)
    return ordered.mapInArrow(run, StructType([*schema.fields, StructField("prev", StringType()), StructField("hash", StringType())]))


def chain_verify(log: DataFrame, by: str, seq: str, payload: Column) -> DataFrame:
    """First place of each sealed log that doesn't hold: first_break (null where all do) and how many entries there are.

    Every row is checked by itself and against the stored hash before it, so
    an edited, inserted, moved or deleted entry shows (but for a cut-off end).
    """
    own = F.sha2(F.concat(F.coalesce("prev", F.lit("")), F.coalesce(payload, F.lit(""))), 256)
    before = F.coalesce(F.lag("hash").over(W.partitionBy(by).orderBy(seq)), F.lit(""))
    checked = log.withColumn("__ok", F.coalesce((own == F.col("hash")) & (before == F.col("prev")), F.lit(False)))
    return checked.groupBy(by).agg(F.min(F.when(~F.col("__ok"), F.col(seq))).alias("first_break"), F.count("*").alias("entries"))


def slot_inject(ranked: DataFrame, found: DataFrame, top_k: int, quota: int = 3, denom: int = 4) -> DataFrame:
    """Associated rows (qid, id, place) take the last seats of a ranking, at 0.99 of its last score.

    At most min(quota, top_k / denom) new ones a query; the tail makes room.
    """
    seats = min(quota, top_k // denom)
    fresh = found.join(ranked.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("turn", F.row_number().over(W.partitionBy("qid").orderBy("place", "id"))).where(F.col("turn") <= seats)
    taken = fresh.groupBy("qid").agg(F.count("*").alias("taken"))
    kept = ranked.where(F.col("rank") <= top_k).join(taken, "qid", "left").where(F.col("rank") <= top_k - F.coalesce("taken", F.lit(0)))
    last = kept.groupBy("qid").agg(F.min("score").alias("last"), F.max("rank").alias("base"))
    added = fresh.join(last, "qid").select("qid", "id", (F.col("base") + F.col("turn")).alias("rank"), (F.col("last") * 0.99).alias("score"))
    return kept.select("qid", "id", "rank", "score").unionByName(added)


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metrics (metric, value) of two systems: relative improvement in percent, 100 where the base is 0."""
    joined = a.select("metric", F.col("value").alias("base")).join(b.select("metric", F.col("value").alias("other")), "metric")
    gain = F.when(F.col("base") == 0, F.when(F.col("other") == 0, 0.0).otherwise(100.0)).otherwise((F.col("other") - F.col("base")) / F.col("base") * 100)
    return joined.withColumn("improvement", gain).withColumn("better", F.col("other") > F.col("base"))


def noise_robustness(a: DataFrame, b: DataFrame, least: int = 3) -> DataFrame:
    """Per query, how many of two runs' top five agree."""
    top = lambda f: f.where("rank <= 5").select("qid", "id").distinct()
    common = top(a).join(top(b), ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("common"))
    return a.select("qid").distinct().join(common, "qid", "left").select("qid", F.coalesce("common", F.lit(0)).alias("common"), (F.coalesce("common", F.lit(0)) >= least).alias("robust"))


def keyword_points(text: Column, words: Column) -> Column:
    """0.4 for the whole query in the text, 0.1 for each of its words there, in thousandths."""
    whole = F.when(F.contains(text, F.array_join(words, " ")), 400).otherwise(0)
    return whole + 100 * F.size(F.filter(words, lambda w: F.contains(text, w)))


def keyword_baseline(queries: DataFrame, docs: DataFrame, k: int, now: int | None = None) -> DataFrame:
    """The k best documents of each query (qid, content): qid, id, points (thousandths), rank.

    0.4 for the whole query in the content, 0.1 for each of its words there
    (also inside words, repeated ones again), 0.15 for each tag that contains
    the word, a hundredth of the importance.  ``docs`` has id, content,
    importance and, if it likes, tags (array of strings).  With ``now``
    (minutes) rows past their time (age_minutes, ttl_days) take no part.
    Ties go to the smaller id.

    Queries go to the documents, ``ASKED`` in each pass over them; a task
    scores its documents for all of these and returns its k best a query, so
    nothing else is shuffled.  Queries without words rank by importance.
    """
    from memlake.operators.analyse import topk
    from memlake.operators.store import expired
    from memlake.operators.substring import in_groups, words_of

    if now is not None:
        docs = docs.where(~expired(F.col("age_minutes"), F.col("ttl_days"), now))
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in docs.columns else F.array().cast("array<string>")
    rows = docs.select("id", F.lower("content").alias("text"), F.transform(tags, F.lower).alias("tags"), "importance")
    asked = queries.select("qid", F.lower("content").alias("whole"), words_of(F.lower("content")).alias("words"))
    names = {c: f.schema[c].dataType for c, f in (("id", rows), ("qid", asked))}
    integral = isinstance(rows.schema["importance"].dataType, IntegralType)
    schema = StructType([StructField("qid", names["qid"]), StructField("id", names["id"]), StructField("points", LongType() if integral else DoubleType())])
    every = None
    for group in in_groups(asked, F.col("qid"), ASKED):
        part = rows.mapInArrow(_keyword_scorer([(r["qid"], r["whole"], r["words"] or []) for r in group], k, schema, integral), schema)
        every = part if every is None else every.unionByName(part)
    return topk(every, "qid", "points", "id", k)


def _keyword_scorer(asked: list[tuple], k: int, schema: StructType, integral: bool):
    """Reads rows (id, text, tags, importance), returns the k best of each query (qid, whole, words) among them."""
    from memlake.operators.substring import Needles, _SPACE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[int, int]]] = {}
        for q, (_, _, words) in enumerate(asked):
            for word, times in Counter(words).items():
                held.setdefault(word, []).append((q, times))
        known, lists = Needles(list(held)), list(held.values())
        size = np.array([len(x) for x in lists], np.int64)
        start = np.cumsum(size) - size
        of, times = (np.array([pair[i] for x in lists for pair in x], np.int64) for i in (0, 1))
        distinct = np.array([len(set(words)) for _, _, words in asked])
        kept, waiting = None, []

        def scored(text: str | None, tags: list, at: int, points: np.ndarray) -> None:
            inside = np.fromiter(set(known.hits(text)), np.int64)
            in_tags = [i for tag in tags if tag for i in {i for w in _SPACE.split(tag) for i in known.in_word(w)}]
            for found, worth in ((inside, 100), (np.array(in_tags, np.int64), 150)):
                n = size[found]
                place = np.repeat(start[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                points[at] += np.bincount(of[place], times[place], len(asked)).astype(np.int64) * worth
                if worth == 100 and text is not None:
                    whole = np.bincount(of[place], minlength=len(asked)) == distinct
                    for q in np.flatnonzero(whole):
                        if asked[q][1] is not None and asked[q][1] in text:
                            points[at, q] += 400

        def best(some: list[pd.DataFrame]) -> pd.DataFrame:
            one = pd.concat(some).sort_values(["q", "points", "id"], ascending=[True, False, True], kind="stable")
            return one[one.groupby("q").cumcount() < k]

        least = np.full(len(asked), -np.inf)
        for batch in batches:
            texts, tags, ids = batch.column("text").to_pylist(), batch.column("tags").to_pylist(), np.array(batch.column("id").to_pylist())
            weight = np.array([np.nan if x is None else float(x) for x in batch.column("importance").to_pylist()])
            for lo in range(0, len(texts), 256):
                points = np.zeros((len(texts[lo : lo + 256]), len(asked)), np.int64)
                for at, (text, some) in enumerate(zip(texts[lo : lo + 256], tags[lo : lo + 256], strict=True)):
                    scored(text, some or [], at, points)
                # Points of a row without importance are unknown and come last.
                total = np.nan_to_num(points + 10 * weight[lo : lo + 256, None], nan=-1e18)
                r, q = np.nonzero(total >= least)
                waiting.append(pd.DataFrame({"q": q, "id": ids[lo : lo + 256][r], "points": total[r, q]}))
                if len(waiting) >= 8:
                    kept, waiting = best([*([] if kept is None else [kept]), *waiting]), []
                    ranked = kept.groupby("q")["points"]
                    full = ranked.size()
                    least[full.index[full >= k]] = ranked.min()[full >= k]
        if waiting or kept is not None:
            kept = best([*([] if kept is None else [kept]), *waiting])
            told = [None if p <= -1e17 else int(p) if integral else p for p in kept["points"].tolist()]
            columns = [[asked[q][0] for q in kept["q"].tolist()], kept["id"].tolist(), told]
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)], schema.names)

    return run

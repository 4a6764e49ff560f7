"""Logs, pages, visibility, lifecycle, versions and set operations on record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def compact_log(log: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """Current rows of an upsert/delete log: the last operation per key wins."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), F.col(seq)).alias("r"))
    return last.where(F.col(f"r.{op}") != "delete").select(key, "r.*").drop(op)


def parse_log(lines: DataFrame, col: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a log of JSON lines, and one row that counts the lines that are none (``skipped``)."""
    good = F.try_parse_json(col).isNotNull() & F.col(col).rlike(r"^\s*\{")
    rows = lines.where(good).select(F.from_json(col, schema).alias("r")).select("r.*")
    return rows, lines.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("skipped"))


def replay_wal(log: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """As ``compact_log``, after the last ``clear`` of the whole log (one row, joined back)."""
    cleared = log.where(F.col(op) == "clear").agg(F.coalesce(F.max(seq), F.lit(-1)).alias("__clear"))
    return compact_log(log.join(F.broadcast(cleared)).where(F.col(seq) > F.col("__clear")).drop("__clear"), key, seq, op)


def import_append(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows, and incoming ones whose key is new or null."""
    return existing.unionByName(incoming.join(existing.select(key), key, "left_anti").select(*existing.columns))


def _tagged(frames: list[DataFrame]) -> DataFrame:
    every = frames[0].withColumn("source_no", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        every = every.unionByName(f.withColumn("source_no", F.lit(i)))
    return every


def merge_sources(frames: list[DataFrame], key: str, updated: str) -> DataFrame:
    """The newest row per key of many stores; ties go to the first store.

    Rows without a key all stay, each under a new one: a hash of the row, its
    store and how often it occurred there before, so reruns agree.
    """
    every = _tagged(frames)
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(updated), "source_no"))
    newest = every.where(F.col(key).isNotNull()).withColumn("__r", rank).where("__r = 1").drop("__r")
    row = F.xxhash64("source_no", F.to_json(F.struct(*frames[0].columns)))
    nameless = every.where(F.col(key).isNull()).withColumn("__h", row).withColumn("__n", F.row_number().over(W.partitionBy("__h").orderBy("__h")))
    named = nameless.withColumn(key, F.xxhash64("__h", "__n").cast(frames[0].schema[key].dataType)).drop("__h", "__n")
    return newest.unionByName(named)


def merge_report(frames: list[DataFrame], key: str, updated: str) -> DataFrame:
    """Per store: rows, those that the merge takes, those that another row replaces, and those without a key."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(updated), "source_no"))
    ranked = _tagged(frames).select("source_no", F.col(key), F.when(F.col(key).isNotNull(), rank).alias("__r"))
    nameless = F.col(key).isNull()
    return ranked.groupBy("source_no").agg(F.count("*").alias("total"), F.count_if(nameless | (F.col("__r") == 1)).alias("added"), F.count_if(F.col("__r") > 1).alias("duplicates"), F.count_if(nameless).alias("without_id"))


def parse_op_log(lines: DataFrame, col: str, order: str, n: int) -> DataFrame:
    """``ts | operation | details`` lines, the newest n; other lines are dropped."""
    parts = F.split(col, r" \| ", 3)
    return lines.where(F.size(parts) == 3).select(order, parts[0].alias("ts"), parts[1].alias("operation"), parts[2].alias("details")).orderBy(F.desc(order)).limit(n)


def expired(age_minutes: Column, ttl_days: Column, now_minutes: int) -> Column:
    """A null or zero ttl never expires, nor does one so long that its end can't be told."""
    ends = F.try_add(age_minutes.cast("long"), F.try_multiply(ttl_days.cast("long"), F.lit(1440).cast("long")))
    return F.coalesce((ttl_days > 0) & (now_minutes > ends), F.lit(False))


def filter_records(mem: DataFrame, memory_type: str | None = None, project: str | None = None, tags: list[str] | None = None, min_importance: int | None = None, top_k: int | None = None) -> DataFrame:
    """Rows that meet every condition given, the ``top_k`` most important of them (ties: the smaller id).

    ``tags``: the row has any of them, in its array ``tags`` or, where there
    is none, in its single ``tag``.
    """
    out = mem
    tagged = F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags or [""]))), F.lit(False)) if "tags" in mem.columns else F.col("tag").isin(tags or [])
    for value, cond in ((memory_type, F.col("memory_type") == memory_type), (project, F.col("project") == project), (tags, tagged), (min_importance, F.col("importance") >= (min_importance or 0))):
        out = out.where(cond) if value is not None else out
    return out if top_k is None else out.orderBy(F.desc("importance"), "id").limit(top_k)


def list_records(mem: DataFrame, now: int, sort_by: str = "age_minutes", descending: bool = True, limit: int = 20, offset: int = 0, include_expired: bool = False, **filters) -> DataFrame:
    """A page of the rows that ``filter_records(**filters)`` keeps, with ``total`` and ``truncated``.

    Sorted by any column (nulls last, then id).  Rows past their time
    (age_minutes, ttl_days at ``now``) count only if asked for.  A negative
    offset is 0, a limit lies between 0 and 1,000.
    """
    live = mem if include_expired else mem.where(~expired(F.col("age_minutes"), F.col("ttl_days"), now))
    by = F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_last()
    return page(filter_records(live, **filters), [by, "id"], min(max(limit, 0), 1000), max(offset, 0))


def page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """A page with ``total`` and ``truncated``; the count is one row joined back."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total)).withColumn("truncated", F.col("total") > offset + limit)


def recent(mem: DataFrame, n: int, chars: int = 100) -> DataFrame:
    """The newest rows (1 to 20): id, rank, preview, total, truncated."""
    from memlake.functions.text import preview

    top = page(mem.select("id", "age_minutes", preview(F.col("content"), chars).alias("preview")), [F.desc("age_minutes"), "id"], min(max(n, 1), 20), 0)
    return top.select("id", F.row_number().over(W.orderBy(F.desc("age_minutes"), "id")).alias("rank"), "preview", "total", "truncated")


def lookup(mem: DataFrame, wanted: DataFrame, seen: Column | None = None) -> DataFrame:
    """Rows by id in the order of a request (id, pos); ids that aren't there, or that ``seen`` hides, are left out."""
    return (mem if seen is None else mem.where(seen)).join(wanted.select("id", "pos"), "id").orderBy("pos")


def merge_tags(a: Column, b: Column) -> Column:
    """Both lists in order, each tag once; nulls are no tags."""
    return F.array_compact(F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def taken_out(mem: DataFrame, archive: DataFrame) -> DataFrame:
    """The rows that aren't archived; what comes out and the archive have no id in common."""
    return mem.join(archive.select("id").distinct(), "id", "left_anti")


def sessionise(turns: DataFrame, conv: str, order: list[str]) -> DataFrame:
    """Adds event_id (``session:`` and the conversation) and each turn's place in it."""
    place = F.row_number().over(W.partitionBy(conv).orderBy(*order))
    return turns.withColumn("event_id", F.concat(F.lit("session:"), F.col(conv).cast("string"))).withColumn("place", place)


def visible(level: str | None, session: str | None = None, user: str | None = None) -> Column:
    """What a caller may see; no scope sees all, global rows are seen by all."""
    if level is None:
        return F.lit(True)
    everyone, same = F.col("privacy_level") == "global", F.col("user_id").eqNullSafe(F.lit(user))
    if level == "user":
        return everyone | ((F.col("privacy_level") == "user") & same)
    return everyone | ((F.col("privacy_level") == "session") & same & F.col("session_id").eqNullSafe(F.lit(session)))


def exclude_inactive(mem: DataFrame, lifecycle: DataFrame) -> DataFrame:
    return mem.join(lifecycle.where("state in ('superseded', 'suppressed')").select("id"), "id", "left_anti")


def lifecycle_apply(events: DataFrame) -> DataFrame:
    """State, hits and last hit per id: the last mark after the last clear; touches count since it."""
    cleared = events.groupBy("id").agg(F.max(F.when(F.col("op") == "clear", F.col("seq"))).alias("cleared"))
    live = events.join(cleared, "id").where("cleared is null or seq > cleared")
    mark = F.max_by("op", F.when(F.col("op").isin("superseded", "suppressed"), F.col("seq")))
    touch = F.col("op") == "touch"
    return live.groupBy("id").agg(F.coalesce(mark, F.lit("active")).alias("state"), F.count_if(touch).alias("hits"), F.max(F.when(touch, F.col("seq"))).alias("last_hit"))


def version_history(edits: DataFrame, key: str, order: str, content: str, reason: str, keep: int = 5) -> DataFrame:
    """Version number (from 1), current content and the newest ``keep`` previous ones with their reasons, newest first."""
    up, down = W.partitionBy(key).orderBy(order), W.partitionBy(key).orderBy(F.desc(order))
    numbered = edits.withColumn("version", F.row_number().over(up)).withColumn("back", F.row_number().over(down)).where(F.col("back") <= keep + 1)
    entry = F.when(F.col("back") > 1, F.struct("back", "version", F.col(content).alias("content"), F.col(reason).alias("reason")))
    plain = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["version"].alias("version"), x["content"].alias("content"), x["reason"].alias("reason")))
    return numbered.groupBy(key).agg(F.max("version").alias("version"), F.max_by(content, "version").alias("content"), plain.alias("history"))


def inherit_scope(sources: DataFrame, group: str) -> DataFrame:
    """Scope of what is made from several rows: global only if all are; one user, else rejected."""
    owned = F.col("privacy_level") != "global"
    agg = sources.groupBy(group).agg(F.count_if(owned).alias("owned"), F.count_distinct(F.when(owned, F.coalesce("user_id", F.lit("")))).alias("users"), F.count_distinct(F.when(owned, F.coalesce("session_id", F.lit("")))).alias("sessions"), F.count_if(F.col("privacy_level") == "session").alias("in_session"), F.max(F.when(owned, F.col("user_id"))).alias("owner"))
    level = F.when(F.col("owned") == 0, "global").when(F.col("users") > 1, "rejected").when((F.col("in_session") == F.col("owned")) & (F.col("sessions") == 1), "session").otherwise("user")
    return agg.select(group, level.alias("level"), F.when(F.col("users") == 1, F.col("owner")).alias("owner"))


#: Relations without a direction.
SYMMETRIC = ("same_event", "same_event_auto", "shared_entity", "shared_artifact", "related", "coordinate")


def edge_union(*parts: DataFrame, symmetric: tuple[str, ...] = SYMMETRIC) -> DataFrame:
    """Edges (a, b, relation, weight) of several tables, each once: a, b, relation, weight.

    Symmetric relations have their small end first, directed ones keep their
    direction; loops are dropped; the first part's weight (the smallest within
    a part) stays, clamped to 0..1.
    """
    every = parts[0].withColumn("__no", F.lit(0))
    for i, f in enumerate(parts[1:], 1):
        every = every.unionByName(f.withColumn("__no", F.lit(i)))
    both = F.col("relation").isin(*symmetric)
    ends = [F.when(both, F.least("a", "b")).otherwise(F.col("a")).alias("a"), F.when(both, F.greatest("a", "b")).otherwise(F.col("b")).alias("b")]
    tidy = every.where("a != b").select(*ends, "relation", F.least(F.greatest("weight", F.lit(0.0)), F.lit(1.0)).alias("weight"), "__no")
    return tidy.groupBy("a", "b", "relation").agg(F.min_by("weight", F.struct("__no", "weight")).alias("weight"))


def remove_nodes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id")
    return edges.join(gone, edges["a"] == gone["id"], "left_anti").join(gone, edges["b"] == gone["id"], "left_anti")


def forget(mem: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and edges without these ids."""
    return mem.join(ids.select("id").distinct(), "id", "left_anti"), remove_nodes(edges, ids)


def stored_edge_guard(edges: DataFrame, alive: DataFrame) -> DataFrame:
    ids = alive.select("id")
    return edges.where("a != b").join(ids, edges["a"] == ids["id"], "left_semi").join(ids, edges["b"] == ids["id"], "left_semi")


def rotate_seeds(candidates: DataFrame, seed: str, score: str, name: str, quota: int) -> DataFrame:
    """Round-robin over seeds, so that one seed can't use up the quota."""
    turn = F.row_number().over(W.partitionBy(seed).orderBy(F.desc(score), name))
    return candidates.withColumn("turn", turn).where(F.col("turn") <= quota).orderBy("turn", seed).limit(quota)

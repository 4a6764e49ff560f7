"""The write path: merging, archive moves, corrections, synthesis and its upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.operators.analyse import class_sizes, components, near_dup_pairs
from memlake.operators.close_sets import SENT, closest
from memlake.storage import checkpointed


#: Columns that ``merge_into`` keeps up.
START = ("version", "history", "merged")


def with_history(rows: DataFrame) -> DataFrame:
    """Rows with version, history and merged, where they lack these."""
    start = dict(zip(START, (F.lit(1), F.array().cast("array<string>"), F.lit(0).cast("long")), strict=True))
    for name, value in start.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return rows


def merge_into(existing: DataFrame, matched: DataFrame, keep: int = 5) -> DataFrame:
    """Existing rows after taking in matched ones (target, and the same columns), with version, history and merged.

    The newest content wins.  ``history`` holds the contents before it, newest
    first, those that the row had already included (``keep`` at most, equal
    neighbours once); ``version`` goes up from the stored one (1 where there
    is none) by each change of content, ``merged`` by each row taken in.
    Tags, entities and source_ids are united (in order), the event is the
    newest known one, importance the highest, privacy the strictest, creation
    the earliest; a missing owner or session is filled, none is changed.  All
    other columns of ``existing`` keep its values, and columns that it lacks
    are left out.  Ids of ``existing`` are unique and not null; a matched row
    without a target there changes nothing.

    Rows that nothing meets pass by; the others take one shuffle on the
    target, which keeps distinct lists and ``keep`` + 1 contents.
    """
    existing = with_history(existing)
    columns = existing.columns
    asked = matched.select(F.col("target").alias("id")).distinct()
    # Up to SENT ids go to every task, so that the rows aren't shuffled to be told apart.
    sent = F.broadcast if asked.count() <= SENT else lambda f: f
    met = sent(asked)
    incoming = matched.drop(*START, *(set(matched.columns) - set(columns) - {"target"}))
    incoming = incoming.join(sent(existing.select("id").join(met, "id", "left_semi").select(F.col("id").alias("target"))), "target", "left_semi")
    old = existing.join(met, "id", "left_semi").withColumn("target", F.col("id")).withColumn("__new", F.lit(0))
    every = old.unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)

    strict = F.when(F.col("privacy_level") == "session", 0).when(F.col("privacy_level") == "user", 1).otherwise(2)
    age = F.struct("updated", "__new", "content")
    order = W.partitionBy("target").orderBy("updated", "__new", "content")
    told = every.withColumn("__changed", F.coalesce(F.lag("content").over(order) != F.col("content"), F.lit(False)))
    told = told.withColumn("__later", F.sum(F.col("__changed").cast("int")).over(order.rowsBetween(1, W.unboundedFollowing)))
    last = F.coalesce(F.lead("__changed").over(order), F.lit(False))
    entry = F.when(last & (F.col("__later") <= keep), F.struct((-F.col("__later")).alias("back"), "content"))
    told = told.withColumn("__entry", entry)

    stored = F.col("__new") == 0
    unite = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    fill = lambda c: F.coalesce(F.max(F.when(stored, F.col(c))), F.max(c))
    fresh = F.transform(F.reverse(F.array_sort(F.collect_list("__entry"))), lambda x: x["content"])
    rules = {
        **{c: unite(c) for c in ("tags", "entities", "source_ids")},
        **{c: fill(c) for c in ("user_id", "session_id")},
        "event_id": F.max_by("event_id", F.when(F.col("event_id").isNotNull(), age)) if "event_id" in columns else None,
        "content": F.max_by("content", age),
        "importance": F.max("importance"),
        "privacy_level": F.min_by("privacy_level", strict),
        "created": F.min("created"),
        "updated": F.max("updated"),
        "merged": F.max(F.when(stored, F.col("merged"))) + F.sum("__new"),
        "version": F.max(F.when(stored, F.col("version"))) + F.count_if("__changed").cast("int"),
        "history": F.slice(F.concat(fresh, F.max(F.when(stored, F.col("history")))), 1, keep),
    }
    own = [c for c in columns if c not in rules and c != "id"]
    picked = [rules[c].alias(c) for c in columns if c in rules]
    if own:
        picked.append(F.max_by(F.struct(*own), F.when(stored, 1)).alias("__own"))
    merged = told.groupBy(F.col("target").alias("id")).agg(*picked)
    merged = merged.select(*[F.col(f"__own.`{c}`") if c in own else F.col(c) for c in columns])
    return existing.join(met, "id", "left_anti").select(*columns).unionByName(merged)


def best_match(incoming: DataFrame, existing: DataFrame, t: float, scope: list[str]) -> DataFrame:
    """For each new row the most similar existing one of its scope (word Jaccard of t or more): id, target, similarity.

    Sketches of word sets are compared within the scope, and only where the
    sizes allow t (``close_sets.closest``).  A null in a scope column is a
    scope value of its own.
    """
    mark = F.to_json(F.struct(*[F.col(c).cast("string").alias(str(i)) for i, c in enumerate(scope)])) if scope else F.lit("")
    words = lambda f: f.select("id", mark.alias("scope"), F.array_sort(F.array_distinct(X.tokenize(F.col("content")))).alias("s"))
    return closest(words(incoming), words(existing), t)


def remember_batch(incoming: DataFrame, existing: DataFrame, t: float, scope: list[str]) -> DataFrame:
    """What becomes of each new row: id, target, outcome.

    ``no_op``: the content stands in the matched row, or in an earlier row of
    this batch and scope (the first by ``updated``, if there, and id);
    ``merge`` into the target; ``clash``: it matches nothing, but its id is
    taken by a stored row; else ``new``.  Ids of ``incoming`` are unique.
    """
    match = best_match(incoming, existing, t, scope)
    # Texts are told by their digests, so none of them is shuffled.
    digest, order = F.sha2("content", 256), [*(["updated"] if "updated" in incoming.columns else []), "id"]
    old = existing.select(F.col("id").alias("target"), digest.alias("__old"))
    rows = incoming.select(*dict.fromkeys([*order, *scope]), digest.alias("__digest"))
    joined = rows.join(match, "id", "left").join(old, "target", "left")
    taken = existing.select("id", F.lit(True).alias("__taken"))
    free = F.col("target").isNull() & F.col("__taken").isNull()
    alike = W.partitionBy(*scope, "__digest", free).orderBy(*order)
    judged = joined.join(taken, "id", "left").withColumn("__first", F.first("id").over(alike))
    repeated = free & (F.col("__first") != F.col("id"))
    outcome = F.when(F.col("target").isNotNull() & (F.col("__old") == F.col("__digest")), "no_op").when(F.col("target").isNotNull(), "merge")
    outcome = outcome.when(F.col("__taken"), "clash").when(repeated, "no_op").otherwise("new")
    return judged.select("id", F.when(repeated, F.col("__first")).otherwise(F.col("target")).alias("target"), outcome.alias("outcome"))


def sound_rows(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be written, and one row with the number of the others.

    Those have no id, no content, or the id of an earlier row of the batch
    (the first by ``updated``, if there, and content stays).
    """
    order = [*(["updated"] if "updated" in incoming.columns else []), "content"]
    good = F.col("id").isNotNull() & (F.coalesce(F.trim("content"), F.lit("")) != "")
    place = F.row_number().over(W.partitionBy("id", good).orderBy(*order))
    marked = incoming.withColumn("__good", good & (place == 1))
    return marked.where("__good").drop("__good"), marked.agg(F.count_if(~F.col("__good")).alias("failed"))


def after_batch(sound: DataFrame, existing: DataFrame, outcome: DataFrame) -> DataFrame:
    """The rows that a store holds after a batch with this outcome."""
    merged = sound.join(outcome.where("outcome = 'merge'").select("id", "target"), "id")
    fresh = sound.join(outcome.where("outcome = 'new'").select("id"), "id", "left_semi")
    return merge_into(existing.unionByName(fresh, allowMissingColumns=True), merged)


def batch_counts(outcome: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: written, merged, unchanged, and failed (clashing ids too)."""
    counts = outcome.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("new", "written"), ("merge", "merged"), ("no_op", "unchanged"), ("clash", "__clash"))])
    return counts.join(F.broadcast(failed)).select("written", "merged", "unchanged", (F.col("failed") + F.col("__clash")).alias("failed"))


def remember(incoming: DataFrame, existing: DataFrame, t: float, scope: list[str], path: str) -> tuple[DataFrame, DataFrame]:
    """Write the store's rows after a batch to ``path``, which must hold nothing yet: the rows read back, and one row of counts.

    New rows are stored with all their columns, matched ones go through
    ``merge_into``; unchanged content is a no-op and makes no version.  A row
    that cannot be written (``sound_rows``), or whose id a stored row has
    though it matches none, is ``failed`` and stays out: no stored row is ever
    overwritten.  Similar, but not equal rows of one batch are both stored.
    Running the same batch again on the result changes nothing but the
    counts.  ``scoped_store`` keeps a store that rewrites only what a batch
    meets.
    """
    sound, failed = sound_rows(incoming)
    sound = checkpointed(sound)
    outcome = checkpointed(remember_batch(sound, existing, t, scope))
    after_batch(sound, existing, outcome).write.parquet(path)
    return existing.sparkSession.read.parquet(path), batch_counts(outcome, failed)


def duplicate_groups(mem: DataFrame, t: float, limit: int = 50, max_scan: int = 0) -> DataFrame:
    """The largest groups of near duplicates: label (smallest id), members, best similarity, preview; scanned, total, truncated.

    Every row counts, exact copies of a word set too (similarity 1), and a
    group may consist of those alone.  Rows without words are in no group.
    The preview is the head of the label's row.  ``max_scan`` above 0 looks at
    so many rows (the smallest ids) only; ``total`` counts the groups found.
    """
    rows = mem.orderBy("id").limit(max_scan) if max_scan > 0 else mem
    pairs = checkpointed(near_dup_pairs(rows, t))
    label = components(pairs.select("a", "b"))
    near = pairs.join(label, pairs["a"] == label["u"]).groupBy("label").agg(F.max("similarity").alias("near"))
    held = class_sizes(rows).join(label, F.col("id") == F.col("u"), "left").withColumn("label", F.coalesce("label", "id"))
    groups = held.groupBy("label").agg(F.sum("copies").alias("members"), F.max(F.when(F.col("copies") > 1, 1.0)).alias("same")).where("members > 1")
    found = checkpointed(groups.join(near, "label", "left").select("label", "members", F.greatest("near", "same").alias("best")))
    counts = rows.agg(F.count("*").alias("scanned")).join(F.broadcast(found.agg(F.count("*").alias("total"))))
    top = found.orderBy(F.desc("members"), "label").limit(limit)
    heads = rows.select(F.col("id").alias("label"), X.preview(F.col("content"), 200).alias("preview"))
    shown = top.join(heads, "label").join(F.broadcast(counts)).withColumn("truncated", F.col("total") > limit)
    return shown.orderBy(F.desc("members"), "label")


def split_by(mem: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows that move; a null condition keeps the row."""
    moves = F.coalesce(gone, F.lit(False))
    return mem.where(~moves), mem.where(moves)


def archive_by_tag(mem: DataFrame, tag: str, older_than: int, limit: int, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Active rows, archived rows, and a report (matched, archived) for the oldest rows with the tag and at least that age.

    At most ``limit`` rows move; a dry run reports the same and moves none.
    """
    matched = mem.where((F.col("tag") == tag) & (F.col("age_minutes") >= older_than))
    moved = checkpointed(matched.orderBy(F.desc("age_minutes"), "id").limit(limit).select("id"))
    counts = matched.agg(F.count("*").alias("matched")).join(F.broadcast(moved.agg(F.count("*").alias("archived"))))
    gone = moved.where("false") if dry_run else moved
    return mem.join(gone, "id", "left_anti"), mem.join(gone, "id", "left_semi"), counts


def unarchive(mem: DataFrame, archive: DataFrame, ids: DataFrame, ttl_days: int) -> tuple[DataFrame, DataFrame]:
    """Active and archived rows after taking ids back with a fresh clock; ids that aren't archived change nothing."""
    asked = ids.select("id").distinct()
    back = archive.join(asked, "id", "left_semi").withColumn("ttl_days", F.lit(ttl_days)).withColumn("age_minutes", F.lit(0).cast("long"))
    return mem.unionByName(back.join(mem.select("id"), "id", "left_anti")), archive.join(asked, "id", "left_anti")


def correct(mem: DataFrame, edits: DataFrame, keep: int = 5) -> DataFrame:
    """Rows with an edit (id, content, reason) get its content, the next version and the old content in their history (newest ``keep``)."""
    new = edits.select("id", F.col("content").alias("__new"), F.col("reason").alias("__why"))
    joined = mem.join(new, "id", "left")
    change = F.col("__new").isNotNull() & (F.col("__new") != F.col("content"))
    entry = F.struct("version", "content", F.col("__why").alias("reason"))
    longer = F.concat(F.coalesce("history", F.array()), F.array(entry))
    history = F.when(change, F.slice(longer, F.greatest(F.size(longer) - keep + 1, F.lit(1)), F.lit(keep))).otherwise(F.col("history"))
    return joined.withColumn("history", history).withColumn("version", F.col("version") + change.cast("int")).withColumn("content", F.when(change, F.col("__new")).otherwise(F.col("content"))).drop("__new", "__why")


def suppress_matching(mem: DataFrame, requests: DataFrame) -> DataFrame:
    """Ids of rows of the requester that contain a forget target (user_id, target), whatever the case.

    A text is searched for its owner's targets only (``substring.Needles``),
    up to the first that it contains, null owners equal to null; only ids are
    shuffled.  Targets without a visible character match nothing.
    """
    from memlake.operators.substring import AT_ONCE, Needles, in_groups

    asked = requests.select(F.col("user_id").cast("string").alias("owner"), F.lower("target").alias("needle")).where("needle is not null").distinct()
    texts = mem.select("id", F.col("user_id").cast("string").alias("owner"), F.lower("content").alias("text"))
    kind = mem.schema["id"].dataType.simpleString()

    def matcher(wanted: dict[str | None, list[str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {owner: Needles(needles) for owner, needles in wanted.items()}
            for batch in batches:
                rows = zip(batch.column("owner").to_pylist(), batch.column("text").to_pylist(), strict=True)
                met = [owner in known and next(known[owner].hits(text), None) is not None for owner, text in rows]
                yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(met, pa.bool_()))], ["id"])

        return run

    every = None
    for group in in_groups(asked, F.col("needle"), AT_ONCE):
        wanted: dict[str | None, list[str]] = {}
        for r in group:
            wanted.setdefault(r["owner"], []).append(r["needle"])
        part = texts.mapInArrow(matcher(wanted), f"id {kind}")
        every = part if every is None else every.unionByName(part)
    return every.distinct()


def cluster_vectors(pairs: DataFrame, min_size: int) -> DataFrame:
    """Members of the connected groups of similar pairs (a, b) with ``min_size`` rows or more: id, cluster."""
    label = components(pairs.select("a", "b"))
    big = label.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    return label.join(big, "label").select(F.col("u").alias("id"), F.col("label").alias("cluster"), "size")


def information_gain(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """1 - mean pairwise cosine of each cluster.

    The mean over all pairs follows from the sum of the unit vectors
    ((|sum|^2 - n) / (n (n - 1))), so no pair is formed.
    """
    norm = F.sqrt(X.dot(F.col("vec"), F.col("vec")))
    parts = members.join(vectors.select("id", "vec"), "id").where(norm > 0).select("cluster", "id", F.posexplode(F.transform("vec", lambda x: x / norm)).alias("i", "x"))
    sums = parts.groupBy("cluster", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    per = sums.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    mean = (F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return per.select("cluster", "n", F.when(F.col("n") > 1, 1 - mean).otherwise(0.0).alias("gain"))


def summarise_clusters(members: DataFrame, texts: DataFrame, items: int = 5, chars: int = 100) -> DataFrame:
    """The heads of each cluster's first items, and how many it has."""
    placed = members.join(texts.select("id", "content"), "id").withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy("id")))
    total = placed.groupBy("cluster").agg(F.count("*").alias("total"))
    heads = placed.where(F.col("r") <= items).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("id", F.substring("content", 1, chars).alias("head")))).alias("rows"))
    return heads.join(total, "cluster").select("cluster", "total", F.concat_ws("\n", F.transform("rows", lambda x: x["head"])).alias("digest"))


def purge_archived(archive: DataFrame, ids: DataFrame) -> DataFrame:
    """The archive without these ids, for good; asking again changes nothing."""
    return archive.join(ids.select("id").distinct(), "id", "left_anti")


def synthesise(mem: DataFrame, vectors: DataFrame, t: float, dim: int, min_size: int = 5, least_gain: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """New synthesis rows, one for each group of rows with similar vectors that adds something and has one owner; and their sources.

    Groups (``cluster_vectors`` of exact pairs at t), their information gain,
    the scope of their sources (mixed owners are rejected) and a digest.  A
    row's id is a digest of its sources' ids, so the same group gives the same
    row again.  The sources (id, source) are a table of their own: a group may
    hold any number.
    """
    from memlake.operators.store import inherit_scope
    from memlake.operators.vectors import similar_pairs

    members = checkpointed(cluster_vectors(similar_pairs(vectors, t, dim), min_size))
    sums = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("z"))
    named = sums.select("cluster", F.concat(F.lit("synthesis-"), F.substring(F.sha2(F.concat_ws(":", "n", "s", "z"), 256), 1, 32)).alias("id"))
    gain = information_gain(members, vectors).where(F.col("gain") >= least_gain).select("cluster", "gain")
    scope = inherit_scope(mem.join(members.select("id", "cluster"), "id"), "cluster").where("level != 'rejected'")
    rows = checkpointed(summarise_clusters(members, mem).join(gain, "cluster").join(scope, "cluster").join(named, "cluster"))
    sources = members.join(rows.select("cluster", F.col("id").alias("__id")), "cluster").select(F.col("__id").alias("id"), F.col("id").alias("source"))
    return rows.select("id", "cluster", "total", "digest", "gain", "level", "owner", F.lit(7).alias("importance"), F.lit(0.65).alias("confidence")), sources


def quarantine(synthesis: DataFrame, hits: DataFrame, least: int = 3, below: float = 0.3) -> DataFrame:
    """Synthesis rows whose hits (id, quality) were poor again and again."""
    poor = hits.groupBy("id").agg(F.count("*").alias("hits"), F.avg("quality").alias("mean")).where((F.col("hits") >= least) & (F.col("mean") < below))
    return synthesis.select("id").join(poor, "id")


def quarantine_move(mem: DataFrame, poor: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the quarantined ones with hits, mean and quarantined_at = ``now``.

    ``poor`` is what ``quarantine`` found; ids it doesn't name, null ones too, stay.
    """
    named = poor.select("id", "hits", "mean").dropDuplicates(["id"])
    return mem.join(named.select("id"), "id", "left_anti"), mem.drop("hits", "mean").join(named, "id").withColumn("quarantined_at", now)


def purge_observed(archive: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The archive without rows whose observation of ``days`` is over; rows that aren't in quarantine stay."""
    return archive.where(F.col("quarantined_at").isNull() | (F.col("quarantined_at") + F.expr(f"interval {int(days)} days") > now))


def unfold(links: DataFrame) -> DataFrame:
    """Sources of each derived row (a, b) with equal weights."""
    n = F.count("*").over(W.partitionBy("a"))
    return links.select("a", "b", (1 / n).alias("weight"))


def backfill_derived(rows: DataFrame, version: int, derive: dict[str, Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Derived columns renewed where the row's version is older; other rows pass unchanged.

    With a ``limit`` only the ids at ``offset``.. in ascending order are
    renewed: batches that cover all ids add up to the full run, which alone
    renews rows without an id.  Asking again changes nothing.
    """
    stale = F.coalesce(F.col("derived_version") < version, F.lit(True))
    if limit is not None:
        batch = rows.select("id").where("id is not null").distinct().orderBy("id").offset(offset).limit(limit)
        rows = rows.join(batch.withColumn("__asked", F.lit(True)), "id", "left")
        stale = stale & F.coalesce(F.col("__asked"), F.lit(False))
    out = rows.withColumn("__stale", stale)
    for name, value in derive.items():
        out = out.withColumn(name, F.when(F.col("__stale"), value).otherwise(F.col(name)))
    return out.withColumn("derived_version", F.when(F.col("__stale"), version).otherwise(F.col("derived_version"))).drop("__stale", "__asked")


def backfill_progress(rows: DataFrame, version: int) -> DataFrame:
    """One row: total, and done, the rows whose derived columns are of that version or a newer one."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("derived_version") >= version).alias("done"))

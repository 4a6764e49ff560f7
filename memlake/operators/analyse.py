"""Relations, rankings, retrieval, statistics and evaluation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlake.functions import text as X
from memlake.operators.close_sets import close_pairs
from memlake.operators.substring import in_groups
from memlake.storage import checkpointed

#: Words asked for that a pass over the texts counts.
TERMS = 200_000


def same_event(mem: DataFrame, event: str = "event_id", most: int = 1000) -> DataFrame:
    """Pairs that share an event, smaller id first: a, b, event, linked_by.

    Two rows of an event of at most ``most`` rows are a ``pair``.  A larger
    event would give pairs by the square of its size; each of its rows is
    linked ``by its first`` one, the smallest id, and all rows with links of
    that kind and event are each other's (``event_members`` lists them).
    """
    sized = event_members(mem, event).withColumnRenamed("first", "__first")
    small = sized.where(F.col("size") <= most)
    a, b = small.select(event, F.col("id").alias("a")), small.select(event, F.col("id").alias("b"))
    stars = sized.where((F.col("size") > most) & (F.col("id") != F.col("__first"))).select(F.col("__first").alias("a"), F.col("id").alias("b"), event, F.lit("first").alias("linked_by"))
    return a.join(b, event).where("a < b").select("a", "b", event, F.lit("pair").alias("linked_by")).unionByName(stars)


def event_members(mem: DataFrame, event: str = "event_id") -> DataFrame:
    """event, id, first (the event's smallest id) and size of every row with an event: its relation in full, without pairs."""
    rows = mem.where(F.col(event).isNotNull()).select(event, "id").distinct()
    return rows.join(rows.groupBy(event).agg(F.count("*").alias("size"), F.min("id").alias("first")), event)


def document_frequency(docs: DataFrame, terms: Column, by: list[str] | None = None) -> DataFrame:
    """term, df over all documents, or within each group of ``by``; a document counts once for each of its ``terms``."""
    each = docs.select(*(by or []), F.explode(F.array_distinct(terms)).alias("term"))
    return each.groupBy(*(by or []), "term").agg(F.count("*").alias("df"))


def hubs(mentions: DataFrame, name: str, doc: str, group: str, least: int = 5, share: float = 0.35) -> DataFrame:
    """Names so general that they link too much: in ``least`` rows and a ``share`` of their group."""
    sizes = mentions.groupBy(group).agg(F.count_distinct(doc).alias("size"))
    df = mentions.groupBy(group, name).agg(F.count_distinct(doc).alias("df"))
    return df.join(sizes, group).where((F.col("df") >= least) & (F.col("df") >= share * F.col("size")))


def shared_names(mentions: DataFrame, name: str, doc: str, group: str) -> DataFrame:
    """Pairs of rows that share a name that is no hub, and how many they share."""
    usable = mentions.select(group, name, doc).distinct().join(hubs(mentions, name, doc, group), [group, name], "left_anti")
    a, b = usable.withColumnRenamed(doc, "a"), usable.withColumnRenamed(doc, "b")
    return a.join(b, [group, name]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def _word_sets(docs: DataFrame) -> DataFrame:
    """id and the SHA-256 that names the word set (no word holds a space); rows without words are left out."""
    sets = docs.select("id", F.array_sort(F.array_distinct(X.tokenize(F.col("content")))).alias("s")).where(F.size("s") > 0)
    return sets.select("id", F.sha2(F.array_join("s", " "), 256).alias("s"))


def copy_classes(docs: DataFrame) -> DataFrame:
    """id, representative: every document with words, and the smallest id of its word set (its own without a copy).

    With the pairs of ``near_dup_pairs`` or ``near_dup_pairs_lsh``, which are
    pairs of representatives, this is every near duplicate there is.
    """
    sets = _word_sets(docs)
    return sets.join(sets.groupBy("s").agg(F.min("id").alias("representative")), "s").select("id", "representative")


def class_sizes(docs: DataFrame) -> DataFrame:
    """id, copies: the representatives of ``copy_classes`` and how many documents each stands for, itself included."""
    return _word_sets(docs).groupBy("s").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies")


def near_dup_pairs(docs: DataFrame, t: float = 0.85) -> DataFrame:
    """All pairs with a Jaccard similarity of at least t over distinct words, exactly (``close_sets.close_pairs``).

    Exact copies of a set are joined as one representative each;
    ``copy_classes`` says which documents it stands for.
    """
    return close_pairs(docs.select("id", F.array_sort(F.array_distinct(X.tokenize(F.col("content")))).alias("s")), t)


def near_dup_char_pairs(docs: DataFrame, t: float = 0.85) -> DataFrame:
    """All pairs with a Jaccard similarity of at least t over distinct character pairs (``text.char_bigrams``): a, b, similarity.

    Character pairs are few and frequent, so no shared one says much; their
    sketches tell them apart (``close_sets.close_pairs``).  Equal sets are
    joined as one representative each, the smallest id; texts without
    character pairs resemble nothing.
    """
    return close_pairs(docs.select("id", F.array_sort(X.char_bigrams(F.col("content"))).alias("s")), t)


def postings(docs: DataFrame) -> DataFrame:
    """term, id, tf and the document's length."""
    tokens = docs.select("id", X.tokenize(F.col("content")).alias("t")).withColumn("length", F.size("t"))
    return tokens.select("id", "length", F.explode("t").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def term_stats(index: DataFrame) -> DataFrame:
    """term, df of an index of postings."""
    return index.groupBy("term").agg(F.count_distinct("id").alias("df"))


def append_postings(index: DataFrame, docs: DataFrame) -> DataFrame:
    """The index with the documents that it lacks; those it has stay as they are."""
    return index.unionByName(postings(docs.join(index.select("id").distinct(), "id", "left_anti")))


def bm25_points(queries: DataFrame, docs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """qid, id, points for every query(qid, content) and document that share a term.

    Every text is read and split once (again for each further ``TERMS`` words
    that are asked for): a task counts the words asked for in its texts, and
    one row a document, with their numbers and counts, goes through a reliable
    checkpoint.  Term scores are rounded to whole millionths before they are
    summed, so the order of summing doesn't matter.  Null texts count as
    documents, but not in the average length.
    """
    spark = docs.sparkSession
    wanted = queries.select("qid", F.explode(F.array_distinct(X.tokenize(F.col("content")))).alias("term"))
    texts = docs.select("id", X.tokenize(F.col("content")).alias("t"))
    schema = StructType([texts.schema["id"], *StructType.fromDDL("length int, counted boolean, numbers array<int>, tfs array<int>").fields])
    named, held = [], None
    for group in in_groups(wanted.select("term").distinct(), F.col("term"), TERMS):
        numbers = {r["term"]: len(named) + i for i, r in enumerate(group)}
        part = texts.mapInArrow(_term_counter(numbers, held is None), schema)
        named += numbers.items()
        held = part if held is None else held.unionByName(part)
    held = checkpointed(held)
    sent = F.broadcast if len(named) <= TERMS else lambda f: f
    every = held.where("counted")
    stats = every.agg(F.count("*").alias("docs"), (F.sum("length") / F.count("length")).alias("avg_length"))
    hits = held.select("id", "length", F.explode(F.arrays_zip("numbers", "tfs")).alias("h")).select("id", "length", F.col("h.numbers").alias("number"), F.col("h.tfs").alias("tf"))
    df = hits.groupBy("number").agg(F.count("*").alias("df"))
    scored = hits.join(sent(df), "number").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    value = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    valued = scored.select("number", "id", F.round(value * 1e6).cast("long").alias("points"))
    asked = wanted.join(F.broadcast(spark.createDataFrame(named, "term string, number int")), "term").select("qid", "number")
    return sent(asked).join(valued, "number").groupBy("qid", "id").agg(F.sum("points").alias("points"))


def _term_counter(numbers: dict[str, int], counted: bool):
    """id, length, counted, numbers and counts of the words in ``numbers`` for each row (id, t); all rows if ``counted``, else those with such a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                found = [(None if t is None else len(t), Counter(numbers[w] for w in t or () if w in numbers)) for t in part.column("t").to_pylist()]
                kept = [i for i, (_, c) in enumerate(found) if counted or c]
                lengths, counts = [found[i][0] for i in kept], [found[i][1] for i in kept]
                lists = pa.array([list(c) for c in counts], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int32()), pa.array([counted] * len(kept), pa.bool_()), *lists], ["id", "length", "counted", "numbers", "tfs"])

    return run


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents of each query(qid, content)."""
    return topk(bm25_points(queries, docs, k1, b), "qid", "points", "id", k).select("qid", "id", "rank", (F.col("points") / 1e6).alias("score"))


def search_chunks(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each query (qid, content) by BM25; a query without words has none (see ``newest_chunks``)."""
    return bm25(queries, chunks, k)


def newest_chunks(chunks: DataFrame, at: str, k: int) -> DataFrame:
    """What a search without keywords shows: the k newest chunks, with their rank."""
    top = chunks.orderBy(F.desc(at), F.desc("id")).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(at), F.desc("id"))))


def topk(df: DataFrame, by: str, score: str, name: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), name))).where(F.col("rank") <= k)


def rank_normalise(df: DataFrame, score: str, by: str) -> DataFrame:
    """Score over the best of its group; what isn't a positive number is 0."""
    good = F.when((F.col(score) > 0) & (F.col(score) < float("inf")), F.col(score)).otherwise(0.0)
    best = F.max(good).over(W.partitionBy(by))
    return df.withColumn("normal", F.when(best > 0, good / best).otherwise(0.0))


def rrf(runs: list[DataFrame], weights: list[float], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of runs (qid, id, rank)."""
    every = None
    for run, w in zip(runs, weights, strict=True):
        part = run.select("qid", "id", (F.lit(w) / (k + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("qid", "id").agg(F.sum("part").alias("score"), F.count("*").alias("routes"))


def evaluate(runs: DataFrame, qrels: DataFrame, top_k: int) -> DataFrame:
    """Reciprocal rank, hits, recall and first rank (top_k + 1 for a miss) of every judged query."""
    hits = qrels.join(runs, ["qid", "id"], "left").groupBy("qid").agg(F.min("rank").alias("first"), F.count("rank").alias("hits"), F.count("*").alias("relevant"))
    return hits.select("qid", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), "hits", (F.col("hits") / F.col("relevant")).alias("recall"), F.coalesce("first", F.lit(top_k + 1)).alias("first"))


def components(edges: DataFrame) -> DataFrame:
    """u, label: the smallest node reachable from each end of an edge (a, b).

    Alternating large-star and small-star rounds: each turns the edges into
    stars around ever smaller centres, with two grouped minima, until nothing
    moves (about the logarithm of the longest chain).  Every round's edges go
    through a reliable checkpoint.
    """
    nodes = edges.select(F.col("a").alias("u")).union(edges.select("b")).distinct()
    now = checkpointed(edges.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    before = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        centre = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(centre, "hi").select(F.explode(F.array("lo", "hi")).alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        now = checkpointed(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = now.groupBy("hi").agg(F.min("lo").alias("label")).select(F.col("hi").alias("u"), "label")
    return nodes.join(found, "u", "left").select("u", F.coalesce("label", "u").alias("label"))


def entropy(df: DataFrame, col: str, classes: int) -> DataFrame:
    counts = df.groupBy(col).count()
    total = counts.agg(F.sum("count").alias("total"))
    p = F.col("count") / F.col("total")
    return counts.join(F.broadcast(total)).agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy")).withColumn("balance", F.round(F.col("entropy") / math.log2(classes), 6))


def near_dup_pairs_lsh(docs: DataFrame, t: float = 0.85, bands: int = 20, rows: int = 5) -> DataFrame:
    """Pairs of ``near_dup_pairs`` (representatives, see ``copy_classes``) found through MinHash bands, each confirmed on the full sets."""
    sets = docs.select("id", F.array_sort(F.array_distinct(X.tokenize(F.col("content")))).alias("s")).where(F.size("s") > 0)
    reps = sets.groupBy("s").agg(F.min("id").alias("id"))
    sample = lambda i: F.array_min(F.transform("s", lambda w: F.xxhash64(F.lit(i), w)))
    keys = F.array(*[F.xxhash64(F.lit(b), *[sample(b * rows + r) for r in range(rows)]) for b in range(bands)])
    buckets = reps.select("id", F.explode(keys).alias("key"))
    pairs = buckets.select(F.col("id").alias("a"), "key").join(buckets.select(F.col("id").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    sa, sb = (reps.select(F.col("id").alias(x), F.col("s").alias("s" + x)) for x in ("a", "b"))
    return pairs.join(sa, "a").join(sb, "b").withColumn("similarity", X.jaccard(F.col("sa"), F.col("sb"))).where(F.col("similarity") >= t).select("a", "b", "similarity")


def recall_semantic(queries: DataFrame, vectors: DataFrame, visible: DataFrame, k: int) -> DataFrame:
    """Exact vector top-k over the rows a caller may see."""
    from memlake.operators.vectors import vector_topk

    return vector_topk(queries, vectors.join(visible.select("id"), "id", "left_semi"), k)


def rediscover(triggers: DataFrame, mem: DataFrame, now_minutes: int, contexts: DataFrame | None = None, least: float = 0.35, stale_days: int = 7, most: int = 3, pool: int = 50) -> DataFrame:
    """Old rows that a trigger (qid, content) brings back: qid, id, normal, rank.

    Only rows untouched for ``stale_days`` are ranked, the ``pool`` best for
    the trigger and, where there is one, for its context (qid, content); the
    two rankings are fused by reciprocal ranks.  Rows with ``least`` of the
    best fused score stay, ``most`` a trigger.
    """
    old = mem.where(now_minutes - F.col("age_minutes") >= stale_days * 1440).select("id")
    every = None
    for asked in [triggers] if contexts is None else [triggers, contexts]:
        run = topk(bm25_points(asked, mem).join(old, "id", "left_semi"), "qid", "points", "id", pool)
        part = run.select("qid", "id", F.round(1e9 / (60 + F.col("rank"))).cast("long").alias("part"))
        every = part if every is None else every.unionByName(part)
    ranked = rank_normalise(every.groupBy("qid", "id").agg(F.sum("part").alias("points")), "points", "qid")
    return topk(ranked.where(F.col("normal") >= least).select("qid", "id", F.round("normal", 9).alias("normal")), "qid", "normal", "id", most)


def multi_view_recall(views: DataFrame, mem: DataFrame, k: int) -> DataFrame:
    """Rankings of several wordings (qid, view, content) of a question, fused into one."""
    each = views.withColumn("v", F.struct("qid", "view"))
    runs = bm25(each.select(F.col("v").alias("qid"), "content"), mem, k)
    fused = runs.groupBy(F.col("qid.qid").alias("qid"), "id").agg(F.sum(F.round(1e9 / (60 + F.col("rank"))).cast("long")).alias("points"))
    return topk(fused, "qid", "points", "id", k)

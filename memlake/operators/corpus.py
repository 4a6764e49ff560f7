"""Transcripts to sentences, scores, error blocks and distilled items; texts to chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import rules as R
from memlake.functions import text as X
from memlake.storage import checkpointed

WEIGHTS = {"decision": 2, "convention": 2, "weak": 1, "preference": 2, "negation": 2, "conclusion": 1, "proper": 1}


def sentences(turns: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row per sentence with its place in the turn; a turn that declares its kind is one sentence."""
    whole = F.array(R.bare(F.col(content)))
    parts = F.when(R.explicit_kind(F.col(content)).isNotNull(), whole).otherwise(R.split_sentences(F.col(content)))
    return turns.select(*keys, F.posexplode(parts).alias("pos", "sentence"))


def score_sentences(rows: DataFrame, col: str = "sentence") -> DataFrame:
    """Score and kind of each sentence; a question costs one point, a declared kind scores 3 whatever the words."""
    s = F.col(col)
    counts = {
        "decision": R.count_hits(s, R.DECISION), "convention": R.count_hits(s, R.CONVENTION), "weak": R.count_hits(s, R.WEAK), "preference": R.preference_hits(s),
        "negation": R.count_hits(s, R.NEGATION), "conclusion": R.count_hits(s, R.CONCLUSION), "proper": R.proper_nouns(s),
    }
    counted = rows.withColumn("__n", F.struct(*[c.alias(n) for n, c in counts.items()]))
    score = sum(F.col(f"__n.{n}") * w for n, w in WEIGHTS.items()) - R.is_question(s).cast("int")
    firm = F.col("__n.negation") + F.col("__n.convention") + F.col("__n.weak") > 0
    kind = F.when(F.col("__n.decision") > 0, "decision").when(firm, "constraint").when(F.col("__n.preference") > 0, "preference").when(F.col("__n.conclusion") > 0, "conclusion").otherwise("code_context")
    told = R.explicit_kind(s)
    return counted.withColumn("score", F.when(told.isNotNull(), 3).otherwise(score)).withColumn("kind", F.coalesce(told, kind)).drop("__n")


def first_per_key(rows: DataFrame, by: list[str], text: str, order: list) -> DataFrame:
    """The first row of each normalised text (white space removed, lower-cased)."""
    key = F.lower(F.regexp_replace(text, r"\s+", ""))
    return rows.withColumn("__k", key).withColumn("__r", F.row_number().over(W.partitionBy(*by, "__k").orderBy(*order))).where("__r = 1").drop("__k", "__r")


def distill(turns: DataFrame, conv: str, turn: str, content: str = "content", threshold: float = 2.0, cap: int = 40) -> DataFrame:
    """What is worth keeping of each conversation, in its order: conv, turn, pos, sentence, score, kind.

    Sentences over the threshold that are no noise and no numbered step, and
    error blocks (score 4, kind error, pos is their line); each text once, the
    ``cap`` best.
    """
    scored = score_sentences(sentences(turns, [conv, turn], content))
    numbered = F.col("sentence").rlike(r"^\s*[0-9]+[.)、](\s|$)") & ~R.has_any(F.col("sentence"), ["禁止", "严禁", "不得", "不要", "不能", "切勿", "杜绝", "不允许"])
    kept = scored.where((F.col("score") >= threshold) & ~R.is_markdown_noise(F.col("sentence")) & ~numbered)
    blocks = error_blocks(turns, [conv, turn], content, per=conv, order=[turn])
    failed = blocks.select(conv, turn, F.col("line").alias("pos"), F.col("block").alias("sentence"), F.lit(4).alias("score"), F.lit("error").alias("kind"))
    every = kept.select(conv, turn, "pos", "sentence", "score", "kind").unionByName(failed)
    once = first_per_key(every, [conv], "sentence", [turn, "pos", "kind"])
    return cap_then_restore_order(once, conv, "score", [turn, "pos", "kind"], cap)


def cap_then_restore_order(rows: DataFrame, by: str, score: str, order: list[str], k: int) -> DataFrame:
    """The k best rows of each group, back in their own order."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), *order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank").sortWithinPartitions(by, *order)


def distill_digest(items: DataFrame, conv: str) -> DataFrame:
    counts = items.groupBy(conv).agg(F.count("*").alias("items"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("decision", "constraint", "preference")])
    return counts.withColumn("digest", F.concat_ws(", ", F.concat("items", F.lit(" items")), F.concat("decision", F.lit(" decisions")), F.concat("constraint", F.lit(" constraints"))))


def guarded(turns: DataFrame, conv: str, content: str = "content", markers: list[str] = R.DELETION) -> DataFrame:
    """Conversations of which no turn speaks of deleting a record; ``markers`` are the phrases that say so."""
    return turns.join(turns.where(R.has_any(F.col(content), markers)).select(conv).distinct(), conv, "left_anti")


def error_blocks(turns: DataFrame, keys: list[str], content: str = "content", most: int = 12, chars: int = 300, per: str | None = None, order: list[str] | None = None, blocks: int = 10) -> DataFrame:
    """Blocks of a text from a line with an error marker to the next blank line, at most ``most`` lines.

    A marker within a running block starts none.  Each text's lines are folded
    in order inside its row.  With ``per``, the first ``blocks`` of each group
    in ``order`` stay.  ``importance`` is 8.
    """
    lines = F.split(F.col(content), "\n")
    start = F.struct(F.array().cast("array<struct<line:int,block:string,n:int>>").alias("blocks"), F.lit(False).alias("open"), F.lit(0).alias("i"))

    def step(s: Column, line: Column) -> Column:
        last, blank = F.element_at(s["blocks"], -1), R.bare(line) == ""
        runs = s["open"] & ~blank & (last["n"] < most)
        opens = ~runs & R.has_any(line, R.ERROR)
        longer = F.struct(last["line"].alias("line"), F.concat(last["block"], F.lit("\n"), line).alias("block"), (last["n"] + 1).alias("n"))
        fresh = F.struct(s["i"].alias("line"), line.alias("block"), F.lit(1).alias("n"))
        more = F.when(runs, F.concat(F.slice(s["blocks"], F.lit(1), F.size(s["blocks"]) - 1), F.array(longer))).when(opens, F.concat(s["blocks"], F.array(fresh))).otherwise(s["blocks"])
        return F.struct(more.alias("blocks"), (runs | opens).alias("open"), (s["i"] + 1).alias("i"))

    hit = turns.where(R.has_any(F.col(content), R.ERROR))
    found = hit.select(*keys, F.explode(F.aggregate(lines, start, step, lambda s: s["blocks"])).alias("b"))
    out = found.select(*keys, "b.line", F.substring(R.bare(F.col("b.block")), 1, chars).alias("block"), F.lit(8).alias("importance"))
    if per is None:
        return out
    place = F.row_number().over(W.partitionBy(per).orderBy(*(order or []), "line"))
    return out.withColumn("__place", place).where(F.col("__place") <= blocks).drop("__place")


def chunk_paragraphs(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Paragraphs between blank lines: chunk_no, content."""
    parts = F.filter(F.transform(F.split(F.col(content), r"\n[ \t]*\n"), R.bare), lambda p: p != "")
    return files.select(key, F.posexplode(parts).alias("chunk_no", "content"))


def chunk_markdown(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Sections by ``#`` and ``##`` headings with their line ranges (from 1); text before the first is a section too."""
    lines = files.select(key, F.posexplode(F.split(F.col(content), "\n")).alias("i", "line"))
    heads = F.sum(F.col("line").rlike("^##? ").cast("int")).over(W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]))
    chunks = lines.withColumn("section", heads).groupBy(key, "section").agg((F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), body.alias("content"))
    return chunks.where(R.bare(F.col("content")) != "")


def chunk_windows(rows: DataFrame, key: str, content: str = "content", n: int = 160) -> DataFrame:
    return rows.select(key, F.posexplode(X.windows(F.col(content), n)).alias("window_no", "content"))


def declared_items(turns: DataFrame, conv: str, turn: str, marker: str, kinds: dict[str, str], content: str = "content") -> DataFrame:
    """Items of the last declared block of each conversation: turn, pos, kind, item, tags, verdict (ok, unknown_kind, empty).

    A block follows the marker line up to a heading, a rule or the end, as a
    JSON array of {type, content, supersedes} or as ``kind: text`` lines.
    Tags name where the item comes from, its kind and, by its first 40
    characters, what it supersedes.  Without a conversation turns belong
    together.
    """
    marked = turns.where(F.contains(content, F.lit(marker)))
    last = marked.groupBy(conv).agg(F.max_by(F.struct(F.col(turn).alias("turn"), F.col(content).alias("content")), turn).alias("t"))
    block = F.regexp_replace(F.element_at(F.split("t.content", r"\Q" + marker + r"\E"), -1), r"(?s)\n(?:#|---).*$", "")
    rows = last.select(conv, F.col("t.turn").alias(turn), R.bare(block).alias("b"))
    parsed = F.from_json("b", "array<struct<type:string,content:string,supersedes:string>>")
    lines = F.filter(F.split("b", "\n"), lambda x: x.rlike(r"^\s*[-*]?\s*\w+\s*[:：]"))
    plain = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^\s*[-*]?\s*(\w+)", 1)).alias("type"), R.bare(F.regexp_extract(x, "[:：](.*)$", 1)).alias("content"), F.lit(None).cast("string").alias("supersedes")))
    items = rows.select(conv, turn, F.posexplode(F.when(F.startswith("b", F.lit("[")), parsed).otherwise(plain)).alias("pos", "i"))
    known = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.lower("i.type")]
    verdict = F.when(known.isNull(), "unknown_kind").when(F.coalesce(F.trim("i.content"), F.lit("")) == "", "empty").otherwise("ok")
    instead = F.substring(R.bare(F.col("i.supersedes")), 1, 40)
    tags = F.array_compact(F.array(F.lit("distilled"), F.lit("model_declared"), known, F.when(instead != "", F.concat(F.lit("supersedes:"), instead))))
    return items.select(conv, turn, "pos", known.alias("kind"), F.col("i.content").alias("item"), tags.alias("tags"), verdict.alias("verdict"))


def dedupe_within(items: DataFrame, by: str, order: list[str], text: str, importance: str, t: float = 0.85) -> DataFrame:
    """Later items that resemble an earlier one (character pairs) fold into it: the first text, the highest importance, how many.

    Equal texts are one item at its first place.  Items of one ``by`` meet
    over the rare character pairs that any partner at t must share (prefix
    filter), so none is missed; each then folds into the first kept item that
    it resembles.  Only the places of similar pairs are walked in order.
    Texts without character pairs resemble nothing.  Rows with a null ``by``
    are a group of their own.
    """
    name, kind, by = by, items.schema[by].dataType.simpleString(), "__by"
    items = items.withColumn(by, F.to_json(F.struct(F.col(name).alias("by"))))  # a null gives {}
    same = items.groupBy(by, text).agg(F.min(name).alias("__name"), F.min(F.struct(*order)).alias("o"), F.max(importance).alias("importance"), F.count("*").alias("n"))
    sets = same.withColumn("i", F.row_number().over(W.partitionBy(by).orderBy("o", text))).withColumn("g", X.char_bigrams(F.col(text)))
    sets = checkpointed(sets)
    each = sets.select(by, "i", F.size("g").alias("size"), F.explode("g").alias("w"))
    rarity = each.groupBy(by, "w").agg(F.count("*").alias("df")).where("df > 1")
    place = F.row_number().over(W.partitionBy(by, "i").orderBy("df", "w"))
    # Pairs of characters seen once come first in the order of rarity and meet nothing.
    shared = each.join(rarity, [by, "w"]).withColumn("alone", F.col("size") - F.count("*").over(W.partitionBy(by, "i")))
    prefix = shared.withColumn("place", place + F.col("alone")).where(F.col("place") <= F.col("size") - F.ceil(t * F.col("size") - 1e-9) + 1)
    x, y = (prefix.select(by, "w", F.col("i").alias(n), F.col("size").alias("s" + n)) for n in ("x", "y"))
    close = (F.col("x") < F.col("y")) & (F.least("sx", "sy") >= t * F.greatest("sx", "sy") - 1e-9)
    pairs = x.join(y, [by, "w"]).where(close).select(by, "x", "y").distinct()
    gx, gy = (sets.select(by, F.col("i").alias(n), F.col("g").alias("g" + n)) for n in ("x", "y"))
    near = pairs.join(gx, [by, "x"]).join(gy, [by, "y"]).where(X.jaccard(F.col("gx"), F.col("gy")) >= t).select(by, "x", "y")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        into: dict[int, int] = {}
        for later, earlier in group.groupby("y")["x"]:
            first = min((e for e in earlier if e not in into), default=None)
            if first is not None:
                into[later] = first
        return pd.DataFrame({by: [group[by].iloc[0]] * len(into), "i": list(into), "head": list(into.values())})

    folded = near.groupBy(by).applyInPandas(walk, f"{by} string, i int, head int")
    headed = sets.join(folded, [by, "i"], "left").withColumn("head", F.coalesce("head", "i"))
    best = headed.groupBy(by, "head").agg(F.max("importance").cast("int").alias("importance"), F.sum("n").alias("n")).withColumnRenamed("head", "i")
    return sets.select(by, "__name", "i", "o", text).join(best, [by, "i"]).select(F.col("__name").cast(kind).alias(name), "o.*", text, "importance", "n")


def _join_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which a null key meets a null key."""
    renamed, same = right, F.lit(True)
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__{k}")
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, same, how).drop(*[f"__{k}" for k in keys])


def absorb(turns: DataFrame, conv: str, turn: str, content: str = "content", cap: int = 4, most: int = 10, marker: str | None = None, kinds: dict[str, str] | None = None) -> DataFrame:
    """Every item that a run considers, and what becomes of it: conv, turn, pos, kind, sentence, importance, event_id, reason.

    A conversation with a declared block (``marker``) gives the items of that
    block and nothing else, even if none is good; any other is distilled.
    Reasons, the first that holds: ``unknown_kind`` or ``empty`` (declared
    items), ``deletion`` (the conversation speaks of deleting a record),
    ``narration``, ``duplicate`` (folded into an earlier item), ``over_limit``
    (more than ``most``, lowest scores first), else ``kept``.  Importance is
    at most ``cap`` (1 to 6).  Nothing is written: ``write.remember`` takes the
    kept items, and leaving it out is the dry run.  Turns without a
    conversation belong together.
    """
    cap, source = min(max(cap, 1), 6), turns
    every = None
    if marker is not None:
        found = declared_items(turns, conv, turn, marker, kinds or {}, content)
        every = found.select(conv, turn, "pos", "kind", F.coalesce("item", F.lit("")).alias("sentence"), F.lit(3).alias("score"), "verdict")
        source = _join_safe(turns, turns.where(F.contains(content, F.lit(marker))).select(conv).distinct(), [conv], "left_anti")
    distilled = distill(source, conv, turn, content).select(conv, turn, "pos", "kind", "sentence", "score", F.lit("ok").alias("verdict"))
    every = distilled if every is None else every.unionByName(distilled)
    told = turns.where(R.has_any(F.col(content), R.DELETION)).select(conv).distinct().withColumn("__told", F.lit(True))
    early = F.when(F.col("verdict") != "ok", F.col("verdict")).when(F.col("__told"), "deletion").when(R.is_process_narration(F.col("sentence")), "narration")
    judged = checkpointed(_join_safe(every, told, [conv], "left").withColumn("early", early).drop("__told", "verdict"))
    order = [turn, "pos", "kind"]
    open_ = judged.where("early is null")
    first = dedupe_within(open_.withColumn("__score", F.col("score")), conv, order, "sentence", "__score").select(conv, *order, "sentence", F.lit(True).alias("__first"))
    placed = _join_safe(open_, first, [conv, *order, "sentence"], "left")
    rank = F.row_number().over(W.partitionBy(conv, F.col("__first").isNotNull()).orderBy(F.desc("score"), *order))
    late = F.when(F.col("__first").isNull(), "duplicate").when(rank > most, "over_limit").otherwise("kept")
    out = placed.select(*judged.columns, late.alias("reason")).unionByName(judged.where("early is not null").withColumn("reason", F.col("early"))).drop("early")
    importance = F.least(X.importance_from_score(F.col("score").cast("double")), F.lit(cap))
    return out.select(conv, turn, "pos", "kind", "sentence", importance.alias("importance"), F.concat(F.lit("session:"), F.col(conv).cast("string")).alias("event_id"), "reason")


def absorb_counts(items: DataFrame, conv: str) -> DataFrame:
    """Per conversation: items considered, and how many fell to each reason."""
    reasons = ("kept", "duplicate", "over_limit", "narration", "deletion", "unknown_kind", "empty")
    return items.groupBy(conv).agg(F.count("*").alias("considered"), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons])

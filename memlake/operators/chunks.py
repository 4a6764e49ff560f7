"""Files to chunks with line ranges: definitions of source code, and turns of written conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions.rules import bare

# What begins a definition, by language; group 1 is the kind, group 2 the name.
_TS_LEAD = r"^(?:(?:export default|export|public|private|protected|static|abstract|async|declare|readonly)\s+)*"
DEFINITIONS = {
    "rust": [r'^(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|default|extern\s+"[^"]*")\s+)*(fn|struct|trait|enum|impl|mod) (?!(?:where|for|dyn|type)\b)([\p{L}\p{N}_!]+)'],
    "python": [r"^(?:async )?(def|class) (?!self\s*[(:])([^(:]*[^(:\s])"],
    "typescript": [_TS_LEAD + r"(interface|type|enum|function|class) ([\p{L}\p{N}_]+)", _TS_LEAD + r"(?:const|let|var) ()([^=]*[^=\s])\s*=\s*(?:async \(|\(|<)"],
    "javascript": [_TS_LEAD + r"(function|class) ([\p{L}\p{N}_]+)", _TS_LEAD + r"(?:const|let|var) ()([^=]*[^=\s])\s*=\s*(?:async \(|\(|<)"],
    "go": [r"^(func) \([^)]*\)\s*([^({\s]+)", r"^(func|type) ([^({\s]+)"],
}
# Comment lines that may document what follows, and what is cut off them.
DOC_LINES = {"rust": (r"^//[/!]", r"^//[/!]\s*"), "python": (r"^#", r"^#\s?"), "typescript": (r"^(?:/\*\*|\*)", r"^(?:/\*\*|\*/?)\s?"), "javascript": (r"^(?:/\*\*|\*)", r"^(?:/\*\*|\*/?)\s?")}
# The words by which a line of a written conversation names who speaks.
ROLES = {"User": ("User", "USER", "用户"), "Assistant": ("Assistant", "ASSISTANT", "助手"), "System": ("System", "SYSTEM", "系统")}


def _by_language(language: Column, values: dict[str, Column], default: Column) -> Column:
    return reduce(lambda out, kv: F.when(language == kv[0], kv[1]).otherwise(out), values.items(), default)


def _definition(line: Column, patterns: list[str]) -> Column:
    """Kind and name of the definition that a line begins; null if none.  An unnamed kind (a variable that holds a function) is ``fn``."""
    out = F.lit(None).cast("struct<kind:string,name:string>")
    for p in reversed(patterns):
        kind = F.regexp_extract(line, p, 1)
        found = F.struct(F.when(kind == "", "fn").otherwise(kind).alias("kind"), F.regexp_extract(line, p, 2).alias("name"))
        out = F.when(line.rlike(p), found).otherwise(out)
    return out


def _comment(lines: Column, marks: str) -> Column:
    """The lines of a comment without their marks, empty ones left out."""
    plain = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(bare(x), marks, ""), r"\s*\*/$", ""))
    return F.filter(plain, lambda x: x != "")


def chunk_code(files: DataFrame, key: str = "path", language: str = "language", content: str = "content") -> DataFrame:
    """Definitions of Rust, Go, TypeScript, JavaScript and Python files: key, start_line, end_line, chunk_type, name, signature, content, doc_comment, language.

    A body ends where its braces are balanced again (in Python, before the
    next line that isn't indented further; blank lines belong to it); without
    a body, or with one that is never closed, the first line is the chunk.  A
    definition inside another belongs to that.  Comment lines above, with
    blank lines between, document it.  Files of other languages, and null
    texts, give nothing.  Lines count from 1.
    """
    source = files.where(F.col(language).isin(*DEFINITIONS) & F.col(content).isNotNull()).select(F.col(key), F.col(language).alias("language"), F.split(content, "\r?\n").alias("__lines"))
    each = source.select(key, "language", F.posexplode("__lines").alias("i", "line"))
    text = bare(F.col("line"))
    count = lambda c: F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))
    so_far = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    is_doc = _by_language(F.col("language"), {k: text.rlike(p) for k, (p, _) in DOC_LINES.items()}, F.lit(False))
    skipped = text.rlike(r"^(?://|/\*|@)") | (text == "") | ((F.col("language") == "python") & text.rlike("^#"))
    marked = each.select(
        key, "language", "i", text.alias("text"), F.length(F.regexp_extract("line", r"^\s*", 0)).alias("indent"),
        F.coalesce(F.sum(count("{") - count("}")).over(before), F.lit(0)).alias("outer"), F.sum(count("{") - count("}")).over(so_far).alias("depth"),
        F.coalesce(F.sum(count("{")).over(before), F.lit(0)).alias("opened_before"), F.sum(count("{")).over(so_far).alias("opened"),
        F.max(F.when(~is_doc & (text != ""), F.col("i"))).over(before).alias("last_code"),
        F.when(~skipped, _by_language(F.col("language"), {k: _definition(text, p) for k, p in DEFINITIONS.items()}, F.lit(None).cast("struct<kind:string,name:string>"))).alias("d"),
    )
    shape = marked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "depth", "opened", "indent", (F.col("text") == "").alias("blank")))).alias("shape"))
    starts = marked.where("d is not null").join(shape, key)
    closed = F.array_min(F.transform(F.filter("shape", lambda x: (x["i"] >= F.col("i")) & (x["depth"] == F.col("outer")) & (x["opened"] > F.col("opened_before"))), lambda x: x["i"]))
    dedent = F.array_min(F.transform(F.filter("shape", lambda x: (x["i"] > F.col("i")) & ~x["blank"] & (x["indent"] <= F.col("indent"))), lambda x: x["i"]))
    indented = F.when(F.col("text").endswith(":"), F.coalesce(dedent, F.size("shape")) - 1).otherwise(F.col("i"))
    ended = starts.withColumn("end", F.when(F.col("language") == "python", indented).otherwise(F.coalesce(closed, F.col("i"))))
    item = F.struct("i", "end", F.col("d.kind").alias("kind"), F.col("d.name").alias("name"), F.col("text").alias("signature"), (F.coalesce("last_code", F.lit(-1)) + 1).alias("doc_from"))
    per_file = ended.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("found"))
    none = F.slice("found", F.lit(1), F.lit(0))
    outermost = F.aggregate("found", none, lambda kept, x: F.when(F.coalesce(F.try_element_at(kept, F.lit(-1))["end"] >= x["i"], F.lit(False)), kept).otherwise(F.concat(kept, F.array(x))))
    kept = per_file.select(key, F.explode(outermost).alias("c")).join(source, key)
    above = F.slice("__lines", F.col("c.doc_from") + 1, F.col("c.i") - F.col("c.doc_from"))
    docs = {k: _comment(above, p) for k, (_, p) in DOC_LINES.items()}
    doc = F.array_join(_by_language(F.col("language"), docs, F.array().cast("array<string>")), "\n")
    return kept.select(
        key, (F.col("c.i") + 1).alias("start_line"), (F.col("c.end") + 1).alias("end_line"), F.col("c.kind").alias("chunk_type"), F.col("c.name").alias("name"), F.col("c.signature").alias("signature"),
        F.array_join(F.slice("__lines", F.col("c.i") + 1, F.col("c.end") - F.col("c.i") + 1), "\n").alias("content"), F.when(doc != "", doc).alias("doc_comment"), "language",
    )


def chunk_roles(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Turns of a written conversation: key, turn_no, role, start_line, end_line, content.

    A line that begins with a role and a colon (plain or wide) begins a turn;
    lines before the first have no role and belong to none.  A text without
    any role gives nothing.
    """
    named = {role: rf"^\s*(?:{'|'.join(words)})[:：]" for role, words in ROLES.items()}
    lines = files.select(key, F.posexplode(F.split(F.col(content), "\r?\n")).alias("i", "line"))
    role = reduce(lambda out, kv: F.when(F.col("line").rlike(kv[1]), kv[0]).otherwise(out), named.items(), F.lit(None).cast("string"))
    turn = F.count("role").over(W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    told = lines.withColumn("role", role).withColumn("turn_no", turn).where("turn_no > 0")
    spoken = F.regexp_replace("line", "|".join(f"(?:{p})" for p in named.values()), "")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("role").isNotNull(), spoken).otherwise(F.col("line")).alias("line")))), lambda x: x["line"]), "\n")
    turns = told.groupBy(key, "turn_no").agg(F.max("role").alias("role"), (F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), bare(body).alias("content"))
    return turns.select(key, "turn_no", "role", "start_line", "end_line", "content")


def chunk_corpus(files: DataFrame, key: str = "path", language: str = "language", content: str = "content") -> DataFrame:
    """All files to chunks: key, start_line, end_line, chunk_type, name, signature, content, doc_comment, language.

    Rust, Go, TypeScript, JavaScript and Python files give their definitions
    (``chunk_code``), Markdown its sections, named by their heading.  Of other
    texts those with role lines give turns, named by the role, and the rest
    paragraphs.  A source file without any definition is read as paragraphs.
    Null and blank texts give nothing.  Every kind is a pass of its own over
    its files only.
    """
    from memlake.operators.corpus import chunk_markdown

    files = files.select(F.col(key), F.coalesce(F.col(language), F.lit("text")).alias("language"), F.col(content).alias("content")).where("content is not null")
    code = chunk_code(files, key, "language", "content")
    columns = code.columns
    source, sections = F.col("language").isin(*DEFINITIONS), F.col("language") == "markdown"
    bare_source = files.where(source).join(code.select(key).distinct(), key, "left_anti")
    named = "|".join(w for words in ROLES.values() for w in words)
    spoken = F.col("content").rlike(rf"(?m)^\s*(?:{named})[:：]")
    texts = files.where(~source & ~sections)

    def shaped(chunks: DataFrame, kind: str, name: Column) -> DataFrame:
        none, whose = F.lit(None).cast("string"), files.select(key, "language")
        told = chunks.select(key, F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.lit(kind).alias("chunk_type"), name.alias("name"), none.alias("signature"), "content", none.alias("doc_comment"))
        return told.join(whose, key).select(*columns)

    heading = F.when(F.col("content").rlike("^#"), F.regexp_extract("content", r"^#+\s*(.*)", 1))
    marked = shaped(chunk_markdown(files.where(sections), key, "content"), "section", heading)
    turns = shaped(chunk_roles(texts.where(spoken), key, "content"), "turn", F.col("role"))
    plain = shaped(paragraph_lines(texts.where(~spoken).unionByName(bare_source), key), "paragraph", F.lit(None).cast("string"))
    typed = code.withColumn("start_line", F.col("start_line").cast("int")).withColumn("end_line", F.col("end_line").cast("int"))
    return typed.unionByName(marked).unionByName(turns).unionByName(plain)


def paragraph_lines(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Runs of lines that aren't blank: key, start_line, end_line, content."""
    lines = files.select(key, F.posexplode(F.split(F.col(content), "\r?\n")).alias("i", "line"))
    blank = bare(F.col("line")) == ""
    run = F.count_if(blank).over(W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    held = lines.withColumn("run", run).where(~blank).groupBy(key, "run")
    return held.agg((F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), body.alias("content")).drop("run")

"""Files in and out: transcripts, hook payloads, document trees, bundles, snapshots, run logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.text import LANGUAGES, PLAIN, detect_language
from memlake.operators.store import replay_wal
from memlake.storage import scratch  # noqa: F401  (part of this module's surface)

BUNDLE_VERSION = "2.0"
# Names under which hosts send a field.
ALIASES = {
    "text": ["last_assistant_message", "last-assistant-message", "text", "response"],
    "session_id": ["session_id", "sessionId", "thread-id", "thread_id", "conversation_id"],
    "host": ["host"],
    "project": ["project"],
    "cwd": ["cwd"],
}
HOST_FIELDS = r'(?:last-assistant-message|last_assistant_message|stop_hook_active|hook_event_name)"?:'


def turn_texts(line: Column) -> Column:
    """A transcript line's text: message.content, its text parts joined, or the line itself where it isn't JSON."""
    content = F.get_json_object(line, "$.message.content")
    parts = F.array_join(F.from_json(content, "array<struct<text:string>>")["text"], "\n")
    broken = F.try_parse_json(line).isNull() | ~line.rlike(r"^\s*\{")
    return F.when(broken, line).otherwise(F.when(content.rlike(r"^\s*\[\s*\{"), parts).otherwise(content))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (ascending within a file), text; blank lines are dropped, broken JSON stays as text."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), turn_texts(F.col("value")).alias("text"))
    return lines.where("trim(text) != ''")


def hook_payload(raw: Column) -> Column:
    """text, session_id, host, project and cwd of a payload, whatever names the host uses.

    Stop-hook payloads and broken ones that look like payloads have an empty
    text; what isn't JSON is itself the text.
    """
    t = F.trim(raw)
    ok = t.startswith("{") & F.try_parse_json(t).isNotNull()
    pick = lambda names: F.coalesce(*[F.get_json_object(t, f"$['{n}']") for n in names])
    stopped = F.coalesce(F.get_json_object(t, "$.stop_hook_active") == "true", F.lit(False))
    text = F.when(ok, F.when(stopped, "").otherwise(F.coalesce(pick(ALIASES["text"]), F.lit("")))).when(t.startswith("{") & t.rlike(HOST_FIELDS), "").otherwise(t)
    fields = [F.when(ok, pick(names)).alias(name) for name, names in ALIASES.items() if name not in ("text", "cwd")]
    cwd = F.when(ok, F.coalesce(pick(ALIASES["cwd"]), F.get_json_object(t, "$.workspace_roots[0]")))
    return F.struct(text.alias("text"), *fields, cwd.alias("cwd"))


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Files of known kinds under a folder: path, language, content; content is null where a file isn't UTF-8."""
    kinds = ",".join([*LANGUAGES, *PLAIN])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{kinds}}}").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", detect_language(F.col("path")).alias("language"), text.alias("content"))


def scan_report(files: DataFrame) -> DataFrame:
    """Per language: files read, and files left out because they aren't UTF-8."""
    read = F.col("content").isNotNull()
    return files.groupBy("language").agg(F.count_if(read).alias("files"), F.count_if(~read).alias("unreadable"))


def write_bundle(kinds: dict[str, DataFrame], path: str, rows_per_file: int = 10000) -> None:
    """JSON envelopes of at most about ``rows_per_file`` records each; together they are the bundle."""
    for kind, rows in kinds.items():
        slices = max(1, -(-rows.count() // rows_per_file))
        record = rows.select(F.struct(*rows.columns).alias("r"))
        sliced = record.groupBy(F.pmod(F.xxhash64(F.to_json("r")), F.lit(slices)).alias("s")).agg(F.collect_list("r").alias(kind))
        sliced.select(F.to_json(F.struct(F.lit(BUNDLE_VERSION).alias("version"), F.lit("memlake").alias("source"), kind)).alias("value")).write.mode("append").text(path)


def read_bundle(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The records of one kind; envelopes of another version are an error."""
    whole = spark.read.text(path, wholetext=False).select(F.from_json("value", f"version string, {kind} array<struct<{schema}>>").alias("e"))
    if not whole.where(~F.coalesce(F.col("e.version") == BUNDLE_VERSION, F.lit(False))).isEmpty():
        raise ValueError(f"bundle: only version {BUNDLE_VERSION} can be read")
    return whole.select(F.explode(f"e.{kind}").alias("r")).select("r.*")


def bundle_counts(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("memories", "chunks", "archive")) -> DataFrame:
    """A dry run: kind and how many records an import would read; nothing is written."""
    fields = ", ".join(f"{k} array<string>" for k in kinds)
    e = spark.read.text(path).select(F.from_json("value", f"version string, {fields}").alias("e"))
    if not e.where(~F.coalesce(F.col("e.version") == BUNDLE_VERSION, F.lit(False))).isEmpty():
        raise ValueError(f"bundle: only version {BUNDLE_VERSION} can be read")
    sizes = [F.sum(F.coalesce(F.array_size(f"e.{k}"), F.lit(0))).alias(k) for k in kinds]
    return e.agg(*sizes).unpivot([], list(kinds), "kind", "records")


def compact_to_snapshot(log: DataFrame, key: str, seq: str, op: str, path: str) -> DataFrame:
    """Write the minimal log with the same replay, and read it back."""
    replay_wal(log, key, seq, op).withColumn(op, F.lit("upsert")).write.mode("overwrite").parquet(path)
    return log.sparkSession.read.parquet(path)


def append_run(outcomes: DataFrame, path: str) -> None:
    outcomes.write.mode("append").parquet(path)


def newest_runs(spark: SparkSession, path: str, order: str, n: int) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc(order)).limit(n)


def jdbc_load(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def jdbc_stage(rows: DataFrame, url: str, staging: str, batch: int = 1000, **options: str) -> None:
    """Rows into a staging table, which is made anew; every partition sends its rows in batches."""
    rows.write.format("jdbc").options(url=url, dbtable=staging, batchsize=str(batch), **options).mode("overwrite").save()


def merge_statement(table: str, staging: str, key: str, columns: list[str]) -> str:
    """Standard SQL that updates the rows of ``table`` whose key is staged and inserts the others."""
    name = lambda c: '"' + c.replace('"', '""') + '"'
    sets = ", ".join(f"{name(c)} = s.{name(c)}" for c in columns if c != key)
    update = f"when matched then update set {sets} " if sets else ""
    return f"merge into {table} t using {staging} s on t.{name(key)} = s.{name(key)} {update}when not matched then insert ({', '.join(map(name, columns))}) values ({', '.join('s.' + name(c) for c in columns)})"


def jdbc_upsert(rows: DataFrame, url: str, table: str, key: str, order: str | None = None, statement: str | None = None, batch: int = 1000, **options: str) -> int:
    """Insert or update rows by ``key``; returns how many rows the database changed.

    The rows go into a staging table in batches, from all executors, and one
    MERGE in one transaction takes them over: either all or none.  A table
    that isn't there is created.  Rows without a key stay out; of rows that
    share one the last by ``order`` counts (else the largest by all columns).
    Columns are those of ``rows``.  Databases without a standard MERGE get
    their own ``statement``, with ``{table}`` and ``{staging}``.  Running the
    same rows again changes nothing in the table.
    """
    spark, columns = rows.sparkSession, rows.columns
    rest = [c for c in columns if c != key]
    named = rows.where(F.col(key).isNotNull())
    if rest:
        by = [order] if order else []
        named = named.groupBy(key).agg(F.max(F.struct(*by, F.struct(*rest).alias("__row"))).alias("r")).select(key, "r.__row.*").select(*columns)
    else:
        named = named.distinct()
    staging = f"{table}_staging_{uuid.uuid4().hex[:12]}"
    rows.where("false").write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
    jdbc_stage(named, url, staging, batch, **options)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, options.get("user"), options.get("password")) if "user" in options else spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        sql = (statement or merge_statement("{table}", "{staging}", key, columns)).replace("{table}", table).replace("{staging}", staging)
        work = connection.createStatement()
        try:
            changed = work.executeUpdate(sql)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            work.executeUpdate(f"drop table {staging}")
            connection.commit()
    finally:
        connection.close()
    return changed

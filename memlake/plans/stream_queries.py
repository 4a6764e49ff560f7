"""Streams over the event table (all that is there, then the end), and file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.plans.common import query, table
from memlake.sources import files
from memlake.storage import scratch
from memlake.streaming import late, pending, stateful
from memlake.streaming import operators as K


def events_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


DAY = "date_trunc('day', ts)"
OPS = "case event_type when 'error' then 'suppressed' when 'signup' then 'clear' when 'purchase' then 'superseded' else 'touch' end"


@query("select event_id, user_id from events")
def k1_ingest_stream(spark, d):
    """Each batch is appended once under its number; K2's trigger is the batch not being empty."""
    root = files.scratch(spark, "ingest")
    K.ingest_stream(events_stream(spark, d).select("event_id", "user_id"), f"{root}/checkpoint", lambda b, n: b.write.mode("overwrite").parquet(f"{root}/rows/batch_no={n}")).awaitTermination()
    return spark.read.parquet(f"{root}/rows").select("event_id", "user_id")


@query("select distinct user_id, event_type from events")
def k3_dedupe_stream(spark, d):
    once = K.dedupe_stream(events_stream(spark, d), ["user_id", "event_type"], "ts", "3650 days")
    return K.run_available(once.select("user_id", "event_type"), "dedupe", "append").select("user_id", "event_type")


ITEM = "concat(event_type, ':', event_id % 23)"  # more than 32 items a user


@query(f"""with e as (select user_id, event_id, {ITEM} as item, (value % 100) / 100.0 as r from events),
 h as (select user_id, list({{'held': [{{'less': 0.0::double, 'item': ''}}][:0], 'item': item, 'r': r::double}} order by event_id) as hits from e group by 1),
 f as (select user_id, list_reduce(list_prepend({{'held': [{{'less': 0.0::double, 'item': ''}}][:0], 'item': '', 'r': 0.0::double}}, hits), lambda a, x: {{'held': list_sort(list_append(
   list_transform(list_filter(a.held, lambda y: y.item <> x.item), lambda y: {{'less': y.less * 0.85, 'item': y.item}}),
   {{'less': -least(x.r - 0.85 * coalesce(list_sum(list_transform(list_filter(a.held, lambda y: y.item = x.item), lambda y: y.less)), 0), 1), 'item': x.item}}))[:32], 'item': x.item, 'r': x.r}}).held as held from h),
 g as (select user_id, event_id, item, row_number() over o as n, item is distinct from lag(item) over o as changed from e window o as (partition by user_id order by event_id)),
 s as (select user_id, (max(n) - max(n) filter (where changed))::int as stable, array_to_string(list(item order by event_id)[-16:], ' ') as trail from g group by 1),
 u as (select user_id, unnest(held) as x from f) select user_id, x.item as item, round(1e-9 - x.less, 6) as activation, stable, trail from u join s using (user_id)""")
def k4_activation_stream(spark, d):
    """The stream's working sets after all hits, against an ordered fold."""
    hits = events_stream(spark, d).select("user_id", F.col("event_id").alias("seq"), F.expr(ITEM).alias("item"), (F.col("value") % 100 / 100.0).alias("relevance"))
    rows = K.run_available(stateful.activation_stream(hits), "activation")
    last = rows.groupBy("user_id").agg(F.max("batch_no").alias("batch_no"))
    return rows.join(last, ["user_id", "batch_no"]).select("user_id", "item", F.round(F.col("activation") + 1e-9, 6).alias("activation"), "stable", F.array_join("trail", " ").alias("trail"))


@query(f"with ops as (select user_id as id, event_id as seq, {OPS} as op from events), cl as (select id, max(case when op = 'clear' then seq end) as cleared from ops group by id) select ops.id, coalesce(arg_max(op, case when op in ('superseded', 'suppressed') then seq end), 'active') as state, count(*) filter (where op = 'touch') as hits, max(case when op = 'touch' then seq end) as last_hit from ops join cl on ops.id = cl.id where cleared is null or seq > cleared group by ops.id")
def k5_lifecycle_stream(spark, d):
    ops = events_stream(spark, d).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.expr(OPS).alias("op"))
    return K.latest(K.run_available(K.lifecycle_stream(ops), "lifecycle"), ["id"]).where("known").drop("known")


@query("select user_id, time_bucket(interval 1 hour, ts) as bucket, count(*) as size, epoch(date_trunc('second', max(ts)))::bigint - epoch(date_trunc('second', min(ts)))::bigint as span from events group by 1, 2")
def k6_auto_events_stream(spark, d):
    rows = K.run_available(K.auto_events_stream(events_stream(spark, d), "user_id", "ts", delay="3650 days"), "auto-events")
    return K.latest(rows, ["user_id", "bucket"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


#: Every seventh event comes with the file after its own; a file covers eight days.
LATE = f"""b as (select *, (datediff('day', date '2024-01-01', ts::date) // 8 + case when event_id % 7 = 0 then 1 else 0 end)::int as turn, date_trunc('hour', ts) as bucket from events),
 t as (select turn, max(ts) as newest from b group by 1), m as (select turn, max(newest) over (order by turn rows between unbounded preceding and 1 preceding) - interval 12 hours as mark from t),
 j as (select b.*, coalesce(bucket + interval 1 hour <= mark, false) as late from b join m using (turn))"""


def split_events(spark, d) -> str:
    """The events in several files, some rows a file too late, through a stream that takes a file at a time."""
    root, e = scratch(spark, "late"), table(spark, d, "events")
    turned = e.withColumn("turn", F.expr("cast(floor(datediff(ts, date'2024-01-01') / 8) + case when event_id % 7 = 0 then 1 else 0 end as int)")).withColumn("ts", F.col("ts").cast("timestamp"))
    for (turn,) in sorted(turned.select("turn").distinct().collect()):  # a few files
        turned.where(F.col("turn") == turn).drop("turn").coalesce(1).write.mode("append").parquet(f"{root}/in")
    schema = turned.drop("turn").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    late.split_late(rows, root, "user_id", "ts", "1 hour", "12 hours").awaitTermination()
    return root


@query(f"with {LATE}, w as (select (select max(newest) from t) - interval 12 hours as final) select user_id, bucket, count(*) as size, epoch(date_trunc('second', max(ts)))::bigint - epoch(date_trunc('second', min(ts)))::bigint as span, bucket + interval 1 hour <= any_value(final) as closed from j, w where not late group by user_id, bucket")
def k6_windows_in_time(spark, d):
    """Windows of the rows that came in time, under a delay that some rows exceed."""
    group = table(spark, d, "events").schema["user_id"]
    return late.windows(spark, split_events(spark, d), group).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(f"with {LATE} select event_id, user_id, turn as batch_no from j where late")
def k6_late_rows(spark, d):
    """The rows that came too late, with the batch that brought them."""
    root = split_events(spark, d)
    return late.late_rows(spark, root, spark.read.parquet(f"{root}/in").schema).select("event_id", "user_id", "batch_no")


@query("select user_id, count(*) as hits from events group by 1")
def k2_synthesis(spark, d):
    """Counts per user, made once from what each intake left pending."""
    root = scratch(spark, "pending")

    def synthesise(number: int) -> None:
        spark.read.parquet(f"{root}/rows").groupBy("user_id").agg(F.count("*").alias("hits")).write.mode("overwrite").parquet(f"{root}/synthesis")

    rows = events_stream(spark, d).select("event_id", "user_id")
    pending.ingest_and_synthesise(rows, root, lambda b, n: b.write.mode("overwrite").parquet(f"{root}/rows/batch_no={n}"), synthesise).awaitTermination()
    return spark.read.parquet(f"{root}/synthesis")


@query("with r as (select user_id as id, max(epoch_us(ts) // 1000 + 3600000 * (1 + user_id % 40)) as expires_ms from events group by 1) select id, expires_ms from r where expires_ms <= (select max(epoch_us(ts) // 1000) from events) - 600000")
def k8_ttl_sweep_stream(spark, d):
    """Users whose last event is longer ago than their time, told by timers."""
    rows = events_stream(spark, d).select(F.col("user_id").alias("id"), F.col("ts").alias("at"), (F.unix_millis("ts") + 3600000 * (1 + F.col("user_id") % 40)).alias("expires_ms"))
    return K.run_available(stateful.ttl_sweep_stream(rows, "10 minutes"), "sweep", "append").select("id", "expires_ms")


@query(f"with r as (select user_id, event_id, row_number() over (partition by user_id, {DAY} order by ts, event_id) as n from events) select user_id, event_id from r where n <= 3")
def k7_daily_cap(spark, d):
    """The batch form of the cap; the stream's form adds muting (tests)."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("n", rank).where("n <= 3").select("user_id", "event_id")


@query(f"with r as (select user_id, epoch_us(ts) as seq, row_number() over (partition by user_id, {DAY} order by ts, event_id) as n from events) select user_id, seq from r where n <= 3")
def k7_daily_cap_stream(spark, d):
    """The stream's own form, over all events as candidates."""
    ts = F.col("ts")
    rows = events_stream(spark, d).select("user_id", F.unix_micros(ts).alias("seq"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.col("event_type").alias("category"), F.lit("candidate").alias("kind"), ts.alias("at"))
    return K.run_available(stateful.daily_cap_stream(rows, "1 day"), "daily-cap", "append").select("user_id", "seq")


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hours then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as start, count(*) as size from s group by user_id, s")
def k9_session_events(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return K.session_events(e, "user_id", "ts", "2 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("with l as (select conv_id, turn, case when (conv_id + turn) % 3 = 2 then concat('{broken ', text) when text <> '' then text end as text from conversations) select * from l where trim(text) <> ''")
def s7_read_transcripts(spark, d):
    one = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message")))
    many = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("content")).alias("message")))
    kind = (F.col("conv_id") + F.col("turn")) % 3
    line = F.when(kind == 0, one).when(kind == 1, many).otherwise(F.concat(F.lit("{broken "), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", files.turn_texts(line).alias("text")).where("trim(text) != ''")


@query("select event_id, case event_id % 5 when 0 then event_type when 1 then '' when 2 then '' when 3 then event_type else concat('{note ', event_type) end as text, case when event_id % 5 in (0, 1, 3) then cast(user_id as varchar) end as session_id, case when event_id % 5 = 3 then '/w' end as cwd, case when event_id % 5 = 0 then 'ide' end as host, case when event_id % 5 = 0 then event_type end as project from events")
def s8_parse_hook_payloads(spark, d):
    head = "case event_id % 5 when 0 then concat('{\"last-assistant-message\":\"', event_type, '\",\"host\":\"ide\",\"project\":\"', event_type, '\",\"thread-id\":\"', user_id, '\"}') when 1 then concat('{\"text\":\"x\",\"session_id\":\"', user_id, '\",\"stop_hook_active\":true}') when 2 then concat('{last-assistant-message:', event_type) when 3 then concat(' {\"response\":\"', event_type, '\",\"conversation_id\":\"', user_id, '\",\"workspace_roots\":[\"/w\"]}') else concat('{note ', event_type) end"
    parsed = table(spark, d, "events").select("event_id", files.hook_payload(F.expr(head)).alias("p"))
    return parsed.select("event_id", "p.text", "p.session_id", "p.cwd", "p.host", "p.project")


@query("""with log as (select user_id, event_id, value, case when event_type = 'error' then 'delete' when event_type = 'signup' and event_id % 97 = 0 then 'clear' else 'upsert' end as op from events),
 c as (select coalesce(max(event_id), -1) as at from log where op = 'clear'), r as (select log.*, row_number() over (partition by user_id order by event_id desc) as n from log, c where event_id > c.at)
 select user_id, event_id, value, 'upsert' as op from r where n = 1 and op <> 'delete'""")
def s3_compact_to_snapshot(spark, d):
    """A log with upserts, deletions and clears; its snapshot replays to the same rows."""
    op = F.when(F.col("event_type") == "error", "delete").when((F.col("event_type") == "signup") & (F.col("event_id") % 97 == 0), "clear").otherwise("upsert")
    log = table(spark, d, "events").select("user_id", "event_id", "value", op.alias("op"))
    return files.compact_to_snapshot(log, "user_id", "event_id", "op", files.scratch(spark, "snapshot"))


def bundle(spark, d) -> str:
    path, docs = files.scratch(spark, "bundle"), table(spark, d, "documents").select("doc_id", "text", "lang")
    files.write_bundle({"memories": docs, "chunks": docs.where("doc_id % 2 = 0"), "archive": docs.where("doc_id % 5 = 0")}, path, 300)
    return path


@query("select 'memories' as kind, doc_id, text, lang from documents union all select 'chunks', doc_id, text, lang from documents where doc_id % 2 = 0 union all select 'archive', doc_id, text, lang from documents where doc_id % 5 = 0")
def s4_bundle(spark, d):
    path, out = bundle(spark, d), None
    for kind in ("memories", "chunks", "archive"):
        part = files.read_bundle(spark, path, kind, "doc_id long, text string, lang string").select(F.lit(kind).alias("kind"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("select 'memories' as kind, count(*) as records from documents union all select 'chunks', count(*) from documents where doc_id % 2 = 0 union all select 'archive', count(*) from documents where doc_id % 5 = 0")
def s4_bundle_counts(spark, d):
    return files.bundle_counts(spark, bundle(spark, d))


@query("select event_id, event_type, user_id from events order by event_id desc limit 20")
def s12_absorb_log(spark, d):
    path, e = files.scratch(spark, "runs"), table(spark, d, "events").select("event_id", "event_type", "user_id")
    for part in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")):
        files.append_run(part, path)
    return files.newest_runs(spark, path, "event_id", 20)

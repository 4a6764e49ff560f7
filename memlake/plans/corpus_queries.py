"""Queries on transcripts and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import rules as R
from memlake.operators import chunks as K
from memlake.operators import corpus as C
from memlake.plans.common import MARKED, MEM, query, table
from memlake.schema import marked_turns, memories


WORDS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda w: w <> '')"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits(col: str, words: list[str]) -> str:
    return f"len(list_distinct(regexp_extract_all(lower({col}), {lit(R.any_of(words))})))"


def has(col: str, words: list[str]) -> str:
    return f"regexp_matches(lower({col}), {lit(R.any_of(words))})"


def bare(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


def noise(col: str) -> str:
    t = bare(col)
    return f"(regexp_matches({t}, {lit(R.NOISE)}) or (contains({t}, '](') and length(regexp_replace(regexp_replace({t}, {lit(R.LINK)}, '', 'g'), '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 4))"


def narration(col: str) -> str:
    t = bare(col)
    return rf"(regexp_matches({t}, '^(?:```|\$|>)') or (starts_with({t}, '/') and not contains({t}, ' ') and octet_length(encode({t})) < 120) or length({t}) < 8 or (not {has(t, R.STRONG)} and regexp_matches(lower({t}), {lit('^' + R.any_of(R.NARRATION))})))"


def question(col: str) -> str:
    return f"(regexp_matches({bare(col)}, '[?？]$') or regexp_matches(lower({bare(col)}), {lit('^' + R.any_of(R.QUESTION))}))"


def clauses(col: str) -> str:
    return f"regexp_split_to_array(lower({col}), '[，。；,;但]')"


def declared(col: str) -> str:
    kinds = " ".join(f"when '{k}' then '{v}'" for k, v in R.DECLARED.items())
    tag, body = (f"regexp_extract({col}, {lit(R.DECLARATION)}, {i})" for i in (1, 2))
    return f"(case when {tag} in ('结论是', '结论') and {has(body, R.PLANNED)} and not {has(body, R.DONE)} then 'fact' else case {tag} {kinds} end end)"


PROPER = r"least(contains(sentence, '`')::int + ((contains(sentence, '/') or contains(sentence, '\')) and contains(sentence, '.'))::int + regexp_matches(sentence, '(?:^|[^\p{L}\p{N}])[A-Z]')::int, 2)"
SENT = f"""{MARKED}, cut as (select id, conv_id, turn, {declared("content")} is not null as whole, case when {declared("content")} is not null then [content] else regexp_split_to_array(content, '[。！!；;\n]') end as segs from marked),
 seg as (select id, conv_id, turn, whole, generate_subscripts(segs, 1) as sn, unnest(segs) as seg from cut),
 part as (select id, conv_id, turn, sn, case when whole then [seg] else list_append(regexp_extract_all(regexp_extract(seg, {lit(R.QUESTION_CHAIN)}, 1), '[^?？]*[?？]'), regexp_extract(seg, {lit(R.QUESTION_CHAIN)}, 2)) end as ps from seg),
 flat as (select id, conv_id, turn, sn, generate_subscripts(ps, 1) as pn, {bare("unnest(ps)")} as sentence from part),
 sent as (select id, conv_id, turn, row_number() over (partition by id order by sn, pn) - 1 as pos, sentence from flat where sentence <> '')"""
SCORED = f"""{SENT}, n as (select *, {hits("sentence", R.DECISION)} as d, {hits("sentence", R.CONVENTION)} as c, {hits("sentence", R.WEAK)} as w, {hits("sentence", R.NEGATION)} as ng, {hits("sentence", R.CONCLUSION)} as cn,
 coalesce(list_sum(list_transform(list_filter({clauses("sentence")}, lambda x: not regexp_matches(x, {lit(R.any_of(R.ONE_OFF))})), lambda x: {hits("x", R.PREFERENCE)})), 0)::int as pf, {PROPER} as pn from sent),
 scored as (select id, conv_id, turn, pos, sentence, case when {declared("sentence")} is not null then 3 else 2 * d + 2 * c + w + 2 * pf + 2 * ng + cn + pn - {question("sentence")}::int end as score,
 case when {declared("sentence")} is not null then {declared("sentence")} when d > 0 then 'decision' when ng + c + w > 0 then 'constraint' when pf > 0 then 'preference' when cn > 0 then 'conclusion' else 'code_context' end as kind from n)"""
NUMBERED = rf"(regexp_matches(sentence, '^\s*[0-9]+[.)、](\s|$)') and not {has('sentence', ['禁止', '严禁', '不得', '不要', '不能', '切勿', '杜绝', '不允许'])})"
BLOCKS = rf"""el as (select id, conv_id, turn, generate_subscripts(regexp_split_to_array(content, '\n'), 1) - 1 as i, unnest(regexp_split_to_array(content, '\n')) as line from marked),
 ef as (select id, conv_id, turn, min(i) as line from el where {has('line', R.ERROR)} group by 1, 2, 3), ee as (select ef.*, (select min(i) from el where el.id = ef.id and i > ef.line and regexp_matches(el.line, '^\s*$')) as stop from ef),
 blk as (select ee.id, ee.conv_id, ee.turn, ee.line::int as line, substr({bare("string_agg(el.line, chr(10) order by i)")}, 1, 300) as block from ee join el on el.id = ee.id and i >= ee.line and i < coalesce(stop, 1000000) and i < ee.line + 12 group by 1, 2, 3, 4),
 blk10 as (select * from (select *, row_number() over (partition by conv_id order by turn, line) as nth from blk) where nth <= 10)"""
DISTILLED = rf"""{SCORED}, {BLOCKS}, cand as (select conv_id, turn, pos::int as pos, sentence, score::int as score, kind from scored where score >= 2 and not {noise("sentence")} and not {NUMBERED} union all select conv_id, turn, line, block, 4, 'error' from blk10),
 k as (select *, row_number() over (partition by conv_id, lower(regexp_replace(sentence, '\s+', '', 'g')) order by turn, pos, kind) as first from cand),
 r as (select *, row_number() over (partition by conv_id order by score desc, turn, pos, kind) as rank from k where first = 1), distilled as (select conv_id, turn, pos, sentence, score, kind from r where rank <= 40)"""


@query(f"with {MARKED}, l as (select id, unnest(regexp_split_to_array(content, '\n')) as line from marked) select id, line from l where not {noise('line')}")
def f8_drop_markdown_noise(spark, d):
    lines = marked_turns(spark, d).select("id", F.explode(F.split("content", "\n")).alias("line"))
    return lines.where(~R.is_markdown_noise(F.col("line")))


@query(f"with {MARKED} select id from marked where not {narration('content')}")
def f9_drop_process_narration(spark, d):
    return marked_turns(spark, d).where(~R.is_process_narration(F.col("content"))).select("id")


@query(f"with {MARKED} select id from marked where conv_id not in (select conv_id from marked where {has('content', R.DELETION)})")
def f10_deletion_guard(spark, d):
    return C.guarded(marked_turns(spark, d), "conv_id").select("id")


@query(f"with {SENT} select id, pos::int as pos, {question('sentence')} as question, len(list_filter({clauses('sentence')}, lambda x: {has('x', R.PREFERENCE)} and not {has('x', R.NEGATION)})) > 0 as preference from sent")
def f11_f12_sentence_kinds(spark, d):
    s = C.sentences(marked_turns(spark, d), ["id"])
    return s.select("id", "pos", R.is_question(F.col("sentence")).alias("question"), R.is_preference_query(F.col("sentence")).alias("preference"))


@query(f"with {MARKED}, s as (select id, concat(case id % 3 when 0 then '麻烦你 请忘记：' when 1 then 'Please forget ' else '忘记' end, substr(content, 1, 12 + id % 50), case when id % 2 = 0 then '了' else '.' end) as t from marked), b as (select id, {bare('t')} as t, regexp_replace({bare('t')}, {lit('^(?:' + R.any_of(R.POLITE) + r'\s*)+')}, '') as body from s), g as (select *, regexp_replace(regexp_extract(body, {lit(R.FORGET)}, 1), {lit(f'^[{R.EDGE_MARKS}]+|[{R.EDGE_MARKS}]+$')}, '', 'g') as target from b) select id, target from g where length(t) <= 60 and regexp_matches(body, {lit(R.FORGET)}) and length(target) >= 2 and not regexp_matches(target, '^[了过]') and not (regexp_matches(body, {lit('^' + R.any_of(R.FORGET_ZH))}) and target like '%了' and not regexp_matches(body, {lit(R.any_of(R.EXPLICIT))}))")
def f13_detect_forget(spark, d):
    lead = F.when(F.col("id") % 3 == 0, "麻烦你 请忘记：").when(F.col("id") % 3 == 1, "Please forget ").otherwise("忘记")
    told = F.concat(lead, F.substring("content", F.lit(1), (12 + F.col("id") % 50).cast("int")), F.when(F.col("id") % 2 == 0, "了").otherwise("."))
    return marked_turns(spark, d).select("id", R.forget_target(told).alias("target")).where("target is not null")


@query(f"with {SENT} select id, pos::int as pos, sentence from sent")
def c1_split_sentences(spark, d):
    return C.sentences(marked_turns(spark, d), ["id"])


@query(f"with {SCORED} select id, pos::int as pos, score, kind from scored")
def c2_score_sentences(spark, d):
    return C.score_sentences(C.sentences(marked_turns(spark, d), ["id"])).select("id", "pos", "score", "kind")


@query(f"with {MARKED}, {BLOCKS} select id, line, block, 8 as importance from blk")
def c3_error_blocks(spark, d):
    return C.error_blocks(marked_turns(spark, d), ["id"])


@query(f"with {DISTILLED} select conv_id, turn, pos::int as pos, sentence, score, kind from distilled")
def c4_distill(spark, d):
    return C.distill(marked_turns(spark, d), "conv_id", "turn")


@query(f"with {DISTILLED}, g as (select conv_id, count(*) as items, count(*) filter (where kind = 'decision') as decision, count(*) filter (where kind = 'constraint') as constraint_, count(*) filter (where kind = 'preference') as preference from distilled group by 1) select conv_id, items, decision, constraint_ as \"constraint\", preference, concat(items, ' items, ', decision, ' decisions, ', constraint_, ' constraints') as digest from g")
def c7_distill_digest(spark, d):
    return C.distill_digest(C.distill(marked_turns(spark, d), "conv_id", "turn"), "conv_id")


@query(rf"with p as (select doc_id as id, regexp_split_to_array(concat('lead', chr(10), replace(text, '. ', '.' || chr(10) || chr(10))), '\n[ \t]*\n') as ps from documents), t as (select id, list_filter(list_transform(ps, lambda x: {bare('x')}), lambda x: x <> '') as ps from p) select id, (generate_subscripts(ps, 1) - 1)::int as chunk_no, unnest(ps) as content from t")
def c8_chunk_paragraphs(spark, d):
    text = F.concat(F.lit("lead\n"), F.replace("content", F.lit(". "), F.lit(".\n\n")))
    return C.chunk_paragraphs(memories(spark, d).select("id", text.alias("content")), "id")


@query(rf"with s as (select doc_id as id, regexp_split_to_array(replace(text, '. ', '.' || chr(10) || '## '), '\n') as ls from documents), l as (select id, generate_subscripts(ls, 1) as i, unnest(ls) as line from s), g as (select *, sum(regexp_matches(line, '^##? ')::int) over (partition by id order by i) as section from l), c as (select id, section::bigint as section, min(i)::int as start_line, max(i)::int as end_line, string_agg(line, chr(10) order by i) as content from g group by 1, 2) select * from c where {bare('content')} <> ''")
def c8_chunk_markdown(spark, d):
    text = F.replace("content", F.lit(". "), F.lit(".\n## "))
    return C.chunk_markdown(memories(spark, d).select("id", text.alias("content")), "id")


@query("with w as (select doc_id as id, list_distinct([substr(text, 1, 160), substr(text, greatest((length(text) - 160) // 2, 0) + 1, 160), substr(text, greatest(length(text) - 160, 0) + 1, 160)]) as w from documents) select id, unnest(w) as content from w")
def c9_chunk_windows(spark, d):
    return C.chunk_windows(memories(spark, d), "id").select("id", "content")


@query(rf"with {MEM}, m as (select id, regexp_extract_all(lower(concat(content, ' see src/File_', id % 97, '.py and v0.', id % 9, ' a.rs.')), {lit(R.MENTION)}) as ws from mem), f as (select id, list_distinct(list_filter(ws, lambda w: regexp_matches(w, '^[a-z0-9_.-]{{2,}}\.[a-z0-9]{{1,8}}$') and regexp_matches(w, '[a-z].*\.') and regexp_matches(w, '\.[0-9]*[a-z][a-z0-9]*$') and length(w) >= 4)) as fs from m) select id, unnest(fs) as artifact from f")
def x9_extract_artifacts(spark, d):
    text = F.concat("content", F.lit(" see src/File_"), (F.col("id") % 97).cast("string"), F.lit(".py and v0."), (F.col("id") % 9).cast("string"), F.lit(" a.rs."))
    return memories(spark, d).select("id", F.explode(R.extract_artifacts(text)).alias("artifact"))


@query(f"with {SENT} select id, pos::int as pos, {hits('sentence', R.NEGATION)}::int as negation, {PROPER}::int as proper, substr(regexp_extract({bare('sentence')}, '^[^。！!？?；;\n]*'), 1, 40) as head, len(list_distinct(list_filter(regexp_extract_all(lower(sentence), '[a-z0-9_]+'), lambda w: length(w) >= 2)))::int as ascii_words from sent")
def x_sentence_functions(spark, d):
    s, ascii_ = F.col("sentence"), F.filter(R.content_words(F.col("sentence")), lambda w: w.rlike("^[a-z0-9_]+$"))
    return C.sentences(marked_turns(spark, d), ["id"]).select("id", "pos", R.count_hits(s, R.NEGATION).alias("negation"), R.proper_nouns(s).alias("proper"), R.head_text(s).alias("head"), F.size(ascii_).alias("ascii_words"))


@query(r"select doc_id as id, len(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda w: w <> ''))::int as length, md5(lower(text)) as lowered from documents")
def x20_text_stats(spark, d):
    from memlake.operators.stats import text_stats

    return text_stats(memories(spark, d)).withColumn("lowered", F.md5("lowered"))


@query(r"""with d as (select doc_id as id, translate(text, '{}', '  ') as text, len(regexp_split_to_array(text, '\r?\n'))::int as n from documents)
 select id, 2 as start_line, 3 + n as end_line, 'fn' as chunk_type, concat('f_', id) as name, concat('doc ', id) as doc_comment from d where id % 2 = 0
 union all select id, 5 + n, 6 + n, 'enum', concat('E_', id), null from d where id % 2 = 0
 union all select id, 2, 3 + n, 'def', concat('f_', id), concat('doc ', id) from d where id % 2 = 1
 union all select id, 4 + n, 5 + n, 'class', concat('C_', id), null from d where id % 2 = 1""")
def c8_chunk_code(spark, d):
    """Rust and Python files whose functions hold the document's lines."""
    name, inner = F.col("id").cast("string"), F.translate("content", "{}", "  ")
    rust = F.concat(F.lit("/// doc "), name, F.lit("\npub fn f_"), name, F.lit("() {\n"), inner, F.lit("\n}\n\nenum E_"), name, F.lit(" {\n}"))
    indented = F.concat(F.lit("    "), F.regexp_replace(inner, "(\r?\n)", "$1    "))
    python = F.concat(F.lit("# doc "), name, F.lit("\ndef f_"), name, F.lit("(x):\n"), indented, F.lit("\n    return x\nclass C_"), name, F.lit(":\n    pass"))
    even = F.col("id") % 2 == 0
    files = memories(spark, d).select("id", F.when(even, "rust").otherwise("python").alias("language"), F.when(even, rust).otherwise(python).alias("content"))
    return K.chunk_code(files, "id").select("id", "start_line", "end_line", "chunk_type", "name", "doc_comment")


@query(r"""with t as (select conv_id, row_number() over (partition by conv_id order by turn, text) as turn_no, role, len(regexp_split_to_array(text, '\n')) as n from conversations)
 select conv_id, turn_no, case role when 'user' then 'User' when 'assistant' then 'Assistant' else 'System' end as role, (sum(n) over w - n + 1)::bigint as start_line, (sum(n) over w)::bigint as end_line
 from t window w as (partition by conv_id order by turn_no)""")
def c8_chunk_roles(spark, d):
    """Conversations written out with a role before each turn."""
    role = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "助手：").otherwise("SYSTEM: ")
    said = table(spark, d, "conversations").select("conv_id", F.struct("turn", "text", F.concat(role, "text").alias("line")).alias("s"))
    whole = said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["line"]), "\n").alias("content"))
    return K.chunk_roles(whole, "conv_id").select("conv_id", "turn_no", "role", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query()
def c8_chunk_corpus(spark, d):
    """Documents as Markdown and plain texts, conversations as texts with roles, and the code cases, all at once."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.when(F.col("doc_id") % 2 == 0, "markdown").otherwise("text").alias("language"), F.col("text").alias("content"))
    said = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    role = lambda x: F.when(x["role"] == "assistant", "Assistant: ").otherwise("User: ")
    talks = said.select(F.concat(F.lit("c"), "conv_id").alias("path"), F.lit("text").alias("language"), F.array_join(F.transform("t", lambda x: F.concat(role(x), F.coalesce(x["text"], F.lit("")))), "\n").alias("content"))
    return K.chunk_corpus(docs.unionByName(talks))

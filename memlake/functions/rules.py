"""Rules on chat sentences (noise, questions, wishes, scores) as Column expressions.

A phrase list becomes one alternation, longest phrase first, so a place in
the text counts for one phrase only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrase lists of the distilling rules.
DECISION = ["决定用", "就用", "改成", "换成", "定为", "选型为", "最终采用", "决定", "决策", "采用", "改用", "统一用", "decided to", "let's use", "switch to", "go with", "we'll use"]
CONVENTION = ["纪律", "约定", "规范", "口径", "原则", "一律", "规定", "默认是", "默认用", "默认值", "默认端口", "统一为", "固定为", "要求是", "convention", "by default"]
WEAK = ["必须", "应当", "must", "always"]
PREFERENCE = [
    "我喜欢用", "我更喜欢用", "我偏好用", "我习惯用", "我通常用", "我一般用", "我平时用", "我常用", "我习惯", "我偏好", "更喜欢用", "优先用", "倾向于用", "宁愿用", "偏爱",
    "i prefer", "i usually", "i tend to", "i like to use", "favorite",
]
ONE_OFF = ["这次", "本次", "此次", "今天", "临时", "下次"]
NEGATION = [
    "不能用", "不要用", "不要", "不能", "禁止", "严禁", "切勿", "不得", "避免", "别用", "放弃", "不允许", "不再", "不优先用", "不偏爱", "不倾向于", "杜绝",
    "don't", "do not", "shouldn't", "should not", "mustn't", "must not", "never", "avoid", "not allowed", "forbidden", "prohibited", "deprecated",
]
CONCLUSION = ["结论是", "结论", "所以", "因此", "最终", "确认", "总结", "综上", "therefore", "in conclusion", "so we"]
QUESTION = ["什么", "为什么", "怎么", "如何", "是否", "能不能", "有没有", "哪", "多少", "何时", "谁", "what", "why", "how"]
ERROR = [
    "panic:", "panicked", "panic at", "traceback", "stack trace", "stacktrace", "segmentation fault", "segfault", "error:", "exception:", "assertion failed", "assertion `left", "exit code", "exit status",
    "报错", "崩溃", "异常退出", "编译错误", "运行时错误", "错误信息", "堆栈", "调用栈",
]
DELETION = ["已删除该记忆", "已从记忆库删除", "已忘记", "已移除该记忆", "已修正该记忆", "删除记忆成功", "forget memory", "correct_memory", "已撤销记忆"]
NARRATION = ["我先", "我先来", "接下来", "然后", "下面", "现在", "让我", "我来", "我会", "首先", "接着", "最后", "let me", "i'll", "i will", "next,", "next ", "first,", "now ", "we need to", "i'm going to"]
STRONG = ["决定", "采用", "必须", "不要", "禁止", "结论", "建议", "根因", "修复", "因为", "decision", "constraint", "must", "should", "conclusion", "root cause"]
FORGET_EN = ["please forget ", "please delete the memory ", "please delete memory ", "forget ", "delete the memory ", "delete memory ", "do not remember ", "don't remember ", "dont remember "]
FORGET_ZH = ["请不要再记得", "请别再记得", "不要再记得", "别再记得", "不要记得", "请删除这条记忆", "请删除记忆", "删除这条记忆", "删除记忆", "请移除记忆", "移除记忆", "请清除记忆", "清除记忆", "请忘记", "请忘掉", "忘记", "忘掉"]
POLITE = ["麻烦你", "麻烦", "请帮我", "帮我"]
EXPLICIT = ["请", "麻烦", "帮我", "记忆", "记录", "信息", "关于", "这条", "那条", "这个", "那个"]

# What makes a line noise, and what is cut off the ends of a forget target.
NOISE = r"(?s)^$|^[#>]|^```|^\|.*\||\|.*\|$|^[-*_ ]{3,}$"
LINK, EDGE_MARKS = r"\[[^\]]*\]\([^)]*\)", r" \t：:，,、\"'“”‘’「」《》（(【\[。．.！!？?；;）)】\]"
QUESTION_CHAIN, HARD_STOP = None, "[。！!；;\n]"
#: CJK characters that carry grammar, not content (our choice).
FUNCTION_CHARACTERS = "的了是在和与也就都而及着过吗呢吧啊这那我你他她它们"
MENTION = r"[a-z0-9_.-]*[a-z0-9_-]"


def any_of(words: list[str]) -> str:
    """An alternation, longest phrase first, for Java and RE2 alike."""
    return "(?:" + "|".join(re.sub(r"([.\\+*?\[\]^$(){}|])", r"\\\1", w) for w in sorted(words, key=len, reverse=True)) + ")"


QUESTION_CHAIN = rf"(?is)^((?:\s*{any_of(QUESTION)}[^?？]*[?？])*)(.*)$"
FORGET = rf"(?is)^(?:{any_of(FORGET_EN)}|{any_of(FORGET_ZH)})(.*)$"


def count_hits(text: Column, words: list[str]) -> Column:
    """How many phrases of the list occur; one inside a longer one found there doesn't count."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(any_of(words)), 0)))


def has_any(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike(any_of(words))


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_markdown_noise(text: Column) -> Column:
    """Empty, heading, quote, fence, table row, rule line, or a line that is only links."""
    t = bare(text)
    links = F.length(F.regexp_replace(F.regexp_replace(t, LINK, ""), r"[^\p{L}\p{N}]", "")) < 4
    return t.rlike(NOISE) | (t.contains("](") & links)


def is_process_narration(text: Column) -> Column:
    """Blank, under eight characters, code, commands, lone paths, or narration without a strong word."""
    t = bare(text)
    code = t.rlike(r"^(?:```|\$|>)") | (t.startswith("/") & ~t.contains(" ") & (F.octet_length(t) < 120))
    return code | (F.length(t) < 8) | (~has_any(t, STRONG) & F.lower(t).rlike("^" + any_of(NARRATION)))


def is_question(text: Column) -> Column:
    """Ends with a question mark or starts with an interrogative."""
    t = bare(text)
    return t.rlike("[?？]$") | F.lower(t).rlike("^" + any_of(QUESTION))


def preference_hits(text: Column) -> Column:
    """Preference phrases in clauses that don't speak of one occasion."""
    clauses = F.split(F.lower(text), "[，。；,;但]")
    lasting = F.filter(clauses, lambda c: ~c.rlike(any_of(ONE_OFF)))
    return F.aggregate(lasting, F.lit(0), lambda n, c: n + count_hits(c, PREFERENCE))


def is_preference_query(text: Column) -> Column:
    """Some clause holds a preference phrase and no negation."""
    return F.exists(F.split(F.lower(text), "[，。；,;但]"), lambda c: c.rlike(any_of(PREFERENCE)) & ~c.rlike(any_of(NEGATION)))


def forget_target(text: Column) -> Column:
    """What a forget instruction names; null where the text is none.

    At most 60 characters; polite openings are dropped; a target has two
    characters or more; narrated Chinese forms don't count.
    """
    t = bare(text)
    body = F.regexp_replace(t, rf"^(?:{any_of(POLITE)}\s*)+", "")
    target = F.regexp_replace(F.regexp_extract(body, FORGET, 1), f"^[{EDGE_MARKS}]+|[{EDGE_MARKS}]+$", "")
    told = body.rlike("^" + any_of(FORGET_ZH)) & target.endswith("了") & ~body.rlike(any_of(EXPLICIT))
    fits = (F.length(t) <= 60) & body.rlike(FORGET) & (F.length(target) >= 2) & ~target.rlike("^[了过]") & ~told
    return F.when(fits, target)


# Tags that an author puts before a statement, and the kinds they name.
DECLARED = {"决策": "decision", "决定": "decision", "约束": "constraint", "偏好": "preference", "结论是": "conclusion", "结论": "conclusion"}
# Words of plans, and words of what is done; a conclusion with the first and none of the second is no conclusion.
PLANNED = ["接下来", "下一步", "我要", "待确认", "待验证", "还需要", "准备", "打算", "将要"]
DONE = ["已完成", "已确认", "已验证", "已修复", "结论是", "因此", "所以", "说明", "表明"]
DECLARATION = rf"(?s)^\s*[-*+]*\s*({'|'.join(DECLARED)})\s*[：:]+\s*(.*)$"


def explicit_kind(text: Column) -> Column:
    """The kind that a tag at the start declares, null without one; a conclusion that only plans is a fact."""
    kinds = F.create_map(*[F.lit(x) for kv in DECLARED.items() for x in kv])
    kind = F.try_element_at(kinds, F.regexp_extract(text, DECLARATION, 1))
    body = F.regexp_extract(text, DECLARATION, 2)
    return F.when((kind == "conclusion") & has_any(body, PLANNED) & ~has_any(body, DONE), "fact").otherwise(kind)


def proper_nouns(text: Column) -> Column:
    """One each for a back-tick, a path with a dot and a capitalised word; at most two."""
    path = (text.contains("/") | text.contains("\\")) & text.contains(".")
    found = (text.contains("`"), path, text.rlike(r"(?:^|[^\p{L}\p{N}])[A-Z]"))
    return F.least(sum(f.cast("int") for f in found), F.lit(2))


def extract_artifacts(text: Column) -> Column:
    """File-like names without their folder, lower-cased, each once; no versions, numbers, one-letter stems or long endings."""
    found = F.regexp_extract_all(F.lower(text), F.lit(MENTION), 0)
    good = lambda w: w.rlike(r"^[a-z0-9_.-]{2,}\.[a-z0-9]{1,8}$") & w.rlike(r"[a-z].*\.") & w.rlike(r"\.[0-9]*[a-z][a-z0-9]*$") & (F.length(w) >= 4)
    return F.array_distinct(F.filter(found, good))


def split_sentences(text: Column) -> Column:
    """Sentences of a turn; a question mark ends one only where the sentence starts with an interrogative."""

    def parts(segment: Column) -> Column:
        chain = F.regexp_extract_all(F.regexp_extract(segment, QUESTION_CHAIN, 1), F.lit("[^?？]*[?？]"), 0)
        return F.concat(chain, F.array(F.regexp_extract(segment, QUESTION_CHAIN, 2)))

    return F.filter(F.transform(F.flatten(F.transform(F.split(text, HARD_STOP), parts)), bare), lambda s: s != "")


def content_words(text: Column) -> Column:
    """Distinct ASCII words of two characters or more, and pairs of neighbouring CJK characters without function characters."""
    low = F.lower(text)
    words = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), 0), lambda w: F.length(w) >= 2)
    runs = F.filter(F.regexp_extract_all(low, F.lit("[一-鿿]+"), 0), lambda r: F.length(r) >= 2)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: ~p.rlike(f"[{FUNCTION_CHARACTERS}]"))))


def head_text(text: Column, n: int = 40) -> Column:
    """The first sentence, at most n characters."""
    return F.substring(F.regexp_extract(bare(text), "(?s)^[^。！!？?；;\n]*", 0), 1, n)

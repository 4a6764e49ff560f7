"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[一-鿿]"
#: File extensions and their languages; all others are text.
LANGUAGES = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "md": "markdown", "mdx": "markdown",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json", "html": "html", "htm": "html", "css": "css", "scss": "css", "less": "css", "xml": "xml", "svg": "xml", "sh": "shell", "bash": "shell", "zsh": "shell", "sql": "sql",
}
#: Further extensions that are read, as text.
PLAIN = ("txt", "rst", "java", "kt", "swift", "c", "h", "cpp", "hpp", "cc", "cxx", "hxx")


def tokenize(text: Column) -> Column:
    """Lower-cased words; from a CJK share of 0.3 on, ASCII runs and bigrams of CJK characters."""
    low = F.lower(text)
    words = F.filter(F.split(low, r"[ \t\n\r\f]+"), lambda w: w != "")
    runs = F.regexp_extract_all(low, F.lit(r"[a-z0-9_-]+"), 0)
    cjk = F.regexp_extract_all(low, F.lit(CJK + "+"), 0)
    pairs = F.flatten(F.transform(cjk, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    share = F.regexp_count(low, F.lit(CJK)) / F.greatest(F.length(low), F.lit(1))
    wide = F.octet_length(text) - F.length(text) >= 0.6 * F.length(text)  # a CJK character is three bytes long; cheaper than counting
    return F.when(wide & (share >= 0.3), F.concat(runs, pairs)).otherwise(words)


def index_terms(text: Column) -> Column:
    """What an index must list for a text so that every scored word is found: distinct tokens, and more.

    Tokens that mix ASCII letters and digits also count by their runs of
    digits and of other characters; in mostly ASCII text, neighbouring CJK
    characters count as pairs.
    """
    low, tokens = F.lower(text), tokenize(text)
    mixed = F.filter(tokens, lambda w: w.rlike("^[a-z0-9_-]+$") & w.rlike("[0-9]") & w.rlike("[a-z]"))
    pieces = F.flatten(F.transform(mixed, lambda w: F.regexp_extract_all(w, F.lit("[0-9]+|[^0-9]+"), 0)))
    runs = F.filter(F.regexp_extract_all(low, F.lit(CJK + "+"), 0), lambda r: F.length(r) >= 2)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(tokens, pieces, pairs))


def char_bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, white space and ASCII punctuation removed."""
    # The characters once, and each with its neighbour: linear in the text, however long.
    one = F.regexp_extract_all(F.regexp_replace(text, r"[\s!-/:-@\[-`{-~]", ""), F.lit("(?s)."), F.lit(0))
    return F.array_distinct(F.filter(F.zip_with(one, F.slice(one, F.lit(2), F.greatest(F.size(one), F.lit(1))), lambda x, y: F.concat(x, y)), lambda p: p.isNotNull()))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1))


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the character pairs of two texts; where neither has any, 1 for equal trimmed texts, else 0."""
    x, y = char_bigrams(a), char_bigrams(b)
    none = (F.size(x) == 0) & (F.size(y) == 0)
    return F.when(none, (F.trim(a) == F.trim(b)).cast("double")).otherwise(jaccard(x, y))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of content words; 0 where either is empty or null."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), jaccard(a, b)).otherwise(0.0)


def count_word(text: Column, word: str) -> Column:
    """ASCII words of three letters or more count at letter boundaries, others as substrings."""
    if word.isascii() and len(word) >= 3:
        return F.regexp_count(F.concat(F.lit(" "), F.regexp_replace(F.lower(text), " ", "  "), F.lit(" ")), F.lit(f"[^a-z]{word.lower()}[^a-z]"))
    return F.regexp_count(F.lower(text), F.lit(rf"\Q{word.lower()}\E"))


def clamp_importance(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(1)), F.lit(10))


def decay(importance: Column, hours: Column, depth: Column, rate: float = 0.05, topo: float = 0.3) -> Column:
    """exp(-rate * days / importance), less by depth; between 0 and 1."""
    value = F.exp(-rate * (hours / 24) / importance) * (1 - depth * topo)
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def hit_decay(days: Column, suppressed: Column) -> Column:
    """Halves every 30 days since the last hit, halves again if suppressed, never below 0.2; 1 without a hit."""
    return F.when(days.isNull(), 1.0).otherwise(F.greatest(F.pow(F.lit(0.5), days / 30) * F.when(suppressed, 0.5).otherwise(1.0), F.lit(0.2)))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def normalise_content(text: Column) -> Column:
    """One line without leading bullets, at most 300 characters."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    return preview(F.regexp_replace(flat, r"^[-*•]+ *", ""), 300)


def windows(text: Column, n: int = 160) -> Column:
    """Head, middle and tail of n characters, each once."""
    middle = F.greatest(F.floor((F.length(text) - n) / 2), F.lit(0)).cast("int") + 1
    last = F.greatest(F.length(text) - n, F.lit(0)) + 1
    return F.array_distinct(F.array(F.substring(text, 1, n), F.substring(text, middle, F.lit(n)), F.substring(text, last, F.lit(n))))


def detect_language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(known[F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)], F.lit("text"))


def owner_key(token: Column, user: Column) -> Column:
    return F.concat(F.substring(F.sha2(F.trim(token), 256), 1, 32), F.lit("::"), user)


def scope_of(user: Column, session: Column) -> Column:
    return F.when(session.isNotNull(), "session").when(user.isNotNull(), "user").otherwise("none")


def scope_at_ingest(user: Column, session: Column) -> Column:
    """As ``scope_of``, but what comes in without an owner is for everyone."""
    return F.when(session.isNotNull(), "session").when(user.isNotNull(), "user").otherwise("global")


def importance_from_score(score: Column) -> Column:
    return F.round(F.least(F.greatest(4 + score, F.lit(3.0)), F.lit(9.0))).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where the dimensions differ or a norm is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.least(F.greatest(dot(a, b) / norm, F.lit(-1.0)), F.lit(1.0)))


def l2_normalise(v: Column) -> Column:
    """The vector at length 1; null for a zero one."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def cosine_decentred(a: Column, b: Column, mean: Column) -> Column:
    """The cosine after the common mean was taken off both; null where the dimensions differ or nothing is left."""
    off = lambda v: F.zip_with(v, mean, lambda x, m: x.cast("double") - m)
    return F.when((F.size(a) == F.size(mean)) & (F.size(b) == F.size(mean)), cosine(off(a), off(b)))

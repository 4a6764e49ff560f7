"""URL filter: fixed host and path rules first, mined token combinations for the rest."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label:block"


def host_of(url: str):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str):
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: str):
    """What a URL is made of: scheme, host labels, path parts with digits as 0, query keys.

    The host itself is no token: it follows from its labels, and a token that
    others imply only multiplies the rules.
    """
    host = host_of(url)
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    keys = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"([^&=]+)="), 1)
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
            F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("label:."), x)),
            F.transform(parts, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0"))),
            F.transform(keys, lambda x: F.concat(F.lit("key:"), x)),
        )
    )


RULE = "rule_id long, antecedent array<string>, trigger string, confidence double, support double"


def mine_rules(urls: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6) -> DataFrame:
    """Association rules from URL tokens to the block label: rule_id, antecedent, trigger, confidence, support.

    ``urls`` holds url and blocked (boolean) of labelled pages; rows with a
    null in either are left out, repeated rows count each, and an empty table
    gives no rule.  FP-growth runs over all of them; rules below either bound
    are pruned, and so is a rule with no more confidence than one whose tokens
    it contains: that one matches wherever it does.  A rule's trigger is its
    rarest token, under which the inverted index lists it.
    """
    spark = urls.sparkSession
    block = F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    known = urls.where("url is not null and blocked is not null")
    baskets = materialise(known.select(F.concat(tokens_of("url"), block).alias("items")), "baskets")
    if not baskets.head(1):
        return spark.createDataFrame([], RULE)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    to_block = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK)))
    rules = to_block.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    rules = materialise(rules.withColumn("rule_id", F.xxhash64("antecedent")), "rules")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    tokens = rules.select("rule_id", F.explode("antecedent").alias("token")).join(single, "token")
    rarest = tokens.groupBy("rule_id").agg(F.min_by("token", F.struct("freq", "token")).alias("trigger"))
    indexed = materialise(rules.join(rarest, "rule_id"), "indexed-rules")
    return indexed.join(_redundant(indexed), "rule_id", "left_anti").select("rule_id", "antecedent", "trigger", "confidence", "support")


def _redundant(rules: DataFrame) -> DataFrame:
    """Ids of rules that contain another with the same confidence or more, found by the other's trigger."""
    wide = rules.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("trigger"))
    other = rules.select("trigger", F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    inside = (F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0)
    return wide.join(other, "trigger").where(inside & (F.col("part_confidence") >= F.col("confidence"))).select("rule_id").distinct()


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls that some rule's tokens all occur in, with the most confident rule.

    Tokens meet the inverted index on the triggers; only urls that hold a
    rule's rarest token are compared with its other tokens.
    """
    tokens = urls.where("url is not null").select("url").distinct().withColumn("tokens", tokens_of("url"))
    wide = tokens.withColumn("trigger", F.explode("tokens"))
    hit = wide.join(rules, "trigger").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hit.groupBy("url").agg(F.max_by("antecedent", F.struct("confidence", "support", "rule_id")).alias("mined"), F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: DataFrame, fixed: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, mined, confidence for every row.

    ``fixed`` lists (verdict, ``host/path``); a rule fits its host and all
    subdomains if the url's path starts with the rule's, the longest wins.
    Where none fits, rule is null and a url that a mined rule matches is
    blocked, any other allowed.  A null url, or one without ``://``, has an
    empty host and path and is allowed.  Repeated rows are judged each; other
    columns are not read.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rule = verdict = None
    for what, text in sorted(fixed, key=lambda x: (-len(x[1]), x[1])):
        domain, _, rest = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    parsed = base.withColumn("host", host_of("url")).withColumn("path", path_of("url"))
    ruled = parsed.withColumn("rule", rule if fixed else F.lit(None).cast("string")).withColumn("fixed", verdict if fixed else F.lit(None).cast("string"))
    found = matches(base, rules)
    judged = ruled.join(found, "url", "left")
    method = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("fixed", method).alias("verdict"), "mined", "confidence")

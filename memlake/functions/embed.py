"""User-supplied embedding models over tables of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def embed(rows: DataFrame, fn: Callable[[list[str]], list], id_col: str = "id", text_col: str = "content", batch: int = 32) -> DataFrame:
    """id, vec for every row; ``fn`` maps a list of texts to vectors.

    A batch that fails is tried text by text; texts that still fail have a
    null vec, as null texts have.
    """

    def tried(texts: list[str]) -> list:
        try:
            return [[float(x) for x in v] for v in fn(texts)]
        except Exception:
            return [None] if len(texts) == 1 else [v for t in texts for v in tried([t])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                some = part.iloc[i : i + batch]
                known = some[text_col].notna().to_numpy()
                vectors = iter(tried(some[text_col][known].tolist()) if known.any() else [])
                yield pd.DataFrame({"id": some[id_col].to_numpy(), "vec": [next(vectors) if k else None for k in known]})

    return rows.select(id_col, text_col).mapInPandas(run, f"id {rows.schema[id_col].dataType.simpleString()}, vec array<float>")


def register_sql(spark) -> None:
    """``ml_words``, ``ml_tokens``, ``ml_char_pairs``, ``ml_jaccard``, ``ml_dot`` and ``ml_cosine`` for SQL text, as SQL functions (no Python at run time).

    ``ml_tokens`` is ``text.tokenize`` (mostly CJK texts give pairs of
    characters), ``ml_char_pairs`` is ``text.char_bigrams``; the cosine of a
    zero vector is null.
    """
    spark.sql(r"create or replace temporary function ml_words(t string) returns array<string> return filter(split(lower(t), '[ \\t\\n\\r\\f]+'), w -> w != '')")
    spark.sql("create or replace temporary function ml_jaccard(a array<string>, b array<string>) returns double return size(array_intersect(a, b)) / greatest(size(array_union(a, b)), 1)")
    spark.sql("create or replace temporary function ml_dot(a array<float>, b array<float>) returns double return aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0d, (s, x) -> s + x)")
    cjk = "[一-鿿]"
    pairs = f"flatten(transform(regexp_extract_all(lower(t), '{cjk}+', 0), r -> transform(sequence(1, greatest(char_length(r) - 1, 1)), i -> substring(r, i, 2))))"
    wide = f"octet_length(t) - char_length(t) >= 0.6 * char_length(t) and regexp_count(lower(t), '{cjk}') / greatest(char_length(lower(t)), 1) >= 0.3"
    spark.sql(f"create or replace temporary function ml_tokens(t string) returns array<string> return case when {wide} then concat(regexp_extract_all(lower(t), '[a-z0-9_-]+', 0), {pairs}) else ml_words(t) end")
    single = r"regexp_extract_all(regexp_replace(t, '[\\s!-/:-@\\[-`{-~]', ''), '(?s).', 0)"
    spark.sql(f"create or replace temporary function ml_char_pairs(t string) returns array<string> return array_distinct(filter(zip_with({single}, slice({single}, 2, 1000000000), (x, y) -> x || y), p -> p is not null))")
    spark.sql("create or replace temporary function ml_cosine(a array<float>, b array<float>) returns double return ml_dot(a, b) / nullif(sqrt(ml_dot(a, a)) * sqrt(ml_dot(b, b)), 0)")

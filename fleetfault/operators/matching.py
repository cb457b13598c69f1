"""Exact "text contains word" matching as an equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containing_pairs(texts: DataFrame, words: DataFrame, keys: Sequence[str], text: str, word: str) -> DataFrame:
    """Distinct ``keys, text, word`` where the non-empty ``word`` occurs in ``text``.

    Only word lengths that occur under a key are cut from its texts, so the
    join meets true matches only and never text x word pairs.
    """
    needles = words.select(*keys, word).where(F.length(word) > 0).distinct()
    sizes = needles.groupBy(*keys).agg(F.collect_set(F.length(word)).alias("_sizes"))
    cuts = F.array_distinct(
        F.flatten(
            F.transform(
                F.filter("_sizes", lambda n: n <= F.length(text)),
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.length(text) - n + 1), lambda p: F.substring(F.col(text), p, n)
                ),
            )
        )
    )
    pieces = (
        texts.select(*keys, text).distinct().join(sizes, list(keys)).select(*keys, text, F.explode(cuts).alias(word))
    )
    return pieces.join(needles, [*keys, word]).select(*keys, text, word)

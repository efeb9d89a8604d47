"""Features of reviews: the deterministic default in place of a language model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from opinara import schema as S
from opinara.functions.text import literal_array, local_sentiment


def keyword_features(reviews: DataFrame, taxonomy: list[str] | None = None, negative: list[str] = S.NEGATIVE_WORDS, positive: list[str] = S.POSITIVE_WORDS) -> DataFrame:
    """One row per review and taxonomy term that its text contains, with the text's sentiment."""
    terms = taxonomy or sorted({t for ts in S.FEATURE_TAXONOMY.values() for t in ts})
    text = F.lower(F.coalesce("review_text", F.lit("")))
    found = F.filter(literal_array(terms), lambda k: F.contains(text, k))
    return reviews.select("review_id", F.explode(found).alias("feature"), local_sentiment(F.col("review_text"), F.lit(None).cast("int"), negative, positive).alias("sentiment"))


def model_features(reviews: DataFrame, extract: Callable, schema: str) -> DataFrame:
    """The same by a function over pandas batches (a remote model, say), for ``mapInPandas``."""
    return reviews.mapInPandas(extract, schema)

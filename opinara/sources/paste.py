"""Reviews from pasted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pasted_reviews(rows: DataFrame, text_col: str, keys: list[str], limit: int = 20, min_chars: int = 10) -> DataFrame:
    """One row per non-blank line, the first ``limit`` of each pasted text, of more than ``min_chars`` characters; position counts from 1."""
    lines = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    out = rows.select(*keys, F.posexplode(F.slice(lines, 1, limit)).alias("p", "line"))
    return out.filter(F.length("line") > min_chars).select(*keys, (F.col("p") + 1).alias("position"), F.col("line").alias("review_text"))

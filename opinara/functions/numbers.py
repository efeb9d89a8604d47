"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(c: Column | str, digits: int = 4) -> Column:
    """Rounded double without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)

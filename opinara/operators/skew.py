"""Joins and look-ups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot when it has more than one in HOT_SHARE of all rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 1000


def lookup_by_key(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "left") -> DataFrame:
    """Join ``rows`` with ``table`` (one row per key; ``count`` = the key's number of rows).

    Keys with more than 1/1000 of all rows, at most 1000 of them by counting, are
    looked up in a broadcast table; the others meet in an ordinary shuffle join,
    where no key is large. Null keys find nothing.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0)).alias("__all"))
    values = [c for c in table.columns if c not in (*keys, count)]
    packed = table.select(*keys, count, F.struct(*values).alias("__v"))
    hot = (
        packed.join(F.broadcast(total), F.col(count) * HOT_SHARE > F.col("__all"))
        .select(*keys, F.col("__v").alias("__hot"))
    )
    cold = packed.join(F.broadcast(total), F.col(count) * HOT_SHARE <= F.col("__all")).select(*keys, F.col("__v").alias("__cold"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    found = marked.filter("__hot IS NOT NULL").select(*rows.columns, *[F.col(f"__hot.{v}").alias(v) for v in values])
    rest = marked.filter("__hot IS NULL").drop("__hot").join(cold, keys, how)
    rest = rest.select(*rows.columns, *[F.col(f"__cold.{v}").alias(v) for v in values])
    return found.unionByName(rest)

"""Agreement of two judgements: ranks with ties, Spearman's correlation, Cohen's kappa."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara.operators.skew import lookup_by_key
from opinara.storage import stored


def average_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the rank (from 1) of ``column`` among all rows, ties share their mean; null for null.

    Equal values are counted first. The different ones are sorted by ranges; the counts of
    earlier ranges, one number each, are added to those within a range, so no task sees
    all rows. The ranks are looked up evenly: a value that many rows share is no hot task.
    """
    values = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    ranges = stored(values.orderBy(column).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__range").agg(F.sum("__n").alias("__size"))
    earlier = sizes.select("__range", (F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")).alias("__earlier"))
    up_to = F.sum("__n").over(Window.partitionBy("__range").orderBy(column))
    ranks = ranges.withColumn("__up_to", up_to).join(F.broadcast(earlier), "__range")
    ranks = ranks.select(column, "__n", (F.col("__earlier") + F.col("__up_to") - (F.col("__n") - 1) / 2).alias(name))
    return lookup_by_key(rows, ranks, [column], "__n")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, spearman) over the rows that have both values; null where one side is constant or rows are missing."""
    both = stored(rows.select(F.col(x).alias("x"), F.col(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL"), "judged")
    ranked = average_ranks(average_ranks(both, "x", "rx"), "y", "ry")
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    return ranked.agg(F.count("*").alias("n"), F.when(spread > 0, F.covar_pop("rx", "ry") / spread).alias("spearman"))


def kappa(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row (n, observed, expected, kappa) over the rows that both judged; kappa is null where chance alone agrees, or there are no rows."""
    cells = rows.select(a.alias("a"), b.alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    sides = cells.select("n", F.expr("a = b").alias("same"), F.inline(F.array(F.struct(F.col("a").alias("label"), F.lit(1).alias("first")), F.struct(F.col("b").alias("label"), F.lit(0).alias("first")))))
    n = F.col("n").cast("double")
    labels = sides.groupBy("label").agg(F.sum(n * F.col("first")).alias("as_a"), F.sum(n * (1 - F.col("first"))).alias("as_b"), F.sum(F.when(F.col("same"), n * F.col("first")).otherwise(0.0)).alias("agreed"))
    sums = labels.agg(F.coalesce(F.sum("as_a"), F.lit(0.0)).alias("n"), F.sum("agreed").alias("agreed"), F.sum(F.col("as_a") * F.col("as_b")).alias("chance"))
    some = F.expr("nullif(n, 0)")
    shares = sums.select(F.col("n").cast("long").alias("n"), (F.col("agreed") / some).alias("observed"), (F.col("chance") / (some * some)).alias("expected"))
    return shares.withColumn("kappa", F.expr("(observed - expected) / nullif(1 - expected, 0)"))

"""Row numbers within large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def positions(df: DataFrame, group: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """``df`` with idx (0-based place in its group by bucket, then ``order``) and n (rows of the group).

    A group is numbered bucket by bucket: rows within (group, bucket) by a window that
    shuffles on both, plus the counts of the earlier buckets, so a hot group is spread
    over as many tasks as it has buckets. ``bucket`` must ascend with ``order``.
    """
    rows = df.withColumn("__b", bucket)
    per = rows.groupBy(*group, "__b").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*group).orderBy("__b")
    per = per.withColumns({"__before": F.sum("__c").over(w) - F.col("__c"), "n": F.sum("__c").over(Window.partitionBy(*group))}).drop("__c")
    local = F.row_number().over(Window.partitionBy(*group, "__b").orderBy(*order)) - 1
    numbered = rows.withColumn("__i", local).join(per, [*group, "__b"])
    return numbered.withColumn("idx", F.col("__before") + F.col("__i")).drop("__b", "__before", "__i")

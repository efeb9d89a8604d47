"""Review-shaped views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A total order of line items: whole rows are unique, keys are not.
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as feature mentions: brand = product, type = feature, return flag = sentiment."""
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("p_brand").alias("product_name"), F.col("p_type").alias("feature"),
        F.when(flag == "R", "negative").when(flag == "A", "positive").otherwise("neutral").alias("sentiment"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("int").alias("rating"),
        F.col("l_shipdate").alias("ts"), (F.col("l_discount") * 10).alias("intensity"), (1 - F.col("l_tax")).alias("confidence"), *LINE_ORDER,
    )


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rated reviews with user names and a feature number from the JSON properties."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("review_id"), F.concat(F.lit("P"), F.col("user_id") % 5).alias("product_name"), F.concat(F.lit("user_"), F.col("user_id")).alias("username"), "ts",
        F.when(kind == "error", "negative").when(kind == "purchase", "positive").otherwise("neutral").alias("sentiment"),
        (5 - F.least(F.lit(4), F.floor(F.col("value") / 25))).cast("int").alias("rating"), (k % 6).alias("feature_no"), "user_id", "value",
    )


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), F.col("source").alias("product_name"), F.col("text").alias("review_text"), F.col("lang").alias("language"))

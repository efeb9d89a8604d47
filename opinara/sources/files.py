"""Readers and writers of review files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.schema import COLUMN_WORDS


def read_reviews(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV (header, all strings) or JSON (rows, one object, or {"reviews": [...]}), by extension."""
    if path.lower().endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding)
    if path.lower().endswith(".json"):
        df = spark.read.json(path, multiLine=True, encoding=encoding)
        return df.select(F.explode("reviews").alias("r")).select("r.*") if df.columns == ["reviews"] else df
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError("a review file is .csv, .json or .parquet")


def read_directory(spark: SparkSession, folder: str, suffix: str = "_reviews.csv", skip: str = "all_reviews.csv") -> DataFrame:
    """Every ``*_reviews.csv`` but the combined file; the product is the file's stem in title case where no column has it."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/*{suffix}")
    name = F.col("_metadata.file_name")
    stem = F.initcap(F.replace(F.replace(name, F.lit(suffix), F.lit("")), F.lit("_"), F.lit(" ")))
    given = F.col("product_name") if "product_name" in df.columns else F.lit(None)
    return df.filter(name != skip).withColumn("product_name", F.coalesce(given, stem))


def normalize_columns(df: DataFrame) -> DataFrame:
    """Columns under their standard names with blank texts dropped; a missing rating, time or user name stays null.

    A column is claimed by the first target one of whose words it has; columns ending in
    ``_id`` are never a text. Without a text column the strings with the longest mean are it.
    """
    taken, names = set(), {}
    for target, hints in COLUMN_WORDS:
        if target in df.columns:
            taken.add(target)
            continue
        for c in df.columns:
            if c not in taken and not c.lower().endswith("_id") and any(h in c.lower() for h in hints):
                names[c] = target
                taken.add(c)
                break
    if "review_text" not in {*df.columns, *names.values()}:
        strings = [c for c, t in df.dtypes if t == "string" and c not in taken]
        if not strings:
            raise ValueError("no column holds review texts")
        means = df.agg(*[F.avg(F.length(c)).alias(c) for c in strings]).first().asDict()
        names[max(strings, key=lambda c: means[c] or 0)] = "review_text"
    df = df.withColumnsRenamed(names)
    for c, kind in (("product_name", "string"), ("rating", "double"), ("timestamp", "timestamp"), ("username", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("Product" if c == "product_name" else None).cast(kind))
    times = [F.try_to_timestamp("timestamp", F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")]
    if dict(df.dtypes)["timestamp"] == "string":
        df = df.withColumn("timestamp", F.coalesce(*times))
    df = df.withColumn("rating", F.expr("try_cast(rating AS double)")).withColumn("review_text", F.trim("review_text"))
    df = df.filter("review_text <> ''")
    if "review_id" not in df.columns:
        df = df.withColumn("review_id", F.xxhash64(*df.columns))
    return df


def save_reviews(reviews: DataFrame, path: str) -> None:
    """Reviews without their feature arrays and the features, one row each, as two tables under ``path``."""
    if "extracted_features" in reviews.columns:
        rows = reviews.select("review_id", F.explode("extracted_features").alias("f")).select("review_id", "f.*")
        rows.write.mode("append").parquet(f"{path}/feature_extractions")
        reviews = reviews.drop("extracted_features")
    reviews.write.mode("append").parquet(f"{path}/reviews")


def save_csv_per_product(reviews: DataFrame, path: str) -> None:
    reviews.write.mode("overwrite").partitionBy("product_name").option("header", True).csv(path)

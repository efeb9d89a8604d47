"""How well extracted features and detections match what was labelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opinara.functions.numbers import percent


def feature_set(features: Column) -> Column:
    """Distinct lower-case names of an array of structs with ``feature``; null is empty."""
    return F.coalesce(F.array_distinct(F.transform(features, lambda f: F.lower(f["feature"]))), F.array().cast("array<string>"))


def feature_matches(labelled: DataFrame, extracted: DataFrame, key: str = "review_id") -> DataFrame:
    """Per labelled review the features found, missed and found besides; one without an extraction has missed all."""
    rows = labelled.select(key, feature_set(F.col("manual_features")).alias("m")).join(extracted.select(key, F.col("extracted_features").alias("x")), key, "left").withColumn("x", feature_set(F.col("x")))
    return rows.select(key, F.array_intersect("m", "x").alias("matches"), F.array_except("m", "x").alias("missed"), F.array_except("x", "m").alias("extra"))


def precision_recall(matches: DataFrame) -> DataFrame:
    """Micro-averaged precision, recall and F1 in percent, and the counts."""
    c = matches.agg(*[F.coalesce(F.sum(F.size(a)), F.lit(0)).alias(n) for a, n in (("matches", "true_positives"), ("extra", "false_positives"), ("missed", "false_negatives"))])
    tp, fp, fn = (F.col(n) for n in ("true_positives", "false_positives", "false_negatives"))
    return c.withColumns({"precision": F.round(percent(tp, tp + fp), 1), "recall": F.round(percent(tp, tp + fn), 1), "f1_score": F.round(percent(2 * tp, 2 * tp + fp + fn), 1)})


def pass_rates(results: DataFrame) -> DataFrame:
    """Totals of test results (test_name, passed)."""
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")).withColumn("pass_rate", percent(F.col("passed"), F.col("total")))


def report(results: DataFrame) -> DataFrame:
    """Results (test_name, passed, actual, target) as rows of a Markdown table, in order of their names."""
    line = F.format_string("| %s | %s | %s | %s |", "test_name", F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.col("actual").cast("string"), F.col("target").cast("string"))
    return results.select("test_name", line.alias("line")).orderBy("test_name")

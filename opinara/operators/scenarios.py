"""What-if revenue and crisis scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opinara import schema as S

#: (type, reviews, feature, texts): the size of a crisis batch and its texts by turns.
CRISES = {
    "packaging_crisis": (50, "packaging", ["The packaging arrived crushed and leaking.", "Box torn open, product spilled everywhere.", "Packaging failed again, cap was loose."]),
    "quality_disaster": (30, "quality", ["It broke on the first day.", "Defective unit, overheats badly."]),
    "bot_attack": (25, "overall", ["Worst product do not buy.", "Do not buy worst product."]),
}


def predicted_rating(rating: Column, change: Column) -> Column:
    """Rating after the complaint rate moves by ``change`` points, 1 to 5."""
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.round(rating - change * S.SENSITIVITY, 1)))


def revenue_impact(drop: Column, revenue: Column) -> Column:
    """Loss of 12 % of the revenue per star; a gained star brings half of that."""
    return F.when(drop > 0, -drop * S.REVENUE_PER_STAR * revenue).otherwise(F.abs(drop) * S.REVENUE_PER_STAR * revenue * 0.5)


def revenue_scenarios(products: DataFrame, baseline: float) -> DataFrame:
    """Three rows per product (rating, rate, revenue): nothing done, a partial and a full fix."""
    rise = F.col("rate") - baseline
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), c.alias("change")) for n, c in (("do_nothing", rise), ("partial_fix", rise * 0.4), ("full_fix", rise * 0.1 - 2))])).alias("c")
    rows = products.select("*", cases).select(*products.columns, "c.*").withColumn("new_rating", predicted_rating(F.col("rating"), F.col("change")))
    return rows.withColumn("revenue_impact", revenue_impact(F.col("rating") - F.col("new_rating"), F.col("revenue")))


def crisis_reviews(spark: SparkSession, kind: str, product: str, base_time: str) -> DataFrame:
    """A batch of negative reviews within an hour, the same every time."""
    n, feature, texts = CRISES[kind]
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("CRISIS_"), i).alias("crisis_id"), F.lit(product).alias("product_name"), F.element_at(F.array(*map(F.lit, texts)), (i % len(texts) + 1).cast("int")).alias("review_text"),
        (F.lit(base_time).cast("timestamp") + F.make_interval(mins=(i * 60 / n).cast("int"))).alias("ts"), F.lit(1).alias("rating"), F.lit("negative").alias("sentiment"), F.lit(feature).alias("feature"), F.lit(kind).alias("crisis_type"), F.lit(True).alias("is_crisis"),
    )


def crisis_metrics(rows: DataFrame, monthly_revenue: float = 500000.0) -> DataFrame:
    """Complaint rates before and after the rows marked is_crisis, their distance, and what is at risk."""
    old = ~F.coalesce("is_crisis", F.lit(False))
    bad = F.col("sentiment") == "negative"
    rates = rows.agg(F.count_if(old).alias("n0"), F.count_if(old & bad).alias("b0"), F.count("*").alias("n1"), F.count_if(bad).alias("b1"))
    before, after = F.col("b0") / F.col("n0") * 100, F.col("b1") / F.col("n1") * 100
    z = F.when(before == 0, 4.0).otherwise((after - before) / F.greatest(before * 0.3, F.lit(1.0)))
    impact = -(after - before) * S.SENSITIVITY
    return rates.select(F.round(before, 4).alias("before"), F.round(after, 4).alias("after"), F.round(z, 4).alias("z"), F.round(impact, 4).alias("rating_impact"), F.round(F.abs(impact) * S.REVENUE_PER_STAR * monthly_revenue, 0).alias("revenue_at_risk"))

"""Weekly metrics, expanding z-scores, anomalies, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara.functions.numbers import percent


def by_week():
    return Window.partitionBy("product_name").orderBy("week_end")


def prior():
    return by_week().rowsBetween(Window.unboundedPreceding, -1)


def week_end(ts: Column) -> Column:
    """The Monday that ends the week (Tuesday to Monday) of a time."""
    return F.next_day(F.date_sub(F.to_date(ts), 1), "MON")


def weekly_metrics(reviews: DataFrame) -> DataFrame:
    """Per product and non-empty week: volume, mean rating, complaint and praise rate. Negative: rating <= 2; positive: >= 4."""
    r = F.col("rating")
    out = reviews.filter("ts IS NOT NULL").groupBy("product_name", week_end(F.col("ts")).alias("week_end")).agg(F.count("rating").alias("volume"), F.sum("rating").alias("stars"), F.count_if(r <= 2).alias("negatives"), F.count_if(r >= 4).alias("positives"))
    out = out.filter("volume > 0")
    return out.select("product_name", "week_end", "volume", (F.col("stars") / F.col("volume")).alias("avg_rating"), percent(F.col("negatives"), F.col("volume")).alias("complaint_rate"), percent(F.col("positives"), F.col("volume")).alias("sentiment_score"))


def expanding_z(value: str, over=None) -> Column:
    """z against the mean and sample deviation of the earlier rows; 0 with fewer than two or no deviation."""
    over = prior() if over is None else over
    sd = F.stddev_samp(value).over(over)
    z = (F.col(value) - F.avg(value).over(over)) / sd
    return F.when((F.count(value).over(over) >= 2) & (sd > 1e-9), z).otherwise(0.0)


def weekly_z(weeks: DataFrame) -> DataFrame:
    return weeks.withColumns({"week_no": F.row_number().over(by_week())} | {f"z_{c}": expanding_z(c) for c in ("avg_rating", "complaint_rate", "volume")})


def weekly_anomalies(weeks: DataFrame) -> DataFrame:
    """(product, week_no, type, z, metric, baseline) from the fourth week on; a rating crash excludes the others."""
    rows = weekly_z(weeks).withColumns({f"base_{c}": F.avg(c).over(prior()) for c in ("avg_rating", "complaint_rate", "volume")})
    crash = (F.col("z_avg_rating") < -2) & (F.col("avg_rating") < 4)
    item = lambda when, kind, c: F.when(when, F.struct(F.lit(kind).alias("type"), F.col(f"z_{c}").alias("z"), F.col(c).cast("double").alias("metric"), F.col(f"base_{c}").alias("baseline")))
    found = F.array_compact(F.array(
        item(crash, "RATING CRASH", "avg_rating"), item(~crash & (F.col("z_complaint_rate") > 2), "COMPLAINT SPIKE", "complaint_rate"),
        item(~crash & (F.col("z_volume") > 2) & (F.col("avg_rating") < 3), "VOLUME SPIKE with LOW RATING", "volume"),
    ))
    return rows.filter("week_no >= 4").select("product_name", "week_no", F.explode(found).alias("a")).select("product_name", "week_no", "a.*")


def silent_growth(weeks: DataFrame, least: float = 1.5) -> DataFrame:
    """Weeks whose complaint z and the two before exceed ``least``."""
    rows = weekly_z(weeks)
    z = F.col("z_complaint_rate")
    rows = rows.withColumns({"z1": F.lag(z, 1).over(by_week()), "z2": F.lag(z, 2).over(by_week())})
    return rows.filter((z > least) & (F.col("z1") > least) & (F.col("z2") > least)).drop("z1", "z2")


def feature_heatmap(reviews: DataFrame, features: list[str]) -> DataFrame:
    """z of each feature's weekly share of negative mentions, one row per product, week and feature."""
    r = F.col("rating")
    wide = reviews.groupBy("product_name", week_end(F.col("ts")).alias("week_end")).agg(F.count("rating").alias("volume"), *[F.count_if((F.col("feature") == f) & (r <= 2)).alias(f"f{i}") for i, f in enumerate(features)])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"f{i}").alias("negatives")) for i, f in enumerate(features)])).alias("x")
    rows = wide.filter("volume > 0").select("product_name", "week_end", "volume", pairs).select("product_name", "week_end", "x.feature", percent(F.col("x.negatives"), F.col("volume")).alias("rate"))
    over = Window.partitionBy("product_name", "feature").orderBy("week_end").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("z", expanding_z("rate", over))


def time_batches(reviews: DataFrame, days: int) -> DataFrame:
    """Batches of ``days`` days from the first day; empty ones are skipped and the rest numbered on."""
    first = reviews.groupBy("product_name").agg(F.min(F.to_date("ts")).alias("__first"))
    rows = reviews.join(first, "product_name").withColumn("__p", F.floor(F.datediff("ts", "__first") / days))
    return _stats(rows, "__p")


def fixed_batches(numbered: DataFrame, size: int) -> DataFrame:
    """Batches of ``size`` rows by idx."""
    return _stats(numbered.withColumn("__p", F.floor(F.col("idx") / size)), "__p")


def _stats(rows: DataFrame, key: str) -> DataFrame:
    r = F.col("rating")
    out = rows.groupBy("product_name", key).agg(F.count("*").alias("reviews"), (F.sum("rating") / F.count("rating")).alias("avg_rating"), F.count_if(r >= 4).alias("p"), F.count_if(r <= 2).alias("c"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    w = Window.partitionBy("product_name").orderBy(key)
    out = out.withColumns({"batch_no": F.row_number().over(w), "positive_rate": percent(F.col("p"), F.col("reviews")), "complaint_rate": percent(F.col("c"), F.col("reviews"))})
    by = Window.partitionBy("product_name").orderBy("batch_no")
    delta = lambda c: F.coalesce(F.col(c) - F.lag(c).over(by), F.lit(0.0))
    out = out.withColumns({"rating_delta": delta("avg_rating"), "complaint_delta": delta("complaint_rate")})
    status = F.when(F.col("rating_delta") < -0.3, "RATING DROP").when(F.col("complaint_delta") > 15, "COMPLAINT SPIKE").when((F.col("rating_delta") < -0.1) | (F.col("complaint_delta") > 5), "WATCH").otherwise("STABLE")
    return out.withColumn("status", status).drop("p", "c", key)


def degradation(batches: DataFrame, good: float = 4.0, poor: float = 3.5) -> DataFrame:
    """Products whose first batch rated above ``good`` and a batch from the third on below ``poor``: the first such, early and recent means."""
    last = Window.partitionBy("product_name")
    rows = batches.withColumns({"r": F.round("avg_rating", 1), "batches": F.count("*").over(last)})
    rows = rows.filter("batches >= 3")
    out = rows.groupBy("product_name").agg(
        F.max(F.when(F.col("batch_no") == 1, F.col("r"))).alias("first_rating"), F.min(F.when((F.col("batch_no") >= 3) & (F.col("r") < poor), F.col("batch_no"))).alias("degraded_at"),
        F.avg(F.when(F.col("batch_no") <= 2, F.col("avg_rating"))).alias("early"), F.avg(F.when(F.col("batch_no") > F.col("batches") - 2, F.col("avg_rating"))).alias("recent"),
    )
    return out.filter((F.col("first_rating") > good) & F.col("degraded_at").isNotNull())

"""Six-factor priorities of issues, teams and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from opinara import schema as S
from opinara.functions.numbers import percent


def severity(intensity: Column, sentiment: Column) -> Column:
    return F.when(sentiment == "positive", 0.0).when(sentiment.isin("neutral", "mixed"), intensity * 50).when(intensity >= 0.8, 100.0).when(intensity >= 0.5, 60.0).otherwise(30.0)


def velocity(current: Column, previous: Column, base: Column) -> Column:
    """Ten times the change against the previous rate, or the rise over the baseline where there is none; at most 100."""
    return F.least(F.lit(100.0), F.coalesce(F.abs(current - previous), F.greatest(F.lit(0.0), current - base)) * 10)


def reach(mentions: Column) -> Column:
    return F.when(mentions > 20, 100.0).when(mentions > 5, 50 + (mentions - 5) / 15 * 50).otherwise(F.greatest(F.lit(20.0), mentions * 4.0))


def recency(windows_ago: Column) -> Column:
    return F.when(windows_ago <= 0, 100.0).when(windows_ago == 1, 50.0).otherwise(0.0)


def scored(issues: DataFrame, base: float = S.BASELINE_RATE) -> DataFrame:
    """``issues`` (intensity, sentiment, rate, previous, negatives, total, confidence, windows_ago) with factors, priority and level."""
    w = S.PRIORITY_WEIGHTS
    factors = {
        "severity": severity(F.col("intensity"), F.col("sentiment")), "velocity": velocity(F.col("rate"), F.col("previous"), F.lit(base)),
        "frequency": F.least(F.lit(100.0), percent(F.col("negatives"), F.col("total"))), "confidence_factor": F.coalesce(F.col("confidence") * 100, F.lit(50.0)),
        "reach": reach(F.col("negatives")), "recency": recency(F.col("windows_ago")),
    }
    total = sum(F.col("confidence_factor" if k == "confidence" else k) * v for k, v in w.items())
    out = issues.withColumns(factors).withColumn("priority", total)
    return out.withColumn("level", level(F.round("priority", 2)))


def level(score: Column) -> Column:
    out = F
    for name, least in S.PRIORITY_LEVELS[:-1]:
        out = out.when(score >= least, name)
    return out.otherwise(S.PRIORITY_LEVELS[-1][0])


def product_issues(mentions: DataFrame) -> DataFrame:
    """One issue per product and feature: complaint rate among its mentions, intensity by the rate, confidence, product's reviews."""
    per = mentions.groupBy("product_name", "feature").agg(F.count("*").alias("mentions"), F.count_if(F.col("sentiment") == "negative").alias("negatives"), F.avg("confidence").alias("confidence"))
    total = per.groupBy("product_name").agg(F.sum("mentions").alias("total"))
    rate = percent(F.col("negatives"), F.col("mentions"))
    return per.join(total, "product_name").withColumns({"rate": rate, "previous": F.lit(None).cast("double"), "intensity": F.when(rate > 20, 0.8).otherwise(0.5), "sentiment": F.lit("negative"), "windows_ago": F.lit(0)})


def top_per(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, ranked from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def primary_team(feature: Column) -> Column:
    f = F.lower(feature)
    return F.when(f.rlike("packaging|delivery|shipping"), "Operations").when(f.rlike("battery|durability|performance|quality"), "Quality").when(f.rlike("price|value|cost|marketing"), "Marketing").otherwise("Support")


def category(product: Column) -> Column:
    p = F.lower(product)
    return F.when(p.rlike("bottle|care"), "Personal Care").when(p.rlike("charge|bolt|electronics"), "Electronics").when(p.rlike("mix|blend|nutri"), "Food").otherwise("General")


def team_actions(spark: SparkSession) -> DataFrame:
    """(stage, team, action_no, action): a small fixed table."""
    rows = [(s, t, i + 1, a) for s, teams in S.TEAM_ACTIONS.items() for t, actions in teams.items() for i, a in enumerate(actions)]
    return spark.createDataFrame(rows, "stage string, team string, action_no int, action string")


def actions_for(issues: DataFrame) -> DataFrame:
    """Each issue (stage, level) with its teams' actions; critical ones are marked urgent. A stage without actions gives none."""
    found = issues.join(F.broadcast(team_actions(issues.sparkSession)), "stage")
    return found.withColumn("action", F.when(F.col("level") == "critical", F.concat(F.lit("URGENT: "), "action")).otherwise(F.col("action")))

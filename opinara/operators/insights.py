"""Texts, records and predictions that follow from scored issues and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara import schema as S
from opinara.operators.scenarios import predicted_rating, revenue_impact


def _by_type(kind: Column, index: int, default: str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, texts in S.ANOMALY_TEXTS.items():
        out = out.when(kind == name, F.lit(texts[index]))
    return out.otherwise(default)


def anomaly_insights(anomalies: DataFrame, kind: str = "type", feature: str | None = None) -> DataFrame:
    """``anomalies`` with action and meaning by their type; a complaint spike of a feature names it."""
    action, meaning = _by_type(F.col(kind), 0, S.ANOMALY_DEFAULT[0]), _by_type(F.col(kind), 1, S.ANOMALY_DEFAULT[1])
    if feature:
        named = (F.col(kind) == "COMPLAINT SPIKE") & (F.coalesce(F.col(feature), F.lit("")) != "")
        action = F.when(named, F.replace(F.lit(S.FEATURE_SPIKE_TEXTS[0]), F.lit("{feature}"), F.col(feature))).otherwise(action)
        meaning = F.when(named, F.replace(F.lit(S.FEATURE_SPIKE_TEXTS[1]), F.lit("{feature}"), F.initcap(F.col(feature)))).otherwise(meaning)
    return anomalies.withColumns({"action": action, "meaning": meaning})


def feature_spikes(heatmap: DataFrame, least: float = 3.0) -> DataFrame:
    """Rows of a heat map (product_name, week_end, feature, rate, z) from a product's fourth week on whose z is over ``least``."""
    week = F.dense_rank().over(Window.partitionBy("product_name").orderBy("week_end"))
    return heatmap.withColumn("week_no", week).filter((F.col("week_no") > 3) & (F.col("z") > least)).withColumn("type", F.lit("COMPLAINT SPIKE"))


def recommendation(level: Column, severity: Column, velocity: Column, reach: Column) -> Column:
    """The advice of a priority level, by the factor that drives it."""
    r = S.RECOMMENDATIONS
    critical = F.when(severity >= 80, r["critical"][0]).when(velocity >= 70, r["critical"][1]).otherwise(r["critical"][2])
    high = F.when(reach >= 70, r["high"][0]).when(velocity >= 50, r["high"][1]).otherwise(r["high"][2])
    medium = F.when(velocity >= 40, r["medium"][0]).otherwise(r["medium"][1])
    return F.when(level == "critical", critical).when(level == "high", high).when(level == "medium", medium).otherwise(r["low"][0])


def action_records(issues: DataFrame) -> DataFrame:
    """Scored issues (level, priority, the factors, lifecycle_stage) as records for an action brief."""
    urgency = F.coalesce(F.create_map(*[F.lit(x) for kv in S.LEVEL_URGENCY.items() for x in kv])[F.col("level")], F.lit("track"))
    return issues.withColumns({
        "urgency": urgency, "recommendation": recommendation(F.col("level"), F.col("severity"), F.col("velocity"), F.col("reach")),
        "requires_attention": F.col("level").isin("critical", "high"), "lifecycle_stage": F.coalesce("lifecycle_stage", F.lit("detected")),
    })


def brief_summary(briefs: DataFrame) -> DataFrame:
    """Counts of briefs with timeline map<string,array>, do_not_do array and teams map: immediate actions, things to avoid, teams."""
    return briefs.select("product_name", F.coalesce(F.size(F.col("timeline")["Immediate"]), F.lit(0)).alias("immediate_actions"), F.size("do_not_do").alias("avoid_count"), F.array_join(F.array_sort(F.map_keys("teams")), ",").alias("teams_addressed"))


def brief_text(briefs: DataFrame) -> DataFrame:
    """A brief (product_name, reviews, issues array of struct(feature, rate), actions, do_not_do) as plain text."""
    rule = "=" * 60
    line = lambda x, i: F.format_string("%d. %s — Complaint Rate: %.1f%%", i + 1, F.upper(x["feature"]), x["rate"])
    issues = F.when(F.size("issues") > 0, F.concat_ws("\n", F.transform("issues", line))).otherwise("No significant issues detected")
    parts = [
        F.lit(f"{rule}\nACTION BRIEF\n{rule}"), F.format_string("Total Reviews: %d\nProduct: %s\n", "reviews", "product_name"), F.concat(F.lit("TOP 3 ISSUES:\n"), issues, F.lit("\n")),
        F.concat(F.lit("TEAM ACTIONS:\n"), F.concat_ws("\n", "actions"), F.lit("\n")), F.concat(F.lit("DO NOT DO:\n"), F.concat_ws("\n", F.transform("do_not_do", lambda x: F.concat(F.lit("- "), x))), F.lit("\n")), F.lit(rule),
    ]
    return briefs.select("product_name", F.concat_ws("\n", *parts).alias("brief"))


def team_cards(top_feature: Column) -> Column:
    """struct(quality, marketing): what the two teams do about a product's top complaint; without one, the general advice."""
    c = S.CARD_TEXTS
    quality = F.when(top_feature.isNull(), c["quality_none"])
    for words, text in c["quality"]:
        quality = quality.when(top_feature.isin(*words), text)
    quality = quality.otherwise(F.concat(F.lit(c["quality_other"]), top_feature))
    marketing = F.when(top_feature.isNull(), c["marketing_none"]).when(F.contains(top_feature, F.lit("packaging")), c["marketing_packaging"]).otherwise(c["marketing_other"])
    return F.struct(quality.alias("quality"), marketing.alias("marketing"))


def currency(amount: Column) -> Column:
    """Crore, lakh or thousands of rupees; a plus for gains, no sign for losses."""
    a = F.abs(amount)
    show = lambda x, digits, form: F.format_string(form, F.bround(x, digits))  # noqa: E731 - ties to even
    text = F.when(a >= 10_000_000, show(a / 10_000_000, 1, "₹%.1f Cr")).when(a >= 100_000, show(a / 100_000, 1, "₹%.1fL")).when(a >= 1000, show(a / 1000, 0, "₹%.0fK")).otherwise(show(a, 0, "₹%,.0f"))
    return F.concat(F.when(amount > 0, "+").otherwise(""), text)


def slider_prediction(rows: DataFrame, rating: str, rates: list[float], revenue: Column, baseline: float = 8.0) -> DataFrame:
    """For each row and each complaint rate of the slider: predicted rating, star drop, revenue impact and risk level."""
    out = rows.withColumn("complaint_rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    out = out.withColumn("predicted_rating", predicted_rating(F.col(rating), F.col("complaint_rate") - baseline))
    drop = F.col(rating) - F.col("predicted_rating")
    out = out.withColumns({"star_drop": drop, "revenue_impact": revenue_impact(drop, revenue)})
    return out.withColumn("risk_level", F.when(F.col("star_drop") > 1.5, "CRITICAL").when(F.col("star_drop") > 0.8, "HIGH").when(F.col("star_drop") > 0.3, "MEDIUM").otherwise("LOW"))


def worst_feature(features: Column) -> Column:
    """struct(feature, intensity, urgency) of the negative feature of the highest intensity, the first of equals; null without one."""
    value = lambda f: F.coalesce(F.create_map(F.lit("low"), F.lit(0.3), F.lit("medium"), F.lit(0.6), F.lit("high"), F.lit(0.9))[F.lower(F.coalesce(f["intensity"], F.lit("medium")))], F.lit(0.5))
    bad = F.filter(features, lambda f: f["sentiment"] == "negative")
    ranked = F.transform(bad, lambda f, i: F.struct(value(f).alias("urgency"), (-i).alias("place"), f["feature"].alias("feature"), f["intensity"].alias("intensity")))
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct(best["feature"].alias("feature"), best["intensity"].alias("intensity"), best["urgency"].alias("urgency")))

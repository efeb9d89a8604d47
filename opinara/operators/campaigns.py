"""Coordinated campaigns of three kinds, their network and the totals of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opinara import schema as S

_COLUMNS = ("kind", "campaign_id", "members", "confidence", "label", "avg_rating", "summary")


def _campaign(rows: DataFrame, kind: str, confidence: int, rating) -> DataFrame:
    label = S.CAMPAIGN_LABEL if confidence >= 70 else S.LOOSE_CAMPAIGN_LABEL
    return rows.withColumns({"kind": F.lit(kind), "confidence": F.lit(confidence), "label": F.lit(label), "avg_rating": rating, "summary": F.concat(F.col("members").cast("string"), F.lit(f" {S.CAMPAIGN_SUMMARIES[kind]}"))}).select(*_COLUMNS)


def burst_campaigns(bursts: DataFrame) -> DataFrame:
    """From ``greedy_bursts``: one row per anchor."""
    rows = bursts.groupBy("product_name", "campaign_id").agg(F.count("*").alias("members"), F.min("rating").cast("double").alias("r"))
    return _campaign(rows.withColumn("campaign_id", F.col("campaign_id").cast("string")), "TIMESTAMP_BURST", 75, F.col("r"))


def username_campaigns(users: DataFrame) -> DataFrame:
    """From ``sequential_users``."""
    rows = users.select(F.concat_ws("", "prefix", "low").alias("campaign_id"), F.col("users").alias("members"))
    return _campaign(rows, "USERNAME_PATTERN", 75, F.lit(3.0))


def text_campaigns(groups: DataFrame, least: int = 3) -> DataFrame:
    """From ``text_groups`` over a similarity of 0.65: groups of at least ``least`` reviews."""
    rows = groups.groupBy(F.col("group_id").cast("string").alias("campaign_id")).agg(F.count("*").alias("members")).filter(F.col("members") >= least)
    return _campaign(rows, "TEXT_SIMILARITY", 60, F.lit(3.0))


def network_nodes(members: DataFrame, individuals: DataFrame) -> DataFrame:
    """Nodes of the map: ``members`` (username, confidence) of campaigns by their highest confidence, then ``individuals`` (username, status) that are in none, by status."""
    color = F.when(F.max("confidence") >= 70, S.CAMPAIGN_COLOR).otherwise(S.LOOSE_CAMPAIGN_COLOR)
    inside = members.filter("username IS NOT NULL").groupBy("username").agg(color.alias("color")).withColumn("size", F.lit(25))
    colors = F.create_map(*[F.lit(x) for kv in S.STATUS_COLORS.items() for x in kv])
    outside = individuals.join(inside.select("username"), "username", "left_anti").select("username", colors[F.col("status")].alias("color"), F.lit(15).alias("size"))
    return inside.unionByName(outside).select("username", F.substring("username", 1, 15).alias("label"), "color", "size")


def network_edges(members: DataFrame) -> DataFrame:
    """Edges of the map: each member of a campaign to its first one.

    A star joins the same nodes as all pairs of the campaign would, in as many edges as members.
    """
    first = members.groupBy("campaign_id").agg(F.min("username").alias("hub"))
    rows = members.join(first, "campaign_id").filter("username <> hub")
    return rows.select("campaign_id", F.col("hub").alias("from_user"), F.col("username").alias("to_user")).distinct()

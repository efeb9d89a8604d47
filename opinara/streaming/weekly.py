"""Weekly counts over a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.storage import fresh_path


def weekly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events per type and week from a Monday, in event time; state of a week ends ``late`` after it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", "7 days", startTime="4 days").alias("w"), "event_type").agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").cast("date").cast("string").alias("week"), "event_type", "events")


def run_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream run over what is there now, into a table in the shared folder."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = fresh_path(spark, "weekly")
    done = weekly_counts(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{out}-state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).queryName(f"weekly_{uuid.uuid4().hex}").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema("week string, event_type string, events long").parquet(out)

"""Writers of results: trend windows, all tables of a run, cached responses, job states, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opinara.sources.scans import exists

TABLES = {
    "reviews": "review_id string, product_name string, category string, review_text string, clean_text string, rating double, sentiment string, timestamp timestamp",
    "feature_extractions": "review_id string, feature string, sentiment string, intensity double, confidence double",
    "trend_windows": "product_name string, feature_name string, window_label string, complaint_rate double, praise_rate double, z_score double, timestamp timestamp",
    "escalations": "product_name string, feature_name string, priority_score double, priority_level string, lifecycle_stage string, timestamp timestamp",
    "action_briefs": "product_name string, brief string, timestamp timestamp",
}


def create_tables(spark: SparkSession, path: str, clear: bool = False) -> None:
    """Empty tables of the schema under ``path`` where there are none; ``clear`` replaces those that are there."""
    for name, columns in TABLES.items():
        if clear or not exists(spark, f"{path}/{name}"):
            spark.createDataFrame([], columns).write.mode("overwrite").parquet(f"{path}/{name}")


def conform(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` with the table's columns alone, in its types; missing ones are null."""
    fields = [x.rsplit(" ", 1) for x in TABLES[table].split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def trend_windows(scored: DataFrame, saved_at: Column) -> DataFrame:
    """Scored windows as rows of the table: one per product, feature and window."""
    return conform(scored.withColumns({"feature_name": F.col("feature"), "window_label": F.concat(F.lit("W"), F.col("window_no")), "timestamp": saved_at}), "trend_windows")


def save_trend_windows(scored: DataFrame, path: str, saved_at: Column) -> None:
    trend_windows(scored, saved_at).write.mode("append").parquet(f"{path}/trend_windows")


def save_all(spark: SparkSession, path: str, tables: dict[str, DataFrame], clear: bool = False) -> None:
    """Every table of a run: all are written beside the target first, and moved in when the last one is there.

    ``clear`` replaces what the tables held, else rows are added. If a write fails, what was
    staged is deleted and the tables are as before. A failure while files are moved can leave
    some tables new and others old: ``snapshots.Store`` saves all or none.
    """
    import uuid

    create_tables(spark, path, False)
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        for name, rows in tables.items():
            conform(rows, name).write.parquet(f"{staging}/{name}")
        for name in tables:
            target = hadoop.Path(f"{path}/{name}")
            if clear:
                fs.delete(target, True)
                fs.mkdirs(target)
            for part in fs.listStatus(hadoop.Path(f"{staging}/{name}")):
                if part.getPath().getName().startswith("part-"):
                    fs.rename(part.getPath(), hadoop.Path(target, part.getPath().getName()))
    finally:
        fs.delete(hadoop.Path(staging), True)


def cache_key(content: list[str]) -> Column:
    """MD5 of the named columns as JSON with its keys in order."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(content)])))


def cached(rows: DataFrame, cache: DataFrame, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose response is in ``cache`` (key, response), rows still to be answered), both with their key."""
    keyed = rows.withColumn("key", cache_key(content))
    return keyed.join(cache, "key"), keyed.join(cache, "key", "left_anti")


def latest_states(states: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last state of each job: of rows with equal keys the one that is greatest by ``order``."""
    rest = [c for c in states.columns if c != key and c not in order]
    return states.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("s")).select(key, "s.*")


def network_json(nodes: DataFrame, edges: DataFrame, per_file: int = 100_000) -> DataFrame:
    """Nodes and edges as JSON lines with their kind, for a viewer."""
    line = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*sorted(df.columns))).alias("line"))
    return line(nodes, "node").unionByName(line(edges, "edge"))

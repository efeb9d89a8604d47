"""Responses of a model kept for later: a table in buckets of keys that many jobs may add to."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opinara.sources.sinks import cache_key
from opinara.storage import stored

SCHEMA = "key string, response string, stored_at timestamp, batch string, bucket int"


class Responses:
    """(key, response, stored_at) under ``path``, one folder a batch, in it one a bucket of keys.

    A batch never touches another one's folder, so batches may be written at the same time; a
    batch that fails leaves no, or fewer, entries, never wrong ones. Of several entries of a key the
    newest counts (of the same moment the larger response). ``seconds`` is how long an entry lives; None: for ever.
    The number of buckets may differ between objects: each entry says its own.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, seconds: int | None = None):
        self.spark, self.path, self.buckets, self.seconds = spark, path.rstrip("/"), buckets, seconds
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _batches(self) -> list:
        found = self._files.listStatus(self._at) if self._files.exists(self._at) else []
        return [s.getPath() for s in found if s.getPath().getName().startswith("batch=")]

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def put(self, entries: DataFrame) -> None:
        """Adds (key, response), and stored_at if there is one (else now). Entries without a key or response are not kept."""
        at = F.col("stored_at") if "stored_at" in entries.columns else F.current_timestamp()
        kept = entries.filter("key IS NOT NULL AND response IS NOT NULL").select("key", "response", at.alias("stored_at"), self._bucket(F.col("key")).alias("bucket"))
        newest = kept.groupBy("bucket", "key").agg(F.max(F.struct("stored_at", "response")).alias("e")).select("key", "e.response", "e.stored_at", "bucket")
        newest.repartition("bucket", "key").write.partitionBy("bucket").parquet(f"{self.path}/batch={self.buckets}-{uuid.uuid4().hex}")

    def entries(self, buckets: list[int] | None = None) -> DataFrame:
        """(key, response, stored_at): the newest live entry of every key, or of those in ``buckets``; only their folders are read."""
        batches = [b for b in self._batches() if buckets is None or b.getName().startswith(f"batch={self.buckets}-")]
        rest = [b for b in self._batches() if b not in batches]
        rows = self._read(batches)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(*buckets))
        rows = rows.unionByName(self._read(rest)) if rest else rows
        if self.seconds is not None:
            rows = rows.filter(F.col("stored_at") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(self.seconds)))
        newest = rows.groupBy("key").agg(F.max(F.struct("stored_at", "response")).alias("e"))
        return newest.select("key", "e.response", "e.stored_at")

    def _read(self, batches: list) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*[b.toString() for b in batches])

    def get(self, rows: DataFrame, content: list[str]) -> DataFrame:
        """``rows`` with key and response, null where none is kept. Equal contents share a key, and a key has one entry, so no row is doubled."""
        keyed = rows.withColumn("key", cache_key(content))
        asked = [r[0] for r in keyed.select(self._bucket(F.col("key"))).distinct().collect()]
        return keyed.join(self.entries(asked).drop("stored_at"), "key", "left")

    def answered(self, rows: DataFrame, content: list[str], ask: Callable[[DataFrame], Column]) -> DataFrame:
        """``rows`` with key and response, from here or else from ``ask`` (the response's column), which sees each different content once.

        Its responses are kept before they are returned (a task that is tried again asks again); null ones, failures, are not, and their rows have none.
        """
        found = stored(self.get(rows, content), "looked_up")
        rest = found.filter("response IS NULL").dropDuplicates(["key"]).drop("response")
        if not rest.isEmpty():
            # stored first: filters on the response would call the model again
            self.put(stored(rest.select("key", ask(rest).alias("response")), "answers"))
        return self.get(found.drop("key", "response"), content)

    def compact(self) -> None:
        """One batch of live entries instead of all that are there now; batches added meanwhile stay. Readers that began before may have to start again."""
        old = self._batches()
        if old:
            self.put(stored(self.entries(), "live"))
            for b in old:
                self._files.delete(b, True)

    def clear(self) -> int:
        """Deletes all batches that are there; returns their number."""
        return sum(bool(self._files.delete(b, True)) for b in self._batches())

    def statistics(self) -> DataFrame:
        """One row: entries that live, stored entries, batches, oldest and newest live moment."""
        all_rows = self._read(self._batches()).agg(F.count("*").alias("stored"), F.count_distinct("batch").alias("batches"))
        return self.entries().agg(F.count("*").alias("entries"), F.min("stored_at").alias("oldest"), F.max("stored_at").alias("newest")).join(all_rows)

"""Kept responses: batches at the same time, newest entry, expiry, pruned look-ups, clearing."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from opinara.sources.responses import Responses


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, f"text {i % 40}", i) for i in range(80)] + [(900, None, 1)], "id int, text string, response_no int")


def test_asked_once(spark, tmp_path, rows):
    store = Responses(spark, str(tmp_path / "r"), buckets=8)
    assert store.statistics().first()["entries"] == 0 and store.clear() == 0
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(text):
        calls.add(1)
        return None if text == "text 7" else f"said {text}"

    for expected in (41, 42):  # the failed content is asked again, nothing else
        got = store.answered(rows, ["text"], lambda r: model(r["text"])).collect()
        assert len(got) == 81 and calls.value == expected
        assert all(x.response == (None if x.text == "text 7" else f"said {x.text}") for x in got)
    assert store.answered(rows.limit(0), ["text"], lambda r: F.lit("x")).count() == 0


def test_concurrent_batches_and_newest(spark, tmp_path):
    store = Responses(spark, str(tmp_path / "r"), buckets=4)

    def add(k):
        store.put(spark.range(30).select(F.col("id").cast("string").alias("key"), F.lit(f"v{k}").alias("response"), F.timestamp_seconds(F.lit(1000 + k)).alias("stored_at")))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(6)))
    store.put(spark.createDataFrame([(None, "x"), ("1", None)], "key string, response string"))
    assert {(x.response) for x in store.entries().collect()} == {"v5"} and store.entries().count() == 30
    assert store.statistics().first()["stored"] == 180
    other = Responses(spark, store.path, buckets=16)
    other.put(spark.createDataFrame([("3", "late")], "key string, response string"))
    assert dict(store.entries().select("key", "response").collect())["3"] == "late"
    store.compact()
    assert dict(other.entries().select("key", "response").collect())["3"] == "late" and store.statistics().first()["stored"] == 30
    brief = Responses(spark, store.path, seconds=3600)
    assert [x.key for x in brief.entries().collect()] == ["3"]
    assert store.clear() == 1 and store.entries().count() == 0


def test_reads_only_asked_buckets(spark, tmp_path, rows):
    store = Responses(spark, str(tmp_path / "r"), buckets=32)
    store.answered(rows, ["text"], lambda r: F.lit("x"))
    plan = store.get(rows.filter("id = 3"), ["text"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]

"""What a row of pages costs: one hash where first pages are found, one copy of a record where it is read."""

from pyspark.sql import functions as F

from opinara.llm import warc
from opinara.storage import fresh_path


def test_first_pages_hash_each_html_once(spark, monkeypatch):
    """The filters of the look-up's joins used to hold the digest's 32 parts, each of which hashed the html again."""
    plans = []
    real = warc.stored
    monkeypatch.setattr(warc, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    pages = spark.createDataFrame([(i, "u", "x" * (i % 7)) for i in range(50)], "page_id long, url string, html string")
    index = warc.write_archives(pages, fresh_path(spark, "warc"))
    assert sum(p.count("sha1(") for p in plans[:-1]) == 1 and plans[-1].count("sha1(") <= 2
    got = {r.page_id: (r.digest, r.refers_to) for r in index.collect()}
    assert got == {i: (warc.digest_of(b"x" * (i % 7)), i % 7 if i > 6 else None) for i in range(50)}


def test_reading_copies_each_record_once(spark):
    """Neighbouring records of one run, whatever their number and size, come back whole."""
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), F.col("id").cast("int")).alias("html")).coalesce(1)
    folder = fresh_path(spark, "warc")
    back = warc.read_records(warc.write_archives(pages, folder), folder).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in back) == [(i, str(i) * i) for i in range(300)]

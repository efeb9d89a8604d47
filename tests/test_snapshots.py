"""Saves of several tables at once: failures between any two steps, retries, two writers."""

import pytest
from pyspark.sql import functions as F

from opinara.sources import sinks, snapshots
from opinara.storage import fresh_path


def counts(store, version=None):
    return {t: store.read(t, version).count() for t in ("reviews", "escalations")}


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([("a", "P", 1.0), ("b", "P", 2.0)], "review_id string, product_name string, rating double").withColumn("extra", F.lit(1))


def test_versions(spark, rows):
    store = snapshots.Store(spark, fresh_path(spark, "store"))
    assert counts(store) == {"reviews": 0, "escalations": 0}
    assert store.save({"reviews": rows, "escalations": rows}, "r1") == 1
    assert store.save({"reviews": rows}, "r2") == 2 and counts(store) == {"reviews": 4, "escalations": 2}
    assert store.save({"reviews": rows}, "r1") == 1 and store.versions() == [1, 2]
    assert store.save({"reviews": rows.limit(1)}, "r3", clear=True) == 3
    assert counts(store) == {"reviews": 1, "escalations": 0} and counts(store, 2) == {"reviews": 4, "escalations": 2}
    assert store.read("reviews").columns == [x.split()[0] for x in sinks.TABLES["reviews"].split(", ")]
    assert store.expire(keep=1) == 3 and store.versions() == [3] and counts(store)["reviews"] == 1


@pytest.mark.parametrize("step", ["second table", "before the commit", "within the commit"])
def test_a_failure_leaves_the_former_version(spark, rows, step, monkeypatch):
    path = fresh_path(spark, "store")
    store = snapshots.Store(spark, path)
    store.save({"reviews": rows}, "r1")
    bad = rows.withColumn("product_name", F.raise_error(F.lit("no")).cast("string"))
    new = {"reviews": rows, "escalations": bad if step == "second table" else rows}

    def fail(*_):
        raise OSError("lost")

    if step == "before the commit":
        monkeypatch.setattr(store, "_commit", fail)
    if step == "within the commit":
        class Lost:
            rename = fail

        monkeypatch.setattr(store, "_context", Lost())
    with pytest.raises(Exception):
        store.save(new, "r2", clear=True)
    again = snapshots.Store(spark, path)
    assert counts(again) == {"reviews": 2, "escalations": 0} and again.versions() == [1]
    assert again.save({"reviews": rows, "escalations": rows}, "r2", clear=True) == 2
    assert counts(again) == {"reviews": 2, "escalations": 2} and again.expire() == {"second table": 1, "before the commit": 2, "within the commit": 2}[step] + (step == "second table")


def test_two_writers(spark, rows):
    path = fresh_path(spark, "store")
    one, two = snapshots.Store(spark, path), snapshots.Store(spark, path)
    one.save({"reviews": rows}, "r0")
    seen = one.manifest()
    two.save({"reviews": rows}, "r1")
    with pytest.raises(snapshots.Conflict):  # the commit of a version that is there
        one._commit(seen, one._write({"reviews": rows}), "r2", False)
    assert one.versions() == [1, 2] and one.manifest()["runs"] == ["r0", "r1"]
    one.manifest = lambda version=None, real=one.manifest, first=[seen]: first.pop() if first and version is None else real(version)
    assert one.save({"reviews": rows}, "r3") == 3 and counts(two)["reviews"] == 6
    one.manifest = lambda version=None: seen
    with pytest.raises(snapshots.Conflict):
        one.save({"reviews": rows}, "r4", clear=True)
    assert counts(two)["reviews"] == 6

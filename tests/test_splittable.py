"""Readers by byte ranges against the plain ones, cut at many places."""

import json
import random

import pytest

from opinara.sources import splittable


@pytest.fixture
def ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield of
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted(map(str, df.collect()))


FIELDS = ["plain", "", 'a "word" in it', "two\nlines", "three\n\n\nlines, and commas", "é日本🙂", '"', '""', ",", "\n", 'end"', "x" * 90 + "\n" + "y" * 90, "{not json}", "\\", "\\n"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv(spark, ranges, tmp_path, end):
    r = random.Random(1)
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if r.random() < 0.3 or any(c in v for c in '",\n') else v
    lines = ["review_id,review_text,product"] + [f"R{i},{quoted(r.choice(FIELDS))},{quoted(r.choice(FIELDS))}" for i in range(70)] + ['R900,5" pipe,6" pipe', "", "R901,last,line"]
    path = str(tmp_path / "a.csv")
    (tmp_path / "a.csv").write_bytes(end.join(lines).encode())
    want = rows_of(spark.read.csv(path, header=True, multiLine=True, escape='"'))
    assert len(want) == 72
    for size in (64, 997):
        ranges(size)
        got = splittable.read_csv(spark, path)
        assert rows_of(got) == want, size
    ranges(256)
    assert splittable.chunks(spark, path, "\n").rdd.getNumPartitions() > 5


def test_several_csv_files(spark, ranges, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("review_text,n\n" + "".join(f'"line {k}\n{i}",{i}\n' for i in range(20)))
    ranges(50)
    want = rows_of(spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"'))
    assert rows_of(splittable.read_csv(spark, str(tmp_path))) == want and len(want) == 60


@pytest.mark.parametrize("form", ["array", "indented", "wrapped", "lines", "one"])
def test_json(spark, ranges, tmp_path, form):
    r = random.Random(2)
    odd = ["}", "{", "]", '"}', "\\", '\\"}', "a\nb", "é日本🙂", "", "[{" * 30, "}]" * 30]
    rows = [{"review_id": i, "review_text": r.choice(odd) + r.choice(odd), "more": {"a": [{"b": r.choice(odd)}] * r.randrange(3), "c": None}, "rating": r.random()} for i in range(1 if form == "one" else 40)]
    raw = {"array": json.dumps(rows), "indented": json.dumps(rows, indent=2), "wrapped": json.dumps({"reviews": rows}, indent=1), "lines": "\n".join(map(json.dumps, rows)) + "\n", "one": json.dumps(rows[0])}[form]
    path = str(tmp_path / "a.json")
    (tmp_path / "a.json").write_text(raw)
    plain = spark.createDataFrame([(json.dumps(x),) for x in rows], "v string").select("v")
    plain.write.text(str(tmp_path / "plain"))
    want = rows_of(spark.read.json(str(tmp_path / "plain")))
    for size in (97,):
        ranges(size)
        assert rows_of(splittable.read_json(spark, path)) == want, size


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("review_text,n\n")
    assert splittable.read_csv(spark, str(tmp_path / "a.csv")).count() == 0
    (tmp_path / "a.json").write_text("[ ]")
    assert splittable.read_json(spark, str(tmp_path / "a.json")).count() == 0

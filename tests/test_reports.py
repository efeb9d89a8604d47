"""Scans, sinks, records, insights and bots on small rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinara.functions import text as X
from opinara.operators import bots, duplicates, insights, records, trends
from opinara.sources import scans, sinks
from opinara.storage import fresh_path, remove_stored


def test_labelled_file_and_encodings(spark, tmp_path):
    rows = 'review_id,manual_features,is_cap_leakage\nA,"[{""feature"":""Cap"",""sentiment"":""negative""}]",True\nB,none,no\nC,,\n'
    (tmp_path / "x_reviews.csv").write_text(rows)
    got = {r.review_id: ([f.feature for f in r.manual_features], r.is_cap_leakage) for r in scans.read_labelled(spark, str(tmp_path / "x_reviews.csv")).collect()}
    assert got == {"A": (["Cap"], True), "B": ([], False), "C": ([], False)}
    (tmp_path / "latin.csv").write_bytes("review_text\ncafé\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("review_text\ncafé\n".encode())
    assert [scans.read_any_encoding(spark, str(tmp_path / f)).first()[0] for f in ("latin.csv", "utf.csv")] == ["café", "café"]
    first = scans.read_first(spark, [str(tmp_path / "none.csv"), str(tmp_path / "utf.csv")], scans.generated_reviews)
    assert first.count() == 1 and scans.read_first(spark, [str(tmp_path / "none.csv")], scans.generated_reviews).count() == 300


def test_generated_reviews(spark):
    rows = scans.generated_reviews(spark, seed=1, rows=3000)
    assert rows.exceptAll(scans.generated_reviews(spark, seed=1, rows=3000)).count() == 0 and rows.select("review_id").distinct().count() == 3000
    share = {r.sentiment: r["count"] / 3000 for r in rows.filter("NOT is_seeded").groupBy("sentiment").count().collect()}
    assert 0.45 < share["positive"] < 0.6 and share["negative"] < 0.25
    assert {r.product_name for r in rows.filter("is_seeded").select("product_name").distinct().collect()} == {"Bottle", "Blender", "Charger"}
    late = rows.filter("product_name = 'Bottle'").orderBy("review_id").tail(300)
    assert sum(r.is_seeded for r in late) > 60
    assert scans.crisis_options(spark).count() == 3


def test_tables_of_a_run(spark):
    path = fresh_path(spark, "run")
    sinks.create_tables(spark, path)
    reviews = spark.createDataFrame([("a", "P", 4.0), ("b", "P", 1.0)], "review_id string, product_name string, rating double")
    sinks.save_all(spark, path, {"reviews": reviews})
    sinks.save_all(spark, path, {"reviews": reviews})
    count = lambda t: spark.read.schema(sinks.TABLES[t]).parquet(f"{path}/{t}").count()
    assert (count("reviews"), count("escalations")) == (4, 0)
    broken = reviews.withColumn("rating", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception):
        sinks.save_all(spark, path, {"escalations": reviews, "reviews": broken}, clear=True)
    assert (count("reviews"), count("escalations")) == (4, 0)
    sinks.save_all(spark, path, {"reviews": reviews}, clear=True)
    assert count("reviews") == 2
    sinks.create_tables(spark, path, clear=True)
    assert count("reviews") == 0 and remove_stored(spark) > 0 and not scans.exists(spark, path)
    lines = sinks.network_json(spark.createDataFrame([("u", "red")], "id string, color string"), spark.createDataFrame([("u", "v")], "a string, b string"))
    assert sorted((r.kind, r.line) for r in lines.collect()) == [("edge", '{"a":"u","b":"v"}'), ("node", '{"color":"red","id":"u"}')]


def test_asked_tries_again_and_keeps_failed_rows(spark):
    def ask(part: pd.DataFrame) -> pd.DataFrame:
        if (part.review_id == 3).any():
            raise ValueError("down")
        return pd.DataFrame({"review_id": part.review_id, "answer": part.review_id * 2})

    got = {r.review_id: (r.answer, r.error) for r in records.asked(spark.range(6).withColumnRenamed("id", "review_id").coalesce(1), ask, "review_id long, answer long", batch=2, wait=0.0).collect()}
    assert got == {0: (0, None), 1: (2, None), 2: (None, "down"), 3: (None, "down"), 4: (8, None), 5: (10, None)}


def test_insights(spark):
    rows = spark.createDataFrame([("COMPLAINT SPIKE", "battery"), ("COMPLAINT SPIKE", None), ("other", "x")], "type string, feature string")
    got = [(r.action, r.meaning) for r in insights.anomaly_insights(rows, feature="feature").collect()]
    assert got[0] == ("Audit battery issues immediately.", "Battery complaints are heavily spiking above normal baseline.") and got[2][0] == "Monitor closely."
    show = spark.createDataFrame([(2.5e7,), (-250000.0,), (1500.0,), (-12.0,), (0.0,)], "a double").select(insights.currency(F.col("a")).alias("c"))
    assert [r.c for r in show.collect()] == ["+₹2.5 Cr", "₹2.5L", "+₹2K", "₹12", "₹0"]
    rates = spark.createDataFrame([("P", "f", w, r) for w, r in enumerate([50.0, 50.0, 10.0, 50.0, 50.0, 50.0, 10.0])], "product_name string, feature string, window_no int, complaint_rate double")
    assert tuple(trends.runs_above(rates, 40.0).first())[2:] == (3, 5)


def test_preprocess_and_emojis(spark):
    rows = spark.createDataFrame([("I LOVE it 👍🏽 🚀🚀",), (None,), (" ",), ("ok 😡",)], "review_text string")
    got = rows.select(X.emoji_tags(F.col("review_text")).alias("e")).select("e.*").collect()
    assert got[0].tags == ["[POSITIVE]", "[ROCKET]"]
    assert got[3].tags == ["[ANGRY]"]
    done = X.preprocess(rows, translate=F.upper).collect()
    assert [r.quality_score for r in done][1:3] == [0, 0] and done[1].flags == ["empty_text"] and done[0].caps_intensity
    assert X.preprocess(rows.limit(0)).count() == 0


def brute_bursts(rows, hours=2, least=3):
    out = []
    for p in {r[1] for r in rows}:
        mine = sorted((r[2], r[0], r[3]) for r in rows if r[1] == p)
        used = set()
        for i, (t, a, _) in enumerate(mine):
            if a in used:
                continue
            near = [x for x in mine[i:] if x[0] <= t + hours * 3600 and x[1] not in used]
            kinds = {x[2] for x in near}
            if len(near) >= least and len(kinds) == 1 and kinds <= {1, 5}:
                used |= {x[1] for x in near}
                out += [(p, a, x[1], x[2]) for x in near]
    return sorted(out)


@pytest.mark.parametrize("step, kinds", [(1, [1, 1, 1, 5, 3]), (1800, [1, 1, 1, 5, 3]), (3600, [5, 5, 5, 5, 5, 2]), (600, [1])])
def test_greedy_bursts_against_brute_force(spark, step, kinds):
    import random

    r = random.Random(4)
    rows = [(i, f"P{i % 3}", r.randrange(0, 200_000) // step * step, r.choice(kinds)) for i in range(300)]
    df = spark.createDataFrame(rows, "review_id long, product_name string, sec long, rating int").withColumn("ts", F.timestamp_seconds("sec"))
    got = sorted(tuple(x) for x in duplicates.greedy_bursts(df).select("product_name", "campaign_id", "review_id", "rating").collect())
    assert got == brute_bursts(rows) and got
    near = {a: [x for x in rows if x[1] == p and t <= x[2] <= t + 7200] for a, p, t, _ in rows}
    wanted = sorted((a, len(x), x[0][3]) for a, x in near.items() if len(x) >= 3 and len({y[3] for y in x}) == 1 and x[0][3] in (1, 5))
    assert sorted(tuple(x) for x in duplicates.bursts(df).select("review_id", "in_window", "campaign_rating").collect()) == wanted


def test_islands_cross_buckets(spark):
    numbers = [1, 2, 3, 5, 8, 9, 11, 30, 31, 33, 33, 100]
    df = spark.createDataFrame([(f"u{n}",) for n in numbers] + [("u033",), ("v7",), ("nobody",), (None,)], "username string")
    got = {(r.prefix, r.username): r.island for r in duplicates.user_islands(df, 2, bucket=4).collect()}
    assert got == {("u", f"u{n}"): i for i, group in enumerate(([1, 2, 3, 5], [8, 9, 11], [30, 31, 33], [100])) for n in group} | {("u", "u033"): 2, ("v", "v7"): 0}


def test_neighbours_count_copies(spark):
    text = "alpha beta gamma delta epsilon zeta"
    rows = [(1, text), (2, text), (3, "alpha beta gamma delta epsilon other words here"), (4, "nothing in common at all"), (5, None)]
    rows += [(10 + i, f"quite unlike filler number{i} text{i} about{i} thing{i}") for i in range(10)]
    got = {r.review_id: r.signal for r in bots.neighbour_signals(spark.createDataFrame(rows, "review_id long, review_text string"), ["the"]).collect()}
    assert got[1] == got[2] == "HIGH_SIMILARITY_MATCH" and 4 not in got and 5 not in got


def test_product_directory(spark, tmp_path):
    (tmp_path / "smart_bottle_reviews.csv").write_text('review_text,is_seeded\n"good, really\ngood",TRUE\nbad,no\n')
    (tmp_path / "bolt_x_reviews.csv").write_text("review_id,product_name,clean_text,sentiment,category\nB7,Bolt Y,fine,positive,Own\n")
    (tmp_path / "all_reviews.csv").write_text("review_text\nnot read\n")
    for name in ("smart_bottle", "bolt_x"):
        folder = tmp_path / name
        folder.mkdir()
        (folder / f"{name}_reviews.csv").write_text((tmp_path / f"{name}_reviews.csv").read_text())
    (tmp_path / "bolt_x" / "all_reviews.csv").write_text("review_id,product_name,clean_text,sentiment,category\nno,no,no,no,no\n")
    got = scans.read_product_directory(spark, str(tmp_path / "smart_bottle"), F.lit("T")).orderBy("review_id").collect()
    assert [tuple(r) for r in got] == [("Smart Bottle_0", "Smart Bottle", "Personal Care", "good, really\ngood", "good, really\ngood", "T", "neutral", True), ("Smart Bottle_1", "Smart Bottle", "Personal Care", "bad", "bad", "T", "neutral", False)]
    got = scans.read_product_directory(spark, str(tmp_path / "bolt_x"), F.lit("T")).collect()
    assert [tuple(r) for r in got] == [("B7", "Bolt Y", "Own", "fine", "fine", "T", "positive", False)]


def test_saved_reviews_and_files_per_product(spark, tmp_path):
    from opinara.sources import files

    rows = spark.createDataFrame([("a", "P1", "x", [("cap", "negative")]), ("b", "P2", 'say "y",\nplease', [])], "review_id string, product_name string, review_text string, extracted_features array<struct<feature string, sentiment string>>")
    path = str(tmp_path / "run")
    for _ in range(2):
        files.save_reviews(rows, path)
    assert spark.read.parquet(f"{path}/reviews").count() == 4 and "extracted_features" not in spark.read.parquet(f"{path}/reviews").columns
    assert [tuple(r) for r in spark.read.parquet(f"{path}/feature_extractions").distinct().collect()] == [("a", "cap", "negative")]
    files.save_csv_per_product(rows.drop("extracted_features"), str(tmp_path / "csv"))
    assert sorted(p.name for p in (tmp_path / "csv").iterdir() if p.is_dir()) == ["product_name=P1", "product_name=P2"]

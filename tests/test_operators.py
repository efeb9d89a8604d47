"""Golden values and small fixtures."""

import pytest
from pyspark.sql import functions as F

from opinara.functions import text as X
from opinara.operators import campaigns as N, duplicates as D, escalation as E, replies as R, scenarios as C, trends as T, vocabulary as V, weekly as W
from opinara.operators.graph import connected_components
from opinara.operators.ordering import positions
from opinara.operators.skew import lookup_by_key
from opinara.sources.files import normalize_columns, read_reviews
from opinara.sources.paste import pasted_reviews


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


def test_priorities(spark):
    rows = [(0.9, "negative", 28.0, 22.0, 28, 100, 2.75 / 3, 0), (0.6, "negative", 15.0, 8.0, 15, 100, 0.775, 0), (0.3, "negative", 3.0, None, 3, 100, 0.60, 1)]
    df = spark.createDataFrame(rows, "intensity double, sentiment string, rate double, previous double, negatives int, total int, confidence double, windows_ago int")
    got = [(round(r.priority, 2), r.level) for r in E.scored(df).orderBy(F.desc("priority")).collect()]
    assert got == [(74.35, "high"), (58.96, "medium"), (21.5, "low")]


def test_lifecycle_golden(spark):
    rates = [8, 12, 18, 25, 28, 26, 20, 15, 8]
    df = spark.createDataFrame([("p", "f", i + 1, float(r)) for i, r in enumerate(rates)], "product_name string, feature string, window_no int, complaint_rate double")
    stages = T.lifecycle(df).orderBy("window_no").collect()
    assert [r.stage for r in stages] == ["detected", "growing", "systemic", "persistent", "persistent", "resolving", "resolving", "resolving", "resolved"]
    assert stages[-1].severity == 0 and T.transitions(T.lifecycle(df)).count() == 5


@pytest.mark.parametrize("n, windows", [(150, 5), (100, 3), (50, 1), (49, 0), (0, 0)])
def test_window_counts(spark, n, windows):
    df = spark.range(n).select(F.lit("p").alias("product_name"), F.col("id"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(F.col("id") * 7).cast("int"))).alias("ts"))
    got = T.sliding_windows(df, ["ts", "id"]).groupBy("window_no").count().collect()
    assert len(got) == windows and all(r["count"] == 50 for r in got)


def test_positions_match_row_numbers(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id"), (F.col("id") / 40).cast("int").alias("b"))
    got = {(r.g, r.id): (r.idx, r.n) for r in positions(df, ["g"], F.col("b"), ["id"]).collect()}
    assert got == {(i % 2, i): (i // 2, 250) for i in range(500)}


def test_revenue_and_crisis(spark):
    df = spark.createDataFrame([("p", 4.3, 38.0, 500000.0)], "product_name string, rating double, rate double, revenue double")
    got = {r.scenario: (r.new_rating, round(r.revenue_impact)) for r in C.revenue_scenarios(df, 8.0).collect()}
    assert got == {"do_nothing": (1.9, -144000), "partial_fix": (3.3, -60000), "full_fix": (4.2, -6000)}
    base = spark.range(115).select(F.when(F.col("id") < 15, "negative").otherwise("positive").alias("sentiment"))
    r = C.crisis_metrics(base.unionByName(C.crisis_reviews(spark, "packaging_crisis", "p", "2024-01-01 00:00:00").select("sentiment", "is_crisis"), allowMissingColumns=True)).first()
    assert (round(r.before, 1), round(r.after, 1), round(r.z, 1), round(r.rating_impact, 2)) == (13.0, 39.4, 6.7, -2.11)


def test_text(spark):
    assert one(spark, X.normalized(F.col("t")), t="WORST   ever!!! soooo <b>bad</b>") == "Worst ever! soo bad"
    assert one(spark, X.emojis_to_tags(F.col("t")), t="👍") == "[POSITIVE]"
    assert one(spark, X.quality_score(F.col("t")), t="[POSITIVE]") == 15
    assert one(spark, X.quality_score(F.col("t")), t=" ") == 0
    assert one(spark, X.local_sentiment(F.col("t"), F.lit(None).cast("int")), t="bad and broken but good") == "negative"
    assert one(spark, X.emotion(F.col("t"), F.lit("negative"))["emotion"], t="This is pathetic and useless, broken") == "angry"
    assert one(spark, X.emotion(F.col("t"), F.lit("mixed"))["emotion"], t="zzz") == "neutral"
    assert one(spark, X.sarcasm(F.col("t"))["confidence"], t='"great" quality!!!') == 0.5


def test_trust_and_repetition(spark):
    assert one(spark, D.trust(F.lit(4), F.lit(True), F.lit(False), F.lit(False)), t=1) == 40
    assert one(spark, D.repeated_sentence(F.col("t")), t="Bad thing. Bad thing! Bad  thing? ok")
    assert not one(spark, D.repeated_sentence(F.col("t")), t="Bad thing. Bad thing! Other thing?")


def test_near_groups(spark):
    texts = ["alpha beta gamma delta epsilon zeta"] * 2 + ["alpha beta gamma delta epsilon zeta eta"] + [f"other{i} words{i} here{i} now{i}" for i in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id long, review_text string")
    groups = D.near_groups(D.similar_pairs(D.tfidf(df, ["the"]))).collect()
    assert {(r.review_id, r.group_id, r.group_size) for r in groups} == {(i, 0, 3) for i in range(3)}


def test_components_and_lookup(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    assert connected_components(e.limit(0)).count() == 0
    rows = spark.range(3000).select((F.when(F.col("id") < 2000, 0).otherwise(F.col("id"))).alias("k"), "id").union(spark.createDataFrame([(None, -1)], "k long, id long"))
    table = rows.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    assert lookup_by_key(rows, table, ["k"], "n").filter("first IS NULL").count() == 1
    assert lookup_by_key(rows, table, ["k"], "n").filter("first = 0").count() == 2000


def test_greedy_bursts_and_users(spark):
    rows = [(i, "p", f"2024-01-01 00:{i:02d}:00", 5, f"user_{u}") for i, u in enumerate((1, 2, 4, 9))] + [(9, "p", "2024-01-02 00:00:00", 1, None)]
    df = spark.createDataFrame(rows, "review_id long, product_name string, ts string, rating int, username string")
    assert {r.review_id for r in D.greedy_bursts(df).collect()} == {0, 1, 2, 3}
    assert [(r.low, r.high, r.users) for r in D.sequential_users(df).collect()] == [(1, 4, 3)]


def test_week_ends_on_monday(spark):
    assert str(one(spark, W.week_end(F.col("t")), t="2024-01-02")) == "2024-01-08"
    assert str(one(spark, W.week_end(F.col("t")), t="2024-01-08")) == "2024-01-08"


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Review Body,Stars,When\n"so, so",4,2024-01-01\n" ",1,2024-01-02\n')
    df = normalize_columns(read_reviews(spark, str(tmp_path / "a.csv")))
    r = df.collect()
    assert len(r) == 1 and r[0].review_text == "so, so" and r[0].rating == 4.0 and r[0].username is None
    (tmp_path / "b.json").write_text('{"reviews": [{"text": "x"}, {"text": "y"}]}')
    assert read_reviews(spark, str(tmp_path / "b.json")).count() == 2
    pasted = spark.createDataFrame([(1, "short\n\nthis is long enough\n"), (2, None)], "id long, text string")
    assert [(x.position, x.review_text) for x in pasted_reviews(pasted, "text", ["id"]).collect()] == [(2, "this is long enough")]


@pytest.mark.parametrize("given, wanted", [("cafÃ© trÃ¨s bon", "café très bon"), ("café", "café"), ("Ãrger ok", "Ãrger ok"), ("Ã© — dash", "Ã© — dash"), ("", ""), (None, None)])
def test_unscrambled(spark, given, wanted):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(X.unscrambled(F.col("t")).alias("x")).first()["x"] == wanted


def test_composed(spark):
    rows = spark.createDataFrame([("e\u0301te\u0301",), ("",), (None,)], "t string").select(X.composed(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == ["\u00e9t\u00e9", "", None]


@pytest.mark.parametrize("text, wanted", [("yeh bahut accha hai", "HINGLISH"), ("the battery is bad", "EN"), ("अच्छा है", "HI"), ("12 !!", "OTHER"), ("der Akku gut", "OTHER"), (None, "OTHER")])
def test_review_language(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(X.review_language(F.col("t")).alias("x")).first()["x"] == wanted


@pytest.mark.parametrize("text, wanted", [("The battery drain was bad", ["battery drain"]), ("battery drain cable 7", ["battery drain", "drain cable", "cable 7", "battery drain cable", "drain cable 7", "battery drain cable 7"]), ("12 34", []), ("ab cd", []), ("product box", []), ("one", []), ("", []), (None, [])])
def test_phrases(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(V.phrases(F.col("t")).alias("x")).first()["x"] == wanted


def test_vocabulary_alert(spark):
    df = spark.createDataFrame([("fuel leak", 9), ("cap loose", 5), ("hinge squeak", 4)], "phrase string, emergence_score long")
    row = V.vocabulary_alert(df, "p", "W2").first()
    assert (row.severity, row.significant, row.suggested) == ("medium", 2, "fuel leak,cap loose")
    assert V.vocabulary_alert(df.filter("emergence_score < 5"), "p", "W2").count() == 0


def test_text_groups_joins_copies_and_near_copies(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "Alpha  beta gamma delta epsilon zeta", "one two three four five six seven", "alpha beta gamma delta epsilon zeta", "short", None, "alpha beta gamma delta epsilon zeta zeta"]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id long, review_text string")
    got = {r.review_id: (r.group_id, r.group_size) for r in D.text_groups(df, []).collect()}
    assert got == {i: (0, 4) for i in (0, 1, 3, 6)}
    assert D.text_groups(df.limit(0), []).count() == 0


def test_network(spark):
    members = spark.createDataFrame([("c1", "a", 75), ("c1", "b", 75), ("c1", "c", 75), ("c2", "b", 60), ("c2", "d", 60)], "campaign_id string, username string, confidence int")
    others = spark.createDataFrame([("a", "TRUSTED"), ("z", "LOW_SUSPICION")], "username string, status string")
    colors = {r.username: (r.color, r["size"]) for r in N.network_nodes(members, others).collect()}
    assert colors == {"a": ("#F44336", 25), "b": ("#F44336", 25), "c": ("#F44336", 25), "d": ("#FF9800", 25), "z": ("#FFEB3B", 15)}
    assert {(r.campaign_id, r.from_user, r.to_user) for r in N.network_edges(members).collect()} == {("c1", "a", "b"), ("c1", "a", "c"), ("c2", "b", "d")}


def test_reply_drafts(spark):
    df = spark.createDataFrame([(7, "Mixer", "cap leak"), (8, None, None)], "review_id long, product_name string, feature string")
    rows = R.reply_drafts(df).collect()
    assert len(rows) == 6 and {r.category for r in rows if r.review_id == 7} == {"packaging"} and {r.category for r in rows if r.review_id == 8} == {"default"}
    first = next(r for r in rows if r.review_id == 7 and r.tone == "professional")
    assert "Mixer" in first.response_text and "REF-7" in first.response_text and first.word_count == len(first.response_text.split())

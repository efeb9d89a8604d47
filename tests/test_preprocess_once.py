"""Preprocessing takes a text's words once, and takes apart only what may be shouted or hold an emoji; results stay."""

from pyspark.sql import functions as F

from opinara.functions import text as X

TEXTS = [None, "", " ", "A", "AB", "a AB c", "aB", "A1B2 x", "[AB] CD", "É È", "ÉÈ", "x AB", "A B", "OK!!! sooo", "I am", "I A", "U.S. made", "ß AB-cd", "AB-CD", "中文 AB", "ⅣⅤ", "A\tB\nCD", "👍🏽 GOOD", "❤️", "️", "x 🔥y", "Ⓐ🎉B"]


def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, review_text string")


def test_words_are_made_once(spark):
    plan = X.preprocess(frame(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(X.WORD) == 1


def test_calm_texts_are_not_taken_apart(spark, monkeypatch):
    made = lambda: [tuple(r) for r in frame(spark).select("i", X.calmed(F.col("review_text")).alias("c")).select("i", "c.*").orderBy("i").collect()]
    got = made()
    monkeypatch.setattr(X, "MAY_SHOUT", "")
    assert [x for x in got if TEXTS[x[0]] is not None] == [x for x in made() if TEXTS[x[0]] is not None]
    assert {TEXTS[i] for i, _, caps in got if caps} >= {"AB", "a AB c", "ÉÈ", "AB-CD", "A1B2 x"} and not any(caps for i, _, caps in got if TEXTS[i] in ("aB", "A", "I am", "I A"))

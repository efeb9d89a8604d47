"""Languages scored where the texts lie: the same as by joins, and nothing of the texts is shuffled."""

import random

from pyspark.sql import functions as F

from opinara.operators import languages as L


def test_in_place(spark, monkeypatch):
    monkeypatch.setattr(L, "WORDS_HELD", 3)
    r = random.Random(2)
    words = {"en": "the and with phone very bad".split(), "de": "der und mit größe sehr schlecht".split()}
    rows = [(i, " ".join(r.choices(words[v], k=r.randint(0, 7))) if i % 9 else None, v if i % 4 else None) for i, v in enumerate(["en", "de"] * 40)]
    df = spark.createDataFrame(rows, "i int, t string, l string").repartition(3)
    counts = {(x.label, x.w): x.c for x in L._word_counts(df.select(F.col("l").alias("label"), L.letter_words(F.col("t")).alias("ws")).filter("label IS NOT NULL")).collect()}
    assert counts == {(v, w): n for v in words for w in words[v] if (n := sum((t or "").split().count(w) for _, t, x in rows if x == v))}
    model = L.fit(df, "t", "l")
    found = L.predicted(df, "t", model)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # that of the repartition above
    got = sorted(found.collect())
    monkeypatch.setattr(L, "BROADCAST_WEIGHTS", 0)
    assert got == sorted(L.predicted(df, "t", model).collect()) and len(got) == len(rows)

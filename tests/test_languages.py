"""Naive Bayes over trigrams against a plain version in Python."""

import math
import random
from collections import Counter

import pytest

from opinara.operators import languages as L


def _plain(train, texts):
    grams = lambda t: [f" {w} "[i : i + 3] for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split() for i in range(len(w))]
    counts = {v: Counter(g for t, x in train if x == v for g in grams(t)) for v in sorted({x for _, x in train if x})}
    size, n = len(set().union(*counts.values())), sum(1 for _, x in train if x)
    w = lambda x: round(math.log(x) * 1e6)
    out = []
    for t in texts:
        gs = grams(t)
        s = {v: w(sum(1 for _, x in train if x == v) / n) + sum(w((c[g] + 1) / (c.total() + size)) for g in gs) for v, c in counts.items()}
        best = max(s, key=lambda v: (s[v], [-ord(c) for c in v]))
        out.append((best, 1 / sum(math.exp((x - s[best]) / 1e6) for x in s.values())) if gs else (None, None))
    return out


@pytest.mark.parametrize("bound", [L.BROADCAST_WEIGHTS, 0])
def test_against_plain(spark, monkeypatch, bound):
    monkeypatch.setattr(L, "BROADCAST_WEIGHTS", bound)
    r = random.Random(5)
    words = {"en": "the and with this not great phone very bad box".split(), "de": "der und mit dies nicht gutes telefon sehr schlecht größe".split(), "es": "el y con este no gran teléfono muy malo año".split()}
    text = lambda v: " ".join(r.choices(words[v], k=r.randint(1, 9)))
    train = [(text(v), v) for v in words for _ in range(40)] + [("the the", None), (None, "en"), ("", "de"), (text("es"), "es")] * 2
    asked = [text(r.choice(list(words))) for _ in range(60)] + ["", None, "123 !!", "zzz qqq xxxx", "a", "the, und; el"] + ["the box"] * 50
    model = L.fit(spark.createDataFrame(train, "t string, l string"), "t", "l")
    assert model.labels == ["de", "en", "es"]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(asked)], "i int, t string, w int")
    got = {x.i: x for x in L.predicted(rows, "t", model).collect()}
    assert len(got) == len(asked) and all(x.w == i for i, x in got.items())
    for i, (lang, p) in enumerate(_plain(train, asked)):
        assert got[i].language == lang and (p is None) == (got[i].probability is None)
        assert p is None or abs(p - got[i].probability) < 1e-9 and got[i].margin >= 0


def test_nothing_to_learn(spark):
    rows = spark.createDataFrame([("the box", None)], "t string, l string")
    assert L.predicted(rows, "t", L.fit(rows, "t", "l")).first()["language"] is None
    one = L.fit(spark.createDataFrame([("the box", "en")], "t string, l string"), "t", "l")
    row = L.predicted(rows, "t", one).first()
    assert (row.language, row.probability, row.margin) == ("en", 1.0, None)
    assert L.predicted(rows.limit(0), "t", one).count() == 0


def test_hinglish_stays(spark):
    model = L.fit(spark.createDataFrame([("this phone is good", "en"), ("esto no es bueno", "es")], "t string, l string"), "t", "l")
    asked = ["bahut accha hai yaar", "this is good", "no es bueno", "", None, "नमस्ते"]
    got = [x.kind for x in L.review_languages(spark.createDataFrame(list(enumerate(asked)), "i int, t string"), "t", model).orderBy("i").collect()]
    assert got == ["HINGLISH", "EN", "OTHER", "OTHER", "OTHER", "OTHER"]

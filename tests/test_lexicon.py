"""Lexicons against one search a term."""

import random
import re

import pytest
from pyspark.sql import functions as F

from opinara.functions import lexicon as L


def test_held_terms(spark):
    r = random.Random(2)
    terms = ["".join(r.choices("abc ", k=r.randint(1, 4))) for _ in range(300)] + ["é", "नम", "👍", "", "a"]
    texts = ["".join(r.choices("abcd é", k=r.randint(0, 30))) for _ in range(200)] + [None, "", "नमस्ते 👍"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    kept = list(dict.fromkeys(t for t in terms if t))
    for x in rows.select("t", L.held_terms(F.col("t"), terms).alias("h")).collect():
        assert x.h == (None if x.t is None else [k for k in kept if k in x.t])
    assert {tuple(x.h) for x in rows.filter("t IS NOT NULL").select(L.held_terms(F.col("t"), []).alias("h")).collect()} == {()}


def test_replaced_terms(spark):
    table = {"gr8": "great", "pls": "please", "pls call": "please phone", "u": "you", "great": "never seen again", "über": "over"}
    texts = ["Gr8 PLS call u", "plsx u2 xu u_u u", "pls calls", "great gr8", "Über U İu u", "", None, "u" * 50, "u,u;u"]
    pattern = re.compile("|".join(rf"(?<!\w){re.escape(k)}(?!\w)" for k in sorted(table, key=len, reverse=True)), re.I)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for x in rows.select("t", L.replaced_terms(F.col("t"), table).alias("r")).collect():
        assert x.r == (None if x.t is None else pattern.sub(lambda m: table[m[0].lower()], x.t))


def test_bound(monkeypatch):
    monkeypatch.setattr(L, "MOST_CHARACTERS", 3)
    with pytest.raises(ValueError):
        L._checked(["ab", "cd"])
    assert L._checked(["ab", "ab", ""]) == ["ab"]

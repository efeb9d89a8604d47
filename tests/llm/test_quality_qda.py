"""The discriminant against densities by the formula, and held-out rows of the tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import quality_qda as qda


def texts(n=160, seed=4):
    r = random.Random(seed)
    good = lambda: " ".join("".join(r.choices("abcdefgh", k=r.choice((2, 4, 6)))) for _ in range(r.choice((3, 40, 200)))) + "."
    bad = lambda: " ".join("".join(r.choices("ABCDE", k=4)) + r.choice(("!!", "###")) for _ in range(r.choice((5, 80))))
    return [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(n)]


def test_against_the_formula(spark):
    rows = texts()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:120]], "doc_id long, quality int")
    x = qda.statistics([t for _, t, _ in rows])
    y = np.array([q for *_, q in rows])[:120]
    known, scale = x[:120], None
    groups = [known[y == k] for k in (0, 1)]
    scale = np.maximum(np.sqrt(sum(((g - g.mean(0)) ** 2).sum(0) for g in groups) / 120), qda.MIN_DEVIATION)
    density = []
    for g in groups:
        z, all_z = (g - known.mean(0)) / scale, (x - known.mean(0)) / scale
        s = np.cov(z.T, bias=True)
        w = qda.shrinkage(s, len(g))
        s = (1 - w) * s + w * max(np.trace(s) / len(s), qda.MIN_SHRINKAGE) * np.eye(len(s))
        d = all_z - z.mean(0)
        density.append(np.log(len(g) / 120) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    model = qda.fit(qda.described(df), labels)
    assert np.allclose(model.densities(x)[:, 1] - model.densities(x)[:, 0], density[1] - density[0], rtol=1e-6, atol=1e-6)
    got = {r.doc_id: (r.quality_score, r.quality_predicted) for r in qda.classified(df, labels).collect()}
    assert np.allclose([got[i][0] for i in range(len(rows))], model.score(x), atol=1e-9)
    assert all(got[i][1] == q == (got[i][0] >= 0.5) for i, _, q in rows)


def test_edges(spark):
    rows = [(1, None), (1, None), (None, ""), (2, " \n\t"), (3, "é" * 40_000 + "\n" + "x " * 300_000), (4, "1"), *[(9, "same text here")] * 50]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "label", "statistics", "quality_score", "uses", "learn")})
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.quality_score for r in qda.classified(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(9, 1), (9, 1), (9, 0), (1, 0), (1, 1), (None, 0), (2, None), (3, 7)], "doc_id long, quality int")
    out = qda.classified(df, one)
    assert out.count() == len(rows) and {r.quality_score for r in out.collect()} == {1.0} and "text" not in out.columns
    both = spark.createDataFrame([(9, 1), (1, 0)], "doc_id long, quality int")
    found = qda.classified(df, both).collect()
    assert all(0 <= r.quality_score <= 1 for r in found) and {r.quality_predicted for r in found if r.doc_id == 9} == {1} and {r.quality_predicted for r in found if r.doc_id == 1} == {0}
    assert qda.classified(df.limit(0), both).count() == 0
    assert {r.quality_score for r in qda.classified(df, both, F.col("doc_id") != 1).collect()} == {1.0}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_rows(spark):
    rows = qda.op13_quality_qda(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    right = [r.predicted == r.quality for r in rows]
    assert len(right) > 80 and sum(right) / len(right) > 0.97

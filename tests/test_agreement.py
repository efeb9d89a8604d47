"""Ranks, Spearman's correlation and kappa against pandas and by hand."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from opinara.operators import agreement as A


def test_ranks_and_spearman_with_heavy_ties(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": np.where(rng.random(4000) < 0.4, 7, rng.integers(-500, 500, 4000)), "y": rng.integers(0, 4, 4000)}, dtype="float64")
    pdf.loc[:20, "x"] = None
    df = spark.createDataFrame([(None if np.isnan(x) else x, y) for x, y in pdf.itertuples(index=False)], "x double, y double")
    got = A.average_ranks(df, "x", "r").toPandas()
    assert len(got) == 4000 and got["r"].isna().sum() == 21
    assert np.allclose(got["r"], got["x"].rank(method="average"), equal_nan=True)
    row, full = A.spearman(df, "x", "y").first(), pdf.dropna()
    assert row.n == len(full) and abs(row.spearman - full["x"].rank().corr(full["y"].rank())) < 1e-9


def test_nothing_to_rank(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert tuple(A.spearman(empty, "x", "y").first()) == (0, None)
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double")
    assert tuple(A.spearman(same, "x", "y").first()) == (2, None)


def test_kappa(spark):
    rows = [("p", "p")] * 20 + [("p", "n")] * 5 + [("n", "p")] * 10 + [("n", "n")] * 15 + [(None, "p")]
    r = A.kappa(spark.createDataFrame(rows, "a string, b string"), F.col("a"), F.col("b")).first()
    assert (r.n, round(r.observed, 9), round(r.expected, 9), round(r.kappa, 9)) == (50, 0.7, 0.5, 0.4)
    one = A.kappa(spark.createDataFrame([("p", "p")], "a string, b string"), F.col("a"), F.col("b")).first()
    assert one.kappa is None
    assert A.kappa(spark.createDataFrame([], "a string, b string"), F.col("a"), F.col("b")).first().n == 0

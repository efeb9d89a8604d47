"""The stream of stages against the batch operator: any batching, late windows, restarts."""

import random


from opinara.operators import trends
from opinara.storage import fresh_path
from opinara.streaming import lifecycle


def series(seed=1, issues=12):
    r = random.Random(seed)
    out = []
    for k in range(issues):
        nos = sorted(r.sample(range(1, 30), r.randrange(1, 14)))
        out += [("P", f"F{k}", no, r.choice([0.0, 5.0, 9.9, 12.0, 12.0, 25.0, 60.0])) for no in nos]
    return out


def rows_of(df):
    return sorted(map(tuple, df.select("product_name", "feature", "window_no", "from_stage", "stage").collect()))


def test_stages_of_prefixes(spark):
    df = spark.createDataFrame(series(), lifecycle.WINDOWS)
    want = {(r.feature, r.window_no): r.stage for r in trends.lifecycle(df, base=5.0).collect()}
    for f in {x[1] for x in series()}:
        mine = [x for x in series() if x[1] == f]
        assert lifecycle.stages([x[3] for x in mine], 5.0) == [want[f, x[2]] for x in mine]


def test_any_batching_with_late_windows_and_restarts(spark):
    rows = series()
    random.Random(2).shuffle(rows)
    want = rows_of(trends.transitions(trends.lifecycle(spark.createDataFrame(rows, lifecycle.WINDOWS), base=5.0)))
    assert want
    for parts in (1, 3):
        source, out = fresh_path(spark, "windows"), fresh_path(spark, "stages")
        for k in range(parts):  # each round is a restart from the checkpoint
            spark.createDataFrame(rows[k::parts] + [(None, "F0", 1, 1.0)], lifecycle.WINDOWS).coalesce(1).write.mode("append").parquet(source)
            lifecycle.follow(spark, source, out, base=5.0, files_per_batch=1)
        assert rows_of(lifecycle.transitions(spark, out)) == want
    before = rows_of(lifecycle.current(spark, out))
    lifecycle.follow(spark, source, out, base=5.0)
    assert rows_of(lifecycle.current(spark, out)) == before


def test_a_window_told_again(spark):
    source, out = fresh_path(spark, "windows"), fresh_path(spark, "stages")
    for rate in (50.0, 0.0):
        spark.createDataFrame([("P", "F", 1, 1.0), ("P", "F", 2, rate)], lifecycle.WINDOWS).coalesce(1).write.mode("append").parquet(source)
        lifecycle.follow(spark, source, out, base=5.0)
    assert rows_of(lifecycle.current(spark, out)) == [("P", "F", 1, "detected", "detected"), ("P", "F", 2, "detected", "resolved")]

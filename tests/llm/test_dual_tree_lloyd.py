"""Dual-tree clustering against plain rounds in Python integers."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import dual_tree_lloyd as lloyd


def nearest(x, c):
    return [min(range(len(c)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(v, c[k])), k)) for v in x]


@pytest.mark.parametrize("spread, jitter", [(3, 1), (100, 2), (1 << 24, 1 << 20), (1 << 40, 5)])
def test_assignment(spread, jitter):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread, (30, 5))[rng.integers(0, 30, 600)] + rng.integers(-jitter, jitter + 1, (600, 5))
    x[100:300] = x[7]
    c = x[:12].copy()
    c[9] = c[4]
    tree = lloyd.cover_tree(x)
    assert lloyd.assign(x, tree, c, lloyd.cover_tree(c, 1)).tolist() == nearest(x.tolist(), c.tolist())


def test_cover_tree_invariants():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (400, 3))
    x[50:90] = x[3]
    t = lloyd.cover_tree(x)
    assert sorted(t.order.tolist()) == list(range(400))
    for i in range(len(t.point)):
        mine = t.order[t.begin[i] : t.end[i]]
        far = np.sqrt(((x[mine] - x[t.point[i]]) ** 2).sum(1))
        assert t.point[i] in mine and np.isclose(far.max(), t.radius[i])
        below = range(t.first[i], t.first[i] + t.count[i])
        if len(below):
            half = 0.5 * 2.0 ** np.ceil(np.log2(t.radius[i]))
            assert t.point[below[0]] == t.point[i] and [t.begin[below[0]], *(t.end[b] for b in below)] == [*(t.begin[b] for b in below), t.end[i]]
            points = x[[t.point[b] for b in below]]
            apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)) + np.eye(len(points)) * 1e9
            assert apart.min() > half and all(t.radius[b] <= half for b in below)


def brute(rows, k, rounds, dim, scale):
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]) if r[0] is not None else "", r[1]))[:k]]
    for step in range(rounds + 1):
        mine = nearest([v for _, v in kept], c)
        if step < rounds:
            groups = [[v for (_, v), m in zip(kept, mine) if m == j] for j in range(len(c))]
            c = [[sum(col) // len(g) for col in zip(*g)] if g else old for g, old in zip(groups, c)]
    d = [sum((a - b) ** 2 for a, b in zip(v, c[m])) for (_, v), m in zip(kept, mine)]
    return [(i, m, x, sum(y for y, n in zip(d, mine) if n == m), sum(d), hashlib.sha256(",".join(map(str, c[m])).encode()).hexdigest()) for (i, _), m, x in zip(kept, mine, d)]


def test_rounds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(300, 4)))]
    rows += [(900 + i, [0.5, -0.25, 1.0, 2.0]) for i in range(80)] + [(5, rows[5][1])] * 3 + [(7, [9.0, 9.0, 9.0, 9.0]), (None, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    odd = [(1000, None), (1001, []), (1002, [1.0]), (1003, [1.0, None, 2.0, 3.0]), (1004, [float("nan")] * 4), (1005, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "ids", "cluster", "distance", "h")}).repartition(3)
    got = lloyd.clustered(df, k=6, rounds=3, dimensions=4, block=64)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows + odd, 6, 3, 4, 64), key=key)
    assert lloyd.clustered(df.limit(0), dimensions=4).count() == 0 and lloyd.clustered(df.filter("vec_id > 999"), dimensions=4).count() == 0
    few = lloyd.clustered(df.filter("vec_id < 3"), k=6, dimensions=4).collect()
    assert len(few) == 3 and {r.inertia for r in few} == {0}


def test_beyond_64_bits(spark):
    big = float(1 << 50)
    rows = [(i, [big * s, 0.0]) for i, s in enumerate((1, 1, -1, -1))]
    got = lloyd.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1, dimensions=2).collect()
    assert len(got) == 4 and {(r.cluster, r.distance, r.inertia) for r in got} == {(0, None, None)}

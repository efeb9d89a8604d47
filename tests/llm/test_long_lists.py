"""Long lists of sets that stay apart, and groups that are stars from the start."""

import random

import pytest
from pyspark.sql import functions as F

from opinara.llm import minhash_dedup as M
from opinara.operators import graph


def components(rows, n=4):
    sets = {}
    for key, text in rows:
        ws = text.split()
        sets.setdefault(key, []).append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)})
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and label[a] != label[b] and any(10 * len(x & y) >= 8 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("repeated", [False, True])
def test_long_lists_meet_round_their_centre(spark, repeated, monkeypatch):
    """A passage that many texts share: what meets all with all are lists of up to STRAYS sets; nothing is lost."""
    monkeypatch.setattr(M, "STRAYS", 8)
    r = random.Random(3)
    passage = [f"p{i}" for i in range(70)]
    families = [[f"f{f}_{i}" for i in range(40)] for f in range(12)]
    rows = []
    for i in range(150):
        tail = list(r.choice(families))
        for _ in range(r.randrange(0, 4)):
            tail[r.randrange(40)] = f"x{r.randrange(10**6)}"
        rows.append((i % 130 if repeated else i, " ".join(passage[: 70 - r.randrange(0, 4)] + tail)))
    seen = []
    made = M.rivals

    def counted(lists, state, *rest):
        seen.append(M.mixed_lists(lists, state).agg(F.max("n")).first()[0] or 0)
        return made(lists, state, *rest)

    monkeypatch.setattr(M, "rivals", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in M.near_duplicates(docs, shingle=4).collect()}
    want = components(rows)
    assert got == want and 1 < len(set(want.values())) < len(want)
    assert len(seen) == 1 and seen[0] <= 8


def test_stars_need_no_round(spark, monkeypatch):
    made = []
    real = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: made.append(1) or real(df))
    star = spark.createDataFrame([(1, 5), (7, 1), (2, 8), (9, 9), (None, 3)], "a long, b long")
    got = {x.node: x.component for x in graph.connected_components(star).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 2: 2, 8: 2} and len(made) == 1
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (52, 51)], "a long, b long")
    got = {x.node: x.component for x in graph.connected_components(path).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 51: 50, 52: 50}

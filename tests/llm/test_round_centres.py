"""Sets round one centre: links by their differences from it, against all pairs."""

import random

import pytest

from opinara.llm import minhash_dedup as M
from opinara.operators.graph import connected_components


def round_one_centre(spark, sets, size):
    """``known`` of the sets round range(size); those linked with it are one component, named -1."""
    c = set(range(size))
    home = {i for i, s in enumerate(sets) if 10 * len(s & c) >= 8 * len(s | c)}
    rows = [(i, -1 if i in home else i, 10**6, -1, size, sorted(c - s), sorted(s - c)) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "node long, component long, centre long, home long, size int, less array<long>, more array<long>")


def brute(sets, known):
    label = {r.node: r.component for r in known.collect()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b) and label[i] != label[j]:
                old = label[i]
                label = {k: label[j] if x == old else x for k, x in label.items()}
    groups = {}
    for k, x in label.items():
        groups.setdefault(x, set()).add(k)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 8)])
def test_links_round_centres(spark, seed, block, monkeypatch):
    monkeypatch.setattr(M, "MEMBERS", block)
    r = random.Random(seed)
    families = [set(r.sample(range(60), 60 - k)) | set(range(100 + 20 * k, 100 + 20 * k + k)) for k in (0, 4, 6, 8, 9)]
    sets = []
    for _ in range(110):
        s = set(r.choice(families))
        s -= set(r.sample(sorted(s), r.randrange(0, 6)))
        sets.append(s | {1000 + r.randrange(40) for _ in range(r.randrange(0, 6))})
    sets = [set(x) for x in dict.fromkeys(map(frozenset, sets))]
    known = round_one_centre(spark, sets, 60)
    links = M.links_round_centres(known, 0.8)
    top = {x.node: x.component for x in connected_components(links).collect()}
    groups = {}
    for x in known.collect():
        groups.setdefault(top.get(x.component, x.component), set()).add(x.node)
    assert sorted(map(sorted, groups.values())) == brute(sets, known) and links.count() > 0


def test_strays_apart_make_no_pairs(spark):
    """200 sets that share their distance from the centre and no more: rows by the members, not by their square."""
    sets = [set(range(12, 100)) | set(range(100, 112)) | {1000 + 14 * i + k for k in range(14)} for i in range(200)]
    known = round_one_centre(spark, sets, 100)
    assert known.filter("component = home").count() == 0
    posts = M.stored(M.open_lists(M.differences_posted(known, 0.8)), "posts")
    assert M.star_pairs(posts).count() + M.met_in_lists(posts).count() == 0


def test_strays_alike_make_a_star(spark):
    """200 sets that differ by one member each: each meets the same one."""
    known = round_one_centre(spark, [set(range(12, 100)) | set(range(100, 112)) | {1000 + i} for i in range(200)], 100)
    posts = M.stored(M.open_lists(M.differences_posted(known, 0.8)), "posts")
    assert M.linked_by_differences(M.star_pairs(posts), known, 0.8).count() == 199

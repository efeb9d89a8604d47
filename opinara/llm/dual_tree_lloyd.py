"""Lloyd's rounds by two trees: cover trees over blocks of vectors, and one over the centroids, compared node by node."""

from __future__ import annotations

import hashlib
import io
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.llm._common import map_arrow, table
from opinara.storage import stored

#: Vectors of one cover tree; each task holds one at a time.
BLOCK = 2048
#: Vectors under which a node is a leaf.
LEAF = 8
#: Pairs of vectors and centroids, or of nodes, that are compared at a time.
SLICE = 1 << 12
#: Scaled components up to here are added up in 64 bits, greater ones as Python integers.
NARROW = 1 << 26
#: Up to here a block's squared distances come exactly from one product of matrices.
SMALL = 1 << 20
#: Squared distances are doubles while trees are walked: a bound must be passed by this share before a pair is dropped.
SLACK = 1e-9


@dataclass(frozen=True)
class CoverTree:
    """Nodes in breadth-first order. Node i holds the points order[begin[i]:end[i]], all within
    radius[i] of its own point; its children are first[i] up to first[i] + count[i] (none: a leaf)."""

    order: np.ndarray
    point: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    count: np.ndarray


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """A simplified cover tree of the rows of ``x``: a child covers what is within half its parent's
    reach, is one of the parent's points (its own point first), and siblings are further apart than that.

    Equal points stay together in one leaf, however many. Siblings are chosen one after another, each
    taking what it covers of the points that are left.
    """
    v = x.astype(np.float64)
    if np.abs(v).max() <= SMALL:
        norms, products = (v * v).sum(1), v @ v.T
        away = lambda q, rest: np.sqrt(norms[rest] + norms[q] - 2 * products[q, rest])
    else:
        away = lambda q, rest: np.sqrt(((v[rest] - v[q]) ** 2).sum(1))
    gone = away(0, np.arange(len(v)))
    queue: list = [(0, np.arange(len(v)), gone)]
    order, done = np.arange(len(v)), 0
    point, radius, begin, end, first, count, start = [], [], [], [], [], [], [0]
    while done < len(queue):
        p, members, reach = queue[done]
        queue[done] = None
        at = start[done]
        done += 1
        point.append(p)
        radius.append(float(reach.max()))
        begin.append(at)
        end.append(at + len(members))
        order[at : at + len(members)] = members
        first.append(len(queue))
        if len(members) <= leaf or radius[-1] == 0:
            count.append(0)
            continue
        half, n = 0.5 * 2.0 ** np.ceil(np.log2(radius[-1])), 0
        rest, far, q = members, reach, p
        while len(rest):
            near = far <= half
            near[rest == q] = True
            queue.append((q, rest[near], far[near]))
            start.append(at)
            at += int(near.sum())
            n += 1
            rest = rest[~near]
            if len(rest):
                q = rest[0]
                far = away(q, rest)
        count.append(n)
    return CoverTree(order, *(np.array(c) for c in (point, radius, begin, end, first, count)))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two tables of equal shape, as exact as their type."""
    d = a - b
    return (d * d).sum(1)


def exact(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if every squared distance fits, else as Python integers."""
    wide = max(int(np.abs(c).max()), int(np.abs(x).max())) > NARROW
    return (x.astype(object), c.astype(object)) if wide else (x.astype(np.int64), c.astype(np.int64))


def children(tree: CoverTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``nodes``, child) of all children; a leaf is its own only child."""
    n = np.maximum(tree.count[nodes], 1)
    owner = np.repeat(np.arange(len(nodes)), n)
    base = np.where(tree.count[nodes] > 0, tree.first[nodes], nodes)
    return owner, base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def assign(x: np.ndarray, tree: CoverTree, c: np.ndarray, centroids: CoverTree) -> np.ndarray:
    """Number of the nearest centroid of every row of ``x``, ties to the smaller number.

    Pairs of nodes go down both trees at once, level by level. With d between the nodes' points,
    every distance between them is within d - both radii and d + both radii; a pair whose
    lower bound is beyond the smallest upper bound of its vectors' node is dropped. Vectors whose
    node has one centroid left take it as a whole; leaves meet leaves by exact integers.
    """
    out = np.zeros(len(x), np.int32)
    vx, vc = x.astype(np.float64), c.astype(np.float64)
    ex, ec = exact(x, c)
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    held = centroids.end - centroids.begin
    while len(a):
        d = np.concatenate([np.sqrt(squared(vx[tree.point[a[i : i + SLICE]]], vc[centroids.point[b[i : i + SLICE]]])) for i in range(0, len(a), SLICE)])
        spread = tree.radius[a] + centroids.radius[b]
        best = np.full(len(tree.point), np.inf)
        np.minimum.at(best, a, d + spread)
        keep = d - spread <= best[a] + SLACK * (best[a] + d + spread + 1)
        a, b = a[keep], b[keep]
        choices = np.bincount(a, held[b], minlength=len(tree.point))
        whole = choices[a] == 1
        for node, k in zip(a[whole], b[whole]):
            out[tree.order[tree.begin[node] : tree.end[node]]] = centroids.order[centroids.begin[k]]
        a, b = a[~whole], b[~whole]
        # a node of vectors is settled when it and all its partners are leaves
        open_pair = (tree.count[a] > 0) | (centroids.count[b] > 0)
        still = np.bincount(a, open_pair, minlength=len(tree.point)) > 0
        final = ~still[a]
        compare(out, ex, ec, tree, centroids, a[final], b[final])
        a, b = a[~final], b[~final]
        # the wider side goes down; a leaf waits for the other side
        down_a = (tree.count[a] > 0) & ((tree.radius[a] >= centroids.radius[b]) | (centroids.count[b] == 0))
        # all pairs of one node of vectors go down together, so that its bounds stay together
        down_a = (np.bincount(a, down_a, minlength=len(tree.point)) > 0)[a]
        i, below = children(tree, a[down_a])
        j, under = children(centroids, b[~down_a])
        a, b = np.concatenate([below, a[~down_a][j]]), np.concatenate([b[down_a][i], under])
    return out


def compare(out: np.ndarray, x: np.ndarray, c: np.ndarray, tree: CoverTree, centroids: CoverTree, a: np.ndarray, b: np.ndarray) -> None:
    """Writes the nearest centroids of the vectors of leaves ``a`` among those of the leaves ``b`` that they meet."""
    if not len(a):
        return
    sizes, widths = tree.end[a] - tree.begin[a], centroids.end[b] - centroids.begin[b]
    rows, number, dist = [], [], []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(sizes * widths) // SLICE])))
    for lo, hi in zip([0, *edges], [*edges, len(a)]):
        n = (sizes * widths)[lo:hi]
        pair = np.repeat(np.arange(lo, hi), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        row = tree.order[tree.begin[a[pair]] + k // widths[pair]]
        cent = centroids.order[centroids.begin[b[pair]] + k % widths[pair]]
        rows.append(row)
        number.append(cent)
        dist.append(np.concatenate([squared(x[row[i : i + SLICE]], c[cent[i : i + SLICE]]) for i in range(0, len(row), SLICE)]) if len(row) else np.zeros(0, x.dtype))
    row, cent, d = np.concatenate(rows), np.concatenate(number), np.concatenate(dist)
    order = np.lexsort((cent, row))
    row, cent, d = row[order], cent[order], d[order]
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    least = np.minimum.reduceat(d, start)
    hit = np.flatnonzero(d == np.repeat(least, np.diff(np.append(start, len(d)))))
    first = np.unique(row[hit], return_index=True)[1]
    out[row[hit][first]] = cent[hit][first]


def packed(x: np.ndarray, tree: CoverTree) -> bytes:
    file = io.BytesIO()
    np.savez(file, x=x, **tree.__dict__)
    return file.getvalue()


def unpacked(raw: bytes) -> tuple[np.ndarray, CoverTree]:
    parts = dict(np.load(io.BytesIO(raw)))
    return parts.pop("x"), CoverTree(**parts)


def blocks(kept: DataFrame, block: int) -> DataFrame:
    """(ids array<long>, tree binary): the vectors of each task in blocks, with their cover trees. Narrow."""

    def run(batches):
        ids, rows = [], []
        for b in batches:
            v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1), np.int64)
            ids += b.column(0).to_pylist()
            rows.append(v)
            while len(ids) >= block:
                v = np.concatenate(rows)
                yield {"ids": [ids[:block]], "tree": [packed(v[:block], cover_tree(v[:block]))]}
                ids, rows = ids[block:], [v[block:]]
        if ids:
            v = np.concatenate(rows)
            yield {"ids": [ids], "tree": [packed(v, cover_tree(v))]}

    return map_arrow(kept, run, "ids array<long>, tree binary")


def sums(trees: DataFrame, c: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """centroid: (vectors, sums of their components). Each task adds up its blocks; k x (d + 1) numbers reach the driver."""
    broad = trees.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        c = broad.value
        centroids, total, count = cover_tree(c, 1), np.zeros(c.shape, object), np.zeros(len(c), np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                x, tree = unpacked(raw)
                mine = assign(x, tree, c, centroids)
                count += np.bincount(mine, minlength=len(c))
                wide = int(np.abs(x).max()) > NARROW
                order = np.argsort(mine, kind="stable")
                start = np.flatnonzero(np.diff(mine[order], prepend=-1))
                part = np.add.reduceat(x[order].astype(object) if wide else x[order], start, axis=0)
                total[mine[order][start]] += part.astype(object)
        used = np.flatnonzero(count)
        values = np.column_stack([count.astype(object), total])[used]
        yield {
            "cluster": np.repeat(used, values.shape[1]), "j": np.tile(np.arange(values.shape[1]), len(used)),
            "s": [Decimal(int(v)) for v in values.ravel()],
        }

    rows = map_arrow(trees.select("tree"), run, "cluster int, j int, s decimal(38,0)").groupBy("cluster", "j").agg(F.sum("s").alias("s")).collect()
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(r["cluster"], [0] * (c.shape[1] + 1))[r["j"]] = int(r["s"])
    return {k: (v[0], v[1:]) for k, v in out.items()}


def assigned(trees: DataFrame, c: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance); a squared distance beyond 64 bits is null."""
    broad = trees.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        c = broad.value
        centroids = cover_tree(c, 1)
        for b in batches:
            for ids, raw in zip(b.column(0), b.column(1).to_pylist()):
                x, tree = unpacked(raw)
                mine = assign(x, tree, c, centroids)
                ex, ec = exact(x, c)
                d = squared(ex, ec[mine])
                yield {"vec_id": ids.values, "cluster": mine, "distance": d if d.dtype != object else [int(v) if v < 1 << 63 else None for v in d]}

    return map_arrow(trees, run, "vec_id long, cluster int, distance long")


def usable(rows: DataFrame, dimensions: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * component) of vectors with ``dimensions`` finite components that fit 62 bits."""
    v = F.col(vector_col).cast("array<double>")
    scaled = F.transform("v", lambda x: x * float(scale))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.size("v") == dimensions)
    fine = F.forall(scaled, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float(1 << 62)), F.lit(False)))
    return rows.filter(fine).select("vec_id", F.transform(scaled, lambda x: F.floor(x)).alias("v"))


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): k-means in exact integers.

    Components become floor(scale * x). The k vectors with the smallest sha256 of
    ``seed:vec_id`` start as centroids, in that order; each round assigns all vectors to
    the nearest centroid (ties: the smaller number) and moves every centroid that has some
    to the floor of their mean.

    Vectors are dealt into blocks where they lie, without a shuffle, and each block's cover
    tree is stored once; a round reads the trees, walks them against a tree over the
    centroids and adds up sums within its task. Only the k centroids are ever broadcast.

    Vectors null, of another length, or with null or non-finite components take no part, nor
    do those with a scaled component of 2**62 or more; a distance or inertia beyond 64 bits
    is null. Repeated rows are vectors of their own; those without a vec_id too, but they
    start no centroid unless too few others are there. Of equal ids the smaller vector starts
    first. With fewer than k vectors there are as many centroids; an empty table gives no
    rows. Other columns, whatever their names, play no part.
    """
    spark = vectors.sparkSession
    kept = usable(vectors, dimensions, scale, id_col, vector_col)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    c = np.array([r["v"] for r in first], np.int64)
    trees = stored(blocks(kept, block), "trees")
    for _ in range(rounds):
        c = c.copy()
        for i, (n, total) in sums(trees, c).items():
            c[i] = [t // n for t in total]
    told = stored(assigned(trees, c), "assigned")
    per = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.bool_or(F.col("distance").isNull()).alias("over")).collect()
    fits = lambda v, over: v if not over and v < 1 << 63 else None
    total = fits(sum(int(r["s"] or 0) for r in per), any(r["over"] for r in per))
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    facts = spark.createDataFrame([(r["cluster"], fits(int(r["s"] or 0), r["over"]), total, digests[r["cluster"]]) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64) -> str:
    nearest = "a{0} AS MATERIALIZED (SELECT id, vec_id, v, c.n AS cluster, list_sum(list_transform(list_zip(v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{0} c QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c.n) = 1)"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS n, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(nearest.format(r))
        if r < rounds:
            parts.append(f"m{r} AS (SELECT cluster, list(m ORDER BY j) AS m FROM (SELECT cluster, j, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range({dimensions})) AS j FROM a{r}) GROUP BY cluster, j) GROUP BY cluster)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT n, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.cluster = n)")
    return f"WITH {', '.join(parts)} SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON n = cluster"


OP11_SQL = _sql()

"""Approximate nearest neighbours by a permutation index: pivots, inverted files, footrule distance, exact reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.llm._common import table

#: Pivots (the bounded sample that the index is fitted on), and the length of a vector's ordered list of nearest pivots.
PIVOTS, LIST = 128, 32
#: Rows of an index block and of a query block; a task holds one of each.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Share of a block, best by footrule distance, whose exact cosine is computed. Data without any structure
#: (unit vectors at random in 64 dimensions) needs so much for a recall of 0.9; clustered data far less.
RERANK_SHARE = 0.4


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part: not null, not zero, all components finite."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return rows.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).filter(~bad & some)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def permutations(v: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` nearest pivots of each row, nearest first, ties to the smaller pivot."""
    return np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :length]


def inverted_files(perms: np.ndarray, n_pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot, the rows that list it and its rank there."""
    rows, ranks = np.divmod(np.arange(perms.size), perms.shape[1])
    order = np.argsort(perms.ravel(), kind="stable")
    edges = np.searchsorted(perms.ravel()[order], np.arange(n_pivots + 1))
    return [(rows[order[a:b]], ranks[order[a:b]].astype(np.int32)) for a, b in zip(edges[:-1], edges[1:])]


def footrule(query: np.ndarray, files: list, n: int, length: int) -> np.ndarray:
    """Spearman's footrule between one list and each row's, a pivot that is not listed counting as rank ``length``.

    A row that shares no pivot has the largest distance; each shared posting lowers it.
    """
    far = length * (length + 1)
    out = np.full(n, far, np.int32)
    for rank, pivot in enumerate(query):
        rows, ranks = files[pivot]
        out[rows] += np.abs(ranks - rank) - (length - rank) - (length - ranks)
    return out


def search_block(q_ids, q_vecs, ids, vecs, pivots, k: int, length: int, share: float) -> pd.DataFrame:
    """Each query's k nearest of one block: postings, footrule, and the exact cosine of the best share (and of all ties with its last)."""
    length = min(length, len(pivots))
    qv, bv = unit(q_vecs), unit(vecs)
    files = inverted_files(permutations(bv, pivots, length), len(pivots))
    take = min(len(ids), max(4 * (k + 1), int(np.ceil(share * len(ids)))))
    found = []
    for i, perm in enumerate(permutations(qv, pivots, length)):
        distance = footrule(perm, files, len(ids), length)
        near = np.flatnonzero(distance <= np.partition(distance, take - 1)[take - 1])
        near = near[ids[near] != q_ids[i]]
        score = bv[near] @ qv[i]
        if len(near) > k:  # keep ties with the k-th; a rounding apart is a tie here and is decided exactly below
            near, score = (x[score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-12] for x in (near, score))
        exact = np.array([cosine(q_vecs[i], vecs[j]) for j in near])
        order = np.lexsort((ids[near], -exact))[:k]
        found.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[near][order], "score": exact[order]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))


def nearest(rows: DataFrame, is_query, k: int = 5, pivots: int = PIVOTS, length: int = LIST, share: float = RERANK_SHARE, block: int = BLOCK, query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, its ``k`` nearest other rows by cosine.

    Every row is indexed. The pivots are the distinct vectors with the smallest hashes of
    their components, a bounded sample. Equal vectors are indexed once, with their k + 1
    smallest ids: they have equal scores, so no other copy can be among the k nearest. The
    index is dealt into blocks by the hash of the vector and the queries into blocks of
    their own; every pair of blocks meets in one task, whose memory the two block sizes
    bound, and gives at most k rows per query, merged by a top-k. No group of vectors is
    ever together. Vectors null, zero, or with null or non-finite components take no part,
    nor do those of another dimension than the commonest (ties: the larger). Rows that
    repeat an id with the same vector count once. An empty table gives no rows.
    """
    spark = rows.sparkSession
    all_rows = usable(rows, id_col, vector_col)
    sizes = all_rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = "query_id long, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]["d"], sizes[0]["n"]
    ours = all_rows.filter(F.size("v") == dim).withColumn("h", F.xxhash64("v"))
    picked = ours.select("h", "v").distinct().orderBy("h", "v").limit(pivots).collect()
    p = unit(np.array([r["v"] for r in picked]))
    n_blocks = max(1, -(-n // block))
    queries = ours.filter(is_query).select(F.col("vec_id").alias("id"), "v").distinct()
    n_query_blocks = max(1, -(-queries.count() // query_block))

    # equal vectors: pre-aggregated to their k + 1 smallest ids in two steps, so that a hot vector's rows never meet in one task
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    some = ours.groupBy("v", "h", salt.alias("s")).agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    classes = some.groupBy("v", "h").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    index = classes.select(F.pmod("h", F.lit(n_blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("qb"), "ids", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("b"), F.pmod(F.xxhash64("id"), F.lit(n_query_blocks)).cast("int").alias("qb"), "id", "v")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        vecs, counts = np.stack(left["v"].to_numpy()), left["ids"].map(len).to_numpy()
        ids = np.concatenate(left["ids"].to_numpy())
        q = np.stack(right["v"].to_numpy())
        return search_block(right["id"].to_numpy(), q, ids, np.repeat(vecs, counts, axis=0), p, k, length, share)

    part = index.groupBy("b", "qb").cogroup(asked.groupBy("b", "qb")).applyInPandas(run, schema)
    best = part.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("r", "x")).select("query_id", (F.col("r") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op6_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)

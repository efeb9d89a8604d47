"""Phrase collocations: count tries per shard, merged by ranges of paths; trie walks and suffix links give the parts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opinara.llm._common import map_arrow, table
from opinara.llm._words import mix, words_of
from opinara.operators.skew import lookup_by_key
from opinara.storage import stored

#: Bytes of text that one trie counts; a longer text is cut where a piece ends.
SHARD_BYTES = 7 << 20
#: log2 of the bits of the filter of frequent nodes: 16 MB, whatever the input's size. It lets rare paths
#: through now and then, which costs a row; the merged counts decide.
FILTER_BITS = 27
#: Parts of a language that are ranked apart before their best ones meet.
RANK_PARTS = 256

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _SEPARATOR.copy()
_GAP[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
LAYOUT = pa.schema([("path", pa.string()), ("n", pa.int64())])


def child(parents: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of the trie node under each parent by each word; hashes only choose which paths are looked at."""
    return mix(parents * _STEP + words)


def root_hashes(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def path_hashes(paths: list[str]) -> np.ndarray:
    """The hash of each path's node, by a walk from its language; a language's own node is the start of the walk."""
    langs, ws = zip(*(x.rsplit("\t", 1) for x in paths))
    ws = [x.split(" ") if x else [] for x in ws]
    h, depth = root_hashes(langs), np.array([len(x) for x in ws])
    for k in range(depth.max()):
        on = np.flatnonzero(depth > k)
        h[on] = child(h[on], words_of([ws[i][k] for i in on])[0])
    return h


def slices(raw: bytes) -> list[bytes]:
    """A text in stretches of about SHARD_BYTES, cut behind separators only; a longer piece stays whole."""
    out, start = [], 0
    while len(raw) - start > SHARD_BYTES:
        window = np.frombuffer(raw, np.uint8, offset=start)
        ends = np.flatnonzero(_SEPARATOR[window[:SHARD_BYTES]])
        if not len(ends):
            ends = SHARD_BYTES + np.flatnonzero(_SEPARATOR[window[SHARD_BYTES:]])[:1]
        if not len(ends):
            break
        out.append(raw[start : start + int(ends[-1]) + 1])
        start += int(ends[-1]) + 1
    return [*out, raw[start:]]


def inside(bitmap: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.ones(len(h), bool)
    x = h & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each different key, in order; the number of every key; how often each stands there)."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    return order[start], number, np.diff(np.append(start, len(keys)))


def trie(texts: list[bytes], langs: list[str], depths: range, bitmaps: list[np.ndarray]) -> dict[str, pa.Array]:
    """The nodes of the given depths of one shard's trie, each depth sorted by its words.

    Under the root stand the languages, under these the words. A node is told by its parent's
    number and its word's, so counts are exact. ``bitmaps[k]`` holds the frequent nodes of
    depth k + 1: a path is followed only if all its stretches of these depths are there.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    solid = ~_GAP[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return {f.name: pa.array([], f.type) for f in LAYOUT}
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    chars = _LOWER[buf[solid]]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(chars)]).dictionary_encode()
    # words are numbered in their order, so nodes are too
    order = pc.sort_indices(coded.dictionary)
    spelled = coded.dictionary.take(order).cast(pa.large_string())
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    word = rank[coded.indices.to_numpy()]
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    piece = np.cumsum(_SEPARATOR[buf], dtype=np.int32)[starts]
    names = sorted(set(langs))
    lang = np.array([names.index(x) for x in langs])[doc]
    hw = words_of(spelled.to_pylist())[0][word]
    del buf, solid, chars, coded, edge, starts, ends, doc, order, rank

    node, h, at = lang.astype(np.int64), root_hashes(names)[lang], np.arange(len(word))
    # at: first word's position of the paths that are followed; first[d]: hash of the path of d words that starts at a position
    hit: list[np.ndarray] = []
    found = []
    if 1 in depths:  # a language's own node, with the number of its words
        found.append(pa.table({"path": pc.binary_join_element_wise(pa.array(names, pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\t", pa.large_string())), "n": np.bincount(lang, minlength=len(names))}))
    for depth in range(1, depths.stop):
        if depth > 1:
            # the path goes on within its piece, and its last stretches are frequent too
            on = (at + depth - 1 < len(word)) & (piece[at] == piece[np.minimum(at + depth - 1, len(word) - 1)])
            for k, ok in enumerate(hit, 1):
                on &= ok[np.minimum(at + depth - k, len(word) - 1)]
            at, node, h = at[on], node[on], h[on]
        h = child(h, hw[at + depth - 1])
        if depth <= len(bitmaps):
            on = inside(bitmaps[depth - 1], h)
            at, node, h = at[on], node[on], h[on]
            hit.append(np.zeros(len(word), bool))
            hit[-1][at] = True
        index, node, count = numbered(node << 32 | word[at + depth - 1])
        if depth in depths:
            spelled_out = pa.array(names, pa.large_string()).take(pa.array(lang[at[index]]))
            path = pc.binary_join_element_wise(spelled_out, spelled.take(pa.array(word[at[index]])), pa.scalar("\t", pa.large_string()))
            for k in range(1, depth):
                path = pc.binary_join_element_wise(path, spelled.take(pa.array(word[at[index] + k])), pa.scalar(" ", pa.large_string()))
            found.append(pa.table({"path": path, "n": count}))
    nodes = pa.concat_tables(found)
    return {f.name: nodes[f.name].combine_chunks().cast(f.type) for f in LAYOUT}


def shard_tries(docs: DataFrame, depths: range, bitmaps: list) -> DataFrame:
    """(path, n): the tries of all shards of ``docs`` (lang, text), each a sorted run a depth. Narrow."""

    def run(batches):
        maps = [np.frombuffer(b.value, np.uint8) for b in bitmaps]
        texts, langs, size = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in slices((text or "").encode()):
                    texts.append(part)
                    langs.append(lang)
                    size += len(part)
                    if size >= SHARD_BYTES:
                        yield from rows(texts, langs, maps)
                        texts, langs, size = [], [], 0
        if texts:
            yield from rows(texts, langs, maps)

    def rows(texts, langs, maps):
        t = trie(texts, langs, depths, maps)
        n = len(t["n"])
        for k in range(0, n, 1 << 16):
            yield {c: v[k : k + (1 << 16)] for c, v in t.items()}

    return map_arrow(docs, run, "path string, n long")


def merged(tries: DataFrame, least: int) -> DataFrame:
    """(lang, path, h, n) with the counts of all shards, of languages and of paths that occur at least ``least`` times.

    Each task has one range of paths, sorted: a merge of the shards' sorted runs, read as a
    stream in which equal neighbours add up. Ranges are cut by whole paths, so a frequent
    first word is many tasks, and a path has at most one row a shard.
    """

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            path, n = t["path"].combine_chunks(), t["n"].to_numpy()
            start = np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False))])
            t = t.take(pa.array(start)).drop_columns("n").append_column("n", pa.array(np.add.reduceat(n, start)))
            held = t.slice(t.num_rows - 1)
            yield from rows(t.slice(0, t.num_rows - 1))
        if held is not None:
            yield from rows(held)

    def rows(t):
        root = pc.ends_with(t["path"], "\t")
        t = t.filter(pc.or_(pc.greater_equal(t["n"], least), root))
        if t.num_rows:
            paths = t["path"].to_pylist()
            yield {"lang": [x.rsplit("\t", 1)[0] for x in paths], "path": paths, "h": path_hashes(paths).view(np.int64), "n": t["n"].combine_chunks()}

    return map_arrow(tries.repartitionByRange("path").sortWithinPartitions("path"), run, "lang string, path string, h long, n long")


def filter_of(nodes: DataFrame, bits: int) -> bytes:
    """A bit map with the bit of each node's hash set: 2**bits bits, whatever the number of nodes."""
    x = F.pmod(F.col("h"), F.lit(1 << bits)) + 1
    rows = nodes.groupBy(F.bitmap_bucket_number(x).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("m")).collect()
    out, size = bytearray(1 << bits >> 3), 4096
    for r in rows:
        part = bytes(r["m"])[: len(out)]
        out[(r["b"] - 1) * size : (r["b"] - 1) * size + len(part)] = part
    return bytes(out)


def words(path: str):
    return F.split(F.element_at(F.split(path, "\t"), -1), " ")


def phrase(ws) -> str:
    return F.array_join(ws, " ")


def parts_of(long: DataFrame) -> DataFrame:
    """(lang, phrase, a, k, side, part): both parts of each cut. Every part is a node of the merged tries.

    The walk from the root to a phrase's node passes its first parts; suffix links, each
    dropping the path's first word, pass its rests.
    """
    cut = F.explode(F.sequence(F.lit(1), F.size("ws") - 1))
    walk = F.struct(F.lit("l").alias("side"), phrase(F.slice("ws", F.lit(1), F.col("k"))).alias("part"))
    link = F.struct(F.lit("r").alias("side"), phrase(F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k"))).alias("part"))
    return long.select("lang", "phrase", "a", "ws", cut.alias("k")).select("lang", "phrase", "a", "k", F.explode(F.array(walk, link)).alias("x")).select("lang", "phrase", "a", "k", "x.*")


def scores(long: DataFrame, nodes: DataFrame, scale: int) -> DataFrame:
    """(lang, phrase, a, score, k, l, r): the lowest cut. A part that many phrases share is a hot key of the look-up."""
    parts = stored(parts_of(long), "parts")
    uses = parts.groupBy("lang", "part").agg(F.count("*").alias("uses"))
    counts = stored(uses.join(nodes.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"]), "counts")
    found = lookup_by_key(parts, counts, ["lang", "part"], "uses", "inner")
    side = lambda x: F.array_sort(F.collect_list(F.when(F.col("side") == x, F.struct("k", "n")))).alias(x)
    cuts = found.groupBy("lang", "phrase").agg(F.first("a").alias("a"), side("l"), side("r"))
    score = f"cast(a AS decimal(20,0)) * {2 * scale} div (cast(x.n AS decimal(20,0)) + y.n)"
    best = F.expr(f"array_min(zip_with(l, r, (x, y) -> struct({score} AS score, x.k AS k, x.n AS l, y.n AS r)))")
    return cuts.select("lang", "phrase", "a", best.alias("x")).select("lang", "phrase", "a", "x.*")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, top: int | None = 2000, inside_percent: int = 80, scale: int = 1_000_000, text_col: str = "text", lang_col: str = "lang", bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of 2 to ``longest`` words (None: all).

    A-Z fold to lower case; texts fall at ``.,;:!?`` and line ends into pieces, these at blanks and
    tabs into words. a counts a phrase's occurrences within pieces, overlaps included; a
    phrase needs ``least`` of them. Cutting it in two gives l and r, the counts of both
    parts, and score floor(2 * scale * a / (l + r)); the lowest cut counts, ties to the
    shorter first part. A phrase goes if a longer one, gone or not, holds it and has
    ``inside_percent`` of its count or more. Ties in score: larger a, then the phrase's bytes.

    1. Shards count their words in tries, written sorted and merged by ranges of paths; then
       the same for pairs of frequent words, then for all longer paths of frequent pairs. No
       stretch of a frequent phrase is rare, so nothing is lost; a filter of fixed size says
       what is frequent.
    2. A walk down a phrase's path gives its first parts, its chain of suffix links (the
       path without its first word, again and again) the rests.

    Null and empty texts count nothing; a null language is ``und``, together with rows that
    say so. Repeated rows count each; other columns, whatever their names, play no part. An
    empty table gives no rows. Counts are exact 64-bit integers, products of them decimals.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    bitmaps, levels = [], []
    for depths in [range(k, k + 1) for k in range(1, min(3, longest + 1))] + ([range(3, longest + 1)] if longest > 2 else []):
        levels.append(stored(merged(stored(shard_tries(rows, depths, bitmaps), "tries"), least), "nodes"))
        if depths.stop <= min(3, longest):
            bitmaps.append(spark.sparkContext.broadcast(filter_of(levels[-1], bits)))
    root = F.col("path").endswith("\t")
    total = levels[0].filter(root).select("lang", F.col("n").alias("words"))
    levels[0] = levels[0].filter(~root)
    nodes = levels[0]
    for x in levels[1:]:
        nodes = nodes.union(x)
    nodes = nodes.select("lang", words("path").alias("ws"), "n").withColumn("phrase", phrase(F.col("ws")))
    long = nodes.filter("size(ws) > 1").select("lang", "phrase", "ws", F.col("n").alias("a"))

    scored = scores(long, nodes, scale)
    size, wide = F.size("ws"), F.col("a").cast("decimal(20,0)")
    held = long.select("lang", "ws", wide.alias("longer"), F.explode(F.sequence(F.lit(2), F.greatest(size - 1, F.lit(2)))).alias("m")).filter(F.col("m") < size)
    held = held.select("lang", "ws", "longer", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("i"))
    held = held.select("lang", phrase(F.slice("ws", F.col("i"), F.col("m"))).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < wide * inside_percent))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # the best of each part first, so that a language with very many phrases is many tasks
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w WHERE len(w) > 0 GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS v(m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
k AS (SELECT lang, m, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:m], ' ') AS rp FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c)),
s AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (2000000::HUGEINT * k.a) // (x.f::HUGEINT + y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.lp JOIN f y ON y.lang = k.lang AND y.phrase = k.rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(generate_series(1, m - j + 1)) AS i FROM c, (VALUES (2), (3)) AS v(j) WHERE j < m) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.longer IS NULL OR 100::HUGEINT * h.longer < 80::HUGEINT * b.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT o.lang, rank::INTEGER AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n, score::BIGINT AS score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000
"""

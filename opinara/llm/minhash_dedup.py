"""Near-duplicates by bottom-k sketches of one hash function, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.llm._common import map_arrow, table
from opinara.llm._words import sequences, words_of
from opinara.operators.graph import connected_components
from opinara.operators.skew import lookup_by_key
from opinara.storage import stored

#: Values of a sketch; the share of them that two sets of a similarity of 0.8 or more have in common but once in
#: 76 000 pairs (under 26 of 48), by which lists are shortened; and the least estimate of a candidate, which such a
#: pair misses once in 900 million (under 20 of 48). A pair with fewer common values is still met where one of them
#: is among the rarest of both.
SKETCH, LEAST_SHARED, LEAST_ESTIMATE = 48, 0.55, 0.4
#: Rows without a doc_id are told by keys from here on, made from their texts.
FIRST_KEY = 1 << 62
#: Members that one task confirms against a centre.
CHUNK = 500
#: Lists of more sets than this do not meet themselves: their sets meet by their differences from one of them.
STRAYS = 128
#: Side of a block of a list of differences.
MEMBERS = 1024
#: Different shingles that are counted at a time there: 32 MB a side, however long the texts.
WIDTH = 8192


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text one after another, set size of each).

    A-Z fold to lower case; a text with fewer than n words is one shingle, one without words has none.
    """
    words, counts = words_of(texts, lower=True)
    begin = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(texts)), counts)
    h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= n:
        inside = doc[: len(words) - n + 1] == doc[n - 1 :]
        h, d = sequences(words, n, 3)[inside], doc[: len(words) - n + 1][inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    few = np.array([sequences(words[begin[i] : begin[i + 1]], int(counts[i]), 100 + int(counts[i]))[0] for i in short], np.uint64)
    h, d = np.concatenate([h, few]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], np.bincount(d[keep], minlength=len(texts))


def sketched(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """(doc_id, given, n_shingles, set_id, sketch): the set's digest and its k smallest hashes."""

    def run(batches):
        for b in batches:
            h, sizes = shingle_sets(b.column(2).to_pylist(), shingle)
            at = np.concatenate([[0], np.cumsum(sizes)])
            sets = [h[x:y] for x, y in zip(at[:-1], at[1:])]
            yield {
                "doc_id": b.column(0), "given": b.column(1), "n_shingles": sizes, "set_id": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "sketch": [s[:k].view(np.int64) for s in sets],
            }

    return map_arrow(docs.select("doc_id", "given", "text"), run, "doc_id long, given long, n_shingles long, set_id binary, sketch array<long>")


def needed(k: int, similarity: float, estimate: float):
    """Values that a sketch must share with a partner's. Sets of which even the partner's fits a sketch are known whole."""
    size = F.size("sketch")
    whole = F.col("n_shingles") <= math.floor(k * similarity)
    return F.when(whole, F.ceil(F.lit(similarity) * F.col("n_shingles") - 1e-9)).otherwise(F.floor(F.lit(estimate) * size)).cast("int")


def inverted_lists(classes: DataFrame, k: int, similarity: float, estimate: float) -> DataFrame:
    """(v, node, typical): for each set the rarest of its retained values that can lead to a partner.

    Two sketches that share o values share one of the size - o + 1 rarest of either, so the
    others need not be posted; nor do values that one set alone retains. ``typical`` adds
    up how many sets share the node's values: it is highest in the middle of a group.
    """
    values = classes.select("node", F.explode("sketch").alias("v"), F.size("sketch").alias("size"), needed(k, similarity, estimate).alias("need"))
    counts = values.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1")
    shared = values.join(counts, "v")
    by_node = shared.groupBy("node").agg(F.first("size").alias("size"), F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("c", "v"))).alias("vs"))
    by_node = by_node.filter("size(vs) >= need")
    rarest = F.slice("vs", 1, F.greatest(F.lit(0), F.size("vs") - F.col("need") + 1))
    typical = F.aggregate("vs", F.lit(0.0), lambda s, x: s + F.log2(x["c"].cast("double")))
    return by_node.select("node", typical.alias("typical"), F.explode(rarest).alias("x")).select("node", "typical", F.col("x.v").alias("v"))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b, round, common, union, less, more): exact sizes for pairs of documents, from their full shingle sets.

    ``less`` are the shingles that only b has, ``more`` those that only a has; ``round`` names b's set.

    The pairs of a b are dealt into chunks of CHUNK and read as a stream sorted by chunk
    with b's text in front, so a task holds one set besides a batch, however many pairs b has.
    """
    per = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.count("*").alias("n"))
    dealt = lookup_by_key(pairs, per, ["b"], "n").select("a", "b", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int").alias("chunk"))
    dealt = stored(dealt, "pairs")
    centres = dealt.select("b", "chunk").distinct().join(texts.withColumnRenamed("node", "b"), "b").select("b", "chunk", F.lit(None).cast("long").alias("a"), "text")
    members = dealt.join(texts.withColumnRenamed("node", "a"), "a").select("b", "chunk", "a", "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = centres.union(members).repartition(n, "b", "chunk").sortWithinPartitions("b", "chunk", F.col("a").asc_nulls_first())

    def run(batches):
        at, sets = None, []
        name_of = lambda c: int.from_bytes(hashlib.blake2b(c.tobytes(), digest_size=8).digest(), "little", signed=True)
        for batch in batches:
            key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            a = batch.column(2).to_pylist()
            h, sizes = shingle_sets(batch.column(3).to_pylist(), shingle)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            out = {"a": [], "b": [], "round": [], "common": [], "union": [], "less": [], "more": []}
            for i, k in enumerate(key):
                s = h[edge[i] : edge[i + 1]]
                if k != at:
                    at, sets = k, []
                if a[i] is None:
                    sets.append((s.copy(), name_of(s)))
                else:  # a repeated doc_id has several texts
                    for c, centre in sets:
                        common = len(np.intersect1d(c, s, assume_unique=True))
                        union = len(c) + len(s) - common
                        differ = (np.setdiff1d(c, s, True).view(np.int64), np.setdiff1d(s, c, True).view(np.int64))
                        for name, x in zip(out, (a[i], k[0], centre, common, union, *differ)):
                            out[name].append(x)
            yield out

    return map_arrow(stream, run, "a long, b long, round long, common long, union long, less array<long>, more array<long>")


def places(lists: list, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, column) of every value that is a column, by column."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists])
    at = np.searchsorted(columns, flat)
    hit = np.flatnonzero(columns[np.minimum(at, len(columns) - 1)] == flat)
    hit = hit[np.argsort(at[hit], kind="stable")]
    return row[hit], at[hit]


def shared(x: list, y: list) -> np.ndarray:
    """Number of common values of each list of x with each of y, by products of WIDTH columns at a time."""
    out = np.zeros((len(x), len(y)), np.float32)
    columns = np.unique(np.concatenate([np.asarray(v, np.int64) for v in x]))
    if not len(columns):
        return out
    sides = [places(s, columns) for s in (x, y)]
    for low in range(0, len(columns), WIDTH):
        tables = []
        for lists, (row, at) in zip((x, y), sides):
            a, b = np.searchsorted(at, (low, low + WIDTH))
            part = np.zeros((len(lists), min(WIDTH, len(columns) - low)), np.float32)
            part[row[a:b], at[a:b] - low] = 1
            tables.append(part)
        out += tables[0] @ tables[1].T
    return out


def open_lists(posts: DataFrame) -> DataFrame:
    """``posts`` of lists in which sets of different components may be linked, without the sets that can't be with any other there.

    The first shingle that two linked sets share leaves both as many as they must have in common
    (``own`` of both less ``free``), and the smallest ``own`` of the list is the least that a partner asks.
    """
    stray = F.when(F.col("stray"), F.col("own"))
    lists = posts.groupBy("centre", "v").agg(F.count("*").alias("n"), F.min("own").alias("least"), F.min(stray).alias("least_stray"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    lists = lists.filter("n > 1 AND lo <> hi AND least_stray IS NOT NULL").drop("lo", "hi")
    found = posts.join(lists.drop("n"), ["centre", "v"])
    return found.filter(F.col("left") >= F.col("own") + F.when(F.col("stray"), F.col("least")).otherwise(F.col("least_stray")) - F.col("free") - 1e-6).drop("least", "least_stray")


def differences_posted(known: DataFrame, similarity: float) -> DataFrame:
    """(centre, v, node, component, stray, own, free, left): each set under the shingles by which it differs from its centre.

    A set is its centre's without ``less`` and with ``more``. Two of one centre are linked
    only if they share own_x + own_y - free of these shingles, with own = (|less| +
    similarity |more|) / (1 + similarity) and free = size (1 - similarity) / (1 + similarity). A set
    outside the centre's component has own > free: it must share more than its partner's
    own, so it never meets what has nothing of its differences. ``left`` counts a set's
    shingles from this one on, rare ones first, among those that any two share.
    """
    stray = F.col("component") != F.col("home")
    counts = known.groupBy("centre").agg(F.count_if(stray).alias("strays"), F.count("*").alias("n")).filter("strays > 0")
    held = stored(lookup_by_key(known, counts, ["centre"], "n", "inner").withColumn("stray", stray), "round")
    each = held.select("centre", "node", "stray", F.explode(F.concat("less", "more")).alias("v"))
    uses = each.groupBy("centre", "v").agg(F.count("*").alias("n"), F.count_if("stray").alias("strays")).filter("n > 1 AND strays > 0").select("centre", "v", F.col("n").alias("often"))
    ordered = each.join(uses, ["centre", "v"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "v"))).alias("vs"))
    own = (F.size("less") + similarity * F.size("more")) / (1 + similarity)
    facts = held.select("node", "centre", "component", "stray", own.alias("own"), (F.col("size") * (1 - similarity) / (1 + similarity)).alias("free"))
    placed = ordered.select("node", F.size("vs").alias("m"), F.posexplode("vs").alias("p", "x")).select("node", F.col("x.v").alias("v"), (F.col("m") - F.col("p")).alias("left"))
    return placed.join(facts, "node").select("centre", "v", "node", "component", "stray", "own", "free", "left")


def star_pairs(posts: DataFrame) -> DataFrame:
    """(a, b): each set with the one set, of all the lists' smallest in ``own``, that it may be linked with."""
    met = posts.join(posts.groupBy("centre", "v").agg(F.min(F.struct("own", "node", "component", "stray", "left")).alias("star")), ["centre", "v"])
    alike = F.least("left", "star.left") >= F.col("own") + F.col("star.own") - F.col("free") - 1e-6
    met = met.filter((F.col("component") != F.col("star.component")) & (F.col("stray") | F.col("star.stray")) & alike)
    return met.groupBy("node").agg(F.min(F.struct("star.own", "star.node")).alias("x")).select(F.col("node").alias("a"), F.col("x.node").alias("b"))


def met_in_lists(posts: DataFrame) -> DataFrame:
    """(a, b): all pairs of different components that may be linked. A list meets itself in blocks of MEMBERS."""
    lists = posts.groupBy("centre", "v").agg(F.count("*").alias("n"), F.count_if("stray").alias("strays"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi AND strays > 0")
    lists = lists.select("centre", "v", F.ceil(F.col("strays") / MEMBERS).cast("int").alias("rows"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("cols"))
    held = stored(posts.join(lists, ["centre", "v"]), "open")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "stray", "own", "left")]
    x = held.filter("stray").select("centre", "v", "free", F.pmod(F.xxhash64("node"), F.col("rows")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), *side("x"))
    y = held.select("centre", "v", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(F.xxhash64("node"), F.col("cols")).cast("int").alias("j"), *side("y"))
    y = y.select(*[F.col(c).alias(c if c.endswith("_y") else f"{c}_k") for c in y.columns])
    once = ~F.col("stray_y") | (F.col("node_x") < F.col("node_y"))
    alike = F.least("left_x", "left_y") >= F.col("own_x") + F.col("own_y") - F.col("free") - 1e-6
    block = [F.col(c) == F.col(f"{c}_k") for c in ("centre", "v", "i", "j")]
    met = x.join(y, block[0] & block[1] & block[2] & block[3] & once & (F.col("component_x") != F.col("component_y")) & alike)
    return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def linked_by_differences(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the components of those ``pairs`` of sets of one centre that are linked.

    |x and y| = size - |less_x| - |less_y| + |less_x and less_y| + |more_x and more_y|: exact,
    from short differences. The pairs of a b are dealt into chunks of CHUNK.
    """
    pairs = stored(pairs, "round_pairs")
    per = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(per, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int").alias("chunk"))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("component", "less", "more")]
    ys = known.withColumnRenamed("node", "b").join(per, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "size", *side("y"))
    both = dealt.join(ys, ["b", "chunk"]).join(known.select(F.col("node").alias("a"), *side("x")), "a")
    same = F.size(F.array_intersect("less_x", "less_y")) + F.size(F.array_intersect("more_x", "more_y"))
    common = F.col("size").cast("long") - F.size("less_x") - F.size("less_y") + same
    union = 2 * F.col("size") - F.size("less_x") + F.size("more_x") - F.size("less_y") + F.size("more_y") - common
    scale = 10**9
    return both.filter(common * scale >= F.lit(round(similarity * scale)) * union).select(F.col("component_x").alias("a"), F.col("component_y").alias("b")).distinct()


def links_round_centres(known: DataFrame, similarity: float) -> DataFrame:
    """(a, b): enough links between different components among the sets confirmed against one centre to join all that are linked.

    ``known``: node, component, centre, home (the centre's component), size (of the
    centre's set), less, more. Sets outside the centre's component meet others in the lists
    of their ``differences_posted``: first only the one of a list that differs least from the
    centre, then what is still in different components.
    """
    posts = stored(open_lists(stored(differences_posted(known, similarity), "differences")), "posts")
    if posts.isEmpty():
        return posts.select(F.col("component").alias("a"), F.col("component").alias("b"))
    first = stored(linked_by_differences(star_pairs(posts), known, similarity), "round_stars")
    now = connected_components(first).select(F.col("node").alias("component"), F.col("component").alias("top"))
    posts = posts.join(now, "component", "left").withColumn("component", F.coalesce("top", "component")).drop("top")
    return first.unionByName(linked_by_differences(met_in_lists(open_lists(posts)), known, similarity))


def mixed_lists(lists: DataFrame, state: DataFrame) -> DataFrame:
    """(v, n) of the lists that hold sets of different components and centres."""
    posted = lists.select("v", "node").join(state, "node")
    found = posted.groupBy("v").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("centre").alias("c0"), F.max("centre").alias("c1"))
    return found.filter("lo <> hi AND c0 <> c1").select("v", "n")


def rivals(lists: DataFrame, state: DataFrame, classes: DataFrame, k: int, similarity: float, estimate: float) -> DataFrame:
    """(a, b): candidates of different components and centres, from the lists that still hold several.

    Their estimate is made on the union of the two sketches, while the list is joined, so
    only candidates that pass it are ever rows. Each list meets itself, so they are to be
    short; they are dealt by their number, since the work is not in their bytes.
    """
    posted = lists.select("v", "node").join(state.select("node", "component", "centre"), "node")
    # unsigned order: the sketches hold the smallest unsigned hashes
    ordered = F.array_sort(F.transform("sketch", lambda v: v.bitwiseXOR(-(2**63))))
    held = posted.join(mixed_lists(lists, state).select("v"), "v").join(classes.select("node", ordered.alias("s"), F.col("n_shingles").alias("size")), "node")
    held = stored(held, "held").repartition(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v")
    x, y = (held.select("v", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "component", "centre", "s", "size")]) for side in "xy")
    low = F.slice(F.array_sort(F.array_union("s_x", "s_y")), 1, k)
    hit = F.size(F.array_intersect(F.array_intersect("s_x", "s_y"), low))
    most = F.greatest("size_x", "size_y")
    least = F.when(most <= k, F.lit(similarity)).otherwise(F.lit(estimate))
    apart = (F.col("node_x") < F.col("node_y")) & (F.col("component_x") != F.col("component_y")) & (F.col("centre_x") != F.col("centre_y"))
    alike = (F.least("size_x", "size_y") >= F.lit(similarity) * most - 1e-9) & (hit >= least * F.size(low) - 1e-9)
    met = x.join(y.withColumnRenamed("v", "vy"), (F.col("v") == F.col("vy")) & apart & alike)
    return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def regrouped(state: DataFrame, edges: DataFrame) -> DataFrame:
    """``state`` with the components that ``edges`` (a, b) link made one; as it is where there are none."""
    if edges.isEmpty():
        return state
    now = connected_components(edges).withColumnRenamed("node", "c")
    out = state.withColumnRenamed("component", "c").join(now, "c", "left")
    return stored(out.select("node", F.coalesce("component", "c").alias("component"), "centre"), "state")


def between_components(links: DataFrame, state: DataFrame) -> DataFrame:
    """(a, b): the components of linked nodes, where they differ."""
    end = lambda x: state.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    return links.select("a", "b").join(end("a"), "a").join(end("b"), "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def against_list_centres(long: DataFrame, lists: DataFrame, centres: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): each set of a ``long`` list with the list's centre, where ``known`` has not met them as single sets."""
    of = centres.join(long.select("v"), "v").select("v", "centre", "n")
    pairs = lookup_by_key(lists.select("v", "node"), of, ["v"], "n", "inner").filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    return pairs.join(known.select(F.col("node").alias("a"), F.col("centre").alias("b")), ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, k: int = SKETCH, estimate: float = LEAST_ESTIMATE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text).

    Documents are linked whose sets of distinct ``shingle``-word shingles have a Jaccard
    similarity of at least ``similarity``; a component is named by its smallest doc_id,
    which alone is kept.

    1. Equal sets are one class (its smallest doc_id), so copies make no pairs.
    2. Inverted lists of the classes' retained values, the rarest that suffice.
    3. In each list everything is paired with its most typical member only; each class
       keeps the partner that most lists give it, and the pair is confirmed on full sets.
    4. The sets of a list of more than STRAYS in which components and centres still differ
       are confirmed against the list's centre too.
    5. Those confirmed against one centre and left outside its component meet others
       of that centre that share enough of their differences from it.
    6. What is still in different components, has different centres and shares a list of
       up to STRAYS sets is estimated on the union of the sketches and confirmed on full
       sets. Pairs inside a component are never made, so large groups cost about their size.

    Steps for which nothing is left are not planned.

    A null or empty text, or one without words, has an empty set and is its own component.
    Rows that repeat a doc_id are one document, linked by any of their texts, one row
    each. Rows without a doc_id are one document for each different text: their doc_id
    stays null, and such a document counts as larger than all others, by a key of 2**62 and
    more made from its text, which is the component_id where it is linked with no other.
    An empty table gives no rows; columns besides doc_id and text play no part.
    """
    key = F.lit(FIRST_KEY) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), key).alias("doc_id"), F.col("doc_id").cast("long").alias("given"), "text")
    rows = stored(sketched(docs, shingle, k), "sketches")
    sets = rows.filter("n_shingles > 0")
    classes = stored(sets.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")), "classes")
    lists = stored(inverted_lists(classes, k, similarity, LEAST_SHARED), "lists")
    involved = lists.select("node").distinct()
    texts = stored(docs.select(F.col("doc_id").alias("node"), "text").join(involved, "node"), "texts")

    centres = lists.groupBy("v").agg(F.max(F.struct("typical", (-F.col("node")).alias("m"))).alias("c"), F.count("*").alias("n")).filter("n > 1").select("v", (-F.col("c.m")).alias("centre"), F.col("c.typical").alias("ct"), "n")
    votes = lookup_by_key(lists.select("v", "node"), centres, ["v"], "n", "inner").filter("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("votes"), F.first("ct").alias("ct"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", "ct", (-F.col("centre")).alias("m"))).alias("x")).select(F.col("node").alias("a"), (-F.col("x.m")).alias("b"))
    stars = stored(confirmed(best, texts, shingle), "stars")
    scale = 10**9
    linked = F.col("common") * scale >= F.lit(round(similarity * scale)) * F.col("union")
    parts = connected_components(stars.filter(linked))

    # a doc_id with several texts has no one difference: it keeps a centre of its own
    known = stars.groupBy("a").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("b", "round", "common", "less", "more")]).filter("n = 1")
    several = involved.join(texts.groupBy("node").count().filter("count > 1").select("node"), "node", "left_semi")
    known = known.join(several.withColumnRenamed("node", "b"), "b", "left_anti")
    own = parts.select(F.col("node").alias("b"), F.col("component").alias("home"))
    state = involved.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    known = known.withColumnRenamed("a", "node").join(state, "node").join(own, "b", "left")
    size = (F.col("common") + F.size("less")).alias("size")
    known = known.select("node", "component", F.col("b").alias("centre"), F.coalesce("home", "b").alias("home"), "round", size, "less", "more")
    known = stored(known, "known")
    state = stored(state.join(known.select("node", "centre"), "node", "left").select("node", "component", F.coalesce("centre", "node").alias("centre")), "state")

    long = stored(mixed_lists(lists, state).filter(F.col("n") > STRAYS), "long")
    if not long.isEmpty():
        met = stored(confirmed(against_list_centres(long, lists, centres, known), texts, shingle), "long-stars")
        state = regrouped(state, stored(between_components(met.filter(linked), state), "long-links"))
        # a set has a row for each of its centres, told by their names
        again = met.select(F.xxhash64("a", "round", "less", "more").alias("key"), F.col("a").alias("node"), F.col("b").alias("centre"), "round", size, "less", "more").dropDuplicates(["key"])
        again = known.select(F.xxhash64("node", "round").alias("key"), *again.columns[1:]).unionByName(again)
        again = again.join(state.select("node", "component"), "node").join(state.select(F.col("node").alias("centre"), F.col("component").alias("home")), "centre")
        known = stored(again.select(F.col("key").alias("node"), "component", F.col("round").alias("centre"), "home", "size", "less", "more"), "known")
        lists = lists.join(long.select("v"), "v", "left_anti")
    state = regrouped(state, stored(links_round_centres(known, similarity), "round"))
    met = stored(rivals(lists, state, classes, k, similarity, estimate), "rivals")
    if not met.isEmpty():
        state = regrouped(state, stored(between_components(confirmed(met, texts, shingle).filter(linked), state), "links"))

    # a doc_id with several sets joins their components by its name, which is their node
    named = classes.join(state, "node", "left").select("set_id", "copies", F.coalesce("component", "node").alias("component_id"))
    out = lookup_by_key(rows.select("doc_id", "given", "n_shingles", "set_id"), named, ["set_id"], "copies")
    component = F.coalesce("component_id", "doc_id")
    return out.select(F.col("given").alias("doc_id"), "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (
  SELECT doc_id, CASE WHEN len(w) < 4 THEN md5(array_to_string(w, ' ')) ELSE md5(array_to_string(w[i:i + 3], ' ')) END AS x
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id
"""

"""Order MinHash fingerprints, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from opinara.llm._common import table

#: A fingerprint has SKETCHES tuples; a tuple is the TUPLE k-mers that come first from the start of one share of the hash space on.
SKETCHES, TUPLE = 64, 2
#: k-mers are pairs of neighbouring words; a word over this many characters is several.
WORD = r"\S{1,16}"
#: The low bits of a packed element hold a k-mer's place in the text.
PLACE_BITS = 26
#: Documents of one bucket of neighbours, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 4000, 1000


def _hash(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE_BITS)


def _share(x: Column) -> Column:
    """0 to SKETCHES - 1, ascending as the signed elements do."""
    return F.shiftright(x, 64 - SKETCHES.bit_length() + 1).cast("int") + SKETCHES // 2


def _place(x: Column) -> Column:
    return x.bitwiseAND((1 << PLACE_BITS) - 1)


def _pack(h: Column, place: Column) -> Column:
    return h.bitwiseAND(~((1 << PLACE_BITS) - 1)).bitwiseOR(place.cast("long"))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the array column ``out``: ascending longs, share number << 32 | hash of the share's tuple.

    The j-th occurrence of a k-mer is an element of its own, from the second on hashed with j, so that
    repetitions count (the multiset of k-mers, not the set). Hash space is cut into
    SKETCHES shares by its top bits; the TUPLE smallest elements from a share's start on, put
    back into text order, are hashed to its entry. Where the share has fewer the next larger
    ones count, after the largest the smallest: each share so has a hash function of its own
    (the one hash, rotated) whose minimal k-mers are taken from the whole text. Every entry
    of a text of two k-mers or more is an ordered tuple. Moving text apart or swapping it changes tuples
    even where the k-mers stay, which is what makes the measure follow the edit distance.
    Every step is linear in the text's length but the two sorts. A null or blank text has
    an empty fingerprint; one word is a k-mer of its own.
    """
    a, b, c, d, e = (f"__omh{k}" for k in "abcde")
    df = df.withColumn(a, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)))
    # k-mer hashes with their places, sorted: equal k-mers stand together in text order
    one = F.size(a) == 1
    df = df.withColumn(b, F.sort_array(F.transform(F.slice(F.col(a), 1, F.greatest(F.size(a) - 1, F.when(one, 1).otherwise(0))), lambda x, i: _pack(F.xxhash64(x, F.get(F.col(a), i + 1)), i))))
    # a first occurrence keeps its k-mer's hash; the others, told by an equal hash before them, are hashed with their number
    df = df.withColumn(c, F.filter(F.col(b), lambda x, j: _hash(x.bitwiseXOR(F.get(F.col(b), j - 1))) == 0))
    df = df.withColumn(b, F.when(F.size(c) == 0, F.col(b)).otherwise(F.filter(F.col(b), lambda x, j: F.coalesce(_hash(x.bitwiseXOR(F.get(F.col(b), j - 1))) != 0, F.lit(True)))))
    begins = F.filter(F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.coalesce(_hash(F.get(F.col(c), j).bitwiseXOR(F.get(F.col(c), j - 1))) != 0, F.lit(True)))
    df = df.withColumn(d, begins)
    numbered = F.transform(
        F.col(d),
        lambda s, r: F.transform(
            F.sequence(s, F.coalesce(F.get(F.col(d), r + 1), F.size(c)) - 1),
            lambda j: F.coalesce(_pack(F.xxhash64(_hash(F.get(F.col(c), s)), j - s + 1), _place(F.get(F.col(c), j))), F.lit(0).cast("long")),
        ),
    )
    df = df.withColumn(d, F.when(F.size(d) == 0, F.col(b)).otherwise(F.sort_array(F.concat(F.col(b), F.flatten(numbered)))))
    # sorted, a share is a stretch: its minimal elements are those with no TUPLE others of the share before them
    df = df.withColumn(e, F.filter(F.col(d), lambda x, j: F.coalesce(_share(F.get(F.col(d), j - TUPLE)) != _share(x), F.lit(True))))

    first, n = F.get(F.col(e), 0), F.size(e)

    def tuple_at(x: Column, j: Column) -> Column:
        after = F.coalesce(F.get(F.col(e), j + 1), first)
        pair = F.when(_place(x) < _place(after), F.xxhash64(_hash(x), _hash(after))).otherwise(F.xxhash64(_hash(after), _hash(x)))
        return F.when(n == 1, F.xxhash64(_hash(x))).otherwise(pair).bitwiseAND(0xFFFFFFFF)

    def entries(shares: Column, hashed: Column) -> Column:
        return F.transform(shares, lambda s: F.shiftleft(s.cast("long"), 32).bitwiseOR(hashed))

    def filled(x: Column, j: Column) -> Column:
        """The entries of the shares after that of the element before, up to that of x: none unless x is its share's first."""
        since = F.coalesce(_share(F.get(F.col(e), j - 1)), F.lit(-1))
        return F.when(since < _share(x), entries(F.sequence(since + 1, _share(x)), tuple_at(x, j))).otherwise(F.array().cast("array<long>"))

    last = _share(F.get(F.col(e), n - 1))
    rest = F.when(last < SKETCHES - 1, entries(F.sequence(last + 1, F.lit(SKETCHES - 1)), tuple_at(first, F.lit(0)))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(out, F.concat(F.flatten(F.transform(F.col(e), filled)), rest))
    return df.drop(a, b, c, d, e)


def likeness(x: str, y: str) -> Column:
    """Equal entries as a share of those that either fingerprint has; 1 for two empty fingerprints."""
    shares = F.size(F.array_union(F.transform(F.col(x), lambda v: F.shiftright(v, 32)), F.transform(F.col(y), lambda v: F.shiftright(v, 32))))
    return F.when(shares == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / shares)


def printed(fp: str) -> Column:
    return F.array_join(F.transform(F.col(fp), lambda v: F.lpad(F.hex(v), 10, "0")), "")


def with_next(df: DataFrame, key: str, tie: str, carry: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with next_<c> for each c in ``carry``: the next row's values by (key, tie), after the last the first's.

    Rows are dealt into buckets of consecutive keys by quantiles; only each bucket's
    smallest key comes to the driver (at most MOST_BUCKETS). The first row of a bucket is
    also dealt to the bucket before it, and the first of all to the last, so one shuffle
    suffices. A null key stands before all others.
    """
    k = F.coalesce(F.col(key), F.lit(-(2**63)))
    keys = df.select(k.alias("k"))
    total = keys.count()
    buckets = max(1, min(MOST_BUCKETS, total // bucket_rows))
    cuts = keys.agg(F.percentile_approx("k", [i / buckets for i in range(1, buckets)] or [0.5], 100 * buckets).alias("q")).first()["q"] or []
    bounds = F.array(*[F.lit(x).cast("long") for x in sorted(set(cuts))]) if buckets > 1 else F.array().cast("array<long>")
    bucket = F.size(F.filter(bounds, lambda x: x <= k))
    heads = sorted((r["b"], r["first"]) for r in keys.groupBy(F.size(F.filter(bounds, lambda x: x <= F.col("k"))).alias("b")).agg(F.min("k").alias("first")).collect())
    before = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}
    own = F.array(F.struct(bucket.alias("b"), F.lit(0).alias("last")))
    if before:
        to = F.create_map(*[F.lit(x).cast(t) for f, b in before.items() for x, t in ((f, "long"), (b, "int"))])
        also = F.array(F.struct(bucket.alias("b"), F.lit(0).alias("last")), F.struct(to[k].alias("b"), F.lit(1).alias("last")))
        own = F.when(k.isin(*before), also).otherwise(own)
    w = Window.partitionBy("__d.b").orderBy("__d.last", key, tie)
    out = df.withColumn("__d", F.explode(own)).withColumns({f"next_{c}": F.lead(c).over(w) for c in carry})
    return out.filter("__d.last = 0").drop("__d")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): fingerprints of the text and of its edited text, and their likeness.

    Edited: the last floor(n / 2) code points give way to the first as many of the next
    document by doc_id (ties by text; after the last the first), or to all it has. One row
    per input row; a null text is empty.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_fingerprint(rows, "text", "fp")
    rows = with_next(rows, "doc_id", "text", ["text", "fp"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"), "fp", "next_fp")
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), printed("fp").alias("fingerprint"), printed("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))

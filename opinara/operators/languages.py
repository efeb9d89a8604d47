"""Languages of reviews: naive Bayes over character trigrams, fitted and applied by joins and sums."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opinara.functions.text import hinglish
from opinara.operators import runs as R
from opinara.operators.skew import lookup_by_key
from opinara.storage import stored

#: Weights are whole millionths of a natural logarithm, so that their sums do not depend on any order.
UNIT = 1_000_000
#: A model with at most so many weights is broadcast (8 bytes each, and its trigrams); a larger one meets the trigrams in a shuffle.
BROADCAST_WEIGHTS = 4_000_000
#: Labels a model may have: each is a column.
MOST_LABELS = 500
#: Words whose sums a task keeps.
WORDS_HELD = 200_000


class Model(NamedTuple):
    """Labels in order; (gram, n, w0, w1, ...) with a weight per label; weights of unknown trigrams; logarithms of the labels' shares."""

    labels: list[str]
    grams: DataFrame
    unseen: list[int]
    prior: list[int]
    size: int


def letter_words(text: Column) -> Column:
    """Runs of letters and marks in lower case; characters beyond the basic plane part words."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]|[^\x{0}-\x{FFFF}]", " ")
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def trigrams(word: Column) -> Column:
    """All trigrams of a word with a blank before and after it, in one pass."""
    return F.regexp_extract_all(F.concat(F.lit(" "), word, F.lit(" ")), F.lit("(?=(...))"), F.lit(1))


def _weight(count: Column, total: Column) -> Column:
    return F.round(F.log(count / total) * UNIT).cast("long")


def _word_counts(rows: DataFrame) -> DataFrame:
    """(label, w, c) of (label, ws), counted batch by batch before they are shuffled."""

    def counted(batches):
        for b in batches:
            row, codes, names = R.coded(b.column(1))
            label = b.column(0).dictionary_encode()
            both, n = np.unique((label.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] << 32) | codes, return_counts=True)
            yield pa.RecordBatch.from_pydict({"label": label.dictionary.take(pa.array(both >> 32)), "w": names.take(pa.array(both & 0xFFFFFFFF)), "c": pa.array(n)})

    return rows.mapInArrow(counted, "label string, w string, c long").groupBy("label", "w").agg(F.sum("c").alias("c"))


def fit(rows: DataFrame, text: str, label: str) -> Model:
    """Trigram counts of every labelled text with one added to each.

    Rows without a label teach nothing; null and empty texts count for their label's share only;
    repeated rows count as often as they occur. Words are counted before their trigrams are
    made, so that a frequent word, or a label that a third of the rows share, leaves a task as one row.
    """
    shares = {r["label"]: r["n"] for r in rows.select(F.col(label).cast("string").alias("label")).filter("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(shares) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    labels = sorted(shares)
    words = _word_counts(rows.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), letter_words(F.col(text)).alias("ws")))
    counts = words.select("label", "c", F.explode(trigrams(F.col("w"))).alias("gram"))
    each = [F.coalesce(F.sum(F.when(F.col("label") == v, F.col("c"))), F.lit(0)).alias(f"c{i}") for i, v in enumerate(labels)]
    table = stored(counts.groupBy("gram").agg(F.sum("c").alias("n"), *each), "trigrams")
    sums = table.agg(F.count("*").alias("size"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"t{i}") for i in range(len(labels))])
    one = F.lit(1.0)
    known = sums.select("size", *[F.col(f"t{i}") for i in range(len(labels))], *[_weight(one, F.greatest(F.col(f"t{i}") + F.col("size"), F.lit(1))).alias(f"u{i}") for i in range(len(labels))]).first()
    weights = [_weight(F.col(f"c{i}") + 1, F.lit(known[f"t{i}"] + known["size"])).alias(f"w{i}") for i in range(len(labels))]
    n = sum(shares.values())
    prior = [round(math.log(shares[v] / n) * UNIT) for v in labels]
    return Model(labels, table.select("gram", "n", *weights), [known[f"u{i}"] for i in range(len(labels))], prior, known["size"])


def _sums(rows: DataFrame, text: str, model: Model) -> DataFrame:
    """``rows`` with ``__s``: the trigrams of each text and the sum of their weights by label, where the text lies; a word's sums are made once."""
    table = model.grams.drop("n").toArrow()
    sent = rows.sparkSession.sparkContext.broadcast((table["gram"].to_pylist(), np.stack([table[f"w{i}"].to_numpy() for i in range(len(model.labels))], 1)))
    unseen, made, kept = np.array(model.unseen, np.int64), [], {}

    def of_word(w: str) -> np.ndarray:
        if w not in kept:
            if not made:
                made.append({g: i for i, g in enumerate(sent.value[0])})
            at = [made[0].get(f" {w} "[i : i + 3], -1) for i in range(len(w))]
            known = [i for i in at if i >= 0]
            kept[w] = np.array([len(w), *(sent.value[1][known].sum(0) + unseen * (len(w) - len(known)))], np.int64)
        return kept[w]

    @F.arrow_udf("array<long>")
    def summed(lists: pa.Array) -> pa.Array:
        row, codes, names = R.coded(lists)
        if len(kept) > WORDS_HELD:
            kept.clear()
        per = np.array([of_word(w) for w in names.to_pylist()], np.int64).reshape(-1, 1 + len(unseen))
        # whole numbers far below 2**53 add up exactly as doubles
        out = np.stack([np.bincount(row, c[codes], len(lists)) for c in per.T], 1).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))

    return rows.withColumn("__s", summed(letter_words(F.col(text))))


def _told(sums: DataFrame, model: Model, *kept: str) -> DataFrame:
    """(kept, language, probability, margin) from ``grams`` and w0, w1, ... with the priors."""
    names = [f"w{i}" for i in range(len(model.labels))]
    ranked = sums.withColumn("sorted", F.sort_array(F.array(*names), False)).withColumn("best", F.get("sorted", F.lit(0)))
    spread = sum(F.exp((F.col(c) - F.col("best")) / UNIT) for c in names)
    first = F.coalesce(*[F.when(F.col(c) == F.col("best"), v) for c, v in zip(names, model.labels)])
    lead = (F.col("best") - F.get("sorted", F.lit(1))) / UNIT / F.col("grams")
    return ranked.select(*kept, first.alias("language"), (1 / spread).alias("probability"), lead.alias("margin"))


def predicted(rows: DataFrame, text: str, model: Model) -> DataFrame:
    """``rows`` with language, probability (of that label) and margin (its lead over the next, in nats a trigram).

    All three are null for texts without letters, and where the model has no label; ties go to the
    label that sorts first; with one label the margin is null. Texts are scored whole where they lie, and
    nothing is shuffled; if the model is too large for that, each different text is scored once, by its trigrams, which meet the weights in a shuffle.
    """
    k = range(len(model.labels))
    if not model.labels:
        return rows.withColumns({"language": F.lit(None).cast("string"), "probability": F.lit(None).cast("double"), "margin": F.lit(None).cast("double")})
    names = [f"w{i}" for i in k]
    if model.size * len(model.labels) <= BROADCAST_WEIGHTS:
        some = F.get("__s", F.lit(0)) > 0
        each = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row")
        sums = _sums(rows, text, model).select(each, F.when(some, F.get("__s", F.lit(0))).alias("grams"), *[F.when(some, F.get("__s", F.lit(i + 1)) + model.prior[i]).alias(c) for i, c in enumerate(names)])
        return _told(sums, model, "__row").select("__row.*", "language", "probability", "margin")
    keyed = rows.withColumn("__text", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    copies = keyed.groupBy("__text").agg(F.count("*").alias("copies"))
    seen = keyed.select("__text", F.explode(letter_words(F.col(text))).alias("w")).select("__text", F.explode(trigrams(F.col("w"))).alias("gram"))
    met = lookup_by_key(seen.groupBy("__text", "gram").agg(F.count("*").alias("m")), model.grams, ["gram"], "n")
    sums = met.groupBy("__text").agg(F.sum("m").alias("grams"), *[F.sum(F.coalesce(F.col(c), F.lit(model.unseen[i])) * F.col("m")).alias(c) for i, c in enumerate(names)])
    once = sums.join(copies, "__text").select("__text", "copies", (F.col("grams") / F.col("copies")).alias("grams"), *[(F.expr(f"{c} div copies") + model.prior[i]).alias(c) for i, c in enumerate(names)])
    told = _told(once, model, "__text", "copies")
    return lookup_by_key(keyed, told, ["__text"], "copies").drop("__text")


def review_languages(rows: DataFrame, text: str, model: Model, english: str = "en", indian: tuple[str, ...] = ("hi", "mr", "bn", "ta", "te", "gu", "kn", "ml", "pa")) -> DataFrame:
    """``rows`` with language, probability, margin and ``kind``: OTHER without Latin letters' words, HINGLISH over a fifth of Hindi words, EN, HI (an Indian language) or OTHER by the model."""
    out = predicted(rows, text, model)
    share, some = hinglish(F.col(text))
    kind = F.when(~some, "OTHER").when(share > 0.2, "HINGLISH").when(F.col("language") == english, "EN").when(F.col("language").isin(*indian), "HI")
    return out.withColumn("kind", F.coalesce(kind, F.lit("OTHER")))

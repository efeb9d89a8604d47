"""Quality by regularised quadratic discriminant analysis over transformed statistics of whole texts."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.llm._common import map_arrow, table, unused
from opinara.llm._words import sequences, words_of
from opinara.llm.language_id import held_out
from opinara.operators.skew import lookup_by_key
from opinara.storage import stored

#: What each text is told by: logarithms of counts and lengths, square roots of shares.
STATISTICS = (
    "words", "chars", "lines", "distinct_words", "distinct_pairs", "distinct_lines", "word_mean", "word_deviation", "word_longest", "upper", "digits",
    "sentence_marks", "symbols", "beyond_ascii", "line_ends", "repeated_bytes", "shouted_words", "symbol_ends", "bare_words", "entropy",
)
#: Least weight of the shrinkage target, so that a covariance is never singular, and the least deviation of a statistic.
MIN_SHRINKAGE, MIN_DEVIATION = 0.01, 1e-3
#: Scores of the labelled rows are counted in so many bins, to set the cut.
CUT_BINS = 10_000

_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL, _BEYOND, _LINE, _BLANK = range(8)
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LOWER, _DIGIT, _BEYOND
_KIND[list(b".,;:!?'\"-")] = _MARK
_KIND[list(b" \t\x0b\x0c\r")] = _BLANK
_KIND[10] = _LINE


def _distinct(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each owner, told by 40 bits of their hashes; a batch has under 2**24 owners."""
    keys = np.sort(owner.astype(np.uint64) << np.uint64(40) | values >> np.uint64(24))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=n)


def statistics(texts: list[str | None]) -> np.ndarray:
    """Rows x STATISTICS, in double precision; a null text is an empty one, for which all are 0."""
    n = len(texts)
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    kind = _KIND[buf]
    histogram = np.array([np.bincount(x, minlength=256) for x in np.split(buf, np.cumsum(sizes)[:-1])]).reshape(n, 256)
    kinds = np.column_stack([histogram[:, _KIND == k].sum(1) for k in range(8)])
    size = np.maximum(sizes, 1)
    same = np.zeros(len(buf), bool)
    same[1:] = (buf[1:] == buf[:-1]) & (doc[1:] == doc[:-1]) & (kind[1:] != _BLANK)
    histogram = histogram / size[:, None]
    entropy = -(histogram * np.log2(np.where(histogram > 0, histogram, 1))).sum(1)

    hashes, counts = words_of(texts)
    owner = np.repeat(np.arange(n), counts)
    solid = (kind != _BLANK) & (kind != _LINE)
    first = solid & ~np.concatenate([[False], solid[:-1] & (doc[1:] == doc[:-1])]) if len(buf) else solid
    starts = np.flatnonzero(first)
    last = solid & ~np.concatenate([solid[1:] & (doc[1:] == doc[:-1]), [False]]) if len(buf) else solid
    ends = np.flatnonzero(last)
    lengths = (ends - starts + 1).astype(np.float64)
    each = np.maximum(counts, 1)

    def in_words(flag: np.ndarray) -> np.ndarray:
        before = np.concatenate([np.zeros(1, np.int32), np.cumsum(flag, dtype=np.int32)])
        return before[ends + 1] - before[starts]

    upper, letters = in_words(kind == _UPPER), in_words((kind == _UPPER) | (kind == _LOWER) | (kind == _BEYOND))
    share = lambda flag: np.sqrt(np.bincount(owner[flag], minlength=n) / each)
    mean = np.bincount(owner, lengths, n) / each
    deviation = np.sqrt(np.maximum(np.bincount(owner, lengths**2, n) / each - mean**2, 0))
    longest = np.zeros(n)
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1][counts > 0]
    if len(begin):
        longest[counts > 0] = np.maximum.reduceat(lengths, begin)
    pairs = sequences(hashes, 2, 5)
    inner = owner[1:] == owner[:-1]
    lines = [set(t.split("\n")) if t else () for t in texts]
    all_letters = np.maximum(kinds[:, _UPPER] + kinds[:, _LOWER] + kinds[:, _BEYOND], 1)
    return np.column_stack([
        np.log1p(counts), np.log1p(sizes), np.log1p(kinds[:, _LINE]), np.log1p(_distinct(owner, hashes, n)),
        np.log1p(_distinct(owner[1:][inner], pairs[inner], n)), np.log1p([len(x) for x in lines]), np.log1p(mean), np.log1p(deviation), np.log1p(longest),
        np.sqrt(kinds[:, _UPPER] / all_letters), *[np.sqrt(kinds[:, k] / size) for k in (_DIGIT, _MARK, _SYMBOL, _BEYOND, _LINE)], np.sqrt(np.bincount(doc[same], minlength=n) / size),
        share((upper == letters) & (letters > 1)), share(np.isin(kind[ends], (_SYMBOL, _DIGIT))), share(letters == 0), entropy,
    ])


@dataclass(frozen=True)
class Model:
    """Standardisation, per class log prior, mean, and the inverse and log determinant of its Cholesky factor; and the cut.

    The cut is the difference of the log densities from which on label 1 is likelier: 0
    by theory, but set by the labelled rows, since short texts are not Gaussian.
    """

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[tuple[float, np.ndarray, np.ndarray, float] | None, ...]
    cut: float = 0.0

    def densities(self, x: np.ndarray) -> np.ndarray:
        """Rows x 2: each class's log density with its prior, but for a shared constant; -inf for a class without rows."""
        z = (x - self.centre) / self.scale
        out = np.full((len(x), 2), -np.inf)
        for k, c in enumerate(self.classes):
            if c is not None:
                prior, mean, inverse, log_det = c
                out[:, k] = prior - log_det - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """(1 + d / (p + |d|)) / 2 for the difference d of the log densities, less the cut, and p statistics: never flat, as odds would be.

        One class alone scores 0 or 1, none 0.5.
        """
        if None in self.classes:
            return np.full(len(x), 0.5 if self.classes == (None, None) else float(self.classes[0] is None))
        low, high = self.densities(x).T
        d = high - low - self.cut
        return 0.5 * (1 + d / (x.shape[1] + np.abs(d)))


def shrinkage(s: np.ndarray, n: float) -> float:
    """Weight of the target by the oracle approximating shrinkage estimator, at least MIN_SHRINKAGE."""
    p = len(s)
    square, trace = (s * s).sum(), np.trace(s) ** 2
    below = (n + 1 - 2 / p) * (square - trace / p)
    return 1.0 if below <= 0 else float(np.clip(((1 - 2 / p) * square + trace) / below, MIN_SHRINKAGE, 1))


def model_of(moments: list[tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """From each class's number of rows, sums and sums of products."""
    n = sum(m[0] for m in moments)
    p = len(STATISTICS)
    if not n:
        return Model(np.zeros(p), np.ones(p), (None, None))
    within = [m[2] - np.outer(m[1], m[1]) / m[0] if m[0] else np.zeros((p, p)) for m in moments]
    centre = sum(m[1] for m in moments) / n
    scale = np.maximum(np.sqrt(np.maximum(np.diag(sum(within)) / n, 0)), MIN_DEVIATION)
    classes = []
    for (rows, sums, _), w in zip(moments, within):
        if not rows:
            classes.append(None)
            continue
        s = w / rows / np.outer(scale, scale)
        weight = shrinkage(s, rows)
        s = (1 - weight) * s + weight * max(np.trace(s) / p, MIN_SHRINKAGE) * np.eye(p)
        root = np.linalg.cholesky(s)
        classes.append((float(np.log(rows / n)), (sums / rows - centre) / scale, np.linalg.inv(root), float(np.log(np.diag(root)).sum())))
    return Model(centre, scale, tuple(classes))


def best_cut(told: list[tuple[int, int, int]], p: int) -> float:
    """The difference of log densities that tells most labelled rows right, the middle of the widest such stretch.

    ``told``: (bin of the score, label, rows).
    """
    counts = np.zeros((2, CUT_BINS + 2))
    for at, label, n in told:
        counts[label, at] += n
    wrong = np.cumsum(counts[1]) - counts[1] + counts[0].sum() - (np.cumsum(counts[0]) - counts[0])
    best = np.flatnonzero(wrong == wrong.min())
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    run = max(runs, key=len)
    x = 2 * np.clip((run[0] + run[-1]) / 2 / CUT_BINS, 1 / CUT_BINS, 1 - 1 / CUT_BINS) - 1
    return float(p * x / (1 - abs(x)))


def described(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with its statistics as an array ``statistics`` (a column of that name is replaced). Narrow."""
    others = [c for c in docs.columns if c not in (text_col, "statistics")]
    docs = docs.select(text_col, *others)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes[1:])

    def run(batches):
        for b in batches:
            yield {n: b.column(i + 1) for i, n in enumerate(others)} | {"statistics": list(statistics(b.column(0).to_pylist()))}

    return map_arrow(docs, run, ", ".join(filter(None, (schema, "statistics array<double>"))))


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """The model of all rows of ``described`` documents that have a label.

    A doc_id has the label that most of its rows in ``labels`` say; labels other than 0 and
    1 and ties teach nothing, nor do null doc_ids. Every document row of a labelled doc_id
    counts, repeated ones too. Each task adds up moments, which are summed by statistic; two
    matrices reach the driver.
    """
    said = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.sum(2 * F.col(label_col) - 1).alias("s"))
    said = said.filter("s <> 0").select("id", (F.col("s") > 0).cast("int").alias("label"))
    known = rows.select(F.col(id_col).alias("id"), "statistics")
    uses = known.groupBy("id").agg(F.count("*").alias("uses")).join(said, "id")
    taught = lookup_by_key(known, uses, ["id"], "uses", "inner").select("label", "statistics")
    p = len(STATISTICS)

    def run(batches):
        total = np.zeros((2, p + 1, p + 1))
        for b in batches:
            label = b.column(0).to_numpy()
            x = np.column_stack([np.ones(b.num_rows), b.column(1).flatten().to_numpy().reshape(-1, p)])
            for k in (0, 1):
                total[k] += x[label == k].T @ x[label == k]
        if total.any():
            k, i, j = np.indices(total.shape).reshape(3, -1)
            yield {"k": k, "i": i, "j": j, "s": total.ravel()}

    sums = map_arrow(taught, run, "k int, i int, j int, s double").groupBy("k", "i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((2, p + 1, p + 1))
    for r in sums:
        total[r["k"], r["i"], r["j"]] = r["s"]
    model = model_of([(t[0, 0], t[0, 1:], t[1:, 1:]) for t in total])
    if None in model.classes:
        return model
    bin_of = F.floor(F.col("quality_score") * CUT_BINS).cast("int")
    told = scored(taught, model).groupBy(bin_of.alias("bin"), "label").agg(F.count("*").alias("n")).collect()
    return replace(model, cut=best_cut([(r["bin"], r["label"], r["n"]) for r in told], p))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``described`` rows with quality_score (0 to 1) and quality_predicted (1 from 0.5 on) instead of their statistics. Narrow."""
    rows = rows.drop("quality_score", "quality_predicted")
    others = [c for c in rows.columns if c != "statistics"]
    rows = rows.select("statistics", *others)
    broad = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            score = broad.value.score(b.column(0).flatten().to_numpy().reshape(-1, len(STATISTICS)))
            yield {n: b.column(i + 1) for i, n in enumerate(others)} | {"quality_score": score, "quality_predicted": (score >= 0.5).astype(np.int32)}

    schema = "".join(f"`{n}` {t}, " for n, t in rows.dtypes[1:])
    return map_arrow(rows, run, schema + "quality_score double, quality_predicted int")


def classified(docs: DataFrame, labels: DataFrame, learn=None, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without texts, with quality_score and quality_predicted; the model learns from labelled rows where ``learn`` holds.

    Every whole text is read once; its statistics are stored, for learning and scoring. Null and empty texts
    are scored by their statistics, all 0. A row without a doc_id is scored and teaches nothing; repeated
    rows have equal scores. An empty table gives no rows, and no labels the score 0.5. Existing
    columns of the new names are replaced.
    """
    flag = unused(docs.columns, "learn")
    rows = stored(described(docs.withColumn(flag, F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)), text_col), "statistics")
    return scored(rows.drop(flag), fit(rows.filter(F.col(flag)), labels, label_col, id_col))


def op13_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classified(docs, table(spark, sf_dir, "labels"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))

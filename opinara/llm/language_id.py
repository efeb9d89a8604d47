"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opinara.llm._common import map_arrow, table

#: Bounds of the fitted sample of each language: documents, characters of each document, bytes of the dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 160, 1500, 32 << 10
#: Texts are compressed in blocks of this many bytes, so that the dictionary matters throughout a long text.
BLOCK_BYTES, LEVEL = 4096, 9
#: A text whose smallest encoding is under the second by less than this share is rejected.
MIN_MARGIN = 0.01
#: What is compressed: lower-case letters and single blanks.
OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Language and raw-content dictionary, the commonest language first: ties go to it."""

    dictionaries: tuple[tuple[str, bytes], ...]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """One dictionary per language from a bounded sample of its labelled rows.

    Every language that has labelled rows is learned: of each, the SAMPLE_DOCS different
    pairs of id and text with the smallest hashes, or all if it has fewer; at most
    SAMPLE_CHARS characters of each, end to end up to DICTIONARY_BYTES. So rows without an
    id teach like others, and rows that repeat id and text teach once, however many.
    Rows with a null or empty text or a null language teach nothing; without any the model
    is empty. Hashes are made distinct before they are ranked, and only the sample's
    texts reach the driver.
    """
    h = F.xxhash64(F.lit(11), id_col, text_col)
    rows = docs.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    first = rows.select("lang", "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    sample = first.filter(F.col("r") <= SAMPLE_DOCS).select("lang", "h")
    text = F.substring("text", 1, SAMPLE_CHARS)
    picked = rows.join(F.broadcast(sample), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min(text).alias("text")).collect()
    texts: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["h"])):
        texts.setdefault(r["lang"], []).append(letters(r["text"]))
    return Model(tuple((r["lang"], b"\n".join(texts[r["lang"]])[:DICTIONARY_BYTES]) for r in counts))


def letters(text: str) -> bytes:
    return OTHER.sub(" ", text.lower()).strip().encode()


def compressors(model: Model) -> list[tuple[str, object]]:
    import zstandard as z

    out = []
    for lang, raw in model.dictionaries:
        d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def classify(text: str | None, by_lang: list[tuple[str, object]]) -> tuple[str, float, float]:
    """(language, score, margin). No text, no letters or no model: ``und``, score and margin 0.

    The score is the winner's weight among all languages when a size x weighs
    exp(-8 x / smallest): 1 / number of languages on a tie, near 1 far ahead. The margin
    is the share by which the smallest size is under the second, whatever the text's length;
    a single language has margin 1.
    """
    if not text or not by_lang or not any(map(str.isalpha, text)):
        return "und", 0.0, 0.0
    raw = letters(text)
    cut = [raw[k : k + BLOCK_BYTES] for k in range(0, len(raw), BLOCK_BYTES)]
    sizes = [(sum(len(c.compress(b)) for b in cut), lang) for lang, c in by_lang]
    best = min(sizes, key=lambda x: x[0])
    if len(sizes) == 1:
        return best[1], 1.0, 1.0
    second = min(s for s in sizes if s is not best)
    weights = sum(math.exp(-8 * (s - best[0]) / best[0]) for s, _ in sizes)
    return best[1], 1 / weights, (second[0] - best[0]) / second[0]


def predict(docs: DataFrame, model: Model, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1), lang_margin and lang_rejected.

    Every whole text is compressed, block by block, with each language's dictionary; the
    smallest total wins, ties go to the commonest language. Rejected: ``und``, and margins under
    ``min_margin``, so also texts of which the encodings of two languages tie. Repeated rows
    get the same result each; existing columns of these names are replaced. Narrow.
    """
    new = ("lang_pred", "lang_score", "lang_margin", "lang_rejected")
    docs = docs.drop(*new)
    broad = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        by_lang = compressors(broad.value)
        for b in batches:
            pred, score, margin = zip(*(classify(x, by_lang) for x in b.column(text_col).to_pylist())) if b.num_rows else ((), (), ())
            yield {n: b.column(i) for i, n in enumerate(b.schema.names)} | {"lang_pred": pred, "lang_score": score, "lang_margin": margin, "lang_rejected": [p == "und" or m < min_margin for p, m in zip(pred, margin)]}

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return map_arrow(docs, run, schema + ", lang_pred string, lang_score double, lang_margin double, lang_rejected boolean")


def held_out():
    """Documents that no model learns from; one without a doc_id has no remainder and is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame) -> Model:
    return fit(docs.filter(~held_out()))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), trained(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_margin", "lang_rejected")

"""From documents to packed sequences: language ID, near-dedup, substring dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.llm import language_id, minhash_dedup, packing, substring_dedup
from opinara.storage import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; those without letters or with a narrow margin go.

    The dictionaries come from a bounded sample of the labelled rows of ``documents``. Each
    row is judged by its text alone, so rows without a doc_id and repeated rows stay or go
    alike; null and blank texts have no letters and go. No rows give none.
    """
    model = language_id.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return language_id.predict(docs, model).filter("NOT lang_rejected").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each group of near-duplicates (five words, 0.8).

    Each different text under a doc_id is a document of its own, told by a hash of both;
    of rows that repeat both one is kept, whichever. Documents without a doc_id are told
    by their text and stand after all others. Null and empty texts, and those without
    words, are near to none. Two of 15 million hashes are equal once in 160 000 runs.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    found = minhash_dedup.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), shingle=5, similarity=0.8)
    ids = keyed.select("__key", "doc_id").distinct().join(found.select(F.col("doc_id").alias("__key"), "component_id").distinct(), "__key")
    kept = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("first")).select("first.__key")
    return docs.withColumn("__key", F.xxhash64("doc_id", "text")).join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words and more that an earlier document, or the same one earlier, has too.

    n_chars follows; a document of which nothing is left goes.
    """
    found = substring_dedup.dedup_substrings(docs.select(*COLUMNS)).filter("n_removed = 0 OR n_removed < n_words")
    text = F.col("kept")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of at most 2048 tokens; every row is a document, also one without a doc_id or text."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("substring_dedup", substrings), ("packing", pack)]

#: Packing depends on a tokenizer, which SQL can't express; tests hold the pipeline against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

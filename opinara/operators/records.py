"""Joins of reviews with what was found about them, and the defaults where nothing was."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara import schema as S


def first_present(df: DataFrame, names: list[str], default) -> Column:
    """The first of ``names`` that ``df`` has as a column, whatever it holds; else ``default``."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(default))


def enriched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right`` by key; where a row is found there, its values win."""
    marked = right.withColumn("__found", F.lit(True))
    both = left.alias("l").join(marked.alias("r"), key, "left")
    pick = lambda c: F.when(F.col("r.__found"), F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")).alias(c) if c in right.columns else F.col(f"l.{c}")
    return both.select(key, *[pick(c) for c in left.columns if c != key], *[F.col(f"r.{c}") for c in right.columns if c not in left.columns])


def with_results(reviews: DataFrame, results: DataFrame, key: str = "review_id") -> DataFrame:
    """``reviews`` with overall_sentiment, human_review_needed and error_message; one without a result is neutral and for a human."""
    found = reviews.join(results.select(key, "overall_sentiment", F.lit(True).alias("__found")), key, "left")
    missing = F.col("__found").isNull()
    return found.withColumns({"overall_sentiment": F.coalesce("overall_sentiment", F.lit("neutral")), "human_review_needed": missing, "error_message": F.when(missing, S.MISSING_RESULT)}).drop("__found")


def parsed_response(content: Column, schema: str) -> Column:
    """The JSON of a model's answer without the fence round it; null where it is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(content), r"^```(json)?", ""), r"```$", ""))
    return F.from_json(bare, schema, {"mode": "PERMISSIVE"})


FEATURES = "array<struct<feature:string,sentiment:string,intensity:double,confidence:double,evidence:string>>"


def validated_extractions(reviews: DataFrame, responses: DataFrame, batch: str = "batch", key: str = "review_id") -> DataFrame:
    """One row per row of ``reviews`` (batch, key): features, overall_sentiment, trust_indicators, human_review_needed, error_message, from ``responses`` (batch, content), one a batch.

    A content is JSON, fenced or not, with an array ``results`` of objects that name their review.
    Where it is no JSON (null and empty too, or no response is there), has no such array, or none
    of its objects names the review, the row is neutral, without features, for a human, and says why. Of
    several objects for a review the last counts; what one lacks, or has in another form, is empty or
    neutral. Objects without an id, or of a review that is not in the batch, are left out.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("content"), r"^```(json)?", ""), r"```$", ""))
    read = responses.select(batch, F.try_parse_json(F.when(bare != "", bare)).alias("__v"))
    read = read.select(batch, F.col("__v").isNotNull().alias("__json"), F.try_variant_get("__v", "$.results", "array<variant>").alias("__results"))
    part = lambda path, kind: F.try_variant_get("__x", path, kind)
    each = read.select(batch, F.posexplode("__results").alias("__at", "__x")).select(batch, part("$." + key, "string").alias("__id"), "__at", F.struct(
        F.coalesce(part("$.features", FEATURES), F.array().cast(FEATURES)).alias("features"), F.coalesce(part("$.overall_sentiment", "string"), F.lit("neutral")).alias("overall_sentiment"),
        F.coalesce(part("$.trust_indicators", "map<string,boolean>"), F.create_map().cast("map<string,boolean>")).alias("trust_indicators"),
    ).alias("__r"))
    last = each.filter("__id IS NOT NULL").groupBy(batch, "__id").agg(F.max_by("__r", "__at").alias("__r"))
    states = read.select(batch, "__json", F.col("__results").isNotNull().alias("__list"))
    found = reviews.withColumn("__id", F.col(key).cast("string")).join(states, batch, "left").join(last, [batch, "__id"], "left")
    error = F.when(~F.coalesce("__json", F.lit(False)), S.NO_JSON).when(~F.col("__list"), S.NO_RESULTS).when(F.col("__r").isNull(), S.MISSING_RESULT)
    r = F.col("__r")
    return found.select(
        *reviews.columns, F.coalesce(r["features"], F.array().cast(FEATURES)).alias("features"), F.coalesce(r["overall_sentiment"], F.lit("neutral")).alias("overall_sentiment"),
        F.coalesce(r["trust_indicators"], F.create_map().cast("map<string,boolean>")).alias("trust_indicators"), error.isNotNull().alias("human_review_needed"), error.alias("error_message"),
    )


def asked(rows: DataFrame, ask: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "review_id", batch: int = 5, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """``ask`` called with batches of ``batch`` rows in each partition; returns its rows (``schema``, with the key) and an error column.

    A batch that fails is tried again after wait, 2 wait, ... seconds; after the last try its
    rows have the key, nulls and the error, so that none is lost. Partitions are asked in parallel.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                for attempt in range(tries):
                    try:
                        yield ask(part)[names].assign(error=None)
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a model raises becomes an error row
                        if attempt + 1 < tries:
                            time.sleep(wait * 2**attempt)
                        else:
                            yield pd.DataFrame({n: part[key].to_numpy() if n == key else None for n in names} | {"error": str(e)})

    return rows.mapInPandas(run, f"{schema}, error string")


def tail_rows(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each group by ``order``, given descending."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def with_guard(weeks: DataFrame, least: int = 4) -> DataFrame:
    """(product_name, weeks, error): products with too few weeks for an analysis carry the error."""
    return weeks.groupBy("product_name").agg(F.count("*").alias("weeks")).withColumn("error", F.when(F.col("weeks") < least, S.TOO_FEW_WEEKS))


def id_map(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(old_id, new_id) of rows that both sides hold under ``key``; others are skipped."""
    return old.select(key, "old_id").join(new.select(key, "new_id"), key).select("old_id", "new_id")

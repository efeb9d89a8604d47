"""Reply drafts from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opinara import schema as S


def reply_category(feature: Column) -> Column:
    f, out = F.lower(feature), F
    for name, terms in S.REPLY_CATEGORIES:
        out = out.when(f.rlike("|".join(terms)), name)
    return out.otherwise("default")


def reply_drafts(issues: DataFrame, prefix: str = "REF-") -> DataFrame:
    """Three rows, one per tone, for each issue (review_id, product_name, feature); a reference is ``prefix`` and the id."""
    tones = F.explode(F.array(*[F.struct(F.lit(t).alias("tone"), F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]).alias("texts")) for t, texts in S.REPLIES.items()]))
    teams = F.create_map(*[F.lit(x) for kv in S.REPLY_TEAMS.items() for x in kv])
    rows = issues.withColumn("category", reply_category(F.col("feature"))).withColumn("t", tones)
    text = F.col("t.texts")[F.col("category")]
    values = {"{product}": F.coalesce("product_name", F.lit("")), "{issue}": F.coalesce("feature", F.lit("")), "{ref_id}": F.concat(F.lit(prefix), F.col("review_id").cast("string")), "{team}": teams[F.col("category")]}
    for mark, value in values.items():
        text = F.replace(text, F.lit(mark), value)
    rows = rows.select("review_id", "category", F.col("t.tone").alias("tone"), text.alias("response_text"))
    return rows.withColumn("word_count", F.size(F.split(F.trim("response_text"), r"\s+")))

"""Count windows, complaint rates, z-scores, directions, lifecycle stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara import schema as S
from opinara.operators.ordering import positions

KEYS = ["product_name", "feature"]


def series():
    return Window.partitionBy(*KEYS)


def ordered():
    return series().orderBy("window_no")


def sliding_windows(mentions: DataFrame, order: list[str], size: int = 50, step: int = 25) -> DataFrame:
    """Each row once per window of ``size`` rows, a new one every ``step``, that it lies in (window_no from 1).

    Windows run over a product's rows by time. The last window ends with the rows and may
    be shorter, but not under half a size. A product with fewer rows than ``size`` has none.
    """
    rows = positions(mentions, ["product_name"], F.to_date("ts"), order)
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / step))
    last = F.least(F.floor(F.col("idx") / step), F.ceil(F.greatest(F.col("n") - size, F.lit(0)) / step))
    rows = rows.filter(F.col("n") >= size).withColumns({"__first": first, "__last": last}).filter("__first <= __last")
    rows = rows.withColumn("k", F.explode(F.sequence("__first", "__last"))).drop("__first", "__last")
    held = F.least(F.col("k") * step + size, F.col("n")) - F.col("k") * step
    return rows.filter(held >= size // 2).withColumn("window_no", (F.col("k") + 1).cast("int")).drop("k")


MOODS = ("negative", "positive", "neutral", "mixed")


def _moods() -> list[Column]:
    return [F.count("*").alias("total_mentions"), *[F.count_if(F.col("sentiment") == s).alias(f"{s}_mentions") for s in MOODS]]


def _with_rates(counts: DataFrame) -> DataFrame:
    rate = lambda s: F.col(f"{s}_mentions") / F.col("total_mentions") * 100
    return counts.withColumns({"complaint_rate": rate("negative"), "praise_rate": rate("positive"), "neutral_rate": rate("neutral"), "mixed_rate": rate("mixed")})


def feature_rates(windowed: DataFrame) -> DataFrame:
    """Mentions and rates per product, feature and window."""
    return _with_rates(windowed.groupBy(*KEYS, "window_no").agg(*_moods()))


def window_rates(mentions: DataFrame, order: list[str], size: int = 50, step: int = 25) -> DataFrame:
    """``feature_rates`` of ``sliding_windows``, where ``step`` divides ``size``.

    Rows are counted by stretches of ``step`` rows, and only these counts are copied into
    the windows that hold the stretch.
    """
    if size % step:
        return feature_rates(sliding_windows(mentions, order, size, step))
    rows = positions(mentions, ["product_name"], F.to_date("ts"), order).filter(F.col("n") >= size)
    cells = rows.groupBy(*KEYS, F.floor(F.col("idx") / step).alias("cell")).agg(F.max("n").alias("n"), *_moods())
    first, last = F.greatest(F.lit(0), F.col("cell") - size // step + 1), F.least(F.col("cell"), F.ceil((F.col("n") - size) / step))
    cells = cells.withColumns({"first": first, "last": last}).filter("first <= last").withColumn("k", F.explode(F.sequence("first", "last")))
    cells = cells.filter(F.least(F.lit(size), F.col("n") - F.col("k") * step) >= size // 2)
    sums = [F.sum(c).alias(c) for c in ("total_mentions", *(f"{s}_mentions" for s in MOODS))]
    return _with_rates(cells.groupBy(*KEYS, (F.col("k") + 1).cast("int").alias("window_no")).agg(*sums))


def baseline() -> Column:
    return F.max(F.when(F.col("window_no") == 1, F.col("complaint_rate"))).over(series())


def z_scores(rates: DataFrame) -> DataFrame:
    """z against the first window, in population deviations of the series; a deviation of 0 counts as 0.01. Null without a first window or with one window."""
    sd = F.stddev_pop("complaint_rate").over(series())
    z = (F.col("complaint_rate") - baseline()) / F.when(sd < 1e-9, 0.01).otherwise(sd)
    return rates.withColumns({"baseline_rate": baseline(), "z_score": F.when(F.count("*").over(series()) >= 2, z)})


def emerging(rates: DataFrame) -> DataFrame:
    """Flags windows at least twice and 10 points above the first; from a baseline of 0 any rise is infinite."""
    base, rate = baseline(), F.col("complaint_rate")
    ratio = F.when(base > 0, rate / base).when(rate > 0, float("inf")).otherwise(1.0)
    flag = (ratio >= S.EMERGING_RATIO) & (rate - base >= S.EMERGING_POINTS)
    return rates.withColumns({"baseline_rate": base, "is_emerging": F.coalesce(flag, F.lit(False))})


def directions(rates: DataFrame) -> DataFrame:
    """Per series: slope of the rates by their order, largest |z|, spiking, declining or stable."""
    rows = emerging(z_scores(rates)).withColumn("i", F.row_number().over(ordered()) - 1)
    out = rows.groupBy(*KEYS).agg(
        F.count("*").alias("windows"), F.regr_slope("complaint_rate", "i").alias("slope"), F.coalesce(F.max(F.abs("z_score")), F.lit(0.0)).alias("max_severity"),
        F.bool_or("is_emerging").alias("any_emerging"), F.max_by("complaint_rate", "window_no").alias("latest_rate"),
    )
    slope = F.coalesce("slope", F.lit(0.0))
    kind = F.when(F.col("windows") < 2, "stable").when((slope > 1) | (F.col("max_severity") > S.Z_ANOMALY), "spiking").when(slope < -1, "declining").otherwise("stable")
    return out.withColumn("direction", kind)


def lifecycle(rates: DataFrame, base: float = S.BASELINE_RATE) -> DataFrame:
    """The stage of every prefix of a series, and its severity.

    By prefix aggregates alone: number of rates over twice the baseline, longest run of
    such, previous and latest rate.
    """
    rate, over = F.col("complaint_rate"), F.col("complaint_rate") > S.SYSTEMIC_FACTOR * base
    rows = rates.withColumns({"__over": over, "prev": F.lag("complaint_rate").over(ordered()), "__n": F.row_number().over(ordered())})
    rows = rows.withColumns({"__total": F.count_if("__over").over(ordered()), "__island": F.count_if(~F.col("__over")).over(ordered())})
    rows = rows.withColumn("__run", F.count_if("__over").over(Window.partitionBy(*KEYS, "__island").orderBy("window_no")))
    rows = rows.withColumn("__longest", F.max("__run").over(ordered()))
    stage = (
        F.when(F.col("__n") == 1, "detected").when(rate <= base + S.SIGNIFICANT_POINTS, "resolved").when(rate < F.col("prev"), "resolving")
        .when((F.col("__total") >= S.PERSISTENT_WINDOWS) & (rate >= F.col("prev")), "persistent").when(F.col("__longest") >= S.SYSTEMIC_RUN, "systemic")
        .when(rate > F.col("prev"), "growing").otherwise("detected")
    )
    score = F.create_map(*[F.lit(x) for kv in S.STAGE_SEVERITY.items() for x in kv])[stage]
    extra = F.when(rate - base > 20, 10).when(rate - base > 10, 5).otherwise(0)
    rows = rows.withColumns({"stage": stage, "severity": F.when(stage == "resolved", 0).otherwise(F.least(F.lit(100), score + extra)).cast("int")})
    return rows.drop("__over", "__n", "__total", "__island", "__run", "__longest", "prev")


def transitions(stages: DataFrame) -> DataFrame:
    """Windows where a series enters another stage; it begins detected."""
    return stages.withColumn("from_stage", F.lag("stage", 1, "detected").over(ordered())).filter("from_stage <> stage")


def runs_above(rates: DataFrame, least: float) -> DataFrame:
    """(product_name, feature, longest_run, windows_above): windows whose complaint rate is over ``least``, neighbouring and in all."""
    over = ordered().rowsBetween(Window.unboundedPreceding, 0)
    above = F.col("complaint_rate") > least
    runs = rates.select(*KEYS, "window_no", above.alias("above"), (F.row_number().over(ordered()) - F.count_if(above).over(over)).alias("__run"))
    each = runs.groupBy(*KEYS, "__run").agg(F.count_if("above").alias("n"))
    return each.groupBy(*KEYS).agg(F.max("n").alias("longest_run"), F.sum("n").alias("windows_above"))


def with_attention(states: DataFrame) -> DataFrame:
    """Issues by their latest stage: active until resolved, in need of attention while systemic or persistent."""
    return states.withColumns({"active": F.col("stage") != "resolved", "requires_attention": F.col("stage").isin("systemic", "persistent")})

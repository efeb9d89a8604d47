"""Scans with parameters, labelled files, fall-backs and generated reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opinara import schema as S
from opinara.operators.scenarios import CRISES
from opinara.operators.ordering import positions
from opinara.sources.files import read_directory, read_reviews

FEATURES = "array<struct<feature: string, sentiment: string>>"


def scan(spark: SparkSession, sql: str, rows: DataFrame, **parameters) -> DataFrame:
    """A query over ``{rows}`` with bound parameters ``:name``; values are never part of the SQL text."""
    return spark.sql(sql, args=parameters, rows=rows)


def for_product(rows: DataFrame, product: str, every: str = "All Products") -> DataFrame:
    """Rows of one product, or all of them for the name ``every``."""
    return rows if product == every else rows.filter(F.col("product_name") == product)


def with_manual_features(rows: DataFrame, column: str = "manual_features") -> DataFrame:
    """The JSON array of labelled features as an array of structs; what is not one is empty."""
    return rows.withColumn(column, F.coalesce(F.from_json(column, FEATURES), F.array().cast(FEATURES)))


def read_labelled(spark: SparkSession, path: str, flags: tuple[str, ...] = ("is_cap_leakage", "is_burning_smell", "is_cable_fraying")) -> DataFrame:
    """Labelled reviews of a CSV file: features parsed, flags as booleans."""
    rows = with_manual_features(read_reviews(spark, path))
    return rows.withColumns({c: F.coalesce(F.expr(f"try_cast({c} AS boolean)"), F.lit(False)) for c in flags if c in rows.columns})


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_first(spark: SparkSession, paths: list[str], otherwise) -> DataFrame:
    """The first of ``paths`` that exists, else ``otherwise(spark)``."""
    found = next((p for p in paths if exists(spark, p)), None)
    return read_reviews(spark, found) if found else otherwise(spark)


def read_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """A review file as UTF-8, or as Latin-1 where its bytes are not UTF-8; the bytes are checked where they lie."""
    lines = spark.read.option("wholetext", False).format("text").load(path)
    broken = not lines.filter(~F.is_valid_utf8(F.col("value"))).isEmpty()
    return read_reviews(spark, path, "ISO-8859-1" if broken else "UTF-8")


def crisis_options(spark: SparkSession) -> DataFrame:
    """(key, feature, reviews) of the crises that can be simulated."""
    return spark.createDataFrame([(k, feature, n) for k, (n, feature, _) in CRISES.items()], "key string, feature string, reviews int")


def pick(options: list[str], roll: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (roll % len(options) + 1).cast("int"))


def with_noise(text: Column, roll: Column) -> Column:
    """A tenth each with two letters swapped, an emoji behind, or cut short, by ``roll``."""
    swapped = F.regexp_replace(text, r"^(\w)(\w)", "$2$1")
    kind = roll % 10
    return F.when(kind == 0, swapped).when(kind == 1, F.concat(text, F.lit(" 😡"))).when(kind == 2, F.concat(F.substring(text, 1, 20), F.lit("..."))).otherwise(text)


def generated_reviews(spark: SparkSession, seed: int = 42, rows: int = 300, trend_share: float = 0.38) -> DataFrame:
    """Reviews of three products, half, a third and a sixth of the rows, by hashes of ``seed`` and the row: the same every time.

    60 % are positive, 25 negative, 15 neutral; the last third of each product's rows
    complains of one feature in a share of ``trend_share``. A tenth each has a typo, an emoji or is cut.
    """
    i = F.col("id")
    roll = lambda k: F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k)), F.lit(10_000))
    product = F.when(i * 2 < rows, 0).when(i * 6 < rows * 5, 1).otherwise(2)
    names, issues = ["Bottle", "Blender", "Charger"], ["packaging leaks", "taste is odd", "battery smells"]
    late = F.when(product == 0, i * 3 >= rows).when(product == 1, i * 9 >= rows * 6.5).otherwise(i * 18 >= rows * 17)
    seeded = late & (roll(1) < int(trend_share * 10_000))
    mood = F.when(seeded | (roll(2) >= 7_500), F.when(seeded | (roll(2) < 10_000), "negative")).when(roll(2) < 6_000, "positive").otherwise("neutral")
    item = F.element_at(F.array(*map(F.lit, names)), (product + 1).cast("int"))
    good, plain, bad = pick(["Great {}, works well.", "Love this {}."], roll(3)), pick(["The {} is okay.", "Average {}."], roll(3)), pick(["The {} is bad.", "Poor {}, want a refund."], roll(3))
    text = F.when(seeded, F.concat(F.lit("The {}: "), F.element_at(F.array(*map(F.lit, issues)), (product + 1).cast("int")))).when(mood == "positive", good).when(mood == "neutral", plain).otherwise(bad)
    out = spark.range(rows).select(
        F.concat(F.lit("R"), F.lpad(i.cast("string"), 6, "0")).alias("review_id"), item.alias("product_name"), with_noise(F.replace(text, F.lit("{}"), F.lower(item)), roll(4)).alias("review_text"),
        mood.alias("sentiment"), seeded.alias("is_seeded"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id AS int))").alias("timestamp"),
    )
    return out


def detect_column(columns: list[str], words: list[str]) -> str | None:
    """The first column one of whose words it holds."""
    return next((c for c in columns if any(w in c.lower() for w in words)), None)


def read_product_directory(spark: SparkSession, folder: str, now: Column | None = None) -> DataFrame:
    """The reviews of ``read_directory`` under the columns of a run, with fall-backs where a file has no such column.

    review_id: the product and the row's place in its file, from 0; product_name: by the
    file's name; category: by the product's words; review_text: clean_text, else empty;
    original_text: review_text; timestamp: ``now``; sentiment: neutral; is_seeded: false,
    as anything but "true" in any case. A value that is there, also an empty one, is kept.
    """
    rows = read_directory(spark, folder).withColumns({"__file": F.col("_metadata.file_path"), "__at": F.monotonically_increasing_id()})
    rows = positions(rows, ["__file"], F.shiftright("__at", 33), ["__at"])
    has = lambda c, other: F.coalesce(c, other) if c in rows.columns else other
    rows = rows.withColumn("category", has("category", category(F.col("product_name"), "batch")))
    text = has("review_text", has("clean_text", F.lit("")))
    return rows.select(
        has("review_id", F.concat_ws("_", "product_name", "idx")).alias("review_id"), "product_name", "category", text.alias("review_text"), has("original_text", text).alias("original_text"),
        has("timestamp", (now if now is not None else F.current_timestamp()).cast("string")).alias("timestamp"), has("sentiment", F.lit("neutral")).alias("sentiment"),
        (F.lower(has("is_seeded", F.lit("false"))) == "true").alias("is_seeded"),
    )


def category(name: Column, rules: str = "service") -> Column:
    """Category of a product by words in its name, by the rules of a caller; else General."""
    out = F
    for label, words in S.CATEGORY_RULES[rules]:
        out = out.when(F.lower(name).rlike("|".join(words)), label)
    return out.otherwise("General")

"""The dimensions that filters are drawn from: categories and tags in the order shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories as (slug, label, shown by default, place), and tags as (slug, label) in the order shown.
CATEGORIES = (
    ("musik", "Musik", True, 10),
    ("nightlife", "Nightlife", True, 20),
    ("kultur", "Kultur", True, 30),
    ("familie", "Familie", True, 40),
    ("outdoor", "Outdoor", True, 50),
    ("sport", "Sport", True, 60),
    ("fuehrungen", "Führungen & Touren", False, 70),
    ("sonstiges", "Sonstiges", True, 99),
)
TAGS = (("kirche", "Kirche"), ("museum", "Museum"), ("open-air", "Open Air"), ("klassik", "Klassik"), ("techno", "Techno"))


def categories(spark: SparkSession) -> DataFrame:
    """(pos, slug, label, shown) by place, then slug."""
    rows = sorted(CATEGORIES, key=lambda r: (r[3], r[0]))
    return spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "pos int, slug string, label string, shown boolean")


def tags(spark: SparkSession, used: DataFrame) -> DataFrame:
    """(pos, slug, label) of the distinct tags of ``used`` (slug): known ones in their fixed order, others behind them by name, without a label."""
    fixed = spark.createDataFrame([(i, *t) for i, t in enumerate(TAGS)], "pos int, known string, label string")
    j = used.select("slug").distinct().join(fixed, F.col("slug") == F.col("known"), "left")
    return j.select(F.coalesce("pos", F.lit(len(TAGS))).alias("pos"), "slug", "label").orderBy("pos", "slug")


def counted(dimension: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """``dimension`` with the number of rows whose ``column`` is its slug, 0 included; aggregated before the join."""
    n = rows.groupBy(F.col(column).alias("key_")).agg(F.count("*").alias("n"))
    return dimension.join(n, F.col("slug") == F.col("key_"), "left").drop("key_").withColumn("n", F.coalesce("n", F.lit(0)))

"""Run ledger, source health, bookmarks and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def last_runs(ledger: DataFrame) -> DataFrame:
    """For each source its last run, and its last good run, by id."""
    good = F.when(F.col("ok"), F.col("id"))
    return ledger.groupBy("source").agg(
        F.max("id").alias("last_run"),
        F.max_by("ok", "id").alias("last_ok"),
        F.max(good).alias("last_good_run"),
        F.max_by("event_count", good).alias("last_good_count"),
    )


def source_health(registry: DataFrame, ledger: DataFrame) -> DataFrame:
    """Last runs of every registered source, also those that never ran."""
    return registry.select("source").join(last_runs(ledger), "source", "left")


def silent_zero_runs(ledger: DataFrame) -> DataFrame:
    """Empty runs of a source whose last good run before had events."""
    w = Window.partitionBy("source").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("ok"), F.col("event_count")), ignorenulls=True).over(w)
    return ledger.withColumn("before", before).where("event_count = 0 and before > 0")


def orphan_cutoff(ledger: DataFrame, back: int = 3, hours: int = 12) -> DataFrame:
    """For each source the start of its newest good run, at place ``back`` or later, that began ``hours`` before the newest."""
    good = ledger.where("ok")
    w = Window.partitionBy("source").orderBy(F.desc("id"))
    ranked = good.select("source", "started_at", F.row_number().over(w).alias("r"), F.first("started_at").over(w).alias("newest"))
    old = (F.col("r") >= back) & (F.col("started_at") <= F.col("newest") - F.expr(f"interval {hours} hours"))
    return ranked.where(old).groupBy("source").agg(F.max("started_at").alias("cutoff"))


def bookmark_counts(marks: DataFrame, today: str, device: int | None = None) -> DataFrame:
    """Bookmarks of each key from today on, without those of the device that asks."""
    rows = marks.where(F.col("d") >= F.lit(today).cast("date"))
    if device is not None:
        rows = rows.where(F.col("g") != device)
    return rows.groupBy("k").agg(F.count("*").alias("n"))


def latest_snapshots(messages: DataFrame) -> DataFrame:
    """The latest message of each device."""
    w = Window.partitionBy("g").orderBy(F.desc("t"), F.desc("id"))
    return messages.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def fold_runs(events: DataFrame, least: int = 3) -> DataFrame:
    """Events of one day, venue and title as one row with their times; smaller groups give a row each."""
    key = tx.run_key(F.col("date"), F.col("venue"), F.col("title"))
    grouped = events.withColumn("run_key", key)
    n = F.count("*").over(Window.partitionBy("run_key"))
    grouped = grouped.withColumn("group_", F.when(n >= least, F.lit("")).otherwise(F.col("id").cast("string")))
    return grouped.groupBy("run_key", "group_").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("time")), ",").alias("times"), F.min("id").alias("first_id")
    ).drop("group_")


def record_runs(entries: DataFrame, path: str) -> None:
    """Append entries to the run ledger; what stands there stays."""
    entries.write.mode("append").parquet(path)

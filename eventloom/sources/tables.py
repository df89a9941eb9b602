"""Scans and sinks of the listing store."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LATE = "99:99"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def listings_scan(listings: DataFrame, start: datetime.date | str | None = None) -> DataFrame:
    """Listings from a day on; the day filter reaches the scan."""
    return listings if start is None else listings.where(F.col("date") >= F.lit(start).cast("date"))


def events_scan(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events between two days (either may be open), in order of date, time (none last) and title."""
    out = events
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out.orderBy("date", F.coalesce("time", F.lit(LATE)), "title")


def first_of_each(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def replace_listings(rows: DataFrame, path: str, order: str = "pos") -> None:
    """Replace the stored listings of the sources in ``rows``; within a run the first (source, uid) wins."""
    first = first_of_each(rows, ["source", "uid"], F.col(order))
    first.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def upsert_details(stored: DataFrame, news: DataFrame) -> DataFrame:
    """Latest detail row of each url."""
    both = stored.unionByName(news)
    return first_of_each(both, ["url"], F.desc("fetched_at"))


def event_links(events: DataFrame) -> DataFrame:
    """(uid, listing_id) of every event's listings, once each."""
    return events.select("uid", F.explode("listing_ids").alias("listing_id")).distinct()


def day_export(events: DataFrame, fields: list[str]) -> DataFrame:
    """One row a day: count, JSON of its events in order of time and title, and a version that changes with it."""
    item = F.struct(*[F.col(f) for f in fields])
    keyed = F.struct(F.coalesce("time", F.lit(LATE)).alias("t"), F.col("title").alias("n"), F.col("id").alias("i"), item.alias("e"))
    grouped = events.groupBy("date").agg(F.array_sort(F.collect_list(keyed)).alias("all"))
    out = grouped.select("date", F.size("all").alias("n"), F.to_json(F.transform("all", lambda x: x["e"])).alias("json"))
    return out.withColumn("version", F.substring(F.sha1("json"), 1, 8))


def changed_days(export: DataFrame, previous: DataFrame) -> DataFrame:
    """Days of an export whose version differs from the previous one or is new."""
    p = previous.select(F.col("date").alias("p_date"), F.col("version").alias("p_version"))
    j = export.join(p, F.col("date") == F.col("p_date"), "left")
    return j.where(F.col("p_version").isNull() | (F.col("p_version") != F.col("version"))).select(*export.columns)


def source_registry(sources: DataFrame) -> DataFrame:
    """Sources with their dense rank position from 0, best first."""
    pos = F.row_number().over(Window.orderBy("rank", "source")) - 1  # a dimension of some dozens of rows
    return sources.withColumn("pos", pos)


def ranked_by(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with ``pos`` of their source in a :func:`source_registry`; unknown sources stand behind all known ones."""
    places = registry.select(F.col("source").alias("s_"), "pos")
    known = registry.agg(F.count("*")).scalar()
    return rows.join(places, rows.source == F.col("s_"), "left").withColumn("pos", F.coalesce("pos", known).cast("long")).drop("s_")


def shared_ranks(sources: DataFrame) -> DataFrame:
    """(rank, sources): ranks that more than one source claims, which a registry may not have."""
    each = sources.groupBy("rank").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return each.where(F.size("sources") > 1)


def all_sources(*feeds: DataFrame) -> DataFrame:
    """Listings of all sources in one table; columns that a source lacks are null there."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out

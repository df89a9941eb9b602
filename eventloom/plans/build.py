"""From listings to events: resolve venues, group duplicates, merge, inherit, exclude, mark ongoing offers.

The order of the steps is part of the result: categories are inherited before tours and
excluded events go, and only what stays counts towards ongoing offers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, text as tx
from ..operators import dedup, merge, venues
from ..operators.components import cut

ONGOING_DAYS = 7
DROPPED = ("fuehrungen",)


def gate(listings: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept listings with venue and region, new venues): tours go before they can create a venue, far places after.

    Listings come with the region that their own spelling of the venue tells; it counts where the venue has none.
    """
    kept = listings.where(~F.col("category").isin(*DROPPED))
    resolved, new = venues.resolve(kept, registry)
    regions = registry.select("slug", "region").unionByName(new.select("slug", "region"))
    regions = regions.groupBy("slug").agg(F.min("region").alias("v_region"))
    out = resolved.join(regions, resolved.ort == regions.slug, "left").drop("slug")
    return out.withColumn("region", F.coalesce("v_region", "region")).drop("v_region").where("region <> 'weiter'"), new


def suffixed_uids(events: DataFrame) -> DataFrame:
    """Events with distinct uids: the second of a uid, in cluster order, gets "-2", and so on."""
    n = F.row_number().over(Window.partitionBy("uid").orderBy("cluster"))
    return events.withColumn("n_", n).withColumn("uid", F.when(F.col("n_") > 1, F.concat("uid", F.lit("-"), "n_")).otherwise(F.col("uid"))).drop("n_")


def inherit_category(events: DataFrame) -> DataFrame:
    """Events of no category take their venue's, if its kind is curated and its other events agree on one."""
    told = F.when(~F.col("category").isin("sonstiges", "demo"), F.col("category"))
    seen = events.where("ort is not null and kind is not null").groupBy(F.col("ort").alias("ort_"))
    seen = seen.agg(F.min(told).alias("least_"), F.max(told).alias("most_")).where("least_ = most_")
    takes = (F.col("category") == "sonstiges") & F.col("kind").isNotNull() & F.col("least_").isNotNull()
    joined = events.join(seen, F.col("ort") == F.col("ort_"), "left")
    return joined.withColumn("category", F.when(takes, F.col("least_")).otherwise(F.col("category"))).drop("ort_", "least_", "most_")


def mark_ongoing(events: DataFrame, days: int = ONGOING_DAYS) -> DataFrame:
    """Whether an event's title takes place at its venue on ``days`` dates or more; a missing venue is a venue."""
    long = events.select(F.col("title").alias("title_"), F.col("ort").alias("ort_"), "date").distinct().groupBy("title_", "ort_")
    long = long.agg(F.count("date").alias("n_")).where(F.col("n_") >= days)
    joined = events.join(long, F.col("title").eqNullSafe(F.col("title_")) & F.col("ort").eqNullSafe(F.col("ort_")), "left")
    return joined.withColumn("ongoing", F.col("n_").isNotNull()).drop("title_", "ort_", "n_")


def excluded(events: DataFrame) -> DataFrame:
    """Events with the reason that keeps them out, null for those that stay."""
    named = classify.slugged(events, v_="venue_name")
    reason = classify.exclusion_reason(F.col("title"), F.col("category"), F.col("v_"), F.col("excluded"), F.col("flavour"))
    return named.withColumn("reason", reason).drop("v_")


def build(
    listings: DataFrame,
    registry: DataFrame,
    n_ranks: int = 20,
    umbrella_source: str | None = None,
    sections: tuple[str, ...] = (),
    house_sources: tuple[str, ...] = (),
    aliases: dict[str, str] | None = None,
    details: DataFrame | None = None,
) -> DataFrame:
    """Events from listings (id, source, rank, date, time, title, venue, raw_category and optional texts).

    ``umbrella_source`` lists festivals as a row of their own under headings that are none of ``sections``; ``house_sources``
    are venues' own pages; ``aliases`` joins venue keys; ``details`` (one row a url) fills what listings leave blank.
    """
    given = set(listings.columns)
    texts = [F.lit(None).cast("string").alias(c) for c in ("url", "image_url", "description", "price_text") if c not in given]
    base = classify.slugged(listings.select("*", *texts), r_="raw_category", t_="title", v_="venue")
    # Cut, as the filters of the gate would otherwise work out the slugs anew for each rule, and three readers follow.
    told = {"category": classify.category(F.col("r_"), F.col("t_"), F.col("v_")), "region": classify.region(F.col("v_"))}
    base = cut(base.withColumns(told).drop("r_", "t_", "v_"))
    kept, new = gate(base, registry)
    kept = cut(kept)
    rows = cut(dedup.prepared(kept, aliases, umbrella_source, sections))
    member = dedup.clusters(rows, house_sources)
    ordered = dedup.canonical_order(rows.join(kept.select("id", "rank"), "id"), member, F.coalesce("rank", F.lit(n_ranks)))
    if details is not None:
        kept = merge.with_details(kept, details)
    merged = merge.merge_clusters(kept.join(ordered.select("id", "cluster", "pos"), "id"))
    merged = merged.withColumn("uid", tx.event_uid(F.col("date"), F.col("time"), F.col("title"), F.col("venue")))
    extra = [c for c in ("kind", "excluded", "flavour") if c in registry.columns]
    info = registry.select("slug", F.col("name").alias("venue_name"), *extra)
    for c in ("kind", "excluded", "flavour"):
        if c not in extra:
            info = info.withColumn(c, F.lit(None).cast("string"))
    # Both steps after this read their input twice, so it is cut before each.
    events = cut(suffixed_uids(merged).join(info, merged.ort == F.col("slug"), "left").drop("slug"))
    events = inherit_category(events).where(~F.col("category").isin(*DROPPED))
    return mark_ongoing(cut(excluded(events).where("reason is null"))).drop("reason", "kind", "excluded")

"""Field-wise merge of a cluster by rank of its members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

_NOTHING = tx.PLACEHOLDER_TEXT


def _value(name: str) -> Column:
    """Stripped text, null if empty or the placeholder."""
    v = F.nullif(tx.strip(F.col(name)), F.lit(""))
    return F.when(v != _NOTHING, v)


def _first(value: Column, good: Column, pos: str = "pos") -> Column:
    """Value of the best placed member for which ``good`` holds; one partial and one final aggregation."""
    return F.min_by(value, F.when(good, F.col(pos)))


def merge_clusters(members: DataFrame) -> DataFrame:
    """One row a cluster from members with ``pos`` (1 is best) and ``rank`` (of the source).

    Members have id, source, date, time, title, ort (venue id), venue, category, url, image_url, description, price_text.
    """
    head = lambda c: F.min_by(F.col(c), F.col("pos"))
    price = tx.clean_price(F.col("price_text"))
    desc = _value("description")
    known = tx.venue_key(F.col("venue")) != ""
    by_rank = F.array_sort(F.collect_set(F.struct("rank", "source")))
    return members.groupBy("cluster").agg(
        head("date").alias("date"),
        F.coalesce(F.nullif(head("time"), F.lit("")), _first(_value("time"), _value("time").isNotNull())).alias("time"),
        head("title").alias("title"),
        F.coalesce(_first(F.col("ort"), known), head("ort")).alias("ort"),
        F.coalesce(_first(F.col("venue"), known), head("venue")).alias("venue"),
        F.coalesce(_first(F.col("category"), F.col("category").isNotNull() & ~F.col("category").isin("", "sonstiges")), F.lit("sonstiges")).alias("category"),
        F.coalesce(_first(F.col("url"), tx.is_single_link(F.col("url"))), _first(_value("url"), _value("url").isNotNull())).alias("url"),
        _first(_value("image_url"), _value("image_url").isNotNull()).alias("image_url"),
        F.coalesce(_first(desc, desc.isNotNull() & ~tx.is_short(desc)), _first(desc, desc.isNotNull())).alias("description"),
        _first(price, price.isNotNull()).alias("price_text"),
        F.array_join(F.transform(by_rank, lambda x: x["source"]), ",").alias("sources"),
        F.count("*").alias("n_members"),
        F.array_sort(F.collect_list("id")).alias("listing_ids"),
    )


def with_details(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Listings with blanks filled from their detail page; a long description replaces a short one."""
    d = details.select(F.col("url").alias("d_url"), *[F.col(c).alias(f"d_{c}") for c in ("description", "price_text", "image_url")])
    j = listings.join(d, F.col("url") == F.col("d_url"), "left")
    blank = lambda c: F.coalesce(tx.strip(F.col(c)), F.lit("")) == ""
    fill = lambda c: F.when(blank(c) & (F.coalesce(F.col(f"d_{c}"), F.lit("")) != ""), F.col(f"d_{c}")).otherwise(F.col(c))
    desc = fill("description")
    better = tx.is_short(desc) & ~tx.is_short(F.col("d_description"))
    return j.withColumns(
        {"description": F.when(better, F.col("d_description")).otherwise(desc), "price_text": fill("price_text"), "image_url": fill("image_url")}
    ).select(*listings.columns)

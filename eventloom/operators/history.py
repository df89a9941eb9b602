"""Stored events over time: orphans, upserts, weights, churn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runs import last_runs, orphan_cutoff


def orphans(seen: DataFrame, ledger: DataFrame) -> DataFrame:
    """(uid, signature) of events that every judging source stopped to deliver.

    ``seen`` holds (uid, source, last_seen). A source judges if its last run was good and it has a cut-off; an event
    without a judge is never an orphan. The signature lists all sources of the event.
    """
    healthy = last_runs(ledger).where("last_ok").select("source")
    judges = orphan_cutoff(ledger).join(healthy, "source")
    j = seen.join(judges, "source", "left")
    got = j.groupBy("uid").agg(
        F.count("cutoff").alias("judges"),
        F.bool_and(F.col("last_seen") < F.col("cutoff")).alias("gone"),
        F.array_join(F.array_sort(F.collect_set(F.col("source").cast("string"))), ",").alias("signature"),
    )
    return got.where("judges > 0 and gone").select("uid", "signature")


def upsert(stored: DataFrame, news: DataFrame, key: str, fill: list[str], keep: list[str]) -> DataFrame:
    """Old and new rows on a key: ``fill`` columns take the new value unless it is null, ``keep`` columns stay as first stored."""
    o, n = stored.alias("o"), news.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    cols = [F.coalesce(f"o.{key}", f"n.{key}").alias(key)]
    cols += [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in fill]
    cols += [F.when(F.col(f"o.{key}").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in keep]
    return j.select(*cols)


def weights(deltas: DataFrame, key: str, delta: str, order: list[str]) -> DataFrame:
    """Sum of a key's changes in order, held at 0 from below.

    The held sum is the plain sum minus its lowest prefix (or 0), so no group is gathered in memory.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = deltas.select(key, delta, F.sum(delta).over(w).alias("prefix_"))
    got = run.groupBy(key).agg(F.sum(delta).alias("s_"), F.min("prefix_").alias("low_"))
    return got.select(key, (F.col("s_") - F.least(F.lit(0), F.col("low_"))).alias("weight"))


def churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """(compared, changed): uids of two snapshots whose identity keys are unique in both."""
    once = lambda d, n: d.groupBy("identity").agg(F.count("*").alias("n"), F.min("uid").alias(n)).where("n = 1").drop("n")
    j = once(before, "a").join(once(after, "b"), "identity")
    return j.agg(F.count("*").alias("compared"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


def valid_marks(messages: DataFrame, today: str, most: int = 100, longest: int = 300) -> DataFrame:
    """Messages (g, items of k and d) whose whole list is well-formed, with past, repeated and too long items left out."""
    good = F.forall("items", lambda x: F.coalesce(x["d"].rlike(r"^\d{4}-\d{2}-\d{2}$") & F.startswith(x["k"], F.concat(x["d"], F.lit("|"))), F.lit(False)))
    kept = F.array_distinct(F.filter("items", lambda x: (x["d"] >= today) & (F.length(x["k"]) <= longest)))
    return messages.where((F.size("items") <= most) & good).withColumn("items", kept)


def relinked(bookings: DataFrame, found: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """Bookings of duplicates after a full search: what is found again keeps ``first_seen``, what is not found any more goes.

    ``found`` has duplicate, canonical, score, reason; ``bookings`` has duplicate and first_seen at least; ``events``
    gives both sources. Running it twice changes nothing but ``last_seen``.
    """
    before = bookings.select("duplicate", "first_seen")
    a = events.select(F.col("uid").alias("duplicate"), F.col("source").alias("duplicate_source"))
    b = events.select(F.col("uid").alias("canonical"), F.col("source").alias("canonical_source"))
    j = found.join(a, "duplicate", "left").join(b, "canonical", "left").join(before, "duplicate", "left")
    return j.select(
        "duplicate", "canonical", "duplicate_source", "canonical_source", "score", "reason",
        F.coalesce("first_seen", F.lit(now)).alias("first_seen"), F.lit(now).alias("last_seen"),
    )


def unlinked(events: DataFrame, bookings: DataFrame) -> DataFrame:
    """Events with ``duplicate_of`` as the bookings say: set for duplicates, null for all others."""
    b = bookings.select(F.col("duplicate").alias("uid"), F.col("canonical").alias("of_"))
    names = [c for c in events.columns if c != "duplicate_of"]
    return events.join(b, "uid", "left").select(*names, F.col("of_").alias("duplicate_of"))


def filled_from_duplicates(events: DataFrame, bookings: DataFrame, now: str, fields: tuple[str, ...] = ("image_url", "price_text", "description", "url")) -> DataFrame:
    """Events whose empty fields are taken from their duplicates (the smallest uid that has one first); nothing is overwritten.

    Where the description is taken and no page was read, the duplicate's reading time is taken, or ``now``, so that no
    later reading empties it again.
    """
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    dup = events.select(F.col("uid").alias("duplicate"), "detail_fetched_at", *fields).join(bookings.select("duplicate", "canonical"), "duplicate")
    first = [F.min_by(f, F.when(said(f).isNotNull(), F.col("duplicate"))).alias(f"f_{f}") for f in fields]
    read = F.min_by(F.struct("detail_fetched_at"), F.when(said("description").isNotNull(), F.col("duplicate"))).alias("read_")
    got = dup.groupBy(F.col("canonical").alias("uid")).agg(*first, read)
    j = events.join(got, "uid", "left")
    takes = said("description").isNull() & F.col("f_description").isNotNull()
    fetched = F.coalesce("detail_fetched_at", F.when(takes, F.coalesce("read_.detail_fetched_at", F.lit(now))))
    cols = {f: F.when(said(f).isNull() & F.col(f"f_{f}").isNotNull(), F.col(f"f_{f}")).otherwise(F.col(f)) for f in fields}
    return j.withColumns(cols | {"detail_fetched_at": fetched}).select(*events.columns)


def changed(before: DataFrame, after: DataFrame, key: str, field: str) -> DataFrame:
    """(key, old, new) of rows whose ``field`` differs between two states of one store."""
    b = before.select(key, F.col(field).alias("old"))
    return b.join(after.select(key, F.col(field).alias("new")), key).where(~F.col("old").eqNullSafe(F.col("new")))

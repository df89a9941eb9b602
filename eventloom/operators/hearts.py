"""Marked events (hearts) over time: marking, and finding a mark's event again after the store changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import cut

LATE = "99:99"


def final_winners(events: DataFrame, bookings: DataFrame) -> DataFrame:
    """(uid, winner): where each uid's chain of duplicates ends; uids whose chain ends nowhere, or in a circle, are left out.

    A stored event points by its ``duplicate_of``, one that is gone by its booking (duplicate, canonical). Chains are
    followed by doubling: n rounds reach 2^n steps, and the first round that brings no further end is the last.
    """
    stored = events.select("uid", F.coalesce("duplicate_of", "uid").alias("to"), F.col("duplicate_of").isNull().alias("done"))
    gone = bookings.select(F.col("duplicate").alias("uid"), F.col("canonical").alias("to")).join(stored.select("uid"), "uid", "left_anti")
    step = stored.unionByName(gone.withColumn("done", F.lit(False)))
    ended = -1
    while True:
        step = cut(step)
        now = step.where("done").count()
        if now == ended:
            return step.where("done").select("uid", F.col("to").alias("winner"))
        ended = now
        on = step.select(F.col("uid").alias("at_"), F.col("to").alias("to_"), F.col("done").alias("done_"))
        # An open row whose next uid is unknown ends nowhere, so the inner join drops it.
        moved = step.where("not done").join(on, F.col("to") == F.col("at_")).select("uid", F.col("to_").alias("to"), F.col("done_").alias("done"))
        step = step.where("done").unionByName(moved)


def set_hearts(hearts: DataFrame, marks: DataFrame) -> DataFrame:
    """Hearts (run_key, event_uid and more) after marks (the same columns and ``on``): set where new, gone where off; a set one stays as it was."""
    off = marks.where(~F.col("on")).select("run_key")
    new = marks.where("on").drop("on").dropDuplicates(["run_key"]).join(hearts.select("run_key"), "run_key", "left_anti")
    return hearts.join(off, "run_key", "left_anti").unionByName(new.join(off, "run_key", "left_anti"))


def relinked_hearts(hearts: DataFrame, events: DataFrame, bookings: DataFrame) -> DataFrame:
    """(heart, event_uid, run_key, n_members, status) of hearts (heart, event_uid, run_key, member_uids, identity_key, run_date).

    "ok" if the event is still a shown member of its run; else "neu_verknuepft" to the run's first shown member, to the
    end of the chain of duplicates of the event or of the first former member that has one, or to the first shown event
    of the same identity and day; else "verwaist". Events have uid, run_key, date, time, duplicate_of, identity_key.
    """
    shown = events.where("duplicate_of is null")
    order = F.struct(F.coalesce("time", F.lit(LATE)).alias("t"), F.col("uid"))
    runs = shown.groupBy("run_key").agg(F.min_by("uid", order).alias("first_"), F.count("*").alias("n_"))
    own = shown.select(F.col("uid").alias("event_uid"), "run_key", F.lit(True).alias("own_"))
    tried = F.concat(F.array("event_uid"), F.coalesce("member_uids", F.array().cast("array<string>")))
    chain = hearts.select("heart", F.posexplode(tried).alias("i_", "uid")).join(final_winners(events, bookings), "uid")
    chain = chain.groupBy("heart").agg(F.min_by("winner", "i_").alias("chain_"))
    same = shown.groupBy("identity_key", F.col("date").alias("run_date")).agg(F.min_by("uid", order).alias("same_"))
    j = hearts.join(own, ["event_uid", "run_key"], "left").join(runs, "run_key", "left").join(chain, "heart", "left")
    j = j.join(same, ["identity_key", "run_date"], "left")
    to = F.when(F.col("own_"), F.col("event_uid")).otherwise(F.coalesce("first_", "chain_", "same_"))
    got = j.select("heart", F.coalesce(to, F.col("event_uid")).alias("event_uid"), F.col("run_key").alias("old_"), to.isNull().alias("lost_"), F.coalesce("own_", F.lit(False)).alias("own_"))
    keys = shown.select(F.col("uid").alias("event_uid"), "run_key")
    status = F.when(F.col("own_"), "ok").when(F.col("lost_"), "verwaist").otherwise("neu_verknuepft")
    out = got.join(keys, "event_uid", "left").select("heart", "event_uid", F.when(F.col("lost_"), F.col("old_")).otherwise(F.col("run_key")).alias("run_key"), status.alias("status"))
    return out.join(runs.select("run_key", "n_"), "run_key", "left").select("heart", "event_uid", "run_key", F.when(F.col("status") == "verwaist", 0).otherwise(F.coalesce("n_", F.lit(0))).alias("n_members"), "status")

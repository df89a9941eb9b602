"""Venue registry: resolution of spellings, and maintenance of the registry.

A registry row: slug, name, aliases (array), region, pos (registry order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, text as tx
from . import counting


def _names(registry: DataFrame) -> DataFrame:
    """(spelling, slug, pos) of names and aliases in registry order."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return registry.select("slug", "pos", F.posexplode(every).alias("i", "spelling")).where("spelling <> ''")


def exact_index(registry: DataFrame) -> DataFrame:
    """(spelling, slug): the first venue in registry order that has the spelling."""
    return _names(registry).groupBy("spelling").agg(F.min_by("slug", F.struct("pos", "i")).alias("slug"))


def collapsed_index(registry: DataFrame) -> DataFrame:
    """(key, slug): the first venue whose spelling or own slug collapses to the key."""
    own = registry.select(F.col("slug").alias("key"), "slug", "pos", F.lit(1 << 20).alias("i"))
    keyed = _names(registry).select(tx.venue_slug(F.col("spelling")).alias("key"), "slug", "pos", "i").where("key <> ''")
    return keyed.unionByName(own).groupBy("key").agg(F.min_by("slug", F.struct("pos", "i")).alias("slug"))


def resolve(listings: DataFrame, registry: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(listings with ``ort``, new venues): exact spelling first, collapsed key next, else a venue of its own.

    A new venue is named by the first spelling of its key in ``order``; blank spellings resolve to null.
    """
    raw = tx.strip(F.col("venue"))
    spelt = listings.withColumn("raw_", F.nullif(raw, F.lit("")))
    distinct = spelt.where("raw_ is not null").groupBy("raw_").agg(F.min(order).alias("first_"))
    keyed = distinct.withColumn("key_", tx.venue_slug(F.col("raw_")))
    exact = exact_index(registry).withColumnRenamed("slug", "exact_")
    coll = collapsed_index(registry).withColumnRenamed("slug", "coll_")
    found = (
        keyed.join(exact, F.col("raw_") == F.col("spelling"), "left")
        .join(coll, F.col("key_") == F.col("key"), "left")
        .withColumn("slug_", F.coalesce("exact_", "coll_"))
    )
    named = F.coalesce(F.nullif(F.col("key_"), F.lit("")), F.lit("ort"))
    found = found.withColumn("ort", F.coalesce("slug_", named))
    new = (
        found.where("slug_ is null")
        .groupBy(F.col("ort").alias("slug"))
        .agg(
            F.min_by("raw_", "first_").alias("name"),
            F.array_sort(F.collect_list(F.struct("first_", "raw_"))).alias("spellings"),
            F.min("first_").alias("first_seen"),
        )
        .select("slug", "name", F.transform("spellings", lambda x: x["raw_"]).alias("aliases"), classify.region(tx.slugify(F.col("name"))).alias("region"), "first_seen")
    )
    out = spelt.join(found.select("raw_", "ort"), "raw_", "left").drop("raw_")
    return out, new


def merge_into(registry: DataFrame, mapping: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Venues joined into their targets by ``mapping`` (old, target, ord); the registry without those that went.

    The target's aliases come first, then name and aliases of the others by ord, each once. A field that is empty or says
    "sonstiges" takes the first value of the others that says more.
    """
    m = registry.join(mapping, registry.slug == mapping.old, "left")
    m = m.withColumn("to_", F.coalesce("target", "slug")).withColumn("ord_", F.when(F.col("target").isNull(), -1).otherwise(F.col("ord")))
    none = F.array().cast("array<string>")
    own = F.coalesce("aliases", none)
    m = m.withColumn("names_", F.when(F.col("target").isNull(), own).otherwise(F.concat(F.array("name"), own)))
    said = lambda f: F.nullif(F.col(f).cast("string"), F.lit(""))
    pick = [F.min_by(f, F.when(said(f).isNotNull(), F.struct(said(f) == "sonstiges", F.col("ord_")))).alias(f) for f in fields]
    every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord_", "names_"))), lambda x: x["names_"]))
    return m.groupBy(F.col("to_").alias("slug")).agg(
        F.min_by("name", "ord_").alias("name"), *pick, F.filter(F.array_distinct(every), lambda x: x != "").alias("aliases")
    )


def search(registry: DataFrame, needle: str) -> DataFrame:
    """Venues whose slug, name or alias holds the needle's slug; an exact slug alone wins."""
    key = tx.slugify(F.lit(needle))
    hit = F.contains("slug", key) | F.contains(tx.slugify(F.col("name")), key) | F.exists("aliases", lambda a: F.contains(tx.slugify(a), key))
    found = registry.where(hit).withColumn("exact_", (F.col("slug") == needle).cast("int"))
    top = F.max("exact_").over(Window.partitionBy())
    return found.withColumn("top_", top).where("top_ = 0 or exact_ = 1").drop("exact_", "top_")


def fill_empty(registry: DataFrame, news: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Registry with empty fields filled from ``news`` (slug and the fields); what is there stays."""
    n = news.select(F.col("slug").alias("n_slug"), *[F.col(f).alias(f"n_{f}") for f in fields])
    j = registry.join(n, F.col("slug") == F.col("n_slug"), "left")
    empty = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) == ""
    return j.withColumns({f: F.when(empty(f), F.col(f"n_{f}")).otherwise(F.col(f)) for f in fields}).select(*registry.columns)


#: Blocks of venues: two of them meet in one task, which counts their pairs.
BLOCKS = 16


def suspicious_pairs(events: DataFrame, excluded: Column | None = None, least: int = 2, example: bool = True, most: int | None = None) -> DataFrame:
    """(a, b, n, example): venue pairs that share a date and title key at least ``least`` times.

    A date's venues of one key are dealt to each two blocks of venues; all pairs of two blocks are counted in one
    task (see :mod:`counting`), so no pair is shuffled before it is counted. ``example`` is the first shared title as venue a spells it;
    it asks for the pairs one by one. With ``most`` (without examples) pairs that cannot be among so many most frequent ones may be left out.
    """
    keys = events.select("date", "title", "ort", tx.title_key(F.col("title")).alias("key"))
    keys = keys.where("key <> '' and ort is not null and ort <> ''")
    if excluded is not None:
        keys = keys.where(~excluded)
    one = keys.groupBy("date", "key", "ort").agg(F.min("title").alias("title"))
    block = F.pmod(F.xxhash64("ort"), F.lit(BLOCKS)).cast("int")
    lists = one.groupBy("date", "key", block.alias("block")).agg(F.array_sort(F.collect_list("ort")).alias("orts"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    dealt = lists.select("date", "key", "block", "orts", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    tile = ["lo", "hi"]
    sides = [F.first(F.when(F.col("block") == F.col(c), F.col("orts")), ignorenulls=True).alias(s) for c, s in zip(tile, ("xs", "ys"))]
    met = dealt.repartition(BLOCKS * (BLOCKS + 1) // 2, *tile).groupBy(*tile, "date", "key").agg(*sides)
    if not example:
        both = met.where("xs is not null and (lo = hi or ys is not null)").sortWithinPartitions(*tile)
        counted = both.select(*tile, "xs", "ys").mapInArrow(counting.shared(least, most), counting.SCHEMA).select("x", F.explode("ys").alias("to"))
        return counted.select(F.least("x", "to.y").alias("a"), F.greatest("x", "to.y").alias("b"), F.col("to.n").alias("n"))
    pairs = met.select(*tile, "date", "key", F.explode("xs").alias("x"), "ys").select(*tile, "date", "key", "x", F.explode("ys").alias("y"))
    pairs = pairs.where("x < y or (lo < hi and x > y)").select(*tile, "date", "key", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    out = pairs.groupBy(*tile, "a", "b").agg(F.count("*").alias("n"), F.min(F.struct("date", "key")).alias("at")).where(F.col("n") >= least)
    told = one.select(F.struct("date", "key").alias("at"), F.col("ort").alias("a"), F.col("title").alias("example"))
    return out.join(told, ["at", "a"]).select("a", "b", "n", "example")


def suspects(pairs: DataFrame, most: int = 15) -> DataFrame:
    """The ``most`` pairs of :func:`suspicious_pairs` that share most, ties by name; the report of possibly double venues."""
    return pairs.orderBy(F.desc("n"), "a", "b").limit(most)

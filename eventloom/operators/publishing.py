"""What leaves the store: event and venue documents, day files that are written only where they changed, and the paired event tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import text as tx
from .components import cut

LATE = "99:99"


def _said(value: Column) -> Column:
    return F.nullif(value.cast("string"), F.lit(""))


def _filled(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def event_documents(events: DataFrame, venues: DataFrame, flavours: DataFrame) -> DataFrame:
    """(date, time, title, uid, ort, json) of events: a document of short keys without empty ones.

    ``events`` has uid, date, time, title, ort, ort_roh, category, url, image_url, description, price_text, sources (comma-joined),
    region and laufend; ``venues`` slug and name; ``flavours`` slug and flavour, at most one of a venue. Links that are not of
    the web are left out, texts cut, facets of the filter found by title, category, venue and its flavour.
    """
    named = venues.select(F.col("slug").alias("ort"), F.col("name").alias("ort_name"))
    liked = flavours.select(F.col("slug").alias("ort"), "flavour")
    j = events.join(named, "ort", "left").join(liked, "ort", "left")
    j = classify.slugged(j.withColumn("place_", F.coalesce("ort_name", F.when(F.col("ort").isNull(), F.col("ort_roh")))), t_="title", v_="place_")
    facets = classify.facets(F.col("t_"), F.col("category"), F.coalesce("v_", F.lit("")), F.col("flavour"))
    keys = {
        "u": _said(F.col("uid")),
        "d": _said(F.col("date")),
        "t": _said(F.col("time")),
        "ti": _said(F.col("title")),
        "o": _said(F.col("ort")),
        "or": _said(F.col("ort_roh")),
        "k": _said(F.col("category")),
        "url": _said(tx.web_url(F.col("url"))),
        "img": _said(tx.image_url(F.col("image_url"))),
        "b": _said(tx.cut_text(F.col("description"))),
        "p": _said(F.col("price_text")),
        "q": _filled(F.split("sources", ",")),
        "r": _said(F.col("region")),
        "rt": _filled(facets),
        "l": F.when(F.coalesce(F.col("laufend").cast("int"), F.lit(0)) != 0, 1),
    }
    doc = F.to_json(F.struct(*[v.alias(k) for k, v in keys.items()]), {"ignoreNullFields": "true"})
    return j.select("date", "time", "title", "uid", "ort", doc.alias("json"))


# Areas of the filter with their facets, in the order shown, and labels. "familie" is computed but never shown.
AREA_LABELS = {
    "musik": "Musik", "club": "Club & Party", "rock": "Rock & Metal", "indie": "Punk, Indie & Bars", "jazz": "Jazz, Blues & Swing", "klassik": "Klassik & Chor",
    "kultur": "Kultur", "buehne": "Theater & Bühne", "film": "Kino & Film", "wort": "Lesung & Vortrag", "kunst": "Ausstellungen & Museen",
    "demo": "Demos", "familie": "Familie", "outdoor": "Feste & Märkte", "sport": "Sport",
}
UNSHOWN = ("familie",)


def facet_dimension(spark: SparkSession) -> DataFrame:
    """(pos, area, facet, label) of the filter in display order; facet is null for the area itself."""
    rows, area = [], None
    parts = {name: a for a, subs in classify.AREAS.items() for name, _ in subs}
    for key, label in AREA_LABELS.items():
        if key in UNSHOWN:
            continue
        area = parts.get(key, key)
        rows.append((len(rows), area, key if key in parts else None, label))
    return spark.createDataFrame(rows, "pos int, area string, facet string, label string")


def facet_counts(facets: DataFrame, dimension: DataFrame) -> DataFrame:
    """``dimension`` with how many rows of ``facets`` (an array column) carry each entry."""
    n = facets.select(F.explode_outer("facets").alias("key_")).groupBy("key_").agg(F.count("*").alias("n"))
    j = dimension.join(n, F.coalesce("facet", "area") == F.col("key_"), "left").drop("key_")
    return j.withColumn("n", F.coalesce("n", F.lit(0)))


def reason_counts(events: DataFrame) -> DataFrame:
    """(reason, n) of events with a reason to be kept out, what follows a colon left off."""
    said = F.trim(F.regexp_replace("reason", ":.*$", ""))
    return events.where("reason is not null").groupBy(said.alias("reason")).agg(F.count("*").alias("n"))


def venue_documents(venues: DataFrame, events: DataFrame, flavours: DataFrame) -> DataFrame:
    """(slug, json) of the venues that a published event uses, that are marked by heart, or that carry a flavour."""
    used = events.where("ort is not null").select(F.col("ort").alias("slug"))
    wanted = used.unionByName(venues.where("heart").select("slug")).unionByName(flavours.select("slug")).distinct()
    place = lambda c: F.nullif(F.round(F.col(c), 5), F.lit(0.0))
    keys = {
        "n": _said(F.col("name")),
        "h": F.when(F.col("heart"), 1),
        "w": _said(tx.web_url(F.col("homepage"))),
        "a": _said(F.col("address")),
        "art": _said(F.col("kind")),
        "c": _said(tx.image_url(F.col("cover"))),
        "lat": place("lat"),
        "lon": place("lon"),
    }
    doc = F.to_json(F.struct(*[v.alias(k) for k, v in keys.items()]), {"ignoreNullFields": "true"})
    return venues.join(wanted, "slug", "left_semi").select("slug", doc.alias("json"))


def day_documents(documents: DataFrame) -> DataFrame:
    """(date, n, json, version): a day's documents in order of time, title and uid, with a version that changes with them."""
    keyed = F.struct(F.coalesce("time", F.lit(LATE)).alias("t"), F.col("title").alias("n"), F.col("uid").alias("i"), F.col("json").alias("e"))
    days = documents.groupBy("date").agg(F.array_sort(F.collect_list(keyed)).alias("all"))
    body = F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["e"]), ","), F.lit("]"))
    return days.select("date", F.size("all").alias("n"), body.alias("json")).withColumn("version", F.substring(F.sha1("json"), 1, 8))


def day_changes(days: DataFrame, index: DataFrame, now: Column | str) -> DataFrame:
    """``days`` with generated_at and changed: an unchanged version keeps the time stamp of ``index`` (date, version, generated_at)."""
    old = index.select("date", F.col("version").alias("v_"), F.col("generated_at").alias("g_"))
    same = F.col("version").eqNullSafe(F.col("v_")) & F.col("g_").isNotNull()
    stamp = F.when(same, F.col("g_")).otherwise(F.lit(now) if isinstance(now, str) else now)
    return days.join(old, "date", "left").withColumns({"generated_at": stamp, "changed": ~same}).drop("v_", "g_")


def _stored(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def write_days(days: DataFrame, path: str, now: str) -> int:
    """Write the days that are new or changed, each as a partition of its own; days that are not in ``days`` stay. How many were written.

    The partitions hold version and generated_at themselves, so the index is read from them and a run that failed half-way is
    simply run again. A run without changes writes nothing.
    """
    spark = days.sparkSession
    index = spark.createDataFrame([], "date string, version string, generated_at string")
    if _stored(spark, path):
        index = spark.read.schema("n int, json string, version string, generated_at string, date string").parquet(path).select("date", "version", "generated_at")
    # Cut first: the index is read from the folder that is about to be written.
    marked = cut(day_changes(days.withColumn("date", F.col("date").cast("string")), index, now).where("changed").drop("changed"))
    n = marked.count()
    if n:
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    return n


def replace_events(events: DataFrame, path: str) -> None:
    """Replace the stored events and their bridge (uid, listing_id) together.

    Both are written to a new folder first; then one small file, written aside and renamed over, names that folder. Until then, and
    if either write fails, readers see the pair before. ``events`` carries listing_ids, which only the bridge keeps.
    """
    spark = events.sparkSession
    run = uuid.uuid4().hex
    events.drop("listing_ids").write.parquet(f"{path}/{run}/events")
    events.select("uid", F.explode("listing_ids").alias("listing_id")).distinct().write.parquet(f"{path}/{run}/bridge")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at("current").toUri(), conf)
    fs = at("current").getFileSystem(conf)
    out = fs.create(at(f"current-{run}"), True)
    out.write(bytearray(run.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(at(f"current-{run}"), at("current"), options)


def stored_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, bridge) of the pair that was published last."""
    run = spark.read.text(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/{run}/events"), spark.read.parquet(f"{path}/{run}/bridge")


def hearts_of(uids: DataFrame, hearts: DataFrame) -> DataFrame:
    """(uid, run_key) of each uid that a heart holds as its event, else as a member of its run; of several the first run key."""
    own = hearts.select(F.col("event_uid").alias("uid"), "run_key", F.lit(0).alias("by_"))
    member = hearts.select(F.explode("member_uids").alias("uid"), "run_key", F.lit(1).alias("by_"))
    index = own.unionByName(member).groupBy("uid").agg(F.min(F.struct("by_", "run_key"))["run_key"].alias("run_key"))
    return uids.select("uid").distinct().join(index, "uid")


def orphan_report(orphans: DataFrame, events: DataFrame, hearts: DataFrame, bookings: DataFrame, seen: DataFrame, most: float = 0.5) -> DataFrame:
    """Orphans (uid, signature) with what would happen to each; nothing is deleted.

    ``held_by`` is the first guard that holds a row back: "herz" (a heart on it or on its run), "quelle" (more than ``most`` of the
    rows of one of its sources became orphans at once, which speaks of a broken source, not of cancelled events); null: it would
    go. ``unlinked`` counts the duplicates that would be freed first, ``booked`` whether its own booking would go with it.
    """
    hearted = hearts_of(orphans, hearts).select("uid", F.lit(True).alias("hearted"))
    freed = bookings.groupBy(F.col("canonical").alias("uid")).agg(F.count("*").alias("unlinked"))
    own = bookings.select(F.col("duplicate").alias("uid"), F.lit(True).alias("booked")).distinct()
    by = seen.join(orphans.select("uid", F.lit(True).alias("lost")), "uid", "left").groupBy("source")
    broken = by.agg((F.count("lost") / F.count("*")).alias("share")).where(F.col("share") > most).select("source")
    suspect = seen.join(broken, "source").select("uid", F.lit(True).alias("suspect")).distinct()
    j = orphans.join(events, "uid")
    for more in (hearted, suspect, freed, own):
        j = j.join(more, "uid", "left")
    held = F.when(F.col("hearted"), "herz").when(F.col("suspect"), "quelle")
    return j.select("uid", "signature", "title", "date", held.alias("held_by"), F.coalesce("unlinked", F.lit(0)).alias("unlinked"), F.coalesce("booked", F.lit(False)).alias("booked"))


def orphan_summary(report: DataFrame, samples: int = 3) -> DataFrame:
    """(signature, n, titles): how many rows of each signature would go, with the titles of the first ``samples`` by date and uid."""
    w = Window.partitionBy("signature").orderBy("date", "uid")
    free = report.where("held_by is null").withColumn("r_", F.row_number().over(w))
    first = F.array_sort(F.collect_list(F.when(F.col("r_") <= samples, F.struct("r_", "title"))))
    return free.groupBy("signature").agg(F.count("*").alias("n"), F.array_join(F.transform(first, lambda x: x["title"]), ", ").alias("titles"))


def reclassified(events: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with new category, venue_hint and tags, changes): the rules run again over the whole store.

    ``events`` has uid, title, venue, raw_category, category, venue_hint and tags (an array); ``venues`` slug, name, kind. The hint is
    the kind of the venue of that name. Changes hold a row (uid, field, old, new) for each field that differs, tags comma-joined.
    """
    kinds = venues.groupBy(F.col("name").alias("venue")).agg(F.min("kind").alias("kind_"))
    j = classify.slugged(events.join(kinds, "venue", "left"), r_="raw_category", t_="title", v_="venue")
    new = {
        "category": classify.category(F.col("r_"), F.col("t_"), F.col("v_")),
        "venue_hint": F.col("kind_"),
        "tags": classify.tags(F.col("t_"), F.col("v_"), F.coalesce("kind_", F.lit(""))),
    }
    both = j.withColumns({f"n_{k}": v for k, v in new.items()})
    flat = lambda c: F.array_join(c, ",")
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("field"), (flat(k) if k == "tags" else F.col(k)).alias("old"), (flat(f"n_{k}") if k == "tags" else F.col(f"n_{k}")).alias("new"))
            for k in new
        ]
    )
    changes = both.select("uid", F.explode(rows).alias("x")).select("uid", "x.*").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(*[F.col(f"n_{c}").alias(c) if c in new else F.col(c) for c in events.columns]), changes

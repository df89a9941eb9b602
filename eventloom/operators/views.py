"""List views of stored events and venues: filters, look-ups, winners, targets, coverage and the quality gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

LATE = "99:99"
#: Fewer events than this are not published.
LEAST_EVENTS = 200


def chosen_categories(x: str | Sequence[str] | None) -> list[str] | None:
    """Categories named by one string (comma-separated), a list, or nothing; None stands for all."""
    if x is None:
        return None
    names = x.split(",") if isinstance(x, str) else list(x)
    names = [n.strip() for n in names if n.strip()]
    return None if not names or "alle" in names else names


def with_categories(events: DataFrame, chosen: list[str] | None, hidden: DataFrame) -> DataFrame:
    """Events of the chosen categories; without a choice, those not in ``hidden`` (one column: category)."""
    if chosen is not None:
        return events.where(F.col("category").isin(*chosen))
    return events.join(hidden.select("category"), "category", "left_anti")


def not_meeting_point(kind: Column) -> Column:
    """Whether a venue is a place of its own, not just where a walk starts."""
    return F.coalesce(kind, F.lit("")) != "treffpunkt"


def located(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull()


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Whether a point lies in a box, its edges included; no point lies nowhere."""
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def events_in_range(
    events: DataFrame, venues: DataFrame, start: str, end: str, only: list[str] | None = None, without: Sequence[str] = (), far: bool = True
) -> DataFrame:
    """Winners (no ``duplicate_of``) between two days by category, with venue name; meeting points lose their venue slug."""
    e = events.where(F.col("duplicate_of").isNull() & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if only is not None:
        e = e.where(F.col("category").isin(*only))
    if without:
        e = e.where(~F.coalesce(F.col("category").isin(*without), F.lit(False)))
    v = venues.select(F.col("slug").alias("ort"), F.col("name").alias("venue_name"), "kind", F.col("region").alias("venue_region"))
    j = e.join(v, "ort", "left")
    if not far:
        j = j.where(F.coalesce("venue_region", F.lit("")) != "weiter")
    return j.withColumn("ort", F.when(not_meeting_point(F.col("kind")), F.col("ort")))


def page_filter(
    events: DataFrame, sources: Sequence[str], known: Sequence[str], tags: Sequence[str] = (), search: str = "", ongoing: bool = False, around: bool = False
) -> DataFrame:
    """What a visitor's settings leave of a list: offers that run on, places around, sources, any of the tags, and a search in title and venue.

    A source that is not ``known`` always stays; an event without a region is in town.
    """
    keep = F.lit(True) if ongoing else ~F.coalesce(F.col("ongoing"), F.lit(False))
    if not around:
        keep = keep & F.coalesce(F.col("region"), F.lit("")).isin("", "dresden")
    keep = keep & (~F.col("source").isin(*known) | F.col("source").isin(*sources))
    if tags:
        keep = keep & F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, tags)))
    if search:
        hay = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("venue", F.lit(""))))
        keep = keep & F.contains(hay, F.lit(search.lower()))
    return events.where(keep)


def event_by_uid(events: DataFrame, venues: DataFrame, uid: str) -> DataFrame:
    """One event with its venue's name and region."""
    v = venues.select(F.col("slug").alias("ort"), F.col("name").alias("venue_name"), F.col("region").alias("venue_region"))
    return events.where(F.col("uid") == uid).join(v, "ort", "left")


def tags_per_event(tagged: DataFrame, order: Sequence[str]) -> DataFrame:
    """(uid, tags): each event's tags (uid, tag) in display order."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("tag"))
    kept = tagged.where(at > 0).select("uid", F.struct(at.alias("at"), "tag").alias("t")).distinct()
    return kept.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["tag"]).alias("tags"))


def identity_winners(events: DataFrame) -> DataFrame:
    """(key, date, uid): the winner of each identity key and date, earliest time first, none last, then uid."""
    rows = events.where("duplicate_of is null").withColumn("key", tx.identity_key(F.col("source"), F.col("url"), F.col("date").cast("string")))
    first = F.struct(F.coalesce("time", F.lit(LATE)).alias("t"), F.col("uid"))
    return rows.groupBy("key", "date").agg(F.min_by("uid", first).alias("uid"))


def detail_candidates(events: DataFrame, links: DataFrame, listings: DataFrame, known: DataFrame, hosts: Sequence[str], most: int = 2500) -> DataFrame:
    """(url, date): pages worth reading for events with a short description, nearest days first.

    An event's own link counts if its host is allowed, else those of its listings; known pages are left out.
    """
    host = lambda c: F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    short = events.where(tx.is_short(F.col("description"))).select("uid", "date", F.col("url").alias("own"))
    via = links.join(listings.select(F.col("id").alias("listing_id"), "url"), "listing_id").select("uid", "url")
    named = short.select("date", F.col("own").alias("url")).unionAll(short.join(via, "uid").select("date", "url"))
    fit = named.where(host(F.col("url")).isin(*hosts)).groupBy("url").agg(F.min("date").alias("date"))
    return fit.join(known.select("url"), "url", "left_anti").orderBy("date", "url").limit(most).select("url", "date")


def pins(events: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((slug, name, n): located venues with their events; (located, missing): events with and without a place)."""
    v = venues.where(located(F.col("lat"), F.col("lon")) & not_meeting_point(F.col("kind"))).select(F.col("slug").alias("ort"), "name")
    j = events.join(v, "ort", "left")
    on_map = j.where("name is not null").groupBy(F.col("ort").alias("slug"), "name").agg(F.count("*").alias("n"))
    return on_map, j.agg(F.count("name").alias("located"), F.count_if(F.col("name").isNull()).alias("missing"))


def enrichment_targets(venues: DataFrame, events: DataFrame, field: str, today: str, most: int) -> DataFrame:
    """(slug, n): venues that lack ``field``, by how many events are to come there; meeting points are no targets."""
    lacking = venues.where((F.coalesce(F.col(field).cast("string"), F.lit("")) == "") & not_meeting_point(F.col("kind")))
    n = events.where(F.col("date") >= F.lit(today).cast("date")).groupBy(F.col("ort").alias("slug")).agg(F.count("*").alias("n"))
    return lacking.join(n, "slug").select("slug", "n").orderBy(F.desc("n"), "slug").limit(most)


def coverage(venues: DataFrame, events: DataFrame, fields: Sequence[str], today: str) -> DataFrame:
    """(field, have, venues, share): how many of the venues with events to come have each field."""
    used = events.where(F.col("date") >= F.lit(today).cast("date")).select(F.col("ort").alias("slug")).distinct()
    v = venues.join(used, "slug", "left_semi")
    has = [F.struct(F.lit(f).alias("field"), (F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias("has")) for f in fields]
    each = v.select(F.explode(F.array(*has)).alias("x")).groupBy(F.col("x.field").alias("field"))
    out = each.agg(F.count_if("x.has").alias("have"), F.count("*").alias("venues"))
    return out.withColumn("share", F.round(F.col("have") / F.col("venues"), 6))


def hearts(events: DataFrame, marks: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """(hearted events to come, soonest first; past ones, latest first); ``marks`` has uid."""
    day = F.lit(today).cast("date")
    mine = events.join(marks.select("uid").distinct(), "uid", "left_semi")
    time = F.coalesce("time", F.lit(LATE))
    return mine.where(F.col("date") >= day).orderBy("date", time, "uid"), mine.where(F.col("date") < day).orderBy(F.desc("date"), F.desc(time), F.desc("uid"))


def publishable(events: DataFrame, least: int = LEAST_EVENTS) -> DataFrame:
    """The events, or an error when there are so few that a source must have broken."""
    n = events.agg(F.count("*").alias("all_"))
    checked = n.select(F.assert_true(F.col("all_") >= least, F.lit(f"fewer than {least} events: not published")).alias("bad_"))
    return events.join(F.broadcast(checked), F.col("bad_").isNull(), "left_semi")


def used_venues(venues: DataFrame, events: DataFrame, hearted: DataFrame, flavoured: DataFrame) -> DataFrame:
    """Venues that an event uses, that are hearted, or that have a flavour; each once."""
    slugs = events.select(F.col("ort").alias("slug")).unionAll(hearted.select("slug")).unionAll(flavoured.select("slug"))
    return venues.join(slugs.distinct(), "slug", "left_semi")


def first_places(pages: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows of several pages as one list: the first of each key in page order, inside a window of days."""
    w = Window.partitionBy(*keys).orderBy(*order)
    inside = pages.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return inside.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def with_pages(rows: DataFrame, details: DataFrame, most: int) -> DataFrame:
    """Listing rows with time, price and text of their page, if it is one of the ``most`` nearest; others keep what they have."""
    urls = rows.groupBy("url").agg(F.min("date").alias("first_")).orderBy("first_", "url").limit(most).select("url")
    d = details.join(urls, "url", "left_semi").select("url", *[F.col(c).alias(f"d_{c}") for c in ("time", "price_text", "description")])
    j = rows.join(d, "url", "left")
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"d_{c}")) for c in ("time", "price_text", "description")}
    return j.withColumns(filled).select(*rows.columns)


def duplicate_counts(duplicates: DataFrame, listings: DataFrame) -> DataFrame:
    """(source, canonical_source, n): how often one source's listing repeats another's."""
    a = listings.select(F.col("id").alias("duplicate"), "source")
    b = listings.select(F.col("id").alias("canonical"), F.col("source").alias("canonical_source"))
    return duplicates.join(a, "duplicate").join(b, "canonical").groupBy("source", "canonical_source").agg(F.count("*").alias("n"))


def duplicate_report(duplicates: DataFrame, events: DataFrame, start: str, end: str) -> DataFrame:
    """Bookings of duplicates with both titles, where the duplicate's day lies between two days."""
    a = events.select(F.col("id").alias("duplicate"), "date", F.col("title").alias("title"))
    b = events.select(F.col("id").alias("canonical"), F.col("title").alias("canonical_title"))
    inside = a.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return duplicates.join(inside, "duplicate").join(b, "canonical")


def slim(events: DataFrame) -> DataFrame:
    """(uid, json) of events for an export: empty fields left out, region only if not in town, ongoing only if so, score to one place (50 if none)."""
    texts = ("uid", "title", "date", "time", "venue", "category", "source", "url", "image_url", "price_text", "description", "venue_slug")
    have = [F.nullif(F.col(f).cast("string"), F.lit("")).alias(f) for f in texts if f in events.columns]
    more = [
        F.when(F.col("ongoing"), F.lit(True)).alias("ongoing"),
        F.when(F.size("tags") > 0, F.col("tags")).alias("tags"),
        F.when(F.col("region") != "dresden", F.col("region")).alias("region"),
        F.round(F.coalesce(F.col("score").cast("double"), F.lit(50.0)), 1).alias("score"),
    ]
    return events.select("uid", F.to_json(F.struct(*have, *more)).alias("json"))

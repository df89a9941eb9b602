"""Rows from feeds: calendar entries, recurring dates, news items, assemblies, labelled texts and line-ups."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import classify, extract as ex, rules
from ..functions.text import once, slugify

LATE = "99:99"


def _field(event: Column, name: str) -> Column:
    """Value of a calendar field, its escapes undone; null if absent."""
    raw = F.regexp_extract(event, rf"(?m)^{name}(?:;[^:\r\n]*)?:(.*?)\r?$", 1)
    plain = F.regexp_replace(F.regexp_replace(raw, r"\\n", "\n"), r"\\([,;\\])", "$1")
    return F.nullif(F.trim(ex.unescaped(plain)), F.lit(""))


def calendar_rows(feeds: DataFrame, column: str = "value", zone: str = "Europe/Berlin") -> DataFrame:
    """``feeds`` (whatever else they hold) with a row for each entry: uid, title, date, time, venue, categories, description, url.

    Folded lines are joined. Times that end in Z are turned to ``zone``, others stand as they are; whole days have no time.
    """
    unfolded = F.regexp_replace(column, r"\r?\n[ \t]", "")
    found = F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT"), F.lit(1))
    rest = [c for c in feeds.columns if c != column]
    each = feeds.select(*rest, F.posexplode(found).alias("entry", "e_"))
    start = _field(F.col("e_"), "DTSTART")
    local = F.try_to_timestamp(F.substring(start, 1, 15), F.lit("yyyyMMdd'T'HHmmss"))
    at = F.when(start.endswith("Z"), F.from_utc_timestamp(local, zone)).otherwise(local)
    whole_day = F.try_to_timestamp(F.when(F.length(start) == 8, start), F.lit("yyyyMMdd"))
    return each.select(
        *rest,
        "entry",
        _field(F.col("e_"), "UID").alias("uid"),
        _field(F.col("e_"), "SUMMARY").alias("title"),
        F.coalesce(at, whole_day).cast("date").alias("date"),
        F.date_format(at, "HH:mm").alias("time"),
        _field(F.col("e_"), "LOCATION").alias("venue"),
        _field(F.col("e_"), "CATEGORIES").alias("categories"),
        _field(F.col("e_"), "DESCRIPTION").alias("description"),
        _field(F.col("e_"), "URL").alias("url"),
    ).where("date is not null")


def recurring_days(rules: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """((id, date): occurrences between two days; rules that are not understood).

    A rule has id, first (its first date), freq (DAILY, WEEKLY, MONTHLY), every, until, times and skipped (array of
    dates). MONTHLY means the same weekday of the same week of the month. ``times`` counts from the first date on.
    """
    known = F.col("freq").isin("DAILY", "WEEKLY", "MONTHLY") & (F.coalesce("every", F.lit(1)) >= 1) & F.col("first").isNotNull()
    good = rules.where(F.coalesce(known, F.lit(False))).withColumn("every", F.coalesce("every", F.lit(1)))
    last = F.least(F.lit(end).cast("date"), F.coalesce("until", F.lit(end).cast("date")))
    week = F.floor((F.day("first") - 1) / 7).cast("int")
    steps = F.when(F.col("freq") == "DAILY", F.datediff(last, "first") / F.col("every")).when(
        F.col("freq") == "WEEKLY", F.datediff(last, "first") / (7 * F.col("every"))
    ).otherwise((F.months_between(F.last_day(last), F.trunc("first", "month")) + 1) / F.col("every"))
    n = F.greatest(F.floor(steps), F.lit(-1)).cast("int")
    each = good.select("*", last.alias("last_"), week.alias("week_"), F.explode(F.when(n >= 0, F.sequence(F.lit(0), n))).alias("k_"))
    month = F.add_months(F.trunc("first", "month"), F.col("k_") * F.col("every"))
    shift = F.pmod(F.weekday("first") - F.weekday(month), F.lit(7)).cast("int")
    nth = F.date_add(month, shift + 7 * F.col("week_"))
    day = F.when(F.col("freq") == "DAILY", F.date_add("first", F.col("k_") * F.col("every"))).when(
        F.col("freq") == "WEEKLY", F.date_add("first", 7 * F.col("k_") * F.col("every"))
    ).otherwise(F.when(F.month(nth) == F.month(month), nth))
    dated = each.withColumn("date", day).where("date is not null and date <= last_ and date >= first")
    nth_time = F.row_number().over(Window.partitionBy("id").orderBy("date"))
    kept = dated.withColumn("time_", nth_time).where("times is null or time_ <= times")
    out = kept.where((F.col("date") >= F.lit(start).cast("date")) & ~F.array_contains(F.coalesce("skipped", F.array().cast("array<date>")), F.col("date")))
    return out.select("id", "date"), rules.where(~F.coalesce(known, F.lit(False)))


def news_rows(feeds: DataFrame, column: str = "value") -> DataFrame:
    """``feeds`` with a row for each item of an RSS text: title without its leading day, date, link and description; items without a valid day are left out."""
    rest = [c for c in feeds.columns if c != column]
    each = feeds.select(*rest, F.posexplode(ex.feed_items(F.col(column))).alias("item", "x_"))
    part = lambda tag: F.trim(ex.unescaped(F.regexp_extract("x_", rf"(?s)<{tag}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1)))
    title = part("title")
    day = F.try_to_timestamp(F.regexp_extract(title, r"(\d{1,2}\.\d{1,2}\.\d{4})", 1), F.lit("d.M.yyyy")).cast("date")
    return each.select(
        *rest,
        "item",
        F.trim(F.regexp_replace(title, r"^\s*\d{1,2}\.\d{1,2}\.\d{4}\s*[:–-]?\s*", "")).alias("title"),
        day.alias("date"),
        F.nullif(part("link"), F.lit("")).alias("link"),
        F.nullif(part("description"), F.lit("")).alias("description"),
    ).where("date is not null")


def labelled(text: Column, labels: tuple[str, ...]) -> Column:
    """Map of a description's "Label: value" lines, the first of each label."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    names = F.array(*[F.lit(x.lower()) for x in labels])
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v"), F.contains(x, F.lit(":")).alias("ok")))
    found = F.filter(pairs, lambda p: p["ok"] & F.array_contains(names, p["k"]) & (p["v"] != ""))
    first = F.filter(found, lambda p, i: F.array_position(F.transform(found, lambda o: o["k"]), p["k"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"])))


def teaser(text: Column, stop: str) -> Column:
    """Lines of a text up to the one that starts with ``stop``, joined by blanks; null if there are none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    at = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit(stop))), True)
    upto = F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(lines)
    return F.nullif(F.array_join(F.filter(upto, lambda x: x != ""), " "), F.lit(""))


def page_text(candidate: Column, fallback: str, least: int = 40) -> Column:
    """A detail page's text with single blanks; null if it is the fallback or shorter than ``least``."""
    tight = F.trim(F.regexp_replace(candidate, r"\s+", " "))
    return F.when((F.length(tight) >= least) & (tight != fallback), tight)


def lineup_rows(slots: DataFrame, sections: tuple[str, ...], category: Column) -> DataFrame:
    """One umbrella row for each (source, date, heading, venue) with two slots or more, unless the heading is a mere section.

    Slots have source, date, heading, venue, time, title, category. The row's title and raw category are the heading, its
    time is the earliest slot's (none comes last), its description lists the slots. Its category is ``category`` of the
    heading, or where that is "sonstiges" the commonest other category of the slots, ties by name.
    """
    key = ["source", "date", "heading", "venue"]
    named = slots.where(F.col("heading").isNotNull() & ~F.col("heading").isin("", *sections))
    entry = F.struct(F.coalesce("time", F.lit(LATE)).alias("t"), F.col("title").alias("n"))
    grouped = named.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("all_")).where(F.size("all_") >= 2)
    counts = named.where("category <> 'sonstiges'").groupBy(*key, "category").agg(F.count("*").alias("n_"))
    common = counts.groupBy(*key).agg(F.min_by("category", F.struct(-F.col("n_"), F.col("category"))).alias("common_"))
    line = F.transform("all_", lambda x: F.when(x["t"] == LATE, x["n"]).otherwise(F.concat(x["t"], F.lit(" "), x["n"])))
    first = F.get("all_", F.lit(0))["t"]
    common = common.select("common_", *[F.col(k).alias(f"{k}_") for k in key])
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    j = grouped.join(common, same, "left").select(*key, "all_", "common_")
    own = j.withColumn("own_", category)
    return own.select(
        *key,
        F.col("heading").alias("title"),
        F.nullif(first, F.lit(LATE)).alias("time"),
        F.concat(F.lit("Line-up: "), F.array_join(line, " · ")).alias("description"),
        F.when(F.col("own_") != "sonstiges", F.col("own_")).otherwise(F.coalesce("common_", F.lit("sonstiges"))).alias("category"),
        F.size("all_").alias("n_slots"),
    )


def nearest_year(month: Column, day: Column, today: Column, past: int = 183) -> Column:
    """Day and month in this year, or in the next if that is over ``past`` days ago."""
    this = ex.day_of(F.year(today), month, day)
    return F.when(F.datediff(today, this) > past, ex.day_of(F.year(today) + 1, month, day)).otherwise(this)


def year_by_weekday(month: Column, day: Column, weekday: Column, today: Column, past: int = 183) -> Column:
    """The first of last, this and next year in which the date falls on ``weekday`` (0 is Monday) and is not over ``past`` days ago."""
    days = F.array(*[ex.day_of(F.year(today) + k, month, day) for k in (-1, 0, 1)])
    fit = F.filter(days, lambda d: d.isNotNull() & (F.weekday(d) == weekday) & (F.datediff(today, d) <= past))
    return F.array_min(fit)


def accepted_runs(news: DataFrame, runs: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings to store, ledger entries): a source whose run failed, or is empty where the last good one was not, keeps its old listings.

    ``runs`` has source, error (null if none); ``ledger`` has source, id, ok, event_count.
    """
    n = news.groupBy("source").agg(F.count("*").alias("n"))
    before = ledger.where("ok").groupBy("source").agg(F.max_by("event_count", "id").alias("before"))
    judged = runs.join(n, "source", "left").join(before, "source", "left").select("source", "error", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("before", F.lit(0)).alias("before"))
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when((F.col("n") == 0) & (F.col("before") > 0), F.lit("no rows where the last good run had some"))
    entries = judged.select("source", reason.isNull().alias("ok"), F.col("n").cast("long").alias("event_count"), reason.alias("error"))
    return news.join(entries.where("ok").select("source"), "source", "left_semi"), entries


def umbrella_rows(slots: DataFrame, lineups: DataFrame) -> DataFrame:
    """Slots and line-up rows as one list of listings."""
    return slots.unionByName(lineups.withColumn("raw_category", F.col("heading")), allowMissingColumns=True)


def is_large_house(venue_slug: Column) -> Column:
    """Whether a venue's slug names a large house; no venue is none."""
    parts = F.array(*map(F.lit, rules.LARGE_HOUSES))
    return once(F.coalesce(venue_slug, F.lit("")), lambda slug: F.exists(parts, lambda p: F.contains(slug, p)))


def allowed(rows: DataFrame) -> DataFrame:
    """Rows (title, venue, categories) whose categories hold a listed word, and demonstrations by title; with raw_category and category."""
    words = F.lower(F.coalesce("categories", F.lit("")))
    raw = rows.withColumn("listed_", classify.first_rule(words, rules.FEED_CATEGORIES)).withColumn("raw_category", F.coalesce("listed_", F.lit("")))
    slugs = classify.slugged(raw, rs_="raw_category", ts_="title", vs_="venue")
    judged = slugs.withColumn("category", classify.category(F.col("rs_"), F.col("ts_"), F.col("vs_")))
    return judged.where("listed_ is not null or category = 'demo'").drop("listed_", "rs_", "ts_", "vs_")


def place_name(location: Column) -> Column:
    """What stands before the first comma; links and mail addresses are no place."""
    name = F.trim(F.substring_index(location, ",", 1))
    return F.when((name != "") & ~F.contains(name, F.lit("://")) & ~F.contains(name, F.lit("@")), name)


def place_in_region(location: Column) -> tuple[Column, Column]:
    """(place, whether it is in reach) of "town, place, street"; a place in a town around carries the town's name."""
    parts = F.filter(F.transform(F.split(F.coalesce(location, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")

    def told(x: Column) -> Column:
        town, place = F.get(x, F.lit(0)), F.get(x, F.lit(1))
        here = F.lower(town) == "dresden"
        near = classify.region(slugify(town)) == "umland"
        return F.struct(place.alias("place"), town.alias("town"), here.alias("here"), F.when(~here, near).alias("near"))

    def judged(x: Column) -> Column:
        around = F.when(x["near"], F.concat_ws(" ", x["place"], x["town"]))
        place = F.when(x["here"], x["place"]).when(x["town"].isNotNull(), around)
        return F.struct(place.alias("place"), F.when(x["town"].isNotNull(), x["here"] | x["near"]).otherwise(True).alias("near"))

    both = once(once(parts, told), judged)
    return both["place"], both["near"]


def assemblies(texts: DataFrame, start: str, end: str, column: str = "value") -> DataFrame:
    """``texts`` with a row for each assembly of a JSON text that takes place between two days: date, time, title, venue, description.

    Assemblies without place or title, called off, or with no valid day are left out; a procession's starting point is its place.
    """
    fields = ("Startpunkt", "Ort", "Thema", "Status", "Datum", "Zeit", "Veranstalter", "Teilnehmer")
    kind = "struct<Versammlungen: array<struct<" + ", ".join(f"{f}: string" for f in fields) + ">>>"
    rest = [c for c in texts.columns if c != column]
    each = texts.select(*rest, F.explode(F.from_json(column, kind)["Versammlungen"]).alias("v_"))
    field = lambda f: F.nullif(F.col(f"v_.{f}"), F.lit(""))
    off = F.exists(F.array(*map(F.lit, rules.ASSEMBLY_OFF)), lambda p: F.contains(F.lower(F.coalesce(field("Status"), F.lit(""))), p))
    clock = r"([0-9]{1,2})[.:]([0-9]{2})"
    hour = F.regexp_extract(field("Zeit"), clock, 1)
    told = lambda before, f, after: F.concat(F.lit(before), f, F.lit(after))
    place = ex.squeezed(F.coalesce(field("Startpunkt"), field("Ort")))
    lines = [
        F.when(field("Startpunkt").isNotNull(), told("Aufzug, Startpunkt: ", place, ".")),
        told("Veranstalter/-in: ", ex.squeezed(field("Veranstalter")), "."),
        told("Teilnehmerprognose lt. Veranstalter: ", ex.squeezed(field("Teilnehmer")), "."),
    ]
    day = F.when(field("Datum").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(field("Datum"), F.lit("yyyy-MM-dd"))).cast("date")
    rows = each.where(~off).select(
        *rest,
        day.alias("date"),
        F.when(hour != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.regexp_extract(field("Zeit"), clock, 2))).alias("time"),
        ex.squeezed(field("Thema")).alias("title"),
        place.alias("venue"),
        F.nullif(F.concat_ws(" ", *lines), F.lit("")).alias("description"),
    )
    return rows.where(F.col("title").isNotNull() & F.col("venue").isNotNull() & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def _galleries(node: object) -> list[dict]:
    out, open_ = [], [node]
    while open_:
        x = open_.pop()
        if isinstance(x, dict):
            for k, v in reversed(x.items()):
                if k.endswith("_galleryData") and isinstance(v, dict):
                    out.append(v)
                else:
                    open_.append(v)
        elif isinstance(x, list):
            open_.extend(reversed(x))
    return out


@F.pandas_udf(ArrayType(StringType()))
def _gallery_json(texts: pd.Series) -> pd.Series:
    def items(text: str | None) -> list[str]:
        try:
            found = _galleries(json.loads(text or "null"))
        except ValueError:
            return []
        return [json.dumps(i) for g in found for i in g.get("items") or []]

    return texts.map(items)


def gallery_items(texts: DataFrame, column: str = "value") -> DataFrame:
    """``texts`` with a row for each item of a gallery (any key that ends in "_galleryData", at any depth): title, description, link, media.

    Depth is unknown, so a JSON walk in Arrow batches finds the items; broken JSON gives none.
    """
    rest = [c for c in texts.columns if c != column]
    each = texts.select(*rest, F.posexplode(_gallery_json(F.col(column))).alias("item", "j_"))
    meta = "metaData struct<title: string, description: string, name: string, link: struct<data: struct<url: string>>>, mediaUrl string"
    got = each.select(*rest, "item", F.from_json("j_", meta).alias("i_"))
    return got.select(
        *rest,
        "item",
        ex.squeezed(F.col("i_.metaData.title")).alias("title"),
        F.col("i_.metaData.description").alias("description"),
        F.col("i_.metaData.link.data.url").alias("link"),
        F.coalesce("i_.mediaUrl", "i_.metaData.name").alias("media"),
    ).where("title is not null")

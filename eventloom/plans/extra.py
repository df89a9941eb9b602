"""Queries of list views, registry documents and feeds over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions import text as tx
from ..operators import dedup, feeds, registry as reg, views
from ..sources import tables
from . import sql as s
from .catalog import _fx, c, listings, on_listings, query

TODAY = "2024-01-15"
_V = """v as (select s_suppkey as k, s_name as name, replace(lower(s_name), '#', '-') as slug,
  case when s_suppkey % 7 = 0 then 'treffpunkt' when s_suppkey % 3 = 0 then 'club' end as kind,
  case when s_suppkey % 5 = 0 then null else 51.0 + (s_suppkey % 100) / 1000.0 end as lat,
  case when s_suppkey % 5 = 0 then null else 13.5 + (s_suppkey % 90) / 1000.0 end as lon,
  case when s_suppkey % 4 = 0 then 'weiter' else 'dresden' end as region,
  case when s_suppkey % 6 = 0 then null else 'https://' || s_suppkey end as homepage from supplier)"""
_E = """e as (select fx.id, fx.date, fx.time, fx.title, fx.venue, fx.source_pos, fx.raw_category as category,
  replace(lower(fx.venue), '#', '-') as ort, case when fx.id % 9 = 0 then fx.id - 1 end as duplicate_of,
  fx.id % 13 = 0 as ongoing, case when fx.id % 10 = 0 then 'weiter' when fx.id % 3 = 0 then null else 'dresden' end as region,
  case when fx.id % 4 = 0 then 'a,b' when fx.id % 4 = 1 then 'b' else '' end as taglist from fx)"""


def venues_of(spark: SparkSession, d: str) -> DataFrame:
    tables.read_table(spark, d, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(f"with {_V} select * from v").withColumns({x: c(x).cast("double") for x in ("lat", "lon")})


def events_of(spark: SparkSession, d: str) -> DataFrame:
    listings(spark, d)
    out = spark.sql(f"with {s.LISTINGS}, {_E} select * from e")
    return out.withColumn("source", F.concat(F.lit("q"), c("source_pos").cast("string"))).withColumn("tags", F.array_remove(F.split("taglist", ","), ""))


def _ve(select: str, more: str = "") -> str:
    return f"with {s.LISTINGS}, {_V}, {_E}{', ' + more if more else ''} {select}"


# --- list views -----------------------------------------------------------------------------------
@query("flt4_events_in_range", _ve("""select e.id, case when coalesce(v.kind, '') <> 'treffpunkt' then e.ort end as ort, v.name as venue_name from e left join v on v.slug = e.ort
  where duplicate_of is null and date between date '2024-01-05' and date '2024-01-25' and category in ('click', 'view', 'error') and category not in ('error') and coalesce(v.region, '') <> 'weiter'"""))
def flt4(spark: SparkSession, d: str) -> DataFrame:
    return views.events_in_range(events_of(spark, d), venues_of(spark, d), "2024-01-05", "2024-01-25", ["click", "view", "error"], ["error"], far=False).select("id", "ort", "venue_name")


@query("flt5_page_filter", _ve("""select id from e where not ongoing and coalesce(region, 'dresden') = 'dresden' and (source_pos not in (1, 2, 3, 4) or source_pos in (2, 3))
  and taglist like '%a%' and contains(lower(concat(title, ' ', venue)), 'zugabe')"""))
def flt5(spark: SparkSession, d: str) -> DataFrame:
    return views.page_filter(events_of(spark, d), ["q2", "q3"], ["q1", "q2", "q3", "q4"], ["a", "x"], "Zugabe").select("id")


@query("flt6_chosen_categories", _ve("select id, category from e where category in ('click', 'view') union all select id, 'unhidden' as category from e where category not in ('error', 'click')"))
def flt6(spark: SparkSession, d: str) -> DataFrame:
    e = events_of(spark, d)
    hidden = e.where("category in ('error', 'click')").select("category").distinct()
    chosen = views.with_categories(e, views.chosen_categories("click, view"), hidden).select("id", "category")
    return chosen.unionAll(views.with_categories(e, views.chosen_categories("alle"), hidden).select("id", F.lit("unhidden").alias("category")))


@query("flt7_flt8_places", f"with {_V} select slug, lat is not null and lat between 51.02 and 51.05 and lon between 13.5 and 13.56 as inside from v where lat is not null and coalesce(kind, '') <> 'treffpunkt'")
def flt8(spark: SparkSession, d: str) -> DataFrame:
    v = venues_of(spark, d).where(views.located(c("lat"), c("lon")) & views.not_meeting_point(c("kind")))
    return v.select("slug", views.in_box(c("lat"), c("lon"), 51.02, 51.05, 13.5, 13.56).alias("inside"))


@query("flt10_publishable", _ve("select id from e where date >= date '2024-01-02'"))
def flt10(spark: SparkSession, d: str) -> DataFrame:
    return views.publishable(events_of(spark, d).where(c("date") >= F.lit("2024-01-02").cast("date"))).select("id")


@query("joi11_tags_per_event", _ve("select id as uid, case taglist when 'a,b' then 'b,a' else taglist end as tags from e where taglist <> ''"))
def joi11(spark: SparkSession, d: str) -> DataFrame:
    tagged = events_of(spark, d).select(c("id").alias("uid"), F.explode("tags").alias("tag"))
    return views.tags_per_event(tagged, ["b", "a"]).select("uid", F.array_join("tags", ",").alias("tags"))


_PIN = "lat is not null and coalesce(kind, '') <> 'treffpunkt'"


@query("joi13_pins_located", _ve(f"""select v.slug, count(*) as n from e join v on v.slug = e.ort where {_PIN} group by 1
  union all select '(located)', count(*) from e where ort in (select slug from v where {_PIN})
  union all select '(missing)', count(*) from e where ort not in (select slug from v where {_PIN})"""))
def joi13(spark: SparkSession, d: str) -> DataFrame:
    on_map, totals = views.pins(events_of(spark, d), venues_of(spark, d))
    both = F.array(*[F.struct(F.lit(f"({x})").alias("slug"), c(x).alias("n")) for x in ("located", "missing")])
    return on_map.select("slug", "n").unionAll(totals.select(F.explode(both).alias("x")).select("x.slug", "x.n"))


@query("joi14_identity_winners", _ve("""select k as key, date, arg_min(id, (coalesce(time, '99:99'), id)) as uid from (select *, 'q' || source_pos || '|https://x/' || category || '|' || cast(date as varchar) as k from e where duplicate_of is null) group by 1, 2"""))
def joi14(spark: SparkSession, d: str) -> DataFrame:
    e = events_of(spark, d).withColumn("url", F.concat(F.lit("https://x/"), "category")).withColumn("uid", c("id"))
    won = views.identity_winners(e)
    plain = F.concat_ws("|", "source", "url", c("date").cast("string"))
    named = e.select("uid", plain.alias("key"))
    return won.drop("key").join(named, "uid").select("key", "date", "uid")


@query("joi16_event_lookup", _ve("select e.id as uid, e.title, v.name as venue_name, v.region as venue_region from e left join v on v.slug = e.ort where e.id = 12"))
def joi16(spark: SparkSession, d: str) -> DataFrame:
    e = events_of(spark, d).withColumn("uid", c("id").cast("string"))
    return views.event_by_uid(e, venues_of(spark, d), "12").select(c("id").alias("uid"), "title", "venue_name", "venue_region")


@query("joi8_top5_detail_pages", _ve("""select url, min(date) as date from (
    select 'https://www.good.de/' || (id % 5000) as url, date, id from e where id % 2 = 0
    union all select 'https://more.de/' || (id % 3000) as url, date, id from e where id % 5 = 0)
  where cast(regexp_extract(url, '(\\d+)$', 1) as bigint) % 11 <> 0 group by 1 order by 2, 1 limit 2500"""))
def joi8(spark: SparkSession, d: str) -> DataFrame:
    host = F.when(c("id") % 2 == 0, "https://www.good.de/").otherwise("https://bad.de/")
    e = events_of(spark, d).select(c("id").alias("uid"), "date", F.lit("short").alias("description"), F.concat(host, (c("id") % 5000).cast("string")).alias("url"), "id")
    links = e.where("id % 5 = 0").select("uid", c("id").alias("listing_id"))
    rows = e.select("id", F.concat(F.lit("https://more.de/"), (c("id") % 3000).cast("string")).alias("url"))
    n = F.regexp_extract("url", r"(\d+)$", 1).cast("long")
    known = e.select("url").unionAll(rows.select("url")).where(n % 11 == 0).distinct()
    return views.detail_candidates(e, links, rows, known, ["good.de", "more.de"])


@query("agg7_enrichment_targets", _ve("select v.slug, count(*) as n from v join e on e.ort = v.slug where v.homepage is null and coalesce(v.kind, '') <> 'treffpunkt' and e.date >= date '2024-01-15' group by 1 order by 2 desc, 1 limit 25"))
def agg7(spark: SparkSession, d: str) -> DataFrame:
    return views.enrichment_targets(venues_of(spark, d), events_of(spark, d), "homepage", TODAY, 25)


@query("agg19_coverage", _ve("""select field, count(*) filter (val <> '') as have, count(*) as venues, round(count(*) filter (val <> '') / count(*), 6) as share from (
    select 'homepage' as field, coalesce(homepage, '') as val from v where slug in (select ort from e where date >= date '2024-01-15')
    union all select 'lat', coalesce(cast(lat as varchar), '') from v where slug in (select ort from e where date >= date '2024-01-15')) group by 1"""))
def agg19(spark: SparkSession, d: str) -> DataFrame:
    return views.coverage(venues_of(spark, d), events_of(spark, d), ["homepage", "lat"], TODAY)


@query("top6_hearts", _ve("select id, case when date >= date '2024-01-15' then 'coming' else 'past' end as part from e where id % 97 = 0"))
def top6(spark: SparkSession, d: str) -> DataFrame:
    e = events_of(spark, d).withColumn("uid", c("id"))
    coming, past = views.hearts(e, e.where("id % 97 = 0").select("uid"), TODAY)
    return coming.select("id", F.lit("coming").alias("part")).unionAll(past.select("id", F.lit("past").alias("part")))


@query("set3_used_venues", _ve("select slug from v where slug in (select ort from e where id % 50 = 0) or k % 10 = 0 or k % 9 = 0"))
def set3(spark: SparkSession, d: str) -> DataFrame:
    v = venues_of(spark, d)
    return views.used_venues(v, events_of(spark, d).where("id % 50 = 0"), v.where("k % 10 = 0"), v.where("k % 9 = 0")).select("slug")


@query("ext33_pages_union", _ve("select id from (select *, row_number() over (partition by title, ort order by date, id) as r from e where date between date '2024-01-03' and date '2024-01-28') where r = 1"))
def ext33(spark: SparkSession, d: str) -> DataFrame:
    return views.first_places(events_of(spark, d), ["title", "ort"], ["date", "id"], "2024-01-03", "2024-01-28").select("id")


@query("ext34_list_and_pages", _ve("""select e.id, coalesce(e.time, case when u.url is not null and (e.id % 700) % 3 = 0 then '21:00' end) as time from (select *, id % 700 as url from e) e
  left join (select id % 700 as url from e group by 1 order by min(date), cast(id % 700 as varchar) limit 100) u on u.url = e.url"""))
def ext34(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = events_of(spark, d).select("id", "date", "time", none.alias("price_text"), none.alias("description"), (c("id") % 700).cast("string").alias("url"))
    pages = rows.select("url").distinct().where(c("url").cast("long") % 3 == 0).select("url", F.lit("21:00").alias("time"), none.alias("price_text"), none.alias("description"))
    return views.with_pages(rows, pages, 100).select("id", "time")


def _duplicates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = listings(spark, d).withColumn("category", F.lit("musik"))
    ready = dedup.prepared(rows, umbrella_source="q03", sections=("view",))
    ranked = ready.join(rows.select("id", "rank"), "id")
    return rows, dedup.find_duplicates(ranked, c("rank"), ("q05", "q11"))


@query("clu8_find_duplicates")
def clu8(spark: SparkSession, d: str) -> DataFrame:
    return _duplicates(spark, d)[1].withColumn("score", F.round("score", 6))


@query("agg8_duplicate_sources")
def agg8(spark: SparkSession, d: str) -> DataFrame:
    rows, found = _duplicates(spark, d)
    return views.duplicate_counts(found, rows)


# --- registry documents -----------------------------------------------------------------------------
@query("src4_registry_load", f"with {_V} select slug, name, 'Club ' || name as first_alias, region, k % 10 = 0 as herz, lat from v")
def src4(spark: SparkSession, d: str) -> DataFrame:
    v = venues_of(spark, d)
    one = F.struct("name", F.array(F.concat(F.lit("Club "), "name")).alias("aliase"), "region", (c("k") % 10 == 0).alias("herz"), "lat")
    texts = v.select(F.to_json(F.create_map("slug", one)).alias("value"))
    return reg.load_registry(texts).select("slug", "name", F.get("aliase", F.lit(0)).alias("first_alias"), "region", "herz", "lat")


@query("src5_flavours", f"with {_V} select slug, case k % 3 when 0 then 'techno' else 'jazz' end as flavour from v where k % 3 <> 2 and k % 8 <> 0")
def src5(spark: SparkSession, d: str) -> DataFrame:
    v = venues_of(spark, d)
    main = F.when(c("k") % 3 == 0, "techno").when(c("k") % 3 == 1, "jazz").otherwise("unklar")
    texts = v.select(F.to_json(F.struct(F.create_map("slug", F.struct(main.alias("haupt"))).alias("orte"))).alias("value"))
    return reg.load_flavours(texts, v.where("k % 8 <> 0"))


@query("src11_registry_save", f"""with {_V} select slug, '{{"name":"' || name || '","region":"' || region || '"' || case when kind is not null then ',"art":"' || kind || '"' else '' end
  || case when k % 10 = 0 then ',"herz":true' else '' end || case when homepage is not null then ',"homepage":"' || homepage || '"' else '' end || '}}' as json from v""")
def src11(spark: SparkSession, d: str) -> DataFrame:
    v = venues_of(spark, d).select("slug", "name", F.array().cast("array<string>").alias("aliase"), "region", F.coalesce("kind", F.lit("sonstiges")).alias("art"), (c("k") % 10 == 0).alias("herz"), "homepage")
    return reg.registry_json(v)


@query("cur2_cur4_rename_and_favour", f"with {_V} select case when k % 11 = 0 then slug || '-neu' else slug end as slug, k % 10 = 0 as herz from v")
def cur2(spark: SparkSession, d: str) -> DataFrame:
    v = venues_of(spark, d).withColumn("herz", F.lit(False))
    marked = reg.set_favourites(v, v.where("k % 10 = 0").select("slug", F.lit(True).alias("herz")))
    return reg.renamed(marked, v.where("k % 11 = 0").select(c("slug").alias("old"), F.concat("slug", F.lit("-neu")).alias("new"))).select("slug", "herz")


@query("cur6_registry_import", f"with {_V} select slug, case when k % 2 = 0 then name || ',Club ' || name else '' end as aliases from v")
def cur6(spark: SparkSession, d: str) -> DataFrame:
    v = venues_of(spark, d)
    some = v.where("k % 2 = 0")
    a = some.select("slug", F.concat(F.lit("Club "), "name").alias("alias"), F.lit(2).alias("pos")).unionAll(some.select("slug", c("name").alias("alias"), F.lit(1).alias("pos")))
    return reg.nested(v, a).select("slug", F.array_join("aliases", ",").alias("aliases"))


# --- feeds -----------------------------------------------------------------------------------------
@query("ext13_calendar_rows", _fx("""select id, title || ', live' as title, cast(date as varchar) as date, case when id % 3 = 0 then null else coalesce(time, '20:00') end as time, venue from fx"""))
def ext13(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("date", "yyyyMMdd")
    clock = F.replace(F.coalesce("time", F.lit("20:00")), F.lit(":"), F.lit(""))
    start = F.when(c("id") % 3 == 0, F.concat(F.lit("DTSTART;VALUE=DATE:"), day)).otherwise(F.concat(F.lit("DTSTART;TZID=Europe/Berlin:"), day, F.lit("T"), clock, F.lit("00")))
    entry = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:"), F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("\\,\r\n  live\r\n"), start, F.lit("\r\nLOCATION:"), "venue", F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    rows = listings(spark, d).select("id", entry.alias("value"))
    return feeds.calendar_rows(rows).select("id", "title", c("date").cast("string").alias("date"), "time", "venue")


@query("ext14_recurring_days", _fx("""select id, cast(unnest(generate_series(date, least(date + 40, date '2024-02-20'), case when id % 2 = 0 then interval 3 day else interval 7 day end)) as date) as date from fx where id % 5 <> 0
  union all select id, date from fx where id % 5 = 0"""))
def ext14(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d)
    rules = rows.select(
        "id", c("date").alias("first"), F.when(c("id") % 5 == 0, "MONTHLY").when(c("id") % 2 == 0, "DAILY").otherwise("WEEKLY").alias("freq"),
        F.when((c("id") % 5 != 0) & (c("id") % 2 == 0), 3).otherwise(1).alias("every"), F.date_add("date", 40).alias("until"),
        F.when(c("id") % 5 == 0, 1).alias("times"), F.array(F.lit("1999-01-01").cast("date")).alias("skipped"),
    )
    return feeds.recurring_days(rules, "2020-01-01", "2024-02-20")[0]


@query("ext15_news_rows", _fx("select id, title, date, 'https://x/' || id as link from fx where id % 4 <> 0"))
def ext15(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(c("id") % 4 == 0, "31.02.2024").otherwise(F.date_format("date", "dd.MM.yyyy"))
    item = F.concat(F.lit("<rss><item><title>"), day, F.lit(": "), F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("</title><link>https://x/"), c("id").cast("string"), F.lit("</link></item></rss>"))
    return feeds.news_rows(listings(spark, d).select("id", item.alias("value"))).select("id", "title", "date", "link")


on_listings(
    "ext16_labelled_text",
    {
        "price": lambda: F.try_element_at(feeds.labelled(_told(), ("Preis", "Alter")), F.lit("preis")),
        "age": lambda: F.try_element_at(feeds.labelled(_told(), ("Preis", "Alter")), F.lit("alter")),
        "teaser": lambda: feeds.teaser(_told(), "Tickets"),
    },
    {"price": "(id % 50) || ' Euro'", "age": "null", "teaser": "title || ' Preis: ' || (id % 50) || ' Euro Preis: 99'"},
)
_told = lambda: F.concat("title", F.lit("\n\n Preis: "), (c("id") % 50).cast("string"), F.lit(" Euro\nPreis: 99\nTickets & Infos\nmore"))
on_listings(
    "ext35_page_text",
    {"text": lambda: feeds.page_text(F.concat("title", F.lit("  \n "), "venue"), "nothing here", 30)},
    {"text": "case when length(title || ' ' || venue) >= 30 then title || ' ' || venue end"},
)
on_listings(
    "ext25_repaired",
    {"text": lambda: ex.repaired(F.decode(F.encode("title", "UTF-8"), "ISO-8859-1"))},
    {"text": "title"},
)
on_listings(
    "ext26_year_rules",
    {
        "half": lambda: feeds.nearest_year(F.month("date"), F.day("date"), F.lit("2024-09-01").cast("date")),
        "weekday": lambda: feeds.year_by_weekday(F.month("date"), F.day("date"), F.weekday("date"), F.lit("2024-03-01").cast("date")),
    },
    {"half": "case when date '2024-09-01' - date > 183 then cast(date + interval 1 year as date) else date end", "weekday": "date"},
)


@query("ext18_lineup_rows", _fx("""select source_pos, date, raw_category as heading, venue, nullif(min(coalesce(time, '99:99')), '99:99') as time, count(*) as n_slots,
  'Line-up: ' || string_agg(case when time is null then title else time || ' ' || title end, ' · ' order by coalesce(time, '99:99'), title) as description,
  arg_min(case when raw_category = 'click' then 'klick' else 'sonstiges' end, id) as category
  from fx where raw_category <> 'view' group by 1, 2, 3, 4 having count(*) >= 2"""))
def ext18(spark: SparkSession, d: str) -> DataFrame:
    slots = listings(spark, d).withColumn("heading", c("raw_category")).withColumn("category", F.lit("sonstiges"))
    rows = feeds.lineup_rows(slots, ("view",), F.when(c("heading") == "click", "klick").otherwise("sonstiges"))
    return rows.select(F.substring("source", 2, 2).cast("int").alias("source_pos"), "date", "heading", "venue", "time", "n_slots", "description", "category")


@query("str2_run_gate", _fx("""select source_pos, count(*) as n from fx where source_pos % 5 <> 0 group by 1
  union all select source_pos, cast(null as bigint) as n from (select distinct source_pos from fx) where source_pos % 5 = 0"""))
def str2(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d)
    runs = rows.select("source", F.when(c("rank") % 5 == 0, "timeout").alias("error"), "rank").distinct()
    ledger = rows.select("source", F.lit(1).alias("id"), F.lit(True).alias("ok"), F.lit(5).alias("event_count")).distinct()
    kept, entries = feeds.accepted_runs(rows, runs.drop("rank"), ledger)
    n = kept.groupBy("source").agg(F.count("*").alias("n"))
    return entries.join(n, "source", "left").select(F.substring("source", 2, 2).cast("int").alias("source_pos"), "n")


on_listings("scl29_scl30_links", {"plain": lambda: tx.without_query(F.concat(F.lit("https://x.de/"), c("id").cast("string"), F.lit("?a=1#b")))}, {"plain": "'https://x.de/' || id"})

"""Queries of page links, feeds, registry upkeep and duplicate bookings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, rules
from ..functions import text as tx
from ..operators import feeds, hearts, history, pages, venues, views
from ..sources import tables
from . import sql as s
from .catalog import _fx, c, listings, on_listings, query
from .extra import _V, _ve, events_of, venues_of

q = s.q
#: The test pages hold local links only, so links, an address and a place are put behind each, by the same SQL text in both engines.
_PX = """px as (select page_id, concat(coalesce(html, ''),
  '<a class="k" href="https://www.haus', page_id % 7, '.de/x">', case page_id % 4 when 0 then concat('www.haus', page_id % 7, '.de') when 1 then 'Website' when 2 then 'Tickets' else concat('Haus', page_id % 7, '.DE/') end, '</a>',
  case when page_id % 3 = 0 then '<a href="https://www.eventim.de/t">Website</a>' else '' end,
  case when page_id % 5 < 2 then '<a href="https://x.com/h">Web</a>' else '' end,
  case when page_id % 6 = 0 then '<a href="https://zweites.de/">zur <b>Website</b></a>' else '' end,
  '<a href="https://portal.example/own">Website</a><a href="https://www.haus', page_id % 7, '.de/x">zur Homepage</a>',
  '<address><b>Haus ', page_id % 50, '</b> <a href="/ort/', page_id, '">mehr</a></address>',
  '<div class="box-location-description">Haus<br>Weg ', page_id % 90, '<br/>01', lpad(cast(page_id % 1000 as string), 3, '0'), ' Neue Stadt</div>',
  '<a href="https://www.openstreetmap.org/?mlat=', 50 + page_id % 3, '.0512&mlon=13.7250">Karte</a>') as html from pages)"""
_LINKS = rf"""{_PX}, l as (select page_id, unnest(range(0, len(h))) as pos, unnest(h) as href, unnest(t) as label from (
  select page_id, regexp_extract_all(html, {q(pages.LINK)}, 1) as h,
    list_transform(regexp_extract_all(html, {q(pages.LINK)}, 2), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as t from px))"""


def _any(parts: tuple[str, ...]) -> str:
    return q("|".join(p.replace(".", r"\.") for p in parts))


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    tables.read_table(spark, d, "pages").createOrReplaceTempView("pages")
    return spark.sql(f"with {_PX} select * from px")


# --- pages ----------------------------------------------------------------------------------------
@query("ext11_outbound_links", rf"""with {_LINKS}, h as (select *, replace(lower(regexp_extract(href, '^[a-z]+://([^/?#]*)', 1)), 'www.', '') as host, lower(label) as said from l where href like 'http%'),
  o as (select page_id, href, any_value(host) as host, arg_min(said, pos) as said, min(pos) as pos from h where not contains(host, 'portal.example') group by 1, 2),
  k as (select *, case when regexp_matches(host, {_any(pages.SOCIAL_HOSTS)}) then 'social' when regexp_matches(host, {_any(pages.NO_HOMEPAGE_HOSTS)}) then 'other'
    when (contains(said, '.') and not contains(said, ' ') and replace(rtrim(said, '/'), 'www.', '') = host) or said in ({', '.join(map(q, pages.HOMEPAGE_LABELS))}) then 'homepage' else 'other' end as kind from o),
  g as (select page_id, arg_min(href, pos) filter (kind = 'homepage') as homepage, count(*) filter (kind = 'homepage') as n_homepage, count(*) filter (kind = 'social') as n_social, count(*) filter (kind = 'other') as n_other from k group by 1)
  select *, case when n_homepage = 1 then 'ok' when n_homepage > 1 then 'ok_mehrdeutig' when n_social > 0 then 'nur_social' else 'not_found' end as status from g""")
def ext11(spark: SparkSession, d: str) -> DataFrame:
    return pages.outbound(pages_of(spark, d), "portal.example")


@query("ext12_alias_targets", "select 'Haus ' || (page_id % 50) || ' mehr' as label, 'https://portal.example/ort/' || min(page_id) as href from pages group by 1")
def ext12(spark: SparkSession, d: str) -> DataFrame:
    return pages.alias_targets(pages_of(spark, d), "https://portal.example")


_STREET, _TOWN = "'Weg ' || (page_id % 90)", "'01' || lpad(cast(page_id % 1000 as varchar), 3, '0')"


@query("ext10_venue_locations", f"""select page_id, {_STREET} || ', ' || {_TOWN} || ' Neue Stadt' as address, {_STREET} as street, {_TOWN} as postcode, 'Neue Stadt' as city,
  case when page_id % 3 = 1 then 51.0512::double end as lat, case when page_id % 3 = 1 then 13.725::double end as lon from pages""")
def ext10(spark: SparkSession, d: str) -> DataFrame:
    return pages.locations(pages_of(spark, d))


# --- feeds ----------------------------------------------------------------------------------------
_house = "case id % 5 when 0 then 'Semperoper, ' when 1 then 'Domino ' when 2 then 'Grünes Gewölbe ' else '' end"
on_listings(
    "ext20_large_houses",
    {"large": lambda: feeds.is_large_house(tx.slugify(F.concat(F.expr(_house), "venue")))},
    {"large": f"regexp_matches({s.slug(f'(({_house}) || venue)')}, {_any(rules.LARGE_HOUSES)})"},
)
_cats = "case id % 6 when 0 then 'Konzert,Rock' when 1 then 'Vortrag' when 2 then 'Voku, KüFa' when 3 then 'Demo' when 5 then 'Theater & Film' end"


@query("ext21_allowed_entries", _fx("select id, case when id % 12 = 1 then '' else case id % 6 when 0 then 'konzert' when 2 then '' when 3 then 'kundgebung' else 'film' end end as raw_category from fx where id % 6 in (0, 2, 3, 5) or id % 12 = 1"))
def ext21(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(c("id") % 12 == 1, F.lit("Demo für alle")).otherwise(c("title"))
    rows = listings(spark, d).select("id", title.alias("title"), "venue", F.expr(_cats).alias("categories"))
    return feeds.allowed(rows).select("id", "raw_category")


_loc = "case id % 6 when 0 then 'Dresden, ' || venue || ', Weg 1' when 1 then 'Pirna, ' || venue when 2 then 'Leipzig, ' || venue when 3 then 'x@y.de, Dresden' when 4 then '' else 'Pirna' end"
on_listings(
    "ext22_places",
    {
        "name": lambda: feeds.place_name(F.expr(_loc)),
        "place": lambda: feeds.place_in_region(F.expr(_loc))[0],
        "near": lambda: feeds.place_in_region(F.expr(_loc))[1],
    },
    {
        "name": "case id % 6 when 0 then 'Dresden' when 1 then 'Pirna' when 2 then 'Leipzig' when 5 then 'Pirna' end",
        "place": "case id % 6 when 0 then trim(venue) when 1 then trim(venue) || ' Pirna' when 5 then 'Pirna' end",
        "near": "id % 6 in (0, 1, 4, 5)",
    },
)


@query("src6_assemblies", _fx("""select id, date, '09:30' as time, title, case when id % 3 = 0 then venue || ' Start' else venue end as venue,
  nullif(concat_ws(' ', case when id % 3 = 0 then 'Aufzug, Startpunkt: ' || venue || ' Start.' end, case when id % 4 = 0 then 'Veranstalter/-in: V ' || id || '.' end), '') as description
  from fx where id % 5 <> 0 and id % 7 <> 1 and date between date '2024-01-03' and date '2024-02-10'"""))
def src6(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct(
        F.when(c("id") % 3 == 0, F.concat("venue", F.lit("  Start"))).alias("Startpunkt"),
        c("venue").alias("Ort"),
        c("title").alias("Thema"),
        F.when(c("id") % 5 == 0, "Verboten").otherwise("ok").alias("Status"),
        F.when(c("id") % 7 == 1, "2024-02-31").otherwise(c("date").cast("string")).alias("Datum"),
        F.lit("9.30 - 11.00 Uhr").alias("Zeit"),
        F.when(c("id") % 4 == 0, F.concat(F.lit("V "), c("id").cast("string"))).alias("Veranstalter"),
    )
    texts = listings(spark, d).select("id", F.to_json(F.struct(F.array(one).alias("Versammlungen"))).alias("value"))
    return feeds.assemblies(texts, "2024-01-03", "2024-02-10")


@query("ext32_gallery_items", _fx("select id, 0 as item, title || ' A' as title, 'https://x/' || id as link, 'm1' as media from fx union all select id, 1, title || ' B', null, 'n2' from fx where id % 2 = 0"))
def ext32(spark: SparkSession, d: str) -> DataFrame:
    a = F.concat(F.lit('{"metaData":{"title":"'), "title", F.lit(' A","link":{"data":{"url":"https://x/'), c("id").cast("string"), F.lit('"}}},"mediaUrl":"m1"}'))
    b = F.concat(F.lit('{"metaData":{"title":"'), "title", F.lit('  B","name":"n2"}}'))
    items = F.when(c("id") % 2 == 0, F.concat(a, F.lit(","), b)).otherwise(a)
    deep = F.concat(F.lit('{"p":[{"q":{"c_galleryData":{"items":['), items, F.lit("]}}},7]}"))
    return feeds.gallery_items(listings(spark, d).select("id", deep.alias("value"))).drop("description")


# --- registry -------------------------------------------------------------------------------------
@query("cur1_merged_venues", f"""with {_V}, o as (select slug, name, k, 'Club ' || name as alias, coalesce(kind, 'sonstiges') as art, homepage from v),
  t as (select * from o where k % 4 in (0, 3))
  select t.slug, t.name, coalesce(nullif(t.art, 'sonstiges'), nullif(a.art, 'sonstiges'), nullif(b.art, 'sonstiges'), 'sonstiges') as art, coalesce(t.homepage, a.homepage, b.homepage) as homepage,
    concat_ws(',', t.alias, a.name, a.alias, b.name, b.alias) as aliases from t left join o a on t.k % 4 = 0 and a.k = t.k + 1 left join o b on t.k % 4 = 0 and b.k = t.k + 2""")
def cur1(spark: SparkSession, d: str) -> DataFrame:
    v = venues_of(spark, d).withColumns({"art": F.coalesce("kind", F.lit("sonstiges")), "aliases": F.array(F.concat(F.lit("Club "), "name"))})
    to = v.select(c("k").alias("to_"), c("slug").alias("target"))
    mapping = v.where("k % 4 in (1, 2)").join(to, c("k") - c("k") % 4 == c("to_")).select(c("slug").alias("old"), "target", (c("k") % 4).alias("ord"))
    return venues.merge_into(v, mapping, ("art", "homepage")).withColumn("aliases", F.array_join("aliases", ","))


@query("cur5_filled_venues", f"""with {_V} select slug, coalesce(homepage, 'https://new/' || k) as homepage,
  coalesce(cast(lat as double), case when k % 10 = 0 then 51.5 else 50.9 end) as lat from v""")
def cur5(spark: SparkSession, d: str) -> DataFrame:
    v = venues_of(spark, d)
    page = v.select("slug", F.concat(F.lit("https://new/"), c("k").cast("string")).alias("homepage"), F.when(c("k") % 10 == 0, 51.5).alias("lat"))
    asked = v.select("slug", F.lit(50.9).alias("lat"))
    return venues.fill_empty(venues.fill_empty(v, page, ("homepage", "lat")), asked, ("lat",)).select("slug", "homepage", "lat")


@query("cur13_reclassified_regions", f"with {_V} select slug, 'weiter' as old, case when k % 8 = 0 then 'umland' else 'dresden' end as new from v where k % 4 = 0")
def cur13(spark: SparkSession, d: str) -> DataFrame:
    v = venues_of(spark, d)
    named = v.withColumn("said", F.when(c("k") % 8 == 0, F.concat("name", F.lit(" Pirna"))).otherwise(c("name")))
    return history.changed(v, named.withColumn("region", classify.region(tx.slugify(c("said")))), "slug", "region")


# --- duplicates and exports -------------------------------------------------------------------------
def _booked(e: DataFrame) -> DataFrame:
    return e.where("duplicate_of is not null").select(c("id").alias("duplicate"), c("duplicate_of").alias("canonical"))


@query("joi10_duplicate_report", _ve("""select a.id as duplicate, b.id as canonical, a.date, a.title, b.title as canonical_title from e a join e b on b.id = a.duplicate_of
  where a.date between date '2024-01-05' and date '2024-01-25'"""))
def joi10(spark: SparkSession, d: str) -> DataFrame:
    e = events_of(spark, d)
    return views.duplicate_report(_booked(e), e, "2024-01-05", "2024-01-25")


@query("cur14_relinked_duplicates", _ve("""select a.id as duplicate, a.duplicate_of as canonical, a.source_pos as duplicate_source, b.source_pos as canonical_source, 'title' as reason,
  case when a.id % 2 = 0 then '2023-12-01' else '2024-01-15' end as first_seen, '2024-01-15' as last_seen
  from e a left join e b on b.id = a.duplicate_of where a.duplicate_of is not null and a.id % 4 < 3"""))
def cur14(spark: SparkSession, d: str) -> DataFrame:
    e = events_of(spark, d).withColumn("uid", c("id")).drop("source").withColumn("source", c("source_pos"))
    known = e.where("id % 9 = 0 and id % 2 = 0").select(c("uid").alias("duplicate"), F.lit("2023-12-01").alias("first_seen"))
    found = _booked(e.where("id % 4 < 3")).withColumns({"score": F.lit(0.8), "reason": F.lit("title")})
    return history.relinked(known, found, e, "2024-01-15").drop("score")


@query("cur8_filled_from_duplicates", _ve("""select e.id as uid, coalesce(case when e.id % 2 = 0 then 'i' || e.id end, case when d.id % 2 = 0 then 'i' || d.id end) as image_url,
  case when e.id % 9 = 0 then 'd' || e.id when d.id is not null then 'd' || d.id else '' end as description,
  case when e.id % 5 = 0 then 't' || e.id when e.id % 9 <> 0 and d.id is not null then case when d.id % 5 = 0 then 't' || d.id else 'now' end end as detail_fetched_at
  from e left join e d on d.duplicate_of = e.id"""))
def cur8(spark: SparkSession, d: str) -> DataFrame:
    named = lambda x: F.concat(F.lit(x), c("id").cast("string"))
    e = events_of(spark, d).select(
        c("id").alias("uid"), "id", "duplicate_of", F.when(c("id") % 2 == 0, named("i")).alias("image_url"),
        F.when(c("id") % 9 == 0, named("d")).otherwise("").alias("description"), F.when(c("id") % 5 == 0, named("t")).alias("detail_fetched_at"),
    )
    out = history.filled_from_duplicates(e, _booked(e), "now", ("image_url", "description"))
    return out.select("uid", "image_url", "description", "detail_fetched_at")


@query("cur11_relinked_hearts", _ve("""select e.id as heart, case when e.duplicate_of is null then e.id when c.id is not null and e.duplicate_of % 9 <> 0 then c.id else e.id end as event_uid,
  case when e.duplicate_of is null then 'ok' when c.id is not null then 'neu_verknuepft' else 'verwaist' end as status from e left join e c on c.id = e.duplicate_of where e.id % 3 = 0"""))
def cur11(spark: SparkSession, d: str) -> DataFrame:
    e = events_of(spark, d)
    text = lambda n: c(n).cast("string")
    rows = e.select(text("id").alias("uid"), text("id").alias("run_key"), text("date").alias("date"), "time", text("duplicate_of").alias("duplicate_of"), text("id").alias("identity_key"), "id")
    marked = rows.where("id % 3 = 0").select(
        c("uid").alias("heart"), c("uid").alias("event_uid"), "run_key", F.array().cast("array<string>").alias("member_uids"), "identity_key", c("date").alias("run_date")
    )
    none = rows.where("false").select(c("uid").alias("duplicate"), c("uid").alias("canonical"))
    got = hearts.relinked_hearts(marked, rows, none)
    return got.select(c("heart").cast("long").alias("heart"), c("event_uid").cast("long").alias("event_uid"), "status")


@query("src13_changed_days", _fx("select distinct date from fx where day(date) % 3 = 0"))
def src13(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d)
    before = rows.withColumn("title", F.when(F.day("date") % 3 == 0, F.upper("title")).otherwise(c("title")))
    fields = ["id", "title", "time", "venue"]
    return tables.changed_days(tables.day_export(rows, fields), tables.day_export(before, fields)).select("date")


@query("src15_slim_events", _ve("""select id as uid, '{"uid":"' || id || '","title":"' || title || '","date":"' || date || '"' || case when time is null then '' else ',"time":"' || time || '"' end
  || ',"venue":"' || venue || '","category":"' || category || '"' || case when ongoing then ',"ongoing":true' else '' end
  || case when taglist = '' then '' else ',"tags":["' || replace(taglist, ',', '","') || '"]' end
  || case when region = 'weiter' then ',"region":"weiter"' else '' end || ',"score":' || case when id % 2 = 0 then '61.3' else '50.0' end || '}' as json from e"""))
def src15(spark: SparkSession, d: str) -> DataFrame:
    e = events_of(spark, d).drop("source").withColumns({"uid": c("id"), "score": F.when(c("id") % 2 == 0, 61.27)})
    return views.slim(e)

"""Queries of dimensions, ranks, details and the rest of the sources' small rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, extract, text as tx
from ..operators import dimensions as dim
from ..operators import dedup, feeds, merge, registry, venues
from ..sources import tables
from . import sql as s
from .catalog import _CATEGORIZED, _fx, _PREP, _SLUGS, _slugs, c, listings, query
from .extra import _ve, venues_of

_CATS = ", ".join(
    f"({i}, '{slug}', '{label}', {shown})"
    for i, (slug, label, shown) in enumerate(
        [("musik", "Musik", "true"), ("nightlife", "Nightlife", "true"), ("kultur", "Kultur", "true"), ("familie", "Familie", "true"), ("outdoor", "Outdoor", "true"),
         ("sport", "Sport", "true"), ("fuehrungen", "Führungen & Touren", "false"), ("sonstiges", "Sonstiges", "true")]
    )
)


@query("src17_categories", _fx(f"select d.pos, d.slug, d.label, d.shown, count(cats.id) as n from (values {_CATS}) d(pos, slug, label, shown) left join cats on cats.cat = d.slug group by all", _CATEGORIZED))
def src17(spark: SparkSession, d: str) -> DataFrame:
    return dim.counted(dim.categories(spark), _slugs(spark, d), "category")


_TAGGED = f"tagged as (select id, unnest(list_append(string_split({s.tags('t', 'v', chr(39) * 2)}, ','), case when id % 3 = 0 then 'techno' when id % 3 = 1 then 'kirche' else r end)) as slug from slugs)"


@query("src17_tags", _fx("select case slug when 'kirche' then 0 when 'museum' then 1 when 'open-air' then 2 when 'klassik' then 3 when 'techno' then 4 else 5 end as pos, slug, case when slug in ('kirche', 'museum', 'klassik', 'techno') then upper(slug[1]) || slug[2:] when slug = 'open-air' then 'Open Air' end as label, count(*) as n from tagged where slug <> '' group by all", f"{_SLUGS}, {_TAGGED}"))
def src17_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of listings, with a known or an unknown one added to each."""
    own = classify.tags(c("t"), c("v"), F.lit(None).cast("string"))
    more = F.when(c("id") % 3 == 0, "techno").when(c("id") % 3 == 1, "kirche").otherwise(c("r"))
    rows = _slugs(spark, d).select(F.explode(F.concat(own, F.array(more))).alias("slug")).where("slug <> ''")
    return dim.counted(dim.tags(spark, rows), rows, "slug")


@query("src3_ranked_listings", _fx("select id, case when source_pos % 20 < 14 then 13 - source_pos else 14 end as pos from fx"))
def src3_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Rank of each listing's source in a registry of 14 of the 20 sources, the highest number first."""
    rows = listings(spark, d).withColumn("source_pos", c("rank"))
    known = rows.where("source_pos < 14").select("source", (-c("source_pos")).alias("rank")).distinct()
    return tables.ranked_by(rows.drop("rank"), tables.source_registry(known)).select("id", "pos")


@query("src3_shared_ranks", "select r as rank, string_agg(source, ',' order by source) as sources from (select distinct user_id % 7 as r, event_type as source from events where event_id % 3 = 0) group by 1 having count(*) > 1")
def src3_shared(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read_table(spark, d, "events").where("event_id % 3 = 0").select((c("user_id") % 7).alias("rank"), c("event_type").alias("source"))
    return tables.shared_ranks(e).withColumn("sources", F.array_join("sources", ","))


@query("src16_venue_places", _ve("""select slug, '{"n":' || to_json(cast(name as varchar)) || ',"lat":' || cast(cast(lat as double) as varchar) || ',"lon":' || cast(cast(lon as double) as varchar)
  || ',"r":"' || region || '","k":' || coalesce('"' || kind || '"', 'null') || '}' as json from v where lat is not null and lon is not null and coalesce(kind, '') <> 'treffpunkt'"""))
def src16(spark: SparkSession, d: str) -> DataFrame:
    return registry.geo_table(venues_of(spark, d))


_LONG = "case s_suppkey % 4 when 0 then s_name || ' (Saal 2)  Dresden' when 1 then s_name || ' – Träger e.V.' when 2 then 'Haus  ' || s_name || ' im Kulturpalast' else s_name || ' Dresdenfrei - (x) Dresden' end"


@query("scl35_search_names", """select s_suppkey, case s_suppkey % 4 when 0 then s_name when 1 then s_name when 2 then 'Haus ' || s_name else s_name || ' Dresdenfrei' end as name,
  case when s_suppkey % 3 = 0 then 'alt' || s_suppkey when s_suppkey % 5 = 0 then 'Weg ' || s_suppkey when s_suppkey % 2 = 0 then 'Weg ' || s_suppkey || ', 01099 Dresden' else 'Weg ' || s_suppkey || ', Dresden' end as address from supplier""")
def scl35(spark: SparkSession, d: str) -> DataFrame:
    k = c("s_suppkey")
    sup = tables.read_table(spark, d, "supplier").withColumn("long", F.expr(_LONG))
    street = F.when(k % 3 != 0, F.concat(F.lit("Weg "), k.cast("string")))
    code, city = F.when(k % 2 == 0, "01099").otherwise(""), F.lit("Dresden")
    told = k % 5 != 0
    address = tx.postal_address(street, F.when(told, code), F.when(told, city), F.concat(F.lit("alt"), k.cast("string")))
    return sup.select("s_suppkey", tx.place_search_name(c("long")).alias("name"), address.alias("address"))


@query("top4_suspects", _fx("select x.ort as a, y.ort as b, count(*) as n from k x join k y on x.date = y.date and x.key = y.key and x.ort < y.ort group by 1, 2 having count(*) >= 2 order by n desc, a, b limit 15",
  f"k as (select distinct date, {s.title_key('title')} as key, venue as ort from fx where {s.title_key('title')} <> '' and venue not like 'Club%')"))
def top4(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d).withColumn("ort", c("venue"))
    return venues.suspects(venues.suspicious_pairs(rows, c("ort").startswith("Club"), example=False, most=15)).select("a", "b", "n")


_TWICE = f"""twice as (select id, source_pos, date, time, venue, title from fx union all select id + 5000000000, source_pos, date, time, venue,
  case when id % 4 = 0 then title || ' live' when id % 4 = 1 then title || ' 7' when id % 4 = 2 then upper(title) else 'Abend' end from fx where id % 5 <> 0)"""


@query("joi3_doubled_listings", _fx(f"""select x.id as a, y.id as b from p x join p y on x.source = y.source and x.date = y.date and x.time = y.time and x.vkey = y.vkey and x.nums = y.nums and x.id < y.id
  where x.vkey <> '' and x.time <> '00:00' and len(x.tok) > 0 and len(y.tok) > 0 and len(list_intersect(x.tok, y.tok)) = least(len(x.tok), len(y.tok))""", f"{_TWICE}, {_PREP.replace('from fx', 'from twice')}"))
def joi3(spark: SparkSession, d: str) -> DataFrame:
    """Listings with a second copy of most: with a word more, a number more, in capitals, or of another title."""
    listings(spark, d)
    rows = spark.sql(f"with {s.LISTINGS}, {_TWICE} select *, cast(source_pos as string) as source, 'musik' as category, '' as raw_category from twice")
    return dedup.self_duplicates(dedup.prepared(rows))


_LINE = "Die lange Beschreibung der eigenen Seite zu diesem Abend, mit allem, was man dazu wissen muss. "


@query("joi6_detailed_listings", _fx(f"""select id, case when id % 4 = 3 then case when id % 3 = 1 then 'kurz' when id % 3 = 2 then '  ' end
    when id % 4 = 0 then '{_LINE}' || title when id % 3 = 1 then 'kurz' when id % 4 = 1 then 'Zeile ' || title when id % 3 = 2 then '  ' end as description,
  case when id % 5 = 0 then '7 €' when id % 4 <> 3 then '9 €' end as price_text, case when id % 7 = 0 then 'own.jpg' when id % 4 = 2 then 'page.jpg' end as image_url from fx"""))
def joi6(spark: SparkSession, d: str) -> DataFrame:
    """Listings of which three in four have a detail page: with a long text, a short one, or none."""
    k = c("id")
    rows = listings(spark, d).select(
        "id", "title", k.cast("string").alias("url"), F.when(k % 3 == 1, "kurz").when(k % 3 == 2, "  ").alias("description"), F.when(k % 5 == 0, "7 €").alias("price_text"), F.when(k % 7 == 0, "own.jpg").alias("image_url")
    )
    text = F.when(k % 4 == 0, F.concat(F.lit(_LINE), "title")).when(k % 4 == 1, F.concat(F.lit("Zeile "), "title"))
    pages = rows.where("id % 4 <> 3").select("url", text.alias("description"), F.lit("9 €").alias("price_text"), F.when(k % 4 == 2, "page.jpg").otherwise("").alias("image_url"))
    return merge.with_details(rows, pages).select("id", "description", "price_text", "image_url")


@query("set1_slots_and_umbrellas", _fx("""select cast(id as varchar) as id, title, raw_category from fx where id % 2 = 0
  union all select null, min(title), raw_category || date from fx where id % 2 = 1 group by raw_category, date"""))
def set1(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d)
    slots = rows.where("id % 2 = 0").select(c("id").cast("string").alias("id"), "title", "raw_category")
    heads = rows.where("id % 2 = 1").groupBy("raw_category", "date").agg(F.min("title").alias("title"))
    return feeds.umbrella_rows(slots, heads.select(F.concat("raw_category", c("date").cast("string")).alias("heading"), "title")).select("id", "title", "raw_category")


@query("ext30_local_times", "select event_id, strftime(timezone('Europe/Berlin', to_timestamp(cast(floor(epoch(ts)) as bigint) + event_id % 400 * 86400)), '%Y-%m-%d %H:%M') as t from events")
def ext30(spark: SparkSession, d: str) -> DataFrame:
    """Events spread over more than a year, so that both clock changes are met."""
    epoch = F.floor(F.unix_timestamp("ts")) + c("event_id") % 400 * 86400
    return tables.read_table(spark, d, "events").select("event_id", extract.local_time(epoch).alias("t"))


@query("scl36_local_days", "select event_id, cast(timezone('Europe/Berlin', to_timestamp(cast(floor(epoch(ts)) as bigint) + event_id % 400 * 86400)) as date) as day from events")
def scl36(spark: SparkSession, d: str) -> DataFrame:
    epoch = F.floor(F.unix_timestamp("ts")) + c("event_id") % 400 * 86400
    return tables.read_table(spark, d, "events").select("event_id", tx.local_day(F.timestamp_seconds(epoch)).alias("day"))

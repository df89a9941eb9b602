"""Queries of what is published and of the guarded upkeep of the store, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..operators import publishing as pub
from ..operators import runs
from ..operators.components import ensure_checkpoint_dir
from ..sources import tables
from . import sql as s
from .catalog import _CATEGORIZED, _fx, _SLUGS, _slugs, c, listings, query
from .extra import _E, _V, _ve, events_of, venues_of

#: Events and venues with all published fields, by one SQL text in both engines.
_P = """p as (select e.id, cast(e.id as varchar(30)) as uid, e.date, e.time, e.title, case when e.id % 8 = 0 then null else e.ort end as ort, e.venue as ort_roh,
  case e.id % 6 when 0 then 'musik' when 1 then 'kultur' when 2 then 'sonstiges' when 3 then 'demo' when 4 then 'outdoor' else 'sport' end as category,
  case when e.id % 4 = 0 then 'javascript:x' when e.id % 4 = 1 then concat('https://x.de/', e.id) end as url,
  case e.id % 5 when 0 then 'https://kulturkalender-dresden.de/img/fallback.png' when 1 then concat('https://i.ytimg.com/vi/', e.id, '/maxresdefault.jpg') when 2 then '' else concat('HTTP://b.de/', e.id, '.jpg') end as image_url,
  case when e.id % 3 = 0 then concat(repeat('Wort ', 150), e.title) when e.id % 3 = 1 then 'kurz "und" gut' end as description,
  case when e.id % 7 = 0 then '5 €' else '' end as price_text, case when e.id % 2 = 0 then 'a,b' else 'c' end as sources, e.region, e.id % 13 = 0 as laufend from e)"""
_W = """w as (select v.slug, v.name, v.k, v.kind, v.homepage, v.k % 9 = 0 as heart, case when v.k % 4 = 1 then concat('Weg ', v.k) end as address,
  case when v.k % 10 = 0 then 'ftp://x' else concat('https://c.de/', v.k) end as cover, v.lat, v.lon from v)"""


def _published(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events_of(spark, d)
    venues_of(spark, d)
    events = spark.sql(f"with {s.LISTINGS}, {_V}, {_E}, {_P} select * from p")
    places = spark.sql(f"with {_V}, {_W} select * from w").withColumns({x: c(x).cast("double") for x in ("lat", "lon")})
    flavours = places.where("k % 11 = 0").select("slug", F.lit("jazz").alias("flavour"))
    return events, places, flavours



_SAID = lambda k, v: f"case when coalesce({v}, '') <> '' then '\"{k}\":' || to_json(cast({v} as varchar)) end"
_IMG = "case when lower({0}) like 'http%://%' and not contains({0}, 'kulturkalender-dresden.de/img/fallback') then replace({0}, 'maxresdefault.jpg', 'hqdefault.jpg') end"
_B = "case when length(description) > 700 then regexp_replace(description[1:700], ' [^ ]*$', '') || ' …' else description end"
_EVENT_JSON = "'{' || array_to_string(list_filter([" + ", ".join(
    [
        _SAID("u", "uid"), _SAID("d", "cast(date as varchar)"), _SAID("t", "time"), _SAID("ti", "title"), _SAID("o", "ort"), _SAID("or", "ort_roh"), _SAID("k", "category"),
        _SAID("url", "case when url like 'http%' then url end"), _SAID("img", _IMG.format("image_url")), _SAID("b", _B), _SAID("p", "price_text"),
        "'\"q\":[\"' || replace(sources, ',', '\",\"') || '\"]'", _SAID("r", "region"),
        "case when len(rt) > 0 then '\"rt\":[\"' || array_to_string(rt, '\",\"') || '\"]' end", "case when laufend then '\"l\":1' end",
    ]
) + "], lambda x: x is not null), ',') || '}'"
_PAYLOAD = f"""{_P}, {_W}, told as (select p.*, {s.slug('p.title')} as t_, {s.slug("coalesce(w.name, case when p.ort is null then p.ort_roh end)")} as v_,
  case when w.k % 11 = 0 then 'jazz' else '' end as fl from p left join w on w.slug = p.ort),
  faceted as materialized (select *, {s.facets('t_', 'category', 'v_', 'fl')} as rt from told)"""


@query("src14_event_documents", _ve(f"select uid, {_EVENT_JSON} as json from faceted", _PAYLOAD))
def src14_events(spark: SparkSession, d: str) -> DataFrame:
    return pub.event_documents(*_published(spark, d)).select("uid", "json")


_VENUE_JSON = "'{' || array_to_string(list_filter([" + ", ".join(
    [
        _SAID("n", "name"), "case when heart then '\"h\":1' end", _SAID("w", "homepage"), _SAID("a", "address"), _SAID("art", "kind"), _SAID("c", _IMG.format("cover")),
        "'\"lat\":' || cast(round(cast(lat as double), 5) as varchar)", "'\"lon\":' || cast(round(cast(lon as double), 5) as varchar)",
    ]
) + "], lambda x: x is not null), ',') || '}'"


@query("src14_venue_documents", _ve(f"select slug, {_VENUE_JSON} as json from w where heart or k % 11 = 0 or slug in (select ort from p where day(date) <= 3)", f"{_P}, {_W}"))
def src14_venues(spark: SparkSession, d: str) -> DataFrame:
    events, places, flavours = _published(spark, d)
    return pub.venue_documents(places, events.where("day(date) <= 3"), flavours)


_DAYS = """dx as (select date, count(*) as n, '[' || string_agg('"' || id || '"', ',' order by coalesce(time, '99:99'), title, cast(id as varchar)) || ']' as json from fx group by date)"""


def _days(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d).select("date", "time", "title", c("id").cast("string").alias("uid"))
    return pub.day_documents(rows.withColumn("json", F.concat(F.lit('"'), "uid", F.lit('"'))))


@query("src13_stable_stamps", _fx("""select cast(date as varchar) as date, n, substr(sha1(json), 1, 8) as version, case when day(date) % 4 = 0 then 'late' else 'early' end as generated_at from dx""", _DAYS))
def src13_stamps(spark: SparkSession, d: str) -> DataFrame:
    """A first export without every fourth day's last title, a second one of all: what the files then say."""
    days = _days(spark, d)
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/days-{uuid.uuid4().hex}"
    before = days.withColumn("version", F.when(F.day("date") % 4 == 0, "old").otherwise(c("version")))
    pub.write_days(before, path, "early")
    pub.write_days(days, path, "late")
    return spark.read.parquet(path).select(c("date").cast("string").alias("date"), c("n").cast("long").alias("n"), "version", "generated_at")


@query("src8_event_bridge", _fx("select distinct cast(id % 1000000000 as varchar) as uid, id as listing_id from fx"))
def src8(spark: SparkSession, d: str) -> DataFrame:
    """Events of a listing and its repeat, published twice; the bridge of the second time."""
    rows = listings(spark, d).withColumn("uid", (c("id") % 1_000_000_000).cast("string"))
    events = rows.groupBy("uid").agg(F.min("title").alias("title"), F.concat(F.collect_list("id"), F.collect_list("id")).alias("listing_ids"))
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/events-{uuid.uuid4().hex}"
    pub.replace_events(events.where("uid % 2 = 0"), path)
    pub.replace_events(events, path)
    return pub.stored_events(spark, path)[1]


_O = """o as (select id, title, date, source_pos, id % 5 = 0 as lost from e where date >= date '2024-01-15' and source_pos <> 3
  union all select id, title, date, source_pos, id % 5 <> 1 as lost from e where date >= date '2024-01-15' and source_pos = 3)"""


@query("cur10_orphan_report", _ve("""select cast(id as varchar) as uid, case when id % 25 = 0 or id % 35 = 0 then 'herz' when source_pos = 3 then 'quelle' end as held_by,
  cast(case when id % 45 = 0 then 2 else 0 end as bigint) as unlinked, id % 55 = 0 as booked from o where lost""", _O))
def cur10(spark: SparkSession, d: str) -> DataFrame:
    e = events_of(spark, d).where("date >= date '2024-01-15'").withColumn("uid", c("id").cast("string"))
    lost = F.when(c("source_pos") == 3, c("id") % 5 != 1).otherwise(c("id") % 5 == 0)
    orphans = e.where(lost).select("uid", c("source").alias("signature"))
    nobody = F.array().cast("array<string>")
    hearts = e.where("id % 25 = 0").select("uid", nobody.alias("m")).unionByName(e.where("id % 35 = 0").select(F.concat(F.lit("x"), "uid").alias("uid"), F.array("uid").alias("m")))
    hearts = hearts.select(c("uid").alias("event_uid"), c("uid").alias("run_key"), c("m").alias("member_uids"))
    dup = e.where("id % 45 = 0").select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("x"), "uid").select(F.concat("x", "uid").alias("duplicate"), c("uid").alias("canonical"))
    dup = dup.unionByName(e.where("id % 55 = 0").select(c("uid").alias("duplicate"), F.lit("other").alias("canonical")))
    report = pub.orphan_report(orphans, e.select("uid", "title", "date"), hearts, dup, e.select("uid", "source"))
    return report.select("uid", "held_by", "unlinked", "booked")


_R = f"""{_SLUGS}, r0 as (select slugs.id, case when slugs.id % 3 = 0 then 'alt' else {s.category('t', 'r', 'v')} end as category, case when slugs.id % 4 = 0 then 'club' else v.kind end as hint,
  case when slugs.id % 5 = 0 then 'techno,zzz' else {s.tags('t', 'v', "coalesce(v.kind, '')").replace("contains(v,", "contains(slugs.v,")} end as tags,
  {s.category('t', 'r', 'v')} as n_category, v.kind as n_hint, {s.tags('t', 'v', "coalesce(v.kind, '')").replace("contains(v,", "contains(slugs.v,")} as n_tags
  from slugs join fx using (id) left join v on v.name = fx.venue)"""
_R = _R.replace(s.category("t", "r", "v"), s.category("t", "r", "slugs.v"))


@query("cur13_reclassified", _ve("""select id, 'category' as field, category as old, n_category as new from r0 where category is distinct from n_category
  union all select id, 'venue_hint', hint, n_hint from r0 where hint is distinct from n_hint
  union all select id, 'tags', tags, n_tags from r0 where tags is distinct from n_tags""", _R))
def cur13(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d).withColumns({"category": F.lit(""), "venue_hint": F.lit(None).cast("string"), "tags": F.array().cast("array<string>")})
    places = venues_of(spark, d)
    fresh, _ = pub.reclassified(rows.withColumn("uid", c("id")), places)
    stale = fresh.withColumns(
        {
            "category": F.when(c("id") % 3 == 0, "alt").otherwise(c("category")),
            "venue_hint": F.when(c("id") % 4 == 0, "club").otherwise(c("venue_hint")),
            "tags": F.when(c("id") % 5 == 0, F.array(F.lit("techno"), F.lit("zzz"))).otherwise(c("tags")),
        }
    )
    return pub.reclassified(stale, places)[1].select(c("uid").alias("id"), "field", "old", "new")


@query("cur12_hearts_of_uids", _ve("""select id, case when id % 10 = 0 then 'own' || id when id % 10 = 1 then 'run' || (id - 1) end as run_key from e where id % 10 < 2 and id < 1000000000 and (id % 10 = 0 or (id - 1) in (select id from e))"""))
def cur12(spark: SparkSession, d: str) -> DataFrame:
    e = events_of(spark, d).where("id < 1000000000")
    text = lambda x: x.cast("string")
    kept = e.where("id % 10 = 0")
    own = kept.select(text(c("id")).alias("event_uid"), F.concat(F.lit("own"), "id").alias("run_key"), F.array().cast("array<string>").alias("member_uids"))
    run = kept.select(F.concat(F.lit("n"), "id").alias("event_uid"), F.concat(F.lit("run"), "id").alias("run_key"), F.array(text(c("id")), text(c("id") + 1)).alias("member_uids"))
    return pub.hearts_of(e.select(text(c("id")).alias("uid")), own.unionByName(run)).select(c("uid").cast("long").alias("id"), "run_key")


_WANT = ", ".join(f"({i}, '{a}', {s.q(f) if f else 'null'}, {s.q(label)})" for i, (a, f, label) in enumerate(
    [("musik", None, "Musik"), ("musik", "club", "Club & Party"), ("musik", "rock", "Rock & Metal"), ("musik", "indie", "Punk, Indie & Bars"), ("musik", "jazz", "Jazz, Blues & Swing"),
     ("musik", "klassik", "Klassik & Chor"), ("kultur", None, "Kultur"), ("kultur", "buehne", "Theater & Bühne"), ("kultur", "film", "Kino & Film"), ("kultur", "wort", "Lesung & Vortrag"),
     ("kultur", "kunst", "Ausstellungen & Museen"), ("demo", None, "Demos"), ("outdoor", None, "Feste & Märkte"), ("sport", None, "Sport")]))


@query("src18_facet_counts", _fx(f"""select d.pos, d.area, d.facet, d.label, count(x.key) as n from (values {_WANT}) d(pos, area, facet, label)
  left join (select unnest({s.facets('t', 'cat', 'v', chr(39) * 2)}) as key from cats) x on x.key = coalesce(d.facet, d.area) group by all""", _CATEGORIZED))
def src18(spark: SparkSession, d: str) -> DataFrame:
    found = _slugs(spark, d).select(classify.facets(c("t"), c("category"), c("v"), F.lit(None).cast("string")).alias("facets"))
    return pub.facet_counts(found, pub.facet_dimension(spark))


@query("flt3_reason_counts", _fx(f"select reason, count(*) as n from (select case when id % 9 = 0 then 'Ort' else {s.exclusion('lower(said)')} end as reason from (select id, concat(title, case id % 4 when 0 then ' (abgesagt)' when 1 then ' fuer Senioren' else '' end) as said from fx)) where reason is not null group by 1"))
def flt3(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat("title", F.expr("case id % 4 when 0 then ' (abgesagt)' when 1 then ' fuer Senioren' else '' end"))
    reason = classify.exclusion_reason(said, F.lit("musik"), F.lit(""), F.when(c("id") % 9 == 0, F.concat(F.lit("zu: "), "venue")), F.lit(""))
    return pub.reason_counts(listings(spark, d).withColumn("reason", reason))


@query("set2_all_sources", _fx("""select id, case when id % 3 = 0 then null else title end as title, case when id % 3 = 1 then null else venue end as venue, case when id % 3 = 2 then 'x' end as url from fx"""))
def set2(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d)
    a, b, e = (rows.where(c("id") % 3 == k) for k in range(3))
    return tables.all_sources(a.select("id", "venue"), b.select("title", "id"), e.select("id", "title", "venue", F.lit("x").alias("url"))).select("id", "title", "venue", "url")


@query("src10_recorded_runs", "select event_id as id, user_id % 20 as source, event_type <> 'error' as ok from events")
def src10(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after two appends."""
    e = tables.read_table(spark, d, "events").select(c("event_id").alias("id"), (c("user_id") % 20).alias("source"), (c("event_type") != "error").alias("ok"))
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    runs.record_runs(e.where("id % 2 = 0"), path)
    runs.record_runs(e.where("id % 2 = 1"), path)
    return spark.read.parquet(path)

"""Further queries of the catalog: extraction, pages, store views and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions import text as tx
from ..operators import history, pages
from ..sources import tables
from . import sql as s
from .catalog import _LEDGER, _REG, _first, _fx, c, ledger, listings, on_listings, query, registry

q = s.q


def _found(x: str, p: str, g: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {q(p)}, {g}), '')"


def _squeezed(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


def _put(*parts: object) -> object:
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


# --- extraction -----------------------------------------------------------------------------------
_t1, _t2 = "(time || ' bis 23.30 Uhr')", "(cast(date as varchar) || ' | ' || time)"


def _time(x: str) -> str:
    return f"case when regexp_matches({x}, {q(ex.TIME_ONLY)}) then {x} else {_found(x, ex.TIME_INSIDE, 0)} end"


on_listings(
    "ext2_time_text",
    {"whole": lambda: ex.time_text(_put(c("time"), " bis 23.30 Uhr")), "inside": lambda: ex.time_text(_put(c("date").cast("string"), " | ", c("time")))},
    {"whole": _time(_t1), "inside": _time(_t2)},
)
_tail = "case id % 4 when 0 then ' Eintritt: ' || id % 90 || ',50 € bis 95 Euro' when 1 then ' Eintritt ist frei' when 2 then ' kostenlos' else ' Eintritt: nach Wahl; mehr' end"
_priced = lambda: F.concat("title", F.expr(_tail))
on_listings("ext7_price", {"price": lambda: ex.price(_priced())}, {"price": "coalesce(" + ", ".join(_squeezed(f"regexp_extract(title || {_tail}, {q(p)}, 1)") for p in ex.PRICES) + ")"})
_src = "('a.jpg ' || (id % 900) || 'w, b.jpg ' || (id % 700) || 'w, c.jpg')"
_sized = f"list_transform(list_transform(string_split({_src}, ','), lambda x: string_split(trim(x), ' ')), lambda p: {{'w': coalesce(try_cast(regexp_extract(coalesce(p[2], ''), '^(\\d+)w$', 1) as int), 0), 'url': p[1]}})"
on_listings(
    "ext8_image_variant",
    {"url": lambda: ex.image_variant(F.expr(_src))},
    {"url": f"coalesce(list_sort(list_filter({_sized}, lambda x: x.w >= 500))[1], list_sort({_sized})[-1]).url"},
)
on_listings("ext9_style_image", {"url": lambda: ex.style_image(_put("background-image: url('", c("title"), ".jpg')"))}, {"url": "title || '.jpg'"})
on_listings("ext5_paren_category", {"cat": lambda: ex.paren_category(_put(c("title"), " ( ", c("raw_category"), " )"))}, {"cat": f"trim({_found(chr(40) + 'title || ' + q(' ( ') + ' || raw_category || ' + q(' )') + chr(41), ex.IN_PARENS)})"})
on_listings(
    "ext23_moved",
    {"title": lambda: ex.unmoved_title(_put(c("title"), " (hochverlegt in die ", c("venue"), ")")), "place": lambda: ex.moved_to(_put(c("title"), " (hochverlegt in die ", c("venue"), ")"))},
    {"title": _squeezed("title"), "place": "trim(venue)"},
)
on_listings(
    "ext24_sold_out",
    {"t": lambda: ex.unsold_title(F.expr("case when id % 3 = 0 then title || ' (Ausverkauft!)' else title end")), "price": lambda: ex.sold_out(F.expr("case when id % 3 = 0 then title || ' (Ausverkauft!)' else title end"))},
    {"t": "title", "price": "case when id % 3 = 0 then 'ausverkauft' end"},
)
on_listings(
    "ext28_start_time",
    {"t": lambda: ex.start_time(F.expr("'Einlass: ' || (id % 30) || ' Uhr' || case when id % 2 = 0 then ', Beginn ' || (id % 28) || ':15 Uhr' else '' end"))},
    {"t": "case when id % 2 = 0 and id % 28 <= 23 then lpad(cast(id % 28 as varchar), 2, '0') || ':15' when id % 30 <= 23 then lpad(cast(id % 30 as varchar), 2, '0') || ':00' end"},
)
on_listings(
    "ext29_clock",
    {"t": lambda: ex.clock(F.expr("(id % 12 + 1) || ':05 ' || case when id % 2 = 0 then 'PM' else 'a.m.' end"))},
    {"t": "lpad(cast((id % 12 + 1) % 12 + case when id % 2 = 0 then 12 else 0 end as varchar), 2, '0') || ':05'"},
)
on_listings("ext31_feed_category", {"f": lambda: ex.feed_category(_put("Highlights, ", c("raw_category"))), "g": lambda: ex.genre_category(F.when(c("id") % 5 == 0, "Poetry").when(c("id") % 5 == 1, "").otherwise(c("raw_category")))}, {"f": "raw_category", "g": "case id % 5 when 0 then 'Lesung' when 1 then null else 'Konzert' end"})
_m, _d = "(id % 12 + 1)", "(id % 31 + 1)"


def _date(y: str) -> str:
    return f"cast(try_strptime(({y}) || '-' || {_m} || '-' || {_d}, '%Y-%m-%d') as date)"


on_listings(
    "ext26_next_day",
    {"d": lambda: ex.next_day(F.expr(_m), F.expr(_d), c("date"))},
    {"d": f"case when {_date('year(date)')} >= date - 7 then {_date('year(date)')} when {_date('year(date)')} is not null then {_date('year(date) + 1')} end"},
)
on_listings("ext27_month", {"m": lambda: ex.month_number(F.expr("element_at(array('Januar','Februar','März','April','Mai','Juni','Juli','August','September','Oktober','November','Dezember'), int(id % 12 + 1))"))}, {"m": "id % 12 + 1"})


@query("ext6_page_metadata", rf"""select page_id, {_squeezed("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title,
  {_squeezed("regexp_replace(regexp_extract(html, '(?is)<h[1-4][^>]*>(.*?)</h[1-4]>', 1), '<[^>]*>', ' ', 'g')")} as heading from pages""")
def ext6(spark: SparkSession, d: str) -> DataFrame:
    return pages.metadata(tables.read_table(spark, d, "pages")).select("page_id", "title", "heading")


# --- filters and views ------------------------------------------------------------------------------
@query("flt4_range_list", _fx("select id, case when source_pos % 4 = 0 then null else venue end as venue from fx where date between date '2024-01-05' and date '2024-01-25' and raw_category in ('click', 'view') and venue <> 'TBA'"))
def flt4(spark: SparkSession, d: str) -> DataFrame:
    r = tables.events_scan(listings(spark, d), "2024-01-05", "2024-01-25").where("raw_category in ('click', 'view') and venue <> 'TBA'")
    return r.select("id", F.when(c("rank") % 4 != 0, c("venue")).alias("venue"))


on_listings("flt5_page_search", {"venue": lambda: F.upper("venue")}, {"venue": "upper(venue)"}, where="contains(lower(concat(title, ' ', venue)), 'club')")


@query("flt6_hidden_categories", _fx("select id from fx where raw_category not in (select raw_category from fx group by 1 order by count(*), 1 limit 2)"))
def flt6(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d)
    hidden = rows.groupBy("raw_category").agg(F.count("*").alias("n")).orderBy("n", "raw_category").limit(2)
    return rows.join(hidden, "raw_category", "left_anti").select("id")


_MARKS = "m as (select user_id as g, cast(cast(ts as date) as varchar) as d, case when event_id % 301 = 0 then 'x|' else '' end || cast(cast(ts as date) as varchar) || '|' || event_type as k from events)"


@query("flt9_valid_marks", f"""with {_MARKS}, bad as (select g from m group by 1 having count(distinct k) > 100 or not bool_and(starts_with(k, d || '|')))
  select g, count(distinct k) filter (d >= '2024-01-15') as n from m where g not in (select g from bad) group by 1""")
def flt9(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("ts").cast("string")
    k = F.concat(F.when(c("event_id") % 301 == 0, "x|").otherwise(""), day, F.lit("|"), "event_type")
    m = tables.read_table(spark, d, "events").select(c("user_id").alias("g"), F.struct(day.alias("d"), k.alias("k")).alias("x"))
    return history.valid_marks(m.groupBy("g").agg(F.collect_set("x").alias("items")), "2024-01-15").select("g", F.size("items").alias("n"))


def _with_uid(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).withColumn("uid", tx.event_uid(c("date"), c("time"), c("title"), c("venue")))


@query("joi9_shared_uids", _fx("select uid, string_agg(distinct cast(source_pos as varchar), ',' order by cast(source_pos as varchar)) as sources from u group by 1 having count(distinct source_pos) > 1", _first))
def joi9(spark: SparkSession, d: str) -> DataFrame:
    g = _with_uid(spark, d).groupBy("uid").agg(F.array_sort(F.collect_set(c("rank").cast("string"))).alias("all"))
    return g.where("size(all) > 1").select("uid", F.array_join("all", ",").alias("sources"))


@query("joi13_pins", _fx("select slug, count(*) as n from reg join (select * from fx where date >= date '2024-01-15') f on f.venue = reg.name where pos % 4 <> 0 group by 1", _REG))
def joi13(spark: SparkSession, d: str) -> DataFrame:
    located = registry(spark, d).where("pos % 4 <> 0")
    return tables.listings_scan(listings(spark, d), "2024-01-15").join(located, c("venue") == c("name")).groupBy("slug").agg(F.count("*").alias("n"))


@query("joi14_identity_winner", _fx("select source_pos, date, raw_category, arg_min(uid, (coalesce(time, '99:99'), uid)) as uid from u group by 1, 2, 3", _first))
def joi14(spark: SparkSession, d: str) -> DataFrame:
    first = F.min_by("uid", F.struct(F.coalesce("time", F.lit("99:99")).alias("t"), c("uid")))
    return _with_uid(spark, d).groupBy(c("rank").alias("source_pos"), "date", "raw_category").agg(first.alias("uid"))


@query("joi15_best_source", _fx("select uid, min(source_pos) as best, min(id) as first_id, count(distinct source_pos) as n from u group by 1", _first))
def joi15(spark: SparkSession, d: str) -> DataFrame:
    return _with_uid(spark, d).groupBy("uid").agg(F.min("rank").alias("best"), F.min("id").alias("first_id"), F.count_distinct("rank").alias("n"))


@query("agg5_totals", _fx("select count(*) as listings, count(distinct uid) as events, (select count(*) from (select uid from u group by 1 having count(distinct source_pos) > 1)) as merged, count(*) filter (id % 97 = 0) as hearted from u", _first))
def agg5(spark: SparkSession, d: str) -> DataFrame:
    per = _with_uid(spark, d).groupBy("uid").agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b"), F.count_if(c("id") % 97 == 0).alias("h"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return per.agg(total("n").alias("listings"), F.count("*").alias("events"), F.count_if(c("a") < c("b")).alias("merged"), total("h").alias("hearted"))


@query("agg10_source_health", f"with {_LEDGER} select s.source, max(id) as last_run, max(started_at) filter (ok) as last_success from (select range as source from range(25)) s left join ledger l on l.source = s.source group by 1")
def agg10(spark: SparkSession, d: str) -> DataFrame:
    runs_ = ledger(spark, d).groupBy("source").agg(F.max("id").alias("last_run"), F.max(F.when(c("ok"), c("started_at"))).alias("last_success"))
    return spark.range(25).withColumnRenamed("id", "source").join(runs_, "source", "left")


@query("agg15_like_rates", "select event_type, user_id % 20 as src, cast(round(100.0 * (count(*) filter (event_id % 3 = 0) + 1) / (count(*) + 2)) as bigint) as rate from events group by 1, 2")
def agg15(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read_table(spark, d, "events")
    rate = F.round(100 * (F.count_if(c("event_id") % 3 == 0) + 1) / (F.count("*") + 2)).cast("long")
    return e.groupBy("event_type", (c("user_id") % 20).alias("src")).agg(rate.alias("rate"))


@query("agg16_held_weights", """select user_id, cast(sum(x) - least(0, min(p)) as bigint) as weight from (select user_id, x, sum(x) over (partition by user_id order by ts, event_id rows unbounded preceding) as p
  from (select user_id, ts, event_id, event_id % 5 - 2 as x from events)) group by 1""")
def agg16(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read_table(spark, d, "events").withColumn("x", c("event_id") % 5 - 2)
    return history.weights(e, "user_id", "x", ["ts", "event_id"])


@query("agg17_venue_cover", _fx("select slug, case when pos % 4 = 0 then name || '.jpg' else (select arg_min(title, (date, id)) from fx where fx.venue = reg.name and date >= date '2024-01-15') end as cover from reg", _REG))
def agg17(spark: SparkSession, d: str) -> DataFrame:
    up = tables.listings_scan(listings(spark, d), "2024-01-15").groupBy("venue").agg(F.min_by("title", F.struct("date", "id")).alias("img"))
    own = F.when(c("pos") % 4 == 0, F.concat("name", F.lit(".jpg")))
    return registry(spark, d).join(up, c("name") == c("venue"), "left").select("slug", F.coalesce(own, "img").alias("cover"))


@query("agg18_uid_churn", _fx(f"""select count(*) as compared, count(*) filter (a <> b) as changed from
  (select concat(source_pos, '|', raw_category, '|', date, '|', id % 500) as identity, min(uid) as a, min(case when id % 97 = 0 then 'new-' || uid else uid end) as b from u group by 1 having count(*) = 1)""", _first))
def agg18(spark: SparkSession, d: str) -> DataFrame:
    ident = F.concat_ws("|", "rank", "raw_category", "date", c("id") % 500)
    before = _with_uid(spark, d).select("id", ident.alias("identity"), "uid")
    after = before.withColumn("uid", F.when(c("id") % 97 == 0, F.concat(F.lit("new-"), "uid")).otherwise(c("uid")))
    return history.churn(before, after)


# --- top lists, curation, history ---------------------------------------------------------------------
@query("top3_last_past_event", _fx("select venue, arg_max(id, (date, coalesce(time, ''), id)) as last_id from fx where date < date '2024-01-15' group by 1"))
def top3(spark: SparkSession, d: str) -> DataFrame:
    past = listings(spark, d).where("date < date'2024-01-15'")
    return past.groupBy("venue").agg(F.max_by("id", F.struct("date", F.coalesce("time", F.lit("")).alias("t"), "id")).alias("last_id"))


@query("top7_newest_venues", _fx("select venue, min(id) as first_id from fx group by 1 order by 2 desc limit 8"))
def top7(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy("venue").agg(F.min("id").alias("first_id")).orderBy(F.desc("first_id")).limit(8)


@query("cur3_venue_search", f"with {_REG} select slug from reg where contains(slug, '00') or contains({s.slug(q('Club ') + ' || name')}, 'club-supplier-1')")
def cur3(spark: SparkSession, d: str) -> DataFrame:
    r = registry(spark, d)
    return r.where(F.contains("slug", F.lit("00")) | F.exists("aliases", lambda a: F.contains(tx.slugify(a), F.lit("club-supplier-1")))).select("slug")


@query("cur7_upsert", "select user_id, coalesce(max(value) filter (event_id % 2 = 1 and event_id % 3 = 0), max(value) filter (event_id % 2 = 0)) as value, coalesce(min(event_type) filter (event_id % 2 = 0), min(event_type) filter (event_id % 2 = 1)) as event_type from events group by 1")
def cur7(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read_table(spark, d, "events")
    each = lambda rows, v: rows.groupBy("user_id").agg(F.max(v).alias("value"), F.min("event_type").alias("event_type"))
    old = each(e.where("event_id % 2 = 0"), c("value"))
    return history.upsert(old, each(e.where("event_id % 2 = 1"), F.when(c("event_id") % 3 == 0, c("value"))), "user_id", ["value"], ["event_type"])


_SEEN = "seen as (select event_type || '-' || event_id % 400 as uid, user_id % 20 as source, max(ts) as last_seen from events group by 1, 2)"


@query(
    "cur9_orphans",
    f"""with {_LEDGER}, {_SEEN}, g as (select source, started_at, row_number() over (partition by source order by id desc) as r, first_value(started_at) over (partition by source order by id desc) as newest from ledger where ok),
    judges as (select source, max(started_at) as cutoff from g where r >= 3 and started_at <= newest - interval 12 hours and source in (select source from ledger group by 1 having max_by(ok, id)) group by 1)
    select uid, string_agg(cast(source as varchar), ',' order by cast(source as varchar)) as signature from seen left join judges using (source) group by 1 having count(cutoff) > 0 and bool_and(last_seen < cutoff)""",
)
def cur9(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read_table(spark, d, "events").select(F.concat("event_type", F.lit("-"), c("event_id") % 400).alias("uid"), (c("user_id") % 20).alias("source"), "ts")
    return history.orphans(e.groupBy("uid", "source").agg(F.max("ts").alias("last_seen")), ledger(spark, d))

"""Queries over the test tables and their SQL.

The test tables hold no event listings, so ``listings`` derives some from events, parts and
suppliers with the same SQL text in Spark and DuckDB; it grows with those tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, text as tx
from ..operators import dedup, runs, venues
from ..operators.components import cut
from ..sources import tables
from . import build as plan
from . import sql as s

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with a numbered source."""
    for name in ("events", "part", "supplier"):
        tables.read_table(spark, sf_dir, name).createOrReplaceTempView(name)
    out = spark.sql(f"with {s.LISTINGS} select * from fx")
    return out.withColumn("source", F.concat(F.lit("q"), F.lpad(F.col("source_pos").cast("string"), 2, "0"))).withColumnRenamed("source_pos", "rank")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue registry from suppliers: every 5th excluded, every 3rd of a curated kind."""
    sup = tables.read_table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return sup.select(
        tx.venue_slug(F.col("s_name")).alias("slug"),
        F.col("s_name").alias("name"),
        F.array(F.concat(F.lit("Club "), "s_name")).alias("aliases"),
        classify.region(tx.slugify(F.col("s_name"))).alias("region"),
        k.alias("pos"),
        F.when(k % 3 == 0, "club").alias("kind"),
        F.when(k % 5 == 0, "geschlossen").alias("excluded"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run ledger from events: one run an event."""
    e = tables.read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 20).alias("source"),
        F.col("ts").alias("started_at"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("event_id") % 100).alias("event_count"),
    )


_LEDGER = """ledger as (select event_id as id, user_id % 20 as source, ts as started_at, event_type <> 'error' as ok,
  case when event_id % 5 = 0 then 0 else event_id % 100 end as event_count from events)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in _Q:
            raise ValueError(f"two queries are named {name}")
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _fx(select: str, more: str = "") -> str:
    return f"with {s.LISTINGS}{', ' + more if more else ''} {select}"


def on_listings(name: str, cols: dict[str, Callable[[], Column]], sql: dict[str, str], where: str = "true") -> None:
    """A query that computes columns of every listing."""
    picked = ", ".join(f"{v} as {k}" for k, v in sql.items())
    query(name, _fx(f"select id, {picked} from fx where {where}"))(
        lambda spark, d: listings(spark, d).where(where).select("id", *[f().alias(k) for k, f in cols.items()])
    )


def on_documents(name: str, cols: dict[str, Callable[[], Column]], sql: dict[str, str]) -> None:
    """A query that computes columns of every document's whole text."""
    picked = ", ".join(f"{v} as {k}" for k, v in sql.items())
    query(name, f"select doc_id, {picked} from documents")(
        lambda spark, d: tables.read_table(spark, d, "documents").select("doc_id", *[f().alias(k) for k, f in cols.items()])
    )


c = F.col
joined = lambda x: F.array_join(x, ",")
jsql = lambda x: f"array_to_string({x}, ',')"

# --- scalar functions -------------------------------------------------------------------------
on_documents("scl1_slugify", {"slug": lambda: tx.slugify(c("text"))}, {"slug": s.slug("text")})
on_listings(
    "scl2_run_slug",
    {"t": lambda: tx.run_slug(c("title")), "v": lambda: tx.run_slug(c("venue"))},
    {"t": s.slug("title"), "v": s.slug("venue")},
)
on_listings(
    "scl3_run_key",
    {"k": lambda: tx.run_key(c("date"), c("venue"), c("title"))},
    {"k": f"concat(cast(date as varchar), '|', {s.slug('venue')}, '|', {s.slug('title')})"},
)
_uid = f"substr(sha1(concat(cast(date as varchar), '|', coalesce(time, ''), '|', {s.slug('title')}, '|', {s.slug('venue')})), 1, 16)"
on_listings("scl4_event_uid", {"uid": lambda: tx.event_uid(c("date"), c("time"), c("title"), c("venue"))}, {"uid": _uid})
on_listings(
    "scl5_identity_key",
    {"k": lambda: tx.identity_key(c("source"), c("raw_category"), c("date"))},
    {"k": "sha1(concat('q', lpad(cast(source_pos as varchar), 2, '0'), '|', coalesce(raw_category, ''), '|', cast(date as varchar)))"},
)
on_documents(
    "scl6_normalize_time",
    {"t": lambda: tx.normalize_time(c("text"))},
    {"t": r"case when regexp_extract(text, '(\d{1,2})[:.](\d{2})', 1) <> '' then concat(lpad(regexp_extract(text, '(\d{1,2})[:.](\d{2})', 1), 2, '0'), ':', regexp_extract(text, '(\d{1,2})[:.](\d{2})', 2)) end"},
)
_min = "try_cast(split_part(time, ':', 1) as int) * 60 + try_cast(split_part(time, ':', 2) as int)"
on_listings("scl7_minutes", {"m": lambda: tx.minutes(c("time"))}, {"m": _min})
on_listings(
    "scl15_keywords",
    {"k": lambda: joined(tx.keywords(c("title")))},
    {
        "k": jsql(
            "list_transform(list_sort(list_transform(list_distinct("
            + s.without(s.words(s.slug("title")), s.rules.STOPWORDS, "length(w) >= 4")
            + "), lambda w: {'n': -length(w), 'w': w})), lambda z: z.w)[1:3]"
        )
    },
)
on_listings("scl16_venue_slug", {"k": lambda: tx.venue_slug(c("venue"))}, {"k": s.venue_slug("venue")})
on_listings("scl17_venue_key", {"k": lambda: tx.venue_key(c("venue"))}, {"k": s.venue_key("venue")})
on_listings("scl18_unknown_venue", {"u": lambda: tx.venue_key(c("venue")) == ""}, {"u": f"({s.venue_key('venue')}) = ''"})
on_listings(
    "scl19_title_tokens", {"k": lambda: joined(F.array_sort(tx.title_tokens(tx.slugify(c("title")))))}, {"k": jsql(f"list_sort({s.tokens(s.slug('title'))})")}
)
on_listings(
    "scl22_time_compatible",
    {"ok": lambda: tx.time_compatible(c("time"), F.lit("23:30"), 90)},
    {"ok": f"time is null or least(abs({_min} - 1410), 1440 - abs({_min} - 1410)) <= 90"},
)
_num = r"list_filter(regexp_extract_all(text, '\d+'), lambda x: not regexp_full_match(x, '(19|20)\d\d'))"
on_documents("scl23_numbers", {"k": lambda: joined(tx.numbers(c("text")))}, {"k": jsql(f"list_sort(list_distinct({_num}))")})
on_documents("scl25_is_short", {"short": lambda: tx.is_short(c("text"))}, {"short": r"length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) < 80"})
on_documents(
    "scl28_cut_text",
    {"cut": lambda: tx.cut_text(c("text"))},
    {"cut": r"case when length(text) > 700 then concat(regexp_replace(substr(text, 1, 700), ' [^ ]*\z', ''), ' …') else text end"},
)
on_listings("scl31_title_key", {"k": lambda: tx.title_key(c("title"))}, {"k": s.title_key("title")})


@query(
    "scl26_single_link",
    r"""select page_id, trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') not in ('', 'index.php', 'index.html')
      and not contains(url, '/terminal/day/') as single, regexp_replace(url, '[?#].*$', '') as bare,
      case when regexp_matches(lower(url), '^https?://') then url end as web from pages""",
)
def scl26(spark: SparkSession, d: str) -> DataFrame:
    p = tables.read_table(spark, d, "pages")
    return p.select("page_id", tx.is_single_link(c("url")).alias("single"), tx.without_query(c("url")).alias("bare"), tx.web_url(c("url")).alias("web"))


on_documents(
    "scl27_clean_price",
    {"price": lambda: tx.clean_price(F.concat(c("text"), F.lit(" | Quelle: "), c("source")))},
    {"price": r"nullif(trim(regexp_replace(concat(text, ' | Quelle: ', source), '(?is)\s*\|?\s*quelle:.*$', ''), ' |'), '')"},
)


@query("scl37_ip_hash", "select event_id, substr(sha256(concat(cast(user_id % 17 as varchar), '|', cast(cast(ts as date) as varchar), '|salt')), 1, 16) as h from events")
def scl37(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read_table(spark, d, "events")
    return e.select("event_id", tx.ip_hash((c("user_id") % 17).cast("string"), F.to_date("ts"), "salt").alias("h"))


# --- classification -------------------------------------------------------------------------------
_SLUGS = f"slugs as materialized (select id, title, {s.slug('title')} as t, {s.slug('raw_category')} as r, {s.slug('venue')} as v from fx)"
_DOC = f"slugs as materialized (select doc_id, {s.slug('text')} as t from documents)"
no = lambda: F.lit(None).cast("string")


def _slugs(spark: SparkSession, d: str) -> DataFrame:
    return classify.slugged(listings(spark, d), r="raw_category", t="title", v="venue").withColumn(
        "category", classify.category(c("r"), c("t"), c("v"))
    )


def _doc_slugs(spark: SparkSession, d: str) -> DataFrame:
    return classify.slugged(tables.read_table(spark, d, "documents").select("doc_id", "text"), t="text")


query("scl9_category", _fx(f"select id, {s.category('t', 'r', 'v')} as category from slugs", _SLUGS))(lambda spark, d: _slugs(spark, d).select("id", "category"))
query("scl24_region", _fx(f"select id, {s.region('v')} as region from slugs", _SLUGS))(
    lambda spark, d: _slugs(spark, d).select("id", classify.region(c("v")).alias("region"))
)
query("scl33_exclusion", _fx(f"select id, {s.exclusion('lower(title)')} as reason from fx"))(
    lambda spark, d: _slugs(spark, d).select("id", classify.exclusion_reason(c("title"), F.lit("musik"), c("v"), F.lit(""), F.lit("")).alias("reason"))
)
query("scl14_tags", _fx(f"select id, {s.tags('t', 'v', chr(39) * 2)} as tags from slugs", _SLUGS))(lambda spark, d: _slugs(spark, d).select("id", joined(classify.tags(c("t"), c("v"), no())).alias("tags")))
_CATEGORIZED = f"{_SLUGS}, cats as materialized (select *, {s.category('t', 'r', 'v')} as cat from slugs)"
query("scl32_facets", _fx(f"select id, {jsql(s.facets('t', 'cat', 'v', chr(39) * 2))} as facets from cats", _CATEGORIZED))(lambda spark, d: _slugs(spark, d).select("id", joined(classify.facets(c("t"), c("category"), c("v"), no())).alias("facets")))
query("scl10_title_decides", f"with {_DOC} select doc_id, {s.category('t', chr(39) * 2, chr(39) * 2)} as category from slugs")(
    lambda spark, d: _doc_slugs(spark, d).select("doc_id", classify.category(F.lit(""), c("t"), F.lit("")).alias("category"))
)
query("scl11_sport", f"with {_DOC} select doc_id, {s.is_sport('t')} as sport from slugs")(
    lambda spark, d: _doc_slugs(spark, d).select("doc_id", classify.is_sport(c("t")).alias("sport"))
)


# --- scans and sinks ------------------------------------------------------------------------------
@query("src1_listings_scan", _fx("select id, date, time from fx where date >= date '2024-01-15'"))
def src1(spark: SparkSession, d: str) -> DataFrame:
    return tables.listings_scan(listings(spark, d), "2024-01-15").select("id", "date", "time")


@query("src2_events_scan", _fx("select id, date, time, title from fx where date between date '2024-01-10' and date '2024-01-20'"))
def src2(spark: SparkSession, d: str) -> DataFrame:
    return tables.events_scan(listings(spark, d), "2024-01-10", "2024-01-20").select("id", "date", "time", "title")


@query("src3_source_registry", _fx("select source_pos as source, row_number() over (order by -source_pos) - 1 as pos, n from (select source_pos, count(*) as n from fx group by 1)"))
def src3(spark: SparkSession, d: str) -> DataFrame:
    known = listings(spark, d).groupBy(c("rank").alias("source")).agg(F.count("*").alias("n"))
    return tables.source_registry(known.withColumn("rank", -c("source"))).select("source", c("pos").cast("long").alias("pos"), "n")


_first = f"u as (select *, {_uid} as uid from fx)"


@query("src7_replace_listings", _fx("select id, source_pos, uid from (select *, row_number() over (partition by source_pos, uid order by id) as r from u) where r = 1", _first))
def src7(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d).withColumn("uid", tx.event_uid(c("date"), c("time"), c("title"), c("venue")))
    return tables.first_of_each(rows, ["rank", "uid"], c("id")).select("id", c("rank").alias("source_pos"), "uid")


@query("src9_details_upsert", "select url, event_id, ts from (select event_type || '-' || user_id as url, event_id, ts, row_number() over (partition by event_type, user_id order by ts desc, event_id desc) as r from events) where r = 1")
def src9(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read_table(spark, d, "events").select(F.concat("event_type", F.lit("-"), "user_id").alias("url"), "event_id", "ts")
    rows = e.withColumn("fetched_at", F.struct("ts", "event_id"))
    return tables.upsert_details(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")).drop("fetched_at")


_day = """g as (select date, count(*) as n, string_agg(concat(cast(id as varchar), ':', coalesce(time, '')), ',' order by coalesce(time, '99:99'), title, id) as json from fx group by date)"""


@query("src12_day_export", _fx("select date, n, substr(sha1(json), 1, 8) as version from g", _day))
def src12(spark: SparkSession, d: str) -> DataFrame:
    keyed = F.struct(F.coalesce("time", F.lit("99:99")).alias("t"), "title", "id", F.concat(c("id").cast("string"), F.lit(":"), F.coalesce("time", F.lit(""))).alias("e"))
    g = listings(spark, d).groupBy("date").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(keyed)).alias("all"))
    return g.select("date", "n", F.substring(F.sha1(F.array_join(F.transform("all", lambda x: x["e"]), ",")), 1, 8).alias("version"))


@query("src14_publication")
def src14(spark: SparkSession, d: str) -> DataFrame:
    return tables.day_export(listings(spark, d), ["id", "title", "time", "venue"]).select("date", "n", "version")


# --- joins and duplicates -------------------------------------------------------------------------
_REG = f"""reg as (select {s.venue_slug('s_name')} as slug, s_name as name, s_suppkey as pos from supplier)"""


@query(
    "joi1_resolve_venues",
    _fx(
        f"""select fx.id, coalesce(a.slug, b.slug, {s.venue_slug('venue')}) as ort from fx
        left join (select n, min_by(slug, pos) as slug from (select name as n, slug, pos from reg union all select 'Club ' || name, slug, pos from reg) group by n) a on a.n = fx.venue
        left join (select k, min_by(slug, pos) as slug from (select slug as k, slug, pos from reg union all select {s.venue_slug("'Club ' || name")}, slug, pos from reg) group by k) b
          on b.k = {s.venue_slug('venue')}""",
        _REG,
    ),
)
def joi1(spark: SparkSession, d: str) -> DataFrame:
    return venues.resolve(listings(spark, d), registry(spark, d))[0].select("id", "ort")


_PREP = f"""p as materialized (select id, source_pos as source, date, time, {s.venue_key('venue')} as vkey, {s.tokens(s.slug('title'))} as tok,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(title, '\\d+'), lambda x: not regexp_full_match(x, '(19|20)\\d\\d')))), ',') as nums from fx)"""


@query(
    "joi3_self_duplicates",
    _fx(
        """select x.id as a, y.id as b from p x join p y on x.source = y.source and x.date = y.date and x.time = y.time and x.vkey = y.vkey and x.nums = y.nums and x.id < y.id
        where x.vkey <> '' and x.time <> '00:00' and len(x.tok) > 0 and len(y.tok) > 0 and len(list_intersect(x.tok, y.tok)) = least(len(x.tok), len(y.tok))""",
        _PREP,
    ),
)
def joi3(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d).withColumn("category", F.lit("musik"))
    return dedup.self_duplicates(dedup.prepared(rows))


@query(
    "joi2_same_venue_overlap",
    _fx(
        f"""select least(x.id, y.id) as a, greatest(x.id, y.id) as b, round(len(list_intersect(x.tok, y.tok)) / least(len(x.tok), len(y.tok)), 6) as overlap
        from p x join p y on x.date = y.date and x.vkey = y.vkey and x.source <> y.source and x.id < y.id
        where x.vkey <> '' and len(x.tok) > 0 and len(y.tok) > 0 and len(list_intersect(x.tok, y.tok)) / least(len(x.tok), len(y.tok)) >= 0.6""",
        _PREP,
    ),
)
def joi2(spark: SparkSession, d: str) -> DataFrame:
    rows = dedup.prepared(listings(spark, d).withColumn("category", F.lit("musik")))
    return dedup.overlapping(rows, 0.6).withColumn("overlap", F.round("overlap", 6))


@query("clu1_accepted_pairs")
def clu1(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d).withColumn("category", F.lit("musik"))
    return dedup.accepted_pairs(cut(dedup.prepared(rows))).withColumn("score", F.round("score", 6))


@query("clu3_clusters")
def clu3(spark: SparkSession, d: str) -> DataFrame:
    return dedup.clusters(cut(dedup.prepared(listings(spark, d).withColumn("category", F.lit("musik")))))


@query(
    "joi7_venue_pairs",
    _fx(
        f"""select x.ort as a, y.ort as b, count(*) as n from k x join k y on x.date = y.date and x.key = y.key and x.ort < y.ort group by 1, 2 having count(*) >= 2""",
        f"k as (select distinct date, {s.title_key('title')} as key, venue as ort from fx where {s.title_key('title')} <> '')",
    ),
)
def joi7(spark: SparkSession, d: str) -> DataFrame:
    return venues.suspicious_pairs(listings(spark, d).withColumn("ort", c("venue")), example=False).select("a", "b", "n")


@query("joi8_detail_candidates", _fx("select distinct f.venue from fx f where f.venue <> 'TBA' and not exists (select 1 from supplier where s_name = f.venue)"))
def joi8(spark: SparkSession, d: str) -> DataFrame:
    known = tables.read_table(spark, d, "supplier").select(c("s_name").alias("venue"))
    return listings(spark, d).where("venue <> 'TBA'").select("venue").distinct().join(known, "venue", "left_anti")


@query("joi12_venue_upcoming", "with " + s.LISTINGS + " select s_name as name, (select count(*) from fx where fx.venue = s_name and fx.date >= date '2024-01-15') as n from supplier")
def joi12(spark: SparkSession, d: str) -> DataFrame:
    up = tables.listings_scan(listings(spark, d), "2024-01-15").groupBy("venue").agg(F.count("*").alias("n"))
    sup = tables.read_table(spark, d, "supplier").select(c("s_name").alias("name"))
    return sup.join(up, c("name") == c("venue"), "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


# --- aggregation ----------------------------------------------------------------------------------
@query("agg2_ongoing", _fx("select id, (select count(distinct date) from fx g where g.title = f.title and g.venue is not distinct from f.venue) >= 7 as ongoing from fx f"))
def agg2(spark: SparkSession, d: str) -> DataFrame:
    return plan.mark_ongoing(listings(spark, d).withColumn("ort", c("venue"))).select("id", "ongoing")


_told = "t as (select id, venue as ort, case when id % 4 = 0 then 'sonstiges' else raw_category end as category, case when length(venue) % 2 = 0 then 'club' end as kind from fx)"


@query(
    "agg3_inherited_category",
    _fx(
        """select id, case when category = 'sonstiges' and kind is not null and (select count(distinct category) from t u where u.ort = t.ort and category not in ('sonstiges', 'demo')) = 1
        then (select min(category) from t u where u.ort = t.ort and category not in ('sonstiges', 'demo')) else category end as category from t""",
        _told,
    ),
)
def agg3(spark: SparkSession, d: str) -> DataFrame:
    cat = F.when(c("id") % 4 == 0, "sonstiges").otherwise(c("raw_category"))
    kind = F.when(F.length("venue") % 2 == 0, "club")
    t = listings(spark, d).select("id", c("venue").alias("ort"), cat.alias("category"), kind.alias("kind"))
    return plan.inherit_category(t).select("id", "category")


@query("agg4_category_counts", _fx("select raw_category as category, count(*) as n from fx group by 1"))
def agg4(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy(c("raw_category").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


@query("agg6_venue_counts", _fx("select venue, count(*) as n, count(distinct date) as days, min(date) as first, max(date) as last from fx group by 1"))
def agg6(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy("venue").agg(F.count("*").alias("n"), F.count_distinct("date").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(
    "agg9_last_runs",
    f"with {_LEDGER} select source, max(id) as last_run, max_by(ok, id) as last_ok, max(id) filter (ok) as last_good_run, max_by(event_count, id) filter (ok) as last_good_count from ledger group by 1",
)
def agg9(spark: SparkSession, d: str) -> DataFrame:
    return runs.last_runs(ledger(spark, d))


@query("agg11_bookmark_counts", "select cast(cast(ts as date) as varchar) || '|' || event_type as k, count(*) as n from events where cast(ts as date) >= date '2024-01-15' and user_id <> 3 group by 1")
def agg11(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read_table(spark, d, "events")
    day = F.to_date("ts")
    marks = e.select(c("user_id").alias("g"), day.alias("d"), F.concat(day.cast("string"), F.lit("|"), "event_type").alias("k"))
    return runs.bookmark_counts(marks, "2024-01-15", device=3)


@query("agg12_devices_per_ip", "select user_id % 17 as ip, count(distinct user_id) as n from events group by 1 having count(distinct user_id) >= 2")
def agg12(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read_table(spark, d, "events")
    return e.groupBy((c("user_id") % 17).alias("ip")).agg(F.count_distinct("user_id").alias("n")).where("n >= 2")


@query(
    "agg13_folded_runs",
    _fx(
        """select run_key, count(*) as n, coalesce(string_agg(time, ',' order by time), '') as times, min(id) as first_id from (select *, count(*) over (partition by run_key) as m from k)
        group by run_key, case when m >= 3 then -1 else id end""",
        f"k as (select *, concat(cast(date as varchar), '|', {s.slug('venue')}, '|', {s.slug('title')}) as run_key from fx)",
    ),
)
def agg13(spark: SparkSession, d: str) -> DataFrame:
    return runs.fold_runs(listings(spark, d))


# --- windows, top lists, sets ----------------------------------------------------------------------
@query("win2_uid_suffix", _fx("select id, case when r > 1 then uid || '-' || r else uid end as uid from (select id, uid, row_number() over (partition by uid order by id) as r from u)", _first))
def win2(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d).withColumn("uid", tx.event_uid(c("date"), c("time"), c("title"), c("venue"))).withColumn("cluster", c("id"))
    return plan.suffixed_uids(rows).select("id", "uid")


@query(
    "win4_heading_carried",
    "select event_id, last_value(h ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as heading from (select event_id, user_id, case when event_id % 9 = 0 then event_type end as h from events)",
)
def win4(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read_table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", F.last(F.when(c("event_id") % 9 == 0, c("event_type")), ignorenulls=True).over(w).alias("heading"))


@query(
    "win6_orphan_cutoff",
    f"""with {_LEDGER}, g as (select source, started_at, row_number() over (partition by source order by id desc) as r, first_value(started_at) over (partition by source order by id desc) as newest from ledger where ok)
    select source, max(started_at) as cutoff from g where r >= 3 and started_at <= newest - interval 12 hours group by 1""",
)
def win6(spark: SparkSession, d: str) -> DataFrame:
    return runs.orphan_cutoff(ledger(spark, d))


@query(
    "win7_silent_zero",
    f"""with {_LEDGER} select id, source, before from (select *, last_value(case when ok then event_count end ignore nulls) over (partition by source order by id rows between unbounded preceding and 1 preceding) as before from ledger)
    where event_count = 0 and before > 0""",
)
def win7(spark: SparkSession, d: str) -> DataFrame:
    return runs.silent_zero_runs(ledger(spark, d)).select("id", "source", "before")


@query("top1_best_of_week", _fx("select id, score from (select id, id % 101 as score, date, time from fx where date between date '2024-01-10' and date '2024-01-16') order by score desc, date, time nulls first, id limit 8"))
def top1(spark: SparkSession, d: str) -> DataFrame:
    week = listings(spark, d).where("date between date '2024-01-10' and date '2024-01-16'").withColumn("score", c("id") % 101)
    return week.orderBy(F.desc("score"), "date", c("time").asc_nulls_first(), "id").limit(8).select("id", "score")


@query("top2_venue_first_events", _fx("select venue, id, r from (select venue, id, row_number() over (partition by venue order by date, coalesce(time, '99:99'), id) as r from fx) where r <= 6"))
def top2(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("venue").orderBy("date", F.coalesce("time", F.lit("99:99")), "id")
    return listings(spark, d).select("venue", "id", F.row_number().over(w).cast("long").alias("r")).where("r <= 6")


@query("str1_bookmark_state", "select g, k, t from (select user_id as g, cast(cast(ts as date) as varchar) || '|' || event_type as k, ts as t, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def str1(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read_table(spark, d, "events")
    m = e.select(c("user_id").alias("g"), F.concat(F.to_date("ts").cast("string"), F.lit("|"), "event_type").alias("k"), c("ts").alias("t"), c("event_id").alias("id"))
    return runs.latest_snapshots(m).select("g", "k", "t")


# --- the whole chain --------------------------------------------------------------------------------
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which distinct events take place, merged over their sources, and which are ongoing."""
    events = plan.build(listings(spark, sf_dir), registry(spark, sf_dir))
    return events.select("uid", "date", "time", "title", "ort", "category", "sources", "n_members", "ongoing")


_Q["build_events"] = flagship


def _load() -> None:
    from . import dimensions, extra, extraction, more, publishing, upkeep  # noqa: F401  they register their queries on import


def queries() -> dict[str, Query]:
    _load()
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

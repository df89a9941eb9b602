"""The venue registry as documents: loading, saving, flavours, favourites, renames, import and the map's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .views import located, not_meeting_point

#: Fields of a stored venue, in the order in which they are written.
FIELDS = ("name", "aliase", "region", "art", "herz", "raus", "homepage", "cover", "beschreibung", "strasse", "plz", "ort", "lat", "lon")
_TYPES = {"aliase": "array<string>", "herz": "boolean", "lat": "double", "lon": "double"}
SCHEMA = "map<string, struct<" + ", ".join(f"{f}: {_TYPES.get(f, 'string')}" for f in FIELDS) + ">>"
#: A kind that says nothing is not written.
PLAIN_KIND = "sonstiges"


def load_registry(texts: DataFrame, column: str = "value") -> DataFrame:
    """(slug and the fields) of JSON objects keyed by slug, one or more objects a table; broken JSON gives no row."""
    return texts.select(F.explode(F.from_json(column, SCHEMA)).alias("slug", "v")).select("slug", "v.*")


def load_flavours(texts: DataFrame, venues: DataFrame | None = None, column: str = "value") -> DataFrame:
    """(slug, flavour): each venue's main flavour but "unklar"; with ``venues`` only those of known ones."""
    kind = "struct<orte: map<string, struct<haupt: string, neben: array<string>, von: string>>>"
    each = texts.select(F.explode(F.from_json(column, kind)["orte"]).alias("slug", "v")).select("slug", F.col("v.haupt").alias("flavour"))
    out = each.where("flavour is not null and flavour not in ('', 'unklar')")
    return out if venues is None else out.join(venues.select("slug"), "slug", "left_semi")


def _written(f: str) -> Column:
    c = F.col(f)
    if f == "aliase":
        return F.when(F.size(c) > 0, c)
    if f == "herz":
        return F.when(c, c)
    if f == "art":
        return F.when(c != PLAIN_KIND, F.nullif(c, F.lit("")))
    return c if f in _TYPES else F.nullif(c, F.lit(""))


def registry_json(venues: DataFrame) -> DataFrame:
    """(slug, json): a line a venue, by slug; fields in fixed order, empty ones and the plain kind left out."""
    fields = [f for f in FIELDS if f in venues.columns]
    return venues.select("slug", F.to_json(F.struct(*[_written(f).alias(f) for f in fields])).alias("json")).orderBy("slug")


def geo_table(venues: DataFrame) -> DataFrame:
    """(slug, json): name, place, region and kind (null if unknown) of located venues that are no meeting points."""
    fit = venues.where(located(F.col("lat"), F.col("lon")) & not_meeting_point(F.col("kind")))
    place = F.struct(F.col("name").alias("n"), "lat", "lon", F.col("region").alias("r"), F.col("kind").alias("k"))
    return fit.select("slug", F.to_json(place, {"ignoreNullFields": "false"}).alias("json"))


def set_favourites(venues: DataFrame, marks: DataFrame) -> DataFrame:
    """Venues with the favourite flag of ``marks`` (slug, herz) where there is one."""
    m = marks.groupBy("slug").agg(F.max("herz").alias("set_"))
    return venues.join(m, "slug", "left").withColumn("herz", F.coalesce("set_", "herz")).drop("set_").select(*venues.columns)


def renamed(venues: DataFrame, names: DataFrame) -> DataFrame:
    """Venues under their new slugs by ``names`` (old, new)."""
    j = venues.join(names, venues.slug == names.old, "left")
    return j.withColumn("slug", F.coalesce("new", "slug")).select(*venues.columns)


def nested(venues: DataFrame, aliases: DataFrame) -> DataFrame:
    """Registry rows from a table of venues and one of aliases (slug, alias, pos), in order of position."""
    a = aliases.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("pos", "alias"))).alias("all_"))
    j = venues.join(a, "slug", "left")
    listed = F.coalesce(F.transform("all_", lambda x: x["alias"]), F.array().cast("array<string>"))
    return j.withColumn("aliases", F.array_distinct(listed)).drop("all_")

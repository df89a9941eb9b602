"""Metadata and links of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import found, squeezed

LINK = r"""(?is)<a\b[^>]*?\shref=["']([^"']*)["'][^>]*>(.*?)</a>"""
ADDRESS = r"(?is)<address\b[^>]*>(.*?)</address>"
# Hosts and labels that decide what a link is, and the places of address and coordinates on a venue's page.
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "twitter.com", "x.com")
NO_HOMEPAGE_HOSTS = (
    "reservix.de", "eventim.de", "ticketmaster.de", "etix.com", "google.com", "google.de", "openstreetmap.org", "maps.app.goo.gl",
    "paypal.com", "spotify.com", "youtube-nocookie.com", "youtube.com", "youtu.be", "vimeo.com",
)
HOMEPAGE_LABELS = ("homepage", "website", "webseite", "web", "internet", "zur website", "zur homepage")
PLACE_BLOCK = r'(?s)<div class="box-location-description">(.*?)</div>'
COORDINATES = (
    r"""(?:google\.[a-z.]+/maps[^"']*?query=|openstreetmap\.org[^"']*?mlat=)"""
    r"""(-?[0-9]{1,2}\.[0-9]{3,})[,&][^0-9-]{0,8}(-?[0-9]{1,3}\.[0-9]{3,})"""
)
AREA = (50.5, 52.0, 12.5, 15.2)

def _meta(html: Column, name: str) -> Column:
    return found(html, rf"""(?is)<meta\b[^>]*?(?:property|name)="{name}"[^>]*?content="([^"]*)\"""")


def metadata(pages: DataFrame) -> DataFrame:
    """(page_id, title, heading, description of at most 500 characters, image): the page's own tags before general ones."""
    h = F.col("html")
    plain = F.regexp_replace(F.regexp_extract(h, r"(?is)<h[1-4]\b[^>]*>(.*?)</h[1-4]>", 1), r"<[^>]*>", " ")
    return pages.select(
        "page_id",
        squeezed(F.coalesce(_meta(h, "og:title"), found(h, r"(?is)<title\b[^>]*>(.*?)</title>"))).alias("title"),
        squeezed(plain).alias("heading"),
        F.substring(squeezed(F.coalesce(_meta(h, "og:description"), _meta(h, "description"))), 1, 500).alias("description"),
        F.coalesce(_meta(h, "og:image"), _meta(h, "twitter:image")).alias("image"),
    )


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, label) of every link; labels without tags."""
    h = F.col("html")
    both = F.arrays_zip(
        F.regexp_extract_all(h, F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all(h, F.lit(LINK), F.lit(2)).alias("label")
    )
    each = pages.select("page_id", F.posexplode(both).alias("pos", "l"))
    label = squeezed(F.regexp_replace("l.label", r"<[^>]*>", " "))
    return each.select("page_id", "pos", F.col("l.href").alias("href"), label.alias("label"))


def _host(href: Column) -> Column:
    return F.replace(F.lower(F.regexp_extract(href, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("www."), F.lit(""))


def _holds(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p)) if parts else F.lit(False)


def link_kind(href: Column, label: Column) -> Column:
    """"social", "homepage" (the label is the link's own domain, or says so) or "other"; ticket, map and video hosts are other."""
    host = _host(href)
    said = F.rtrim(F.lower(F.coalesce(label, F.lit(""))), F.lit("/"))
    domain = F.contains(said, F.lit(".")) & ~F.contains(said, F.lit(" ")) & (F.replace(said, F.lit("www."), F.lit("")) == host)
    named = F.lower(F.coalesce(label, F.lit(""))).isin(*HOMEPAGE_LABELS)
    home = F.when(_holds(host, NO_HOMEPAGE_HOSTS), "other").when(domain | named, "homepage").otherwise("other")
    return F.when(_holds(host, SOCIAL_HOSTS), "social").otherwise(home)


def outbound(pages: DataFrame, own_host: str, chrome: tuple[str, ...] = ()) -> DataFrame:
    """Per page: its first home page candidate, different links to candidates, social sites and elsewhere, and a status.

    Links to ``own_host`` do not count, nor do those that hold one of ``chrome`` (what stands on every page). Of a
    repeated address the first link's label decides.
    """
    href = F.col("href")
    plain = F.replace(F.lower(href), F.lit("www."), F.lit(""))
    each = links(pages).withColumn("href", F.trim("href")).where(F.startswith(F.col("href"), F.lit("http")))
    each = each.where(~F.contains(_host(href), F.lit(own_host)) & ~_holds(plain, chrome))
    once = each.groupBy("page_id", "href").agg(F.min_by(F.struct("pos", "label"), "pos").alias("l"))
    kinds = once.select("page_id", "href", "l.pos", link_kind(href, F.col("l.label")).alias("kind"))
    n = lambda k: F.count_if(F.col("kind") == k)
    first = F.min_by("href", F.when(F.col("kind") == "homepage", F.col("pos")))
    got = kinds.groupBy("page_id").agg(first.alias("homepage"), *[n(k).alias(f"n_{k}") for k in ("homepage", "social", "other")])
    status = F.when(F.col("n_homepage") == 1, "ok").when(F.col("n_homepage") > 1, "ok_mehrdeutig").when(F.col("n_social") > 0, "nur_social")
    both = pages.select("page_id").join(got, "page_id", "left").fillna(0, ["n_homepage", "n_social", "n_other"])
    return both.withColumn("status", status.otherwise("not_found"))


def alias_targets(pages: DataFrame, base: str) -> DataFrame:
    """(label, href): where an ``<address>`` block with this text first leads, by page and place; local links stand on ``base``."""
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(ADDRESS), F.lit(1))).alias("pos", "block"))
    label = squeezed(F.regexp_replace("block", r"<[^>]*>", " "))
    href = F.trim(F.regexp_extract("block", LINK, 1))
    each = blocks.where(F.rlike("block", F.lit(LINK))).select("page_id", "pos", label.alias("label"), href.alias("href"))
    whole = F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(F.concat(F.lit(base), "href"))
    return each.where("label is not null").groupBy("label").agg(F.min_by(whole, F.struct("page_id", "pos")).alias("href"))


def locations(pages: DataFrame) -> DataFrame:
    """(page_id, address, street, postcode, city, lat, lon) of venue pages; each may be null.

    The first line that begins with a postcode gives it and the city, the line above the street. Coordinates outside
    ``AREA`` are taken for none.
    """
    text = F.regexp_replace(F.regexp_replace(F.regexp_extract("html", PLACE_BLOCK, 1), r"<br\s*/?>", "\n"), r"<[^>]+>", " ")
    lines = F.filter(F.transform(F.split(text, "\n"), squeezed), lambda x: x.isNotNull())
    at = F.array_position(F.transform("lines", lambda x: F.rlike(x, F.lit(r"^[0-9]{5}\s+."))), True)
    rows = pages.select("page_id", "html", lines.alias("lines")).withColumn("at", F.coalesce(at, F.lit(0)).cast("int"))
    line = F.when(F.col("at") > 0, F.get("lines", F.col("at") - 1))
    above = F.when(F.col("at") > 1, F.get("lines", F.col("at") - 2))
    lat, lon = (F.regexp_extract("html", COORDINATES, g).try_cast("double") for g in (1, 2))
    south, north, west, east = AREA
    inside = lat.between(south, north) & lon.between(west, east)
    parts = rows.select(
        "page_id",
        F.when(~above.rlike("^(?:tel|mailto):"), above).alias("street"),
        F.nullif(F.substring(line, 1, 5), F.lit("")).alias("postcode"),
        F.trim(F.substring(line, 6, 1 << 30)).alias("city"),
        F.when(inside, lat).alias("lat"),
        F.when(inside, lon).alias("lon"),
    )
    town = F.concat("postcode", F.lit(" "), "city")
    return parts.withColumn("address", F.nullif(F.concat_ws(", ", "street", town), F.lit("")))

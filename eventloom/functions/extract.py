"""Fields out of free text and feeds: times, prices, dates, categories, images. Built-in expressions only.

Null or unmatched input gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_time, slugify

# Patterns and tables that decide which field a text yields.
TIME_ONLY = r"^\s*\d{1,2}[:.]\d{2}\s*(?:[-–—]|bis)?\s*(?:\d{1,2}[:.]\d{2})?\s*(?:Uhr)?\s*$"
TIME_INSIDE = r"\d{1,2}:\d{2}(?:\s*(?:[-–—]|bis)\s*\d{1,2}:\d{2})?(?:\s*Uhr)?"
PRICES = (
    r"(?i)((?:ab\s*)?\d{1,3}(?:[.,]\d{2})?\s*(?:Euro|EUR|€)(?:\s*(?:[-–—]|bis)\s*\d{1,3}(?:[.,]\d{2})?\s*(?:Euro|EUR|€)?)?)",
    r"(?i)(Eintritt\s*(?:ist\s*)?frei)",
    r"(?i)(kostenlos)",
    r"(?i)Eintritt[:\s]+([^.\n;(]{1,40})",
)
IN_PARENS = r"\(\s*([A-Za-zÄÖÜäöüß/ -]{3,20}?)\s*\)"
MOVED = r"(?i)\s*[(\[]\s*(?:hoch|runter)?verlegt\s+(?:in\s+die|in\s+den|in\s+das|ins|nach)\s+([^)\]]+)[)\]]\s*"
SOLD_OUT = r"(?i)\s*\(\s*ausverkauft!?\s*\)\s*"
START = r"(?i)(?:Beginn|Start)\s*:?\s*(\d{1,2})(?:[:.](\d{2}))?\s*Uhr"
DOORS = r"(?i)Einlass\s*:?\s*(\d{1,2})(?:[:.](\d{2}))?\s*Uhr"
TWELVE_HOURS = r"(?i)^\s*(\d{1,2}):(\d{2})\s*([AP])\.?M\.?\s*$"
IMAGE_URL = r"url\(([^)]+)\)"
MONTHS = {"jan": 1, "feb": 2, "mae": 3, "mar": 3, "apr": 4, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "nov": 11, "dez": 12}


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


#: Named character references that texts of this kind use; the ampersand comes last.
REFERENCES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß",
    "eacute": "é", "egrave": "è", "ndash": "–", "mdash": "—", "hellip": "…", "bdquo": "„", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€",
    "copy": "©", "middot": "·", "amp": "&",
}


def unescaped(text: Column) -> Column:
    """Character references decoded: numbers, and the names in ``REFERENCES``."""

    def numbered(x: Column) -> Column:
        ref = F.lower(F.regexp_extract(x, r"(?i)^(x[0-9a-f]{1,6}|[0-9]{1,7});", 1))
        point = F.when(ref.startswith("x"), F.conv(F.substring(ref, 2, 6), 16, 10)).otherwise(ref).cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        known = (ref != "") & point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.when(known, F.concat(char, F.regexp_replace(x, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), x))

    parts = F.split(text, "&#")
    rest = F.array_join(F.transform(F.slice(parts, 2, 1 << 30), numbered), "")
    out = F.when(F.contains(text, F.lit("&#")), F.concat(F.get(parts, F.lit(0)), rest)).otherwise(text)
    for name, char in REFERENCES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def time_text(text: Column) -> Column:
    """The whole text if it is a time or a range, else the first h:mm inside (a date with dots is no time)."""
    t = F.trim(text)
    return F.when(t.rlike(TIME_ONLY), t).otherwise(found(t, TIME_INSIDE, 0))


def price(text: Column) -> Column:
    """First of: an amount or range, "Eintritt frei", "kostenlos", what follows "Eintritt:"."""
    return F.coalesce(*[squeezed(F.regexp_extract(text, p, 1)) for p in PRICES])


def paren_category(text: Column) -> Column:
    return F.trim(found(text, IN_PARENS))


def unmoved_title(title: Column) -> Column:
    """Title without its note of a moved venue; as it is without one."""
    return F.when(title.rlike(MOVED), squeezed(F.regexp_replace(title, MOVED, " "))).otherwise(title)


def moved_to(title: Column) -> Column:
    return F.trim(found(title, MOVED))


def unsold_title(title: Column) -> Column:
    return F.when(title.rlike(SOLD_OUT), F.trim(F.regexp_replace(title, SOLD_OUT, " "))).otherwise(title)


def sold_out(title: Column) -> Column:
    return F.when(title.rlike(SOLD_OUT), F.lit("ausverkauft"))


def start_time(text: Column) -> Column:
    """Hour of "Beginn"/"Start", else of "Einlass", as HH:MM; hours over 23 do not count."""

    def one(p: str) -> Column:
        hour = found(text, p)
        t = F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.coalesce(found(text, p, 2), F.lit("00")))
        return F.when(hour.cast("int") <= 23, t)

    return F.coalesce(one(START), one(DOORS))


def clock(text: Column) -> Column:
    """A 12-hour time as HH:MM; other times as :func:`normalize_time` reads them."""
    hour = found(text, TWELVE_HOURS).cast("int") % 12 + F.when(F.upper(found(text, TWELVE_HOURS, 3)) == "P", 12).otherwise(0)
    twelve = F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), found(text, TWELVE_HOURS, 2))
    return F.when(text.rlike(TWELVE_HOURS), twelve).otherwise(normalize_time(text))


def image_variant(srcset: Column, least: int = 500) -> Column:
    """The narrowest image of at least ``least`` pixels, else the widest; ties by address."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda x: F.split(F.trim(x), r"\s+")), lambda p: F.get(p, F.lit(0)) != "")

    def sized(p: Column) -> Column:
        w = F.regexp_extract(F.coalesce(F.get(p, F.lit(1)), F.lit("")), r"^(\d+)w$", 1)
        return F.struct(F.coalesce(F.nullif(w, F.lit("")).cast("int"), F.lit(0)).alias("w"), F.get(p, F.lit(0)).alias("url"))

    every = F.transform(parts, sized)
    wide = F.array_min(F.filter(every, lambda x: x["w"] >= least))
    return F.coalesce(wide, F.array_max(every))["url"]


def style_image(style: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(style, IMAGE_URL, 1), r"""^['" ]+|['" ]+$""", ""), F.lit(""))


def genre_category(genres: Column) -> Column:
    """Readings by name, any other genre a concert, no genre null."""
    s = slugify(genres)
    return F.when(s == "", None).when(s.rlike("literatur|poetry|lesung"), "Lesung").otherwise("Konzert")


def feed_category(categories: Column) -> Column:
    """First category other than "Highlights"."""
    kept = F.filter(F.transform(F.split(categories, ","), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "highlights"))
    first = F.get(kept, F.lit(0))
    return F.when(F.lower(first) == "konzerte", "Konzert").otherwise(first)


def month_number(name: Column) -> Column:
    """Month by its first three letters."""
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(table, F.substring(F.replace(slugify(name), F.lit("-"), F.lit("")), 1, 3))


def day_of(year: Column, month: Column, day: Column) -> Column:
    """A date; null if there is no such day."""
    return F.try_to_timestamp(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), F.lit("yyyy-M-d")).cast("date")


def next_day(month: Column, day: Column, today: Column, grace: int = 7) -> Column:
    """Day and month in this year, or in the next if that is over ``grace`` days ago; null if this year lacks the day."""
    this = day_of(F.year(today), month, day)
    return F.when(F.datediff(this, today) >= -grace, this).when(this.isNotNull(), day_of(F.year(today) + 1, month, day))


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; anything else stays."""
    narrow = text.rlike(r"^[\x00-\xFF]*$")
    raw = F.encode(F.when(narrow, text), "ISO-8859-1")
    return F.when(narrow & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(text)


def local_time(epoch: Column, zone: str = "Europe/Berlin") -> Column:
    """Date and time of day of epoch seconds as "yyyy-MM-dd HH:mm"."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone), "yyyy-MM-dd HH:mm")


def feed_items(xml: Column) -> Column:
    """Bodies of a feed's items, in order."""
    return F.regexp_extract_all(xml, F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))

"""Rule-based classification of listings: categories, tags, regions, exclusion reasons, facets.

Expressions take slugs (see :func:`slugged`), which a projection of their own computes once a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .text import once, slugify, words_of


def slugged(rows: DataFrame, **texts: str) -> DataFrame:
    """Rows with a slug column for each name = text column."""
    return rows.select("*", *[slugify(F.col(t)).alias(name) for name, t in texts.items()])


def _any_in(slug: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(slug, p))


def first_rule(slug: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """Value of the first (part, value) whose part occurs in ``slug``; null if none does."""
    lits = F.array(*[F.struct(F.lit(a).alias("part"), F.lit(b).alias("value")) for a, b in table])
    return F.get(F.filter(lits, lambda r: F.contains(slug, r["part"])), 0)["value"]


def title_decides(slug: Column) -> Column:
    """"demo" or "fuehrungen" where the title alone settles it."""
    demo = slug.rlike(rules.DEMO) & ~slug.rlike(rules.DEMO_NOT)
    guided = F.exists(F.regexp_extract_all(slug, F.lit(rules.GUIDED), F.lit(1)), lambda w: ~_any_in(w, rules.GUIDED_NOT))
    return F.when(demo, "demo").when(guided, "fuehrungen")


def is_sport(slug: Column) -> Column:
    """Sport to take part in; a match to watch is none."""
    return once(slug, _is_sport)


def _is_sport(slug: Column) -> Column:
    return ~slug.rlike(rules.SPECTATOR_SPORT) & slug.rlike(rules.SPORT) & ~slug.rlike(rules.SPORT_NOT)


def is_film_venue(venue: Column) -> Column:
    return venue.rlike(rules.FILM_VENUE)


def is_guided_tour(slug: Column, venue: Column) -> Column:
    return slug.rlike(rules.TOUR) & ~slug.rlike(rules.TOUR_NOT) & ~venue.rlike(rules.TOUR_MUSIC_VENUE)


def by_keyword(slug: Column, venue: Column) -> Column:
    found = first_rule(slug, rules.TITLE_KEYWORDS)
    return F.coalesce(found, F.when(is_guided_tour(slug, venue), "fuehrungen"), F.lit("sonstiges"))


def category(raw: Column, slug: Column, venue: Column) -> Column:
    """Category from the slugs of raw category, title and venue, in stages."""
    slugs = F.struct(raw.alias("raw"), slug.alias("slug"), venue.alias("venue"))
    return once(slugs, lambda x: _category(x["raw"], x["slug"], x["venue"]))


def _category(raw: Column, slug: Column, venue: Column) -> Column:
    key = F.replace(raw, F.lit("-"), F.lit(""))
    table = tuple((a.replace("-", ""), b) for a, b in rules.RAW_CATEGORIES)
    watched = lambda told: F.when((told == "sport") & slug.rlike(rules.SPECTATOR_SPORT), "sonstiges").otherwise(told)
    by_raw = once(once(key, lambda k: first_rule(k, table)), watched)
    return F.coalesce(
        title_decides(slug),
        F.when(_is_sport(slug), "sport"),
        by_raw,
        F.when(is_film_venue(venue), "kultur"),
        by_keyword(slug, venue),
    )


def tags(t: Column, v: Column, kind: Column) -> Column:
    """Sorted subset of five context tags, from the slugs of title and venue."""
    museum = (_any_in(v, rules.TAG_MUSEUM) | (kind == "museum")) & ~_any_in(v, rules.TAG_MUSEUM_NOT)
    return F.array_sort(
        F.array_compact(
            F.array(
                F.when(_any_in(v, rules.TAG_CHURCH) | (kind == "kirche"), "kirche"),
                F.when(museum, "museum"),
                F.when(F.contains(t, F.lit("open-air")) | F.contains(t, F.lit("openair")), "open-air"),
                F.when(_any_in(t, rules.TAG_CLASSICAL), "klassik"),
                F.when(F.contains(t, F.lit("techno")) | F.contains(t, F.lit("-rave")), "techno"),
            )
        )
    )


def region(slug: Column) -> Column:
    """"dresden", "umland" (near) or "weiter" (far) from a venue's slug; "dresden" in doubt."""
    return once(slug, _region)


def _region(slug: Column) -> Column:
    words = words_of(slug)

    def town(names: tuple[str, ...]) -> Column:
        single = [n for n in names if "-" not in n]
        joined = [n for n in names if "-" in n]
        hit = F.arrays_overlap(words, F.array(*map(F.lit, single)))
        return hit | _any_in(slug, tuple(joined)) if joined else hit

    return (
        F.when(slug == "", "dresden")
        .when(_any_in(slug, rules.CITY_VENUES), "dresden")
        .when(first_rule(slug, rules.VENUE_REGIONS).isNotNull(), first_rule(slug, rules.VENUE_REGIONS))
        .when(F.array_contains(words, "dresden"), "dresden")
        .when(town(rules.FAR_TOWNS), "weiter")
        .when(town(rules.NEARBY_TOWNS), "umland")
        .otherwise("dresden")
    )


def takes_part_in_sport(slug: Column, cat: Column, venue_slug: Column) -> Column:
    """Whether the sport facet applies: by category or title, unless for spectators or for an excluded group."""
    veto = slug.rlike(rules.SPECTATOR_SPORT) | F.concat(slug, F.lit("-"), venue_slug).rlike(rules.SPORT_EXCLUDED)
    hit = (slug.rlike(rules.SPORT) | slug.rlike(rules.SPORT_MORE)) & ~slug.rlike(rules.SPORT_NOT)
    return ~cat.isin("familie", "demo") & ~veto & ((cat == "sport") | hit)


#: Facets of the two areas in display order, each with the flavour of a venue that implies it.
AREAS = {
    "musik": (("club", "club"), ("rock", "rock"), ("indie", "indie"), ("jazz", "jazz"), ("klassik", "klassik")),
    "kultur": (("buehne", "buehne"), ("film", None), ("wort", None), ("kunst", "museum")),
}


def facets(slug: Column, cat: Column, venue: Column, flavour: Column) -> Column:
    """Ordered facets of an event from the slugs of its title and venue, its category and its venue's flavour."""
    given = F.struct(slug.alias("slug"), cat.alias("cat"), venue.alias("venue"), flavour.alias("flavour"))
    return once(given, lambda x: _facets(x["slug"], x["cat"], x["venue"], x["flavour"]))


def _facets(slug: Column, cat: Column, venue: Column, flavour: Column) -> Column:
    none = F.lit(None).cast("string")
    cat = F.coalesce(cat, F.lit(""))
    flavour = F.coalesce(flavour, F.lit(""))
    out, holds = [], {}
    for area, subs in AREAS.items():
        any_sub = F.lit(False)
        for name, own in subs:
            word = slug.rlike(rules.FACET_WORDS[name])
            if name in rules.FACET_NOT:
                word = word & ~slug.rlike(rules.FACET_NOT[name])
            place = (flavour == own) if own else F.lit(False)
            if name == "film":
                place = (flavour == "") & F.coalesce(is_film_venue(venue), F.lit(False))
            holds[name] = cat.isin(area, "sonstiges") & (place | word)
            any_sub = any_sub | holds[name]
        for name, _ in subs:
            shown = holds[name] & ~holds["jazz"] if name == "klassik" else holds[name]
            out.append(F.when(shown, name).otherwise(none))
        out.append(F.when(any_sub | (cat == area), area).otherwise(none))
    family = (cat == "familie") | ((flavour == "familie") & cat.isin("familie", "sonstiges"))
    out += [
        F.when(cat == "demo", "demo").otherwise(none),
        F.when(family, "familie").otherwise(none),
        F.when(cat == "outdoor", "outdoor").otherwise(none),
        F.when(takes_part_in_sport(slug, cat, venue), "sport").otherwise(none),
    ]
    return F.array_compact(F.array(*out))


def exclusion_reason(title: Column, cat: Column, venue: Column, excluded: Column, flavour: Column) -> Column:
    """First reason not to publish an event; null if there is none. ``venue`` is its slug, ``excluded`` its own reason text."""
    t = F.lower(F.coalesce(title, F.lit("")))
    family = (cat == "familie") | ((flavour == "familie") & cat.isin("familie", "sonstiges"))
    return (
        F.when(F.coalesce(excluded, F.lit("")) != "", F.concat(F.lit("Ort: "), excluded))
        .when(venue.rlike(rules.HOTEL), "Hotel/Gasthof")
        .when(t.rlike(rules.CANCELLED), "abgesagt")
        .when(t.rlike(rules.SENIORS), "Senioren")
        .when(t.rlike(rules.TOURISTS), "Touristen-Angebot")
        .when(F.coalesce(family, F.lit(False)), "Familie")
    )

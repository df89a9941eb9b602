"""DuckDB SQL of the text and rule expressions, for checks against the Spark results."""

from __future__ import annotations

from ..functions import classify, rules

LISTINGS = """base as (
 select e.event_id as id, cast(e.ts as date) as date,
        case when e.event_id % 7 = 0 then null
             else concat(lpad(cast(hour(e.ts) as string),2,'0'),':',lpad(cast(minute(e.ts) as string),2,'0')) end as time,
        p.p_name as title,
        case when e.event_id % 11 = 0 then 'TBA' else s.s_name end as venue,
        e.user_id % 20 as source_pos, e.event_type as raw_category
 from events e
 join part p     on p.p_partkey = e.event_id % (select count(*) from part)
 join supplier s on s.s_suppkey = e.event_id % (select count(*) from supplier)),
fx as (
select id, date, time, title, venue, source_pos, raw_category from base
union all
select id + 1000000000, date, time, concat(title, ' Zugabe & Gäste'), concat('Club ', venue),
       (source_pos + 7) % 20, raw_category
from base where id % 3 = 0)"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def slug(x: str) -> str:
    t = f"lower({x})"
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = f"replace({t}, '{a}', '{b}')"
    t = f"regexp_replace(strip_accents({t}), '[^\\x00-\\x7F]', '', 'g')"
    return f"coalesce(trim(regexp_replace({t}, '[^a-z0-9]+', '-', 'g'), '-'), '')"


def words(s: str) -> str:
    return f"list_filter(string_split({s}, '-'), lambda w: w <> '')"


def without(ws: str, names: tuple[str, ...], more: str = "true") -> str:
    return f"list_filter({ws}, lambda w: {more} and not list_contains([{', '.join(map(q, names))}], w))"


def venue_key(x: str) -> str:
    s = slug(x)
    kept = f"array_to_string({without(words(s), rules.GENERIC_VENUE_WORDS)}, '-')"
    unknown = ", ".join(map(q, ("", *rules.UNKNOWN_VENUES)))
    return f"case when {s} in ({unknown}) then '' when {kept} <> '' then {kept} else {s} end"


def venue_slug(x: str) -> str:
    s = slug(f"regexp_replace({x}, '\\([^)]*\\)', ' ', 'g')")
    kept = f"array_to_string({without(words(s), ('dresden', 'e', 'v', 'gmbh'))}, '-')"
    return f"coalesce(nullif({kept}, ''), {s})"


def tokens(s: str) -> str:
    return f"list_distinct({without(words(s), rules.TITLE_STOPWORDS, 'length(w) >= 3')})"


def title_key(x: str) -> str:
    return f"array_to_string(list_filter({words(slug(x))}, lambda w: length(w) > 2)[1:3], '-')"


def matches(s: str, pattern: str) -> str:
    """Existence test; a look-ahead for a word's end may as well take the end in."""
    return f"regexp_matches({s}, {q(pattern.replace('(?=-|$)', '(?:-|$)'))})"


def any_in(s: str, parts: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({s}, {q(p)})" for p in parts) + ")"


def first_rule(s: str, table: tuple[tuple[str, str], ...], default: str = "null") -> str:
    return "case " + " ".join(f"when contains({s}, {q(a)}) then {q(b)}" for a, b in table) + f" else {default} end"


def is_sport(s: str) -> str:
    return f"(not {matches(s, rules.SPECTATOR_SPORT)} and {matches(s, rules.SPORT)} and not {matches(s, rules.SPORT_NOT)})"


def category(s: str, raw: str, v: str) -> str:
    """Category from columns that hold the title's, raw category's and venue's slugs."""
    guided = rules.GUIDED.removeprefix("(?:^|-)").removesuffix("(?=-|$)")
    no = any_in("w", rules.GUIDED_NOT)
    tour = f"{matches(s, rules.TOUR)} and not {matches(s, rules.TOUR_NOT)} and not {matches(v, rules.TOUR_MUSIC_VENUE)}"
    table = tuple((a.replace("-", ""), b) for a, b in rules.RAW_CATEGORIES)
    by_raw = first_rule(f"replace({raw}, '-', '')", table)
    return f"""case when {matches(s, rules.DEMO)} and not {matches(s, rules.DEMO_NOT)} then 'demo'
      when len(list_filter(string_split({s}, '-'), lambda w: regexp_full_match(w, {q(guided)}) and not {no})) > 0 then 'fuehrungen'
      when {is_sport(s)} then 'sport'
      when {by_raw} is not null then case when {by_raw} = 'sport' and {matches(s, rules.SPECTATOR_SPORT)} then 'sonstiges' else {by_raw} end
      when {matches(v, rules.FILM_VENUE)} then 'kultur'
      when {first_rule(s, rules.TITLE_KEYWORDS)} is not null then {first_rule(s, rules.TITLE_KEYWORDS)}
      when {tour} then 'fuehrungen' else 'sonstiges' end"""


def region(v: str) -> str:
    def town(names: tuple[str, ...]) -> str:
        single = ", ".join(q(n) for n in names if "-" not in n)
        joined = tuple(n for n in names if "-" in n)
        hit = f"list_has_any(string_split({v}, '-'), [{single}])"
        return f"({hit} or {any_in(v, joined)})" if joined else hit

    return f"""case when {v} = '' or {any_in(v, rules.CITY_VENUES)} then 'dresden'
      when {first_rule(v, rules.VENUE_REGIONS)} is not null then {first_rule(v, rules.VENUE_REGIONS)}
      when list_contains(string_split({v}, '-'), 'dresden') then 'dresden'
      when {town(rules.FAR_TOWNS)} then 'weiter' when {town(rules.NEARBY_TOWNS)} then 'umland' else 'dresden' end"""


def exclusion(t: str) -> str:
    """Reason by title alone; the patterns' word ends are spelt out for letters of all languages."""
    return f"""case when regexp_matches({t}, {q(rules.CANCELLED)}) then 'abgesagt'
      when regexp_matches({t}, {q(rules.SENIORS.replace(chr(92) + 'bü', '(?:^|[^a-z0-9_äöüß])ü'))}) then 'Senioren'
      when regexp_matches({t}, {q(rules.TOURISTS)}) then 'Touristen-Angebot' end"""


def tags(t: str, v: str, kind: str) -> str:
    """Sorted context tags from slug columns, comma-joined."""
    museum = f"({any_in(v, rules.TAG_MUSEUM)} or {kind} = 'museum') and not {any_in(v, rules.TAG_MUSEUM_NOT)}"
    rows = {
        "kirche": f"{any_in(v, rules.TAG_CHURCH)} or {kind} = 'kirche'",
        "museum": museum,
        "open-air": f"contains({t}, 'open-air') or contains({t}, 'openair')",
        "klassik": any_in(t, rules.TAG_CLASSICAL),
        "techno": f"contains({t}, 'techno') or contains({t}, '-rave')",
    }
    every = ", ".join(f"case when {w} then '{n}' end" for n, w in rows.items())
    return f"array_to_string(list_sort(list_filter([{every}], lambda x: x is not null)), ',')"


def facets(t: str, cat: str, v: str, flavour: str) -> str:
    """The list of an event's facets from slug columns; ``cat`` and ``flavour`` may not be null."""
    out = []
    for area, subs in classify.AREAS.items():
        holds = {}
        for name, own in subs:
            word = matches(t, rules.FACET_WORDS[name])
            if name in rules.FACET_NOT:
                word = f"{word} and not {matches(t, rules.FACET_NOT[name])}"
            place = f"{flavour} = '{own}'" if own else "false"
            if name == "film":
                place = f"{flavour} = '' and {matches(v, rules.FILM_VENUE)}"
            holds[name] = f"({cat} in ('{area}', 'sonstiges') and (({place}) or ({word})))"
        for name, _ in subs:
            shown = f"{holds[name]} and not {holds['jazz']}" if name == "klassik" else holds[name]
            out.append(f"case when {shown} then '{name}' end")
        out.append(f"case when {cat} = '{area}' or {' or '.join(holds.values())} then '{area}' end")
    family = f"{cat} = 'familie' or ({flavour} = 'familie' and {cat} in ('familie', 'sonstiges'))"
    veto = f"({matches(t, rules.SPECTATOR_SPORT)} or {matches('(' + t + chr(32) + '|| ' + q('-') + ' || ' + v + ')', rules.SPORT_EXCLUDED)})"
    sport = f"""{cat} not in ('familie', 'demo') and not {veto} and ({cat} = 'sport' or
      ({matches(t, rules.SPORT)} or {matches(t, rules.SPORT_MORE)}) and not {matches(t, rules.SPORT_NOT)})"""
    for name, w in (("demo", f"{cat} = 'demo'"), ("familie", family), ("outdoor", f"{cat} = 'outdoor'"), ("sport", sport)):
        out.append(f"case when {w} then '{name}' end")
    return f"list_filter([{', '.join(out)}], lambda x: x is not null)"

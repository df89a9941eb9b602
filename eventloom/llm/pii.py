"""Personal data: regular expressions propose, checksums confirm, context scores.

Built-in functions only, one pass over each text, no shuffle. Base kinds are
email, ip, card (Luhn) and phone; ``iban`` (mod 97) adds spans of its own.
Patterns use possessive runs anchored at ``\\G`` or a non-member, which match what
the plain greedy forms match from left to right, but in linear time.

Nulls: a null text counts as empty; a null ``doc_id`` keeps its row. Repeated rows
each give a row; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as sp

KINDS = ["email", "ip", "card", "phone", "iban"]
N_BASE = 4
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9_])"
#: Words near a span that make its kind likelier.
CONTEXT = {
    "email": "e-?mails?|mailto|contact|write|address|kontakt|correo|courriel",
    "ip": "ip|ips|hosts?|servers?|address|login",
    "card": "cards?|visa|mastercard|credit|payment|karte|kreditkarte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|fax|mobile?|telefon|handy",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
#: Words near a span that make its kind less likely.
AGAINST = {
    "email": "example|noreply|placeholder",
    "ip": "version|release|build|section|chapter",
    "card": "isbn|order|serial|tracking|article",
    "phone": "isbn|serial|tracking|score",
    "iban": "serial|part|model",
}
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9}
NEAR = 40


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of ``m`` pass the Luhn check."""
    d = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(m: Column) -> Column:
    """Whether ``m`` (letters as 10 to 35, first four moved to the end) leaves 1 modulo 97."""
    plain = F.regexp_replace(m, r"\x20", "")
    moved = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def iban_ok(m: Column) -> Column:
    """Whether ``m`` has its country's length and leaves 1 modulo 97."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    n, country = F.length(F.regexp_replace(m, r"\x20", "")), F.substring(m, 1, 2)
    fits = F.lit(False)
    for length, countries in by_length.items():
        fits = fits | ((n == length) & country.isin(countries))
    return fits & mod97(m)


def _ip_ok(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
        F.split(m, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(999)) <= 255
    )


def _n_digits(m: Column, low: int, high: int) -> Column:
    return F.length(_digits(m)).between(low, high)


def find_pii(text: Column) -> Column:
    """Sorted spans of all kinds in ``text`` (not null)."""
    none = F.array().cast(sp.NONE)
    gated = lambda gate, spans: F.when(gate, spans).otherwise(none)
    has = lambda rx: F.rlike(text, F.lit(rx))
    return F.array_sort(
        F.concat(
            gated(F.contains(text, F.lit("@")), sp.found(text, EMAIL, 0)),
            gated(has(r"[0-9]\.[0-9]"), sp.found(text, IP, 1, keep=_ip_ok)),
            gated(has(r"[0-9][\x20-]?[0-9]"), sp.found(text, CARD, 2, keep=lambda m: _n_digits(m, 12, 19) & luhn(m))),
            gated(F.contains(text, F.lit("+")), sp.found(text, PHONE, 3, keep=lambda m: _n_digits(m, 9, 15))),
            gated(has("[A-Z]{2}[0-9]{2}"), sp.found(text, IBAN, 4, keep=iban_ok)),
        )
    )


def scores(text: Column, spans: Column) -> Column:
    """A score in 0 to 1 for each span: the kind's prior, halfway up to 1 if a word for it stands within ``NEAR``
    characters, and half of that if a word against it does. Words count whole."""
    prior = F.array(*[F.lit(PRIOR[k]) for k in KINDS])
    whole = lambda words: F.array(*[F.lit(rf"(?i)(?:^|[^A-Za-z0-9_])(?:{words[k]})(?:[^A-Za-z0-9_]|$)") for k in KINDS])
    word, against = whole(CONTEXT), whole(AGAINST)

    def one(x: Column) -> Column:
        start = F.greatest(x["s"] - NEAR, F.lit(0))
        around = F.concat(
            F.substring(text, start + 1, x["s"] - start), F.lit("\n"), F.substring(text, x["e"] + 1, F.lit(NEAR))
        )
        base = F.get(prior, x["k"])
        raised = F.when(F.rlike(around, F.get(word, x["k"])), base + (1 - base) / 2).otherwise(base)
        return F.when(F.rlike(around, F.get(against, x["k"])), raised / 2).otherwise(raised)

    return F.transform(spans, one)


def scan_pii(docs: DataFrame) -> DataFrame:
    """One row a document: counts of base kinds, digest of base spans, all spans, and their scores."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", text.alias("text_")).select("doc_id", "text_", find_pii(F.col("text_")).alias("found_"))
    base = F.filter("found_", lambda x: x["k"] < N_BASE)
    count = lambda k: F.size(F.filter("found_", lambda x: x["k"] == k)).cast("long")
    shown = F.transform(scores(F.col("text_"), F.col("found_")), lambda x: F.round(x, 3).cast("string"))
    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:N_BASE])],
        F.sha2(sp.joined(base, KINDS), 256).alias("base_sha256"),
        sp.joined(F.col("found_"), KINDS).alias("spans"),
        F.array_join(shown, ",").alias("scores"),
    )

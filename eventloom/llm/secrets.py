"""Secret scanning over a trigram inverted index.

Each rule is a regular expression. From its parse tree a Boolean query over trigrams is
derived: an OR of ANDs of the trigrams that every match must hold. The index
lists, for each of those trigrams, the documents that hold it; the postings of a
branch are intersected as bits, and only documents that satisfy a rule's
query are verified with its expression. A rule without a mandatory trigram (a
bare character class), or whose expression the parser does not know, scans every text. Any
number of rules will do. Built-in functions only.

Nulls: a null text counts as empty and has no span; a null ``doc_id`` keeps its
row and its spans. Documents are known by their id and a hash of their text, so rows without an id
are no common key. Repeated rows each give a row. Extra columns are ignored by
:func:`scan_secrets`, whatever their names, and kept by :func:`redact_secrets`.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as node
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as sp


@dataclass(frozen=True)
class Rule:
    """``pattern`` as Java reads it; a match of under ``least`` characters (of ``group``, if given) is dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int | None = None


#: Base rules first; their order is the order of kinds that start at one place.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # the same as every run, short ones dropped
)
#: Further rules; each adds spans of its own kind.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
)


#: More ways than this to match a part of an expression count as unknown.
MOST_WAYS = 256
#: Stands for text that is not known; no trigram crosses it.
_GAP = "\0"


def _ways(tree: object) -> list[str]:
    """The strings that match a parse tree, as far as they are known."""
    out = [""]
    for kind, what in tree:
        part = _part(kind, what)
        if len(out) * len(part) > MOST_WAYS:
            part = [_GAP]
        out = list(dict.fromkeys(a + b for a in out for b in part))
    return out


def _part(kind: object, what: object) -> list[str]:
    if kind is node.LITERAL:
        return [chr(what).lower() if what < 128 else _GAP]
    if kind is node.IN and len(what) <= 5 and all(k is node.LITERAL for k, _ in what):
        return [x for k, c in what for x in _part(k, c)]
    if kind is node.SUBPATTERN:
        return _ways(what[3])
    if kind is node.ATOMIC_GROUP:
        return _ways(what)
    if kind is node.BRANCH:
        return [x for branch in what[1] for x in _ways(branch)]
    if kind in (node.MAX_REPEAT, node.MIN_REPEAT, node.POSSESSIVE_REPEAT):
        low, high, inner = what
        once = _ways(inner)
        if (low, high) == (0, 1):
            return [*once, ""]
        if low == 0:
            return [_GAP]
        return once if high == 1 else [x + _GAP for x in once]
    if kind in (node.AT, node.ASSERT, node.ASSERT_NOT):
        return [""]
    return [_GAP]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of ANDs of lower-case trigrams that a text must hold to match; empty if some way to match needs none."""
    try:
        ways = _ways(_parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return []
    branches = {frozenset(r[i : i + 3] for r in way.split(_GAP) for i in range(len(r) - 2)) for way in ways}
    if not all(branches):
        return []
    return sorted((b for b in branches if not any(o < b for o in branches)), key=sorted)


#: Trigrams whose postings share one long.
_WORD = 62


def trigram_postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Inverted index of the wanted trigrams: (trigram, doc_id, th), each once a row of ``docs``; ``th`` is the text's hash."""
    folded = F.lower(F.coalesce("text", F.lit("")))
    held = F.filter(F.array(*[F.when(F.contains(folded, F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, th, rules): which rules' trigram queries each document satisfies; one row a document that has any."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    wanted = sorted({t for ors in queries.values() for branch in ors for t in branch})
    if not wanted:
        return docs.select("doc_id", F.xxhash64("text").alias("th"), F.array().cast("array<string>").alias("rules")).where("false")
    # Intersection of postings: one bit a trigram, or-ed for each document, then tested branch by branch.
    at = {t: divmod(i, _WORD) for i, t in enumerate(wanted)}
    n_words = -(-len(wanted) // _WORD)

    def bits(word: int) -> Column:
        number = F.create_map(*[F.lit(x) for t in wanted if at[t][0] == word for x in (t, 1 << at[t][1])])
        return F.coalesce(F.bit_or(F.element_at(number, F.col("trigram")).cast("long")), F.lit(0).cast("long")).alias(f"bits{word}")

    lists = trigram_postings(docs, wanted).groupBy("doc_id", "th").agg(*map(bits, range(n_words)))

    def holds(branch: frozenset[str]) -> Column:
        out = F.lit(True)
        for word in sorted({at[t][0] for t in branch}):
            need = F.lit(sum(1 << at[t][1] for t in branch if at[t][0] == word)).cast("long")
            out = out & (F.col(f"bits{word}").bitwiseAND(need) == need)
        return out

    names = []
    for kind, ors in queries.items():
        if ors:
            test = holds(ors[0])
            for branch in ors[1:]:
                test = test | holds(branch)
            names.append(F.when(test, F.lit(kind)))
    hit = F.filter(F.array(*names), lambda x: x.isNotNull())
    return lists.select("doc_id", "th", hit.alias("rules")).where(F.size("rules") > 0)


def _spans(rules: tuple[Rule, ...], text: Column, flags: Column) -> Column:
    """Sorted spans of all rules: indexed ones where ``flags`` names them, the others everywhere."""
    parts = []
    for k, r in enumerate(rules):
        long_enough = lambda m, n=r.least: F.length(m) >= n
        if r.group is None:
            own = sp.found(text, r.pattern, k, keep=long_enough)
        else:
            own = sp.found(text, r.pattern, k, group=r.group, keep_group=long_enough)
        if trigram_query(r.pattern):
            gate = F.array_contains(flags, r.kind)
        else:
            gate = F.rlike(text, F.lit(r.pattern))
        parts.append(F.when(gate, own).otherwise(F.array().cast(sp.NONE)))
    return F.array_sort(F.concat(*parts))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...], column: str) -> DataFrame:
    """``docs`` with the array of spans. The candidate join is null-safe, so rows without an id are verified too."""
    names = docs.columns
    rowed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"), F.col("doc_id").alias("key_"), F.xxhash64("text").alias("th_"))
    picked = candidates(docs.select("doc_id", "text"), rules)
    picked = picked.select(F.col("doc_id").alias("hit_"), F.col("th").alias("hit_th_"), F.col("rules").alias("rules_"))
    same = F.col("key_").eqNullSafe(F.col("hit_")) & (F.col("th_") == F.col("hit_th_"))
    both = rowed.join(picked, same, "left")
    text = F.coalesce(F.col("row_.text"), F.lit(""))
    return both.select("row_", _spans(rules, text, F.coalesce("rules_", F.array().cast("array<string>"))).alias(column))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: int = len(BASE)) -> DataFrame:
    """One row a document: counts of the base kinds, digest of the base spans, and all spans."""
    kinds = [r.kind for r in rules]
    out = with_spans(docs.select("doc_id", "text"), rules, "found_")
    basic = F.filter("found_", lambda x: x["k"] < base)
    count = lambda k: F.size(F.filter("found_", lambda x: x["k"] == k)).cast("long")
    return out.select(
        F.col("row_.doc_id").alias("doc_id"),
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(rules[:base])],
        F.sha2(sp.joined(basic, kinds), 256).alias("base_sha256"),
        sp.joined(F.col("found_"), kinds).alias("spans"),
    )


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found secret replaced by ``mask`` and ``n_chars`` (if there) counted anew; null texts stay null."""
    out = with_spans(docs, rules, "found_")
    text = F.when(F.size("found_") > 0, sp.masked(F.col("row_.text"), F.col("found_"), mask)).otherwise(F.col("row_.text"))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(text.alias("text"))
        elif c == "n_chars":
            changed = F.size("found_") > 0
            cols.append(F.when(changed, F.length(text)).otherwise(F.col("row_").getField(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("row_").getField(c).alias(c))
    return out.select(*cols)

"""Corpus-wide line deduplication by an exact set-similarity self join.

A line's tokens are the set of its lower-case words. Two lines match if the Jaccard
similarity of their sets is at least the threshold (0.8). Lines stand in order of
(doc_id, line number); every line with a matching line before it, kept or not, is
removed. Built-in functions only.

How: each token becomes one long, rarity class first, hash after (rarity is counted over
all documents in 65,536 hash buckets, so the table has a fixed size; any total order
keeps the join exact). The rarest tokens that must meet (prefix filter) become postings;
of lines with the same text only the first place's go on, folded before they are shuffled,
so a frequent line costs one row a task. Texts are not shuffled. A frequent token (over
1 in ``FREQUENT`` words) is no posting by itself: lines that share no rarer prefix token must
share two in a prefix one longer, so pairs of frequent tokens are the postings there. A first semi
join keeps the lines that share a posting with another line and pass the length, positional
and 128-bit parity filters, all of which are lossless. Only those lines are read again, with
their whole token sets, for a second semi join, which verifies the similarity exactly
and stops at the first earlier match, so a group of k near copies costs its postings, not
its k*k pairs. Postings that hold the same lines (near copies share most of their prefix) are one
there, from the first of its tokens on, so a token set is sent once for each company its line is in. Which lines are read again is asked of a bit table of fixed size first; where
it is crowded it only spares less.

Nulls: a null text has no lines and stays null; a null ``doc_id`` stands before all
others. Rows that repeat a ``doc_id`` share its places, so none of them is the later
one. Lines without words are never removed. Extra columns are kept by
:func:`dedup_lines` and ignored by :func:`removed_lines`; an empty table gives an empty
result. Line texts are told apart by 96 bits of hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import cut

BUCKETS = 1 << 16
#: A token is frequent if its hash bucket holds more than one word in so many.
FREQUENT = 4096
#: Token sets up to this size keep their parity bits in one long.
SHORT = 96
#: Bits of the table of lines to read again.
FILTER = 22
_CLASS = 55


def words(text: Column) -> Column:
    """Lower-case words split at white space; may hold empty strings."""
    low = F.lower(text)
    # Splitting at one character is several times as fast as at a pattern, and most texts have only blanks and line ends.
    return F.when(F.rlike(text, F.lit(r"[\t\x0B\f\r]")), F.split(low, r"\s+", -1)).otherwise(
        F.split(F.replace(low, F.lit("\n"), F.lit(" ")), " ", -1)
    )


def place(doc_id: Column, line_no: Column) -> Column:
    """The order of lines as one number; rows without an id stand first."""
    first = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
    return (first * F.lit(1 << 31).cast("decimal(10,0)") + line_no).cast("decimal(32,0)")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, line, h, g) of every line that has a word; ``th`` tells texts under one doc_id apart, (h, g) lines."""
    each = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    )
    return each.where(F.ltrim("line", F.lit(" \t\x0b\f\r")) != "").withColumns({"h": F.xxhash64("line"), "g": F.hash("line")})


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def rarity(docs: DataFrame) -> tuple[Column, int]:
    """(rarity class of each hash bucket; lowest class of frequent tokens).

    The classes (four to a doubling of the word occurrences in all texts) are one array of ``BUCKETS`` numbers, whatever
    the corpus, so they go into the plan as a literal: lookups inside array functions need one.
    """
    each = docs.select(F.explode(words(F.col("text"))).alias("w")).where("w <> ''")
    counted = each.groupBy(_bucket(F.xxhash64("w")).alias("bucket")).agg(F.count("*").alias("n")).toArrow()
    n = np.ones(BUCKETS)
    n[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    classes = np.floor(4 * np.log2(n)).astype(int)
    frequent = max(1, int(np.ceil(4 * np.log2(max(2.0, n.sum() / FREQUENT)))))
    return F.split(F.lit(",".join(map(str, classes.tolist()))), ",").cast("array<int>"), frequent


def with_tokens(lines: DataFrame, rank: Column) -> DataFrame:
    """``lines`` with ``line`` replaced by ``tokens``: its distinct tokens as longs, rarest first.

    An operator whose expressions hold a lambda is not compiled, nor is anything that is an argument of one. So the two
    lambdas stand in projections of their own, and what comes between them in explodes of one element, which are
    compiled and which no optimizer merges (nor does it build the sets once for every use). The outer form adds no filter.
    """
    kept = [c for c in lines.columns if c != "line"]
    only = lambda c, name: F.explode_outer(F.array(c)).alias(name)
    # Elements that cannot be null are sorted as longs, not as objects.
    rank_of = lambda h: F.coalesce(F.get(rank, _bucket(h)), F.lit(0)).cast("long")
    split = lines.select(*kept, only(words(F.col("line")), "ws"))
    hashed = split.select(*kept, F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))
    distinct = hashed.select(*kept, only(F.array_remove(F.array_distinct("hs"), F.xxhash64(F.lit(""))), "ds"))
    ranked = distinct.select(
        *kept, F.transform("ds", lambda h: F.shiftleft(rank_of(h), _CLASS).bitwiseOR(F.shiftrightunsigned(h, 9))).alias("ts")
    )
    # Never null, so no join infers a null check.
    return ranked.select(*kept, only(F.coalesce(F.sort_array("ts"), F.array().cast("array<long>")), "tokens"))


def _share(threshold: float) -> Column:
    """Token sets of sizes n and m match if they share at least this times n + m (with a hair's tolerance)."""
    return F.lit(threshold / (1 + threshold))


def _sketch(tokens: Column) -> list[Column]:
    """Parity bits of a token set: the XOR of two sets' bits has at most as many ones as the sets differ in tokens.

    Up to ``SHORT`` tokens all bits are in the first long and the second is 0. Longer sets spread over both; the XOR of
    their two longs is what the short form would be.
    """
    one = F.lit(1).cast("long")
    at = lambda t: t.bitwiseAND(F.lit(63).cast("long")).cast("int")
    side = lambda t: F.shiftright(t, 6).bitwiseAND(one)
    shifted = lambda v, t: F.call_function("shiftleft", v, at(t))
    zero = F.lit(0).cast("long")
    whole = F.aggregate(tokens, zero, lambda a, t: a.bitwiseXOR(shifted(one, t)))
    second = F.when(F.size(tokens) > SHORT, F.aggregate(tokens, zero, lambda a, t: a.bitwiseXOR(shifted(side(t), t)))).otherwise(zero)
    return [whole, second]


def _differ() -> Column:
    """At least this many tokens are in only one of x and y."""
    ones = lambda c: F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
    both = F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1")).bitwiseXOR(F.col("x.s2")).bitwiseXOR(F.col("y.s2")))
    return F.when((_n("x") > SHORT) & (_n("y") > SHORT), ones("s2") + both).otherwise(ones("s1"))


def _postings(tokens: Column, threshold: float, frequent: int) -> Column:
    """The set's postings: each packs 32 bits of a token or of a pair, the place of its (first) token and the set's size.

    Cutting tokens to 32 bits can only bring more candidates.
    """
    n = F.size(tokens)
    size = F.least(n, F.lit(0xFFFF)).cast("long")
    k = (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int")
    at = lambda i: F.least(i, F.lit(0x7FFF)).cast("long") * 65536 + size
    pack = lambda t, i: F.shiftleft(t, 32).bitwiseOR(at(i))
    one_longer = F.slice(tokens, 1, k + 1)
    plain = F.transform(F.slice(tokens, 1, k), pack)
    # Tokens stand in order of class, so the frequent ones are the last of a prefix, from where the least of them would stand.
    least = F.lit(frequent << _CLASS)
    first = F.array_position(F.sort_array(F.concat(one_longer, F.array(least))), least).cast("int") - 1
    rare = F.slice(tokens, 1, F.least(first, k))
    often = F.slice(tokens, first + 1, F.greatest(F.size(one_longer) - first, F.lit(0)))
    # Lambdas work out whatever they name once an element, so what they need stands in a row of its own.
    bound = F.array(F.struct(often.alias("often"), first.alias("first")))
    each = lambda r: F.transform(
        r.often, lambda a, i: F.transform(F.slice(r.often, i + 2, F.size(r.often)), lambda b: pack(F.xxhash64(a, b), r.first + i))
    )
    pairs = F.flatten(F.flatten(F.transform(bound, each)))
    mixed = F.concat(F.transform(rare, pack), pairs)
    return F.when((n < 2) | (F.element_at(one_longer, -1) < least), plain).otherwise(mixed)


def _tok(side: str) -> Column:
    return F.shiftright(F.col(f"{side}.p"), 32)


def _n(side: str) -> Column:
    return F.col(f"{side}.p").bitwiseAND(F.lit(0xFFFF).cast("long"))


def _i(side: str) -> Column:
    return F.shiftright(F.col(f"{side}.p"), 16).bitwiseAND(F.lit(0x7FFF).cast("long"))


def _may_match(threshold: float) -> Column:
    """Length, positional and parity filters on the rows x and y of one shared posting; sets too large to pack pass."""
    total = _n("x") + _n("y")
    big = F.greatest(_n("x"), _n("y")) >= 0xFFFF
    need = _share(threshold) * total - 1e-9
    length = F.least(_n("x"), _n("y")) >= F.lit(threshold) * F.greatest(_n("x"), _n("y")) - 1e-9
    return big | (length & (F.least(_n("x") - _i("x"), _n("y") - _i("y")) >= need) & (_differ() <= total - 2 * need))


def _maybe_in(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of ``lines`` whose ``h`` may be in ``wanted``: one bit for each value of its low ``FILTER`` bits, in at most 65,536 rows."""
    low = F.col("h").bitwiseAND(F.lit((1 << FILTER) - 1).cast("long"))
    word, at = F.shiftright(low, 6).cast("int"), low.bitwiseAND(F.lit(63).cast("long")).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at)
    table = wanted.groupBy(word.alias("at_")).agg(F.bit_or(one).alias("bits_"))
    return lines.join(F.broadcast(table), (word == F.col("at_")) & (F.col("bits_").bitwiseAND(one) != 0), "left_semi")


def companies(paired: DataFrame) -> DataFrame:
    """(h, company, p): of each line's postings (h, ps) the first for each company, which is the set of lines that a posting holds.

    Lines that share a posting share its company, and there stand at that posting or before it, so no pair is lost, nor
    would one be if two companies had one number. The upper half of ``p`` no longer counts.
    """
    each = paired.select("h", F.explode("ps").alias("p")).select("h", F.shiftright("p", 32).alias("tok"), F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)).alias("p"))
    number = F.xxhash64(F.count("*"), F.bit_xor("h"), F.min("h"), F.max("h"))
    return each.join(each.groupBy("tok").agg(number.alias("company")), "tok").groupBy("h", "company").agg(F.min("p").alias("p"))


def matched_lines(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """((h, g, first, n): distinct lines with their first place and number; (h, g) of those that match an earlier different line)."""
    lines = lines_of(docs).withColumn("place", place(F.col("doc_id"), F.col("line_no")))
    rank, frequent = rarity(docs)
    sets = with_tokens(lines.select("h", "g", "place", "line"), rank)
    s1, s2 = _sketch(F.col("tokens"))
    posted = sets.select("h", "g", "place", _postings(F.col("tokens"), threshold, frequent).alias("ps"), s1.alias("s1"), s2.alias("s2"))
    folded = posted.groupBy("h", "g", "ps", "s1", "s2").agg(F.min("place").alias("first"))
    light = folded.select("h", "s1", "s2", F.explode_outer("ps").alias("p"))  # in this order both sides share one exchange
    near = (_tok("x") == _tok("y")) & (F.col("x.h") != F.col("y.h")) & _may_match(threshold)
    # Two matching lines meet at the first token they share, in rows that both pass; only such rows go on.
    paired = light.alias("x").join(light.alias("y"), near, "left_semi").groupBy("h")
    paired = cut(paired.agg(F.collect_set("p").alias("ps")))
    met = companies(paired).groupBy("h").agg(F.collect_list(F.struct("company", "p")).alias("ms"))
    again = _maybe_in(lines, paired).groupBy("h").agg(F.min(F.struct("place", "line")).alias("r"))
    full = with_tokens(again.join(met, "h").select("h", F.hash("r.line").alias("g"), "ms", F.col("r.place").alias("place"), F.col("r.line").alias("line")), rank)
    full = full.select("h", "g", "ms", "place", "tokens", s1.alias("s1"), s2.alias("s2"))
    heavy = full.select("h", "g", "place", "s1", "s2", "tokens", F.size("tokens").alias("size"), F.inline("ms"))
    # What they share stands from there on, so earlier tokens need not travel; a place too large to pack keeps them all.
    start = F.shiftright("p", 16).bitwiseAND(F.lit(0x7FFF).cast("long")).cast("int")
    start = F.when(start == 0x7FFF, 0).otherwise(start)
    heavy = heavy.select("company", "p", "h", "g", "place", "s1", "s2", "size", F.slice("tokens", start + 1, F.col("size")).alias("rest"))
    shared = F.size(F.array_intersect(F.col("x.rest"), F.col("y.rest")))
    verified = (
        (F.col("x.company") == F.col("y.company"))
        & ((F.col("x.h") != F.col("y.h")) | (F.col("x.g") != F.col("y.g")))  # with g on both sides they share one exchange
        & (F.col("y.place") < F.col("x.place"))
        & _may_match(threshold)
        & (shared >= _share(threshold) * (F.col("x.size") + F.col("y.size")) - 1e-9)
    )
    hit = heavy.alias("x").join(heavy.alias("y"), verified, "left_semi").select("h", "g").distinct()
    return lines.groupBy("h", "g").agg(F.min("place").alias("first"), F.count("*").alias("n")), hit


def removed_places(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, th, line_no) of every removed line."""
    distinct, matched = matched_lines(docs, threshold)
    # Lines that stand once and match none stay; the others are so few that most places need not be shuffled.
    where = distinct.join(matched.withColumn("m", F.lit(True)), ["h", "g"], "left").where(F.col("m") | (F.col("n") > 1))
    where = cut(where.select("h", "g", "first", "m"))
    places = _maybe_in(lines_of(docs).select("doc_id", "th", "line_no", "h", "g"), where)
    later = place(F.col("doc_id"), F.col("line_no")) > F.col("first")
    return places.join(where, ["h", "g"]).where(F.coalesce("m", F.lit(False)) | later).select("doc_id", "th", "line_no")


def _with_gone(rows: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """``rows`` (with key_ and th_) and the sorted numbers of their removed lines, null where there are none."""
    places = removed_places(docs, threshold)
    gone = places.groupBy(F.col("doc_id").alias("gone_id_"), F.col("th").alias("gone_th_")).agg(F.sort_array(F.collect_set("line_no")).alias("gone_"))
    same = F.col("key_").eqNullSafe(F.col("gone_id_")) & (F.col("th_") == F.col("gone_th_"))
    return rows.join(gone, same, "left")


def removed_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row a document: its lines, how many were removed, and their numbers from 0, comma-joined."""
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("key_"), F.xxhash64("text").alias("th_"), n_lines.alias("n_lines"))
    gone = F.coalesce("gone_", F.array().cast("array<int>"))
    return _with_gone(rows, docs, threshold).select(
        F.col("key_").alias("doc_id"),
        "n_lines",
        F.size(gone).cast("long").alias("n_removed"),
        F.array_join(F.transform(gone, lambda x: x.cast("string")), ",").alias("removed"),
    )


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with later matching lines taken out of ``text`` and ``n_chars`` (if there) counted anew."""
    names = docs.columns
    rowed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"), F.col("doc_id").cast("long").alias("key_"), F.xxhash64("text").alias("th_")
    )
    both = _with_gone(rowed, docs.select("doc_id", "text"), threshold)
    text = F.col("row_.text")
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone_"))
    cleaned = F.when(F.col("gone_").isNull() | text.isNull(), text).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    )
    cols = []
    for c in names:
        own = F.col("row_").getField(c)
        if c == "text":
            cols.append(cleaned.alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("gone_").isNull(), own).otherwise(F.length(cleaned)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(own.alias(c))
    return both.select(*cols)

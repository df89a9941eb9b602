"""Near copies of whole documents by an exact set-similarity self join.

A document is the set of its shingles (runs of five lower-case words; a shorter text is one
shingle). Two documents match if the Jaccard similarity of their sets is at least the
threshold (0.8); groups are the connected components of matching documents.

How: documents with equal sets fold to one. Each set is put in one global order, shingles of
rare hash buckets first (any order keeps the join exact), and the head that must meet a
match's head (prefix filter) becomes postings; those of a shingle that no other set has go. Groups
are linked in two steps, so that a group of k near copies need not list its k*k pairs: each
document is first compared with the hub it shares most postings with (the document of a
shingle's list whose shingles are the most widespread), then all pairs that still lie in
different components are. Length, positional and parity filters are lossless, and each remaining
pair is verified on the whole sets; the parity bits, of one size for any set, keep the sets of documents
that share no more than a few shingles from being shuffled. Sets and shingles are told apart by 64-bit hashes.

Nulls: a null text counts as empty, and empty texts are copies of each other; rows without a
``doc_id`` are kept, and count for a group's smallest id only if it has no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components, cut
from .simhash import without

SEED = 42
BUCKETS = 1 << 18
#: Bits of a set's hash that index the filter of wanted sets (2 MB).
FILTER = 24
_FLUSH = 1 << 20
#: Parity bits of a set.
PARITY = 1024


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes (signed 64-bit) of one text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only \x20 \x09-\x0D
    if not words:
        return np.empty(0, np.int64)
    one = xxhash.xxh64_intdigest
    runs = zip(*(words[i:] for i in range(size))) if len(words) > size else [words]
    return np.unique(np.array([one(b" ".join(r), SEED) for r in runs], np.uint64).view(np.int64))


def _identity(s: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0
    return h - (1 << 64) if h >> 63 else h


def _parity(s: np.ndarray) -> np.ndarray:
    """PARITY bits as longs: the XOR of two sets' bits has at most as many ones as the sets differ in shingles."""
    odd = np.bincount(s >> 20 & (PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def rarity(docs: DataFrame, size: int) -> np.ndarray:
    """Rarity class of each hash bucket by its number of shingles in all documents (two classes to a doubling)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, n = np.zeros(BUCKETS, np.int64), [], 0
        for b in batches:
            for t in b.column(0):
                waiting.append(shingles(t.as_py(), size) & (BUCKETS - 1))
                n += len(waiting[-1])
                if n >= _FLUSH:
                    total += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                    waiting, n = [], 0
        if n:
            total += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    classes = np.zeros(BUCKETS, np.uint8)
    classes[found["bucket"].to_numpy()] = 2 * np.log2(found["n"].to_numpy())
    return classes


def heads(docs: DataFrame, classes: np.ndarray, size: int, threshold: float) -> DataFrame:
    """(doc_id, h, n, head, parity) of each row: its set's hash, size, the shingles of which a match must have one in its own head, parity bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ns, parts, bits = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), size)
                k = len(s) - math.ceil(threshold * len(s) - 1e-9) + 1 if len(s) else 0
                parts.append(s[np.lexsort((s, classes[s & (BUCKETS - 1)]))[:k]])
                hs.append(_identity(s))
                ns.append(len(s))
                bits.append(_parity(s))
            cols = [b.column(0), pa.array(hs, pa.int64()), pa.array(ns, pa.int64()), _lists(parts), _lists(bits)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "n", "head", "parity"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, n long, head array<long>, parity array<long>")


def _filter_bits(wanted: DataFrame) -> bytes:
    """A bit for each value of the low ``FILTER`` bits of ``h`` that occurs in ``wanted``."""
    low = F.col("h").bitwiseAND(F.lit((1 << FILTER) - 1).cast("long"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    found = wanted.select(F.shiftright(low, 6).alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER - 6), "<i8")
    bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    return bits.tobytes()


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(h, tokens) of the sets whose hash is in ``wanted``; a filter of fixed size spares most others the way."""
    bits = _filter_bits(wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, parts = [], []
            for t in b.column(0):
                s = shingles(t.as_py(), size)
                h = _identity(s)
                low = h & ((1 << FILTER) - 1)
                if bits[low >> 3] >> (low & 7) & 1:
                    hs.append(h)
                    parts.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), _lists(parts)], names=["h", "tokens"])

    return docs.select("text").mapInArrow(run, "h long, tokens array<long>").join(wanted, "h", "left_semi").dropDuplicates(["h"])


def _need(n: Column, m: Column, threshold: float) -> Column:
    """Sets of sizes n and m match if they share at least this many (with a hair's tolerance)."""
    return F.lit(threshold / (1 + threshold)) * (n + m) - 1e-9


def _may_match(x: str, y: str, threshold: float) -> Column:
    """Length and positional filters on two postings of a shingle; a match passes at the first one that its sets share."""
    n, m, i, j = (F.col(f"{s}.{c}") for c in "ni" for s in (x, y))
    return F.least(n - i, m - j, n, m) >= _need(n, m, threshold)


def _may_equal(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """Those of the (h, o) pairs whose parity bits leave a match a chance; ``marks`` has (h, n, parity)."""
    x, y = (marks.select(F.col("h").alias(h), F.col("n").alias(n), F.col("parity").alias(p)) for h, n, p in (("h", "n", "p"), ("o", "m", "q")))
    both = pairs.join(x, "h").join(y, "o")
    differ = F.aggregate(F.zip_with("p", "q", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, c: a + c)
    return both.where(differ <= F.col("n") + F.col("m") - 2 * _need(F.col("n"), F.col("m"), threshold)).select("h", "o")


def _verified(pairs: DataFrame, docs: DataFrame, marks: DataFrame, size: int, threshold: float) -> DataFrame:
    """Those of the (h, o) pairs that match."""
    pairs = cut(_may_equal(pairs, marks, threshold))
    sets = cut(whole_sets(docs, pairs.select("h").unionAll(pairs.select("o")).distinct(), size))
    x, y = (sets.select(F.col("h").alias(h), F.col("tokens").alias(t)) for h, t in (("h", "s"), ("o", "t")))
    both = pairs.join(x, "h").join(y, "o")
    return both.where(F.size(F.array_intersect("s", "t")) >= _need(F.size("s"), F.size("t"), threshold)).select("h", "o")


def matches(docs: DataFrame, folded: DataFrame, size: int, threshold: float) -> DataFrame:
    """Edges (h, o) of matching sets whose components are those of all matching pairs."""
    marks = cut(folded.select("h", "n", "parity"))
    each = folded.select("h", "n", F.posexplode("head").alias("i", "tok"))
    spread = F.count("*").over(Window.partitionBy("tok"))
    posts = cut(each.withColumn("spread", spread).where("spread > 1"))
    known = posts.groupBy("h").agg(F.sum("spread").alias("weight"))
    hubs = posts.join(known, "h").groupBy("tok").agg(F.max(F.struct("weight", "h", "n", "i")).alias("hub"))
    met = posts.select("tok", F.struct("h", "n", "i").alias("x")).join(hubs, "tok")
    met = met.where((F.col("x.h") != F.col("hub.h")) & _may_match("x", "hub", threshold))
    best = met.groupBy(F.col("x.h").alias("h"), F.col("hub.h").alias("o")).agg(F.count("*").alias("c"))
    best = best.groupBy("h").agg(F.max(F.struct("c", "o"))["o"].alias("o"))
    stars = cut(_verified(best, docs, marks, size, threshold))
    comp = connected_components(stars)
    placed = posts.join(comp, posts.h == comp.node, "left").withColumn("comp", F.coalesce("component", "h"))
    lists = placed.groupBy("tok", "comp").agg(F.collect_list(F.struct("h", "n", "i")).alias("rows"))
    a, b = (lists.select("tok", F.col("comp").alias(f"c{s}"), F.col("rows").alias(f"r{s}")) for s in "ab")
    across = a.join(b, "tok").where("ca < cb").select(F.explode("ra").alias("x"), "rb").select("x", F.explode("rb").alias("y"))
    rest = across.where(_may_match("x", "y", threshold)).select(F.col("x.h").alias("h"), F.col("y.h").alias("o")).distinct()
    return stars.unionAll(_verified(rest, docs, marks, size, threshold))


def near_copy_groups(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, group_id), a row for each row of ``docs``; a group is named by its smallest ``doc_id``."""
    marked = cut(heads(docs, rarity(docs, size), size, threshold))
    folded = marked.groupBy("h").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("head").alias("head"), F.first("parity").alias("parity"))
    comp = connected_components(matches(docs, folded, size, threshold))
    rooted = marked.groupBy("h").agg(F.min("doc_id").alias("first")).join(comp, F.col("h") == comp.node, "left")
    rooted = rooted.select("h", "first", F.coalesce("component", "h").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("group_id"))
    return marked.select("doc_id", "h").join(rooted.join(least, "root").select("h", "group_id"), "h").select("doc_id", "group_id")


def keep_first(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Of each group of near copies the rows with the smallest ``doc_id``; rows without an id are kept."""
    found = near_copy_groups(docs, size, threshold)
    return without(docs, found.where("doc_id <> group_id").select("doc_id").distinct())

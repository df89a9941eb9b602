"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit position ``i`` gets a nonzero 3-bit vector ``a(i)``; table ``v`` (1 to 7) masks in
the positions with an odd inner product ``a(i).v``. Any two positions leave some ``v``
orthogonal to both, so every pair of fingerprints at 2 or fewer differing bits
agrees on a whole mask and meets in some table (Pagh, 2016). Links are made inside the
tables' buckets: a task compares the fingerprints of a bucket and emits one star edge for each
that is linked. A bucket too large to compare at once is split by the same construction over the
bits its mask leaves free, again and again if need be; its fingerprints differ only there, so no pair
is lost, and each level leaves fewer bits in which they can.

Nulls: a null text counts as empty (fingerprint 0, linked like any other); a null
``doc_id`` keeps its row, and is never the smallest id of a component while there
is another. Repeated rows each give a row; extra columns are ignored by
:func:`simhash_components` and kept by :func:`keep_first`, whatever their names. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, cut

SEED = 42
RADIUS = 2
#: Fingerprints that a task compares with each other at once.
BUCKET = 1024
_BLOCK = 1 << 15
_ALL = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only \x20 \x09-\x0D
    if not words:
        return 0
    one = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [one(b" ".join(words), SEED)]
    elif shingle == 3:
        hashes = [one(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
    else:
        hashes = [one(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)]
    h = np.fromiter(hashes, np.uint64, len(hashes))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _BLOCK):
        bits = np.unpackbits(h[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def covering_masks(radius: int = RADIUS, kept: int = 0) -> list[int]:
    """Masks that keep the bits of ``kept`` and, for any ``radius`` other positions, hold some mask blind to all of them."""
    n = (1 << (radius + 1)) - 1
    free = [i for i in range(64) if not kept >> i & 1]
    return [kept | sum(1 << i for k, i in enumerate(free) if bin((1 + k % n) & v).count("1") % 2) for v in range(1, n + 1)]


def bucket_stars(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct fingerprints of a bucket, the smallest that links reach from it within the bucket."""
    own = np.sort(fps)
    bits = own.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(len(own))
    while True:
        new = np.where(near, label[None, :], len(own)).min(1)
        if (new == label).all():
            return own[label][np.searchsorted(own, fps)]
        label = new[new]


def near_links(fps: DataFrame, bucket: int = BUCKET, radius: int = RADIUS) -> DataFrame:
    """Edges (fp, other) whose components are those of all pairs at ``radius`` or fewer differing bits; ``fp`` must be distinct."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row in b.column(0):
                one = row.values.to_numpy()
                root = bucket_stars(one, radius)
                got.append(one[root != one])
                roots.append(root[root != one])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got)), pa.array(np.concatenate(roots))], names=["fp", "other"])

    edges = None
    level, kept = fps.select("fp", F.lit(0).alias("path")), {0: 0}
    while level is not None:
        tables: dict[int, int] = {}
        children = []
        for path, mask in kept.items():
            below = [(path * 8 + v, m) for v, m in enumerate(covering_masks(radius, mask), 1) if m != mask]
            tables |= dict(below)
            keys = F.array(*[F.struct(F.lit(p).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for p, m in below])
            children.append(level.where(F.col("path") == path).select("fp", F.explode(keys).alias("t")).select("fp", "t.path", "t.key"))
        placed = children[0]
        for more in children[1:]:
            placed = placed.unionAll(more)
        sizes = cut(placed.groupBy("path", "key").agg(F.count("*").alias("size")).where("size > 1"))
        small = placed.join(sizes.where(F.col("size") <= bucket), ["path", "key"]).groupBy("path", "key").agg(F.collect_list("fp").alias("fps"))
        found = small.select("fps").mapInArrow(run, "fp long, other long")
        edges = found if edges is None else edges.unionAll(found)
        large = sizes.where(F.col("size") > bucket)
        paths = sorted(r["path"] for r in large.select("path").distinct().collect())
        # A bucket whose mask leaves few bits free cannot be large, so this ends.
        level = cut(placed.join(large.select("path", "key"), ["path", "key"], "left_semi").select("fp", "path").distinct()) if paths else None
        kept = {p: tables[p] for p in paths}
    return edges.distinct()


def simhash_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``."""
    marked = cut(fingerprints(docs, shingle))
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = connected_components(near_links(fps.select("fp")))
    root = F.coalesce("component", "fp")
    rooted = fps.join(comp, fps.fp == comp.node, "left").select("fp", "first", root.alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(member, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Of each group of near copies the rows with the smallest ``doc_id``; rows without an id are kept."""
    found = simhash_components(docs, shingle)
    lost = found.where("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, lost)


def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """``docs``, whatever its columns, without the rows whose id is in ``lost`` (one column)."""
    rowed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col("doc_id").cast("long").alias("key_"))
    left = rowed.join(lost.toDF("lost_"), F.col("key_") == F.col("lost_"), "left_anti")
    return left.select(*[F.col("row_").getField(c).alias(c) for c in docs.columns])

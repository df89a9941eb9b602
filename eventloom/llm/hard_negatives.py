"""Hard-negative mining by exact inner products in a residue number system.

Anchors and candidates are dealt into tiles: a block of anchors meets a stripe of
candidates in one task, which streams the stripe in slices of bounded size. A slice's
score matrix is the product of whole-number component matrices modulo several primes
under 1,024, each in float32 (64 dimensions at a time, so no sum passes 24 bits), put
together by Chinese remaindering in balanced mixed-radix digits: as many primes as the
slice's largest possible score needs, so every score is exact and signed. Two passes
follow each other, as windows depend on positives: the first keeps each anchor's best rows
of its own label, the second, for all of an anchor's windows at once, the best rows of
other labels inside them. A task emits at most ``positives * negatives`` rows an anchor,
whatever the stripe holds; SQL windows merge the stripes.

Rows with a null label, a null vector or a null or non-finite component take no part, nor
do rows without ``vec_id``. Rows that share an anchor's ``vec_id`` are no candidates of it.
Rows that repeat a ``vec_id`` otherwise count one by one: as candidates each is listed, as
anchors each different row asks for itself and equal rows ask once. Vectors of unequal length
meet in their common dimensions. Ties go to the smaller ``vec_id``. A component or a returned
score of over 64 bits is an error, never a wrong number. Extra columns are ignored; an empty
table or one without anchors gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import cut
from .topk import usable, whole_numbers

#: Dimensions of one float32 product: 64 * 511 * 511 < 2**24.
DEPTH = 64
#: Rows of a score matrix held at once: anchors, candidates.
SLICE = (512, 4096)


def primes() -> list[int]:
    """The odd primes under 1,024, largest first."""
    odd = range(3, 1024, 2)
    return [n for n in reversed(odd) if all(n % d for d in range(3, int(n**0.5) + 1, 2))]


def residues(m: np.ndarray, p: int) -> np.ndarray:
    """Balanced remainders, -(p // 2) to p // 2, as float32."""
    r = m % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def _product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """(a @ b.T) mod p in 0..p-1, exact in float32."""
    total = np.zeros((len(a), len(b)), np.int64)
    for d in range(0, a.shape[1], DEPTH):
        total += (a[:, d : d + DEPTH] @ b[:, d : d + DEPTH].T).astype(np.int64)
    return total % p


def remaindered(parts: list[np.ndarray], moduli: list[int], kind: type) -> np.ndarray:
    """Signed numbers from their remainders: balanced mixed-radix digits, summed up in ``kind``."""
    digits: list[np.ndarray] = []
    value, weight = np.zeros(parts[0].shape, kind), 1
    for part, p in zip(parts, moduli):
        rest, inverse = part.copy(), 1
        for d, q in zip(digits, moduli):
            rest -= d * inverse
            rest %= p
            inverse = inverse * q % p
        digit = rest * pow(inverse, -1, p) % p
        digit = np.where(digit > p // 2, digit - p, digit)
        digits.append(digit)
        # 64-bit sums may wrap on the way: the true number fits, so the last sum is right.
        value += digit.astype(kind) * (weight if kind is object else np.array(weight & (1 << 64) - 1, np.uint64).astype(np.int64))
        weight *= p
    return value


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of inner products of two whole-number matrices; int64, or Python numbers where that may not do."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    most = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    bound = most(a) * most(b) * max(1, dims)
    moduli, product = [], 1
    for p in primes():
        if product > 2 * bound + 1:
            break
        moduli.append(p)
        product *= p
    if not moduli:
        return np.zeros((len(a), len(b)), np.int64)
    parts = [_product_mod(residues(a, p), residues(b, p), p) for p in moduli]
    with np.errstate(over="ignore"):
        return remaindered(parts, moduli, np.int64 if bound < 1 << 63 else object)


def _dense(lists: pa.Array) -> np.ndarray:
    """Whole-number lists as a matrix, short ones filled with zeros."""
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(n), n.max(initial=0)), np.int64)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _tiles(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[pa.Table, Iterator[pa.RecordBatch]]]:
    """(anchors, candidate slices) of each tile of a partition sorted by tile and side."""
    state: dict = {"key": None, "held": []}

    def pieces() -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
        for b in batches:
            qb, cs, side = (_longs(b, x) for x in ("qb", "cs", "side"))
            edges = np.flatnonzero((np.diff(qb) != 0) | (np.diff(cs) != 0) | (np.diff(side) != 0)) + 1
            for i, j in zip([0, *edges], [*edges, len(b)]):
                for k in range(i, j, depth):
                    yield (int(qb[i]), int(cs[i])), int(side[i]), b.slice(k, min(depth, j - k))

    stream = pieces()
    ahead = next(stream, None)
    while ahead is not None:
        key = ahead[0]
        anchors = []
        while ahead is not None and ahead[0] == key and ahead[1] == 0:
            anchors.append(ahead[2])
            ahead = next(stream, None)
        state["ahead"] = ahead

        def candidates(key: tuple[int, int] = key) -> Iterator[pa.RecordBatch]:
            while state["ahead"] is not None and state["ahead"][0] == key:
                yield state["ahead"][2]
                state["ahead"] = next(stream, None)

        mine = candidates()
        if anchors:
            yield pa.Table.from_batches(anchors), mine
        for _ in mine:  # whatever was not read, so that the next tile starts at its head
            pass
        ahead = state["ahead"]


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, earlier ones first among equals."""
    if len(score) <= k:
        return np.argsort(-score, kind="stable")
    kth = np.sort(score)[-k] if score.dtype == object else -np.partition(-score, k - 1)[k - 1]
    over = np.flatnonzero(score > kth)
    at = np.concatenate([over, np.flatnonzero(score == kth)[: k - len(over)]])
    return at[np.argsort(-score[at], kind="stable")]


def _best(held: tuple[list[int], list[int]], ids: np.ndarray, score: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """The best ``k`` of those held and new ones; ids ascend, so earlier ones win ties."""
    at = _first(score, k)
    both = sorted(zip(held[0] + score[at].tolist(), held[1] + ids[at].tolist()), key=lambda x: (-x[0], x[1]))[:k]
    return [x[0] for x in both], [x[1] for x in both]


def _run(select: Callable, out: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over tiles: ``select(state, row, scores, ids, same label, anchor)`` keeps what one anchor wants of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, slices in _tiles(batches, SLICE[1]):
            anchors = anchors.combine_chunks()
            own, label, key = (_longs(anchors, x) for x in ("vec_id", "label", "akey"))
            windows = anchors.column("windows").to_pylist()
            w = _dense(anchors.column("w").combine_chunks())
            kept: list = [None] * len(own)
            for c in slices:
                ids, theirs, cw = _longs(c, "vec_id"), _longs(c, "label"), _dense(c.column("w"))
                for i in range(0, len(own), SLICE[0]):
                    scores = exact_products(w[i : i + SLICE[0]], cw)
                    for r in range(len(scores)):
                        kept[i + r] = select(kept[i + r], scores[r], ids, theirs == label[i + r], ids == own[i + r], windows[i + r])
            rows = [(int(key[i]), int(own[i]), n, s) for i, k in enumerate(kept) if k for s, n in _pairs(k)]
            if any(abs(r[3]) >= 1 << 63 for r in rows):
                raise OverflowError("a score needs over 64 bits")
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=out)

    return run


def _pairs(kept: tuple | list) -> Iterator[tuple[int, int]]:
    """(score, id) of one list, or of several without what they share."""
    if isinstance(kept, tuple):
        return zip(*kept)
    most: dict[tuple[int, int], int] = {}
    for lst in kept:
        seen: dict[tuple[int, int], int] = {}
        for pair in zip(*lst):
            seen[pair] = seen.get(pair, 0) + 1
        for pair, n in seen.items():
            most[pair] = max(most.get(pair, 0), n)
    return (pair for pair, n in most.items() for _ in range(n))


def _whole(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    anchor_block: int = 4096,
    stripe: int = 1 << 18,
    least_tiles: int = 32,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor and each of its first ``positives`` rows of the same label: the first ``negatives`` rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score, components being floor(scale * x).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", F.coalesce(anchors, F.lit(False)).alias("a_"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", "label", whole_numbers(F.col("embedding"), scale).alias("w"), "a_")
    n, n_anchors = rows.agg(F.count("*"), F.count_if("a_")).first()
    blocks = max(1, -(-n_anchors // anchor_block))
    # Stripes have a bounded size; small tables are cut finer, so that every core has work.
    stripes = max(-(-n // stripe), min(-(-least_tiles // blocks), -(-n // SLICE[1])), 1)
    deal = lambda of, *by: F.pmod(F.xxhash64(*by), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    none = F.lit(None).cast("array<struct<lo:decimal(38,0),hi:decimal(38,0)>>")
    asked = rows.where("a_").select("vec_id", "label", "w").distinct().withColumn("akey", F.xxhash64("vec_id", "label", "w"))
    offers = rows.select(
        every(blocks).alias("qb"), deal(stripes, "vec_id", "w").alias("cs"), F.lit(1).alias("side"), "vec_id", "label", "w", F.lit(0).cast("long").alias("akey"), none.alias("windows")
    )

    def tiled(asks: DataFrame, select: Callable, names: list[str]) -> DataFrame:
        asks = asks.select(deal(blocks, "akey").alias("qb"), every(stripes).alias("cs"), F.lit(0).alias("side"), "vec_id", "label", "w", "akey", "windows")
        dealt = asks.unionAll(offers).repartition(min(blocks * stripes, 100_000), "qb", "cs").sortWithinPartitions("qb", "cs", "side", "vec_id")
        return dealt.mapInArrow(_run(select, names), ", ".join(f"{x} long" for x in names))

    def nearest(held, scores, ids, same, own, _):
        at = np.flatnonzero(same & ~own)
        return _best(held or ([], []), ids[at], scores[at], positives)

    def within(held, scores, ids, same, own, windows):
        held = held or [([], [])] * len(windows)
        free = ~same & ~own
        out = []
        for h, window in zip(held, windows):
            # Bounds are cut to what a score here can be: numbers past 64 bits compare like the largest.
            lo, hi = (max(-(1 << 63), min((1 << 63) - 1, int(window[x]))) if scores.dtype != object else int(window[x]) for x in ("lo", "hi"))
            at = np.flatnonzero(free & (scores >= lo) & (scores <= hi))
            out.append(_best(h, ids[at], scores[at], negatives) if len(at) else h)
        return out

    order = Window.partitionBy("akey").orderBy(F.desc("positive_score"), "positive_id")
    best = tiled(asked.withColumn("windows", none), nearest, ["akey", "anchor_id", "positive_id", "positive_score"])
    best = cut(best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives))
    # 30 p <= 100 s <= 90 p, as whole numbers: s from -((-30 p) div 100) to (90 p) div 100, rounded down.
    down = lambda x: F.floor(x / F.lit(100).cast("decimal(3,0)"))
    p = F.col("positive_score").cast("decimal(20,0)")
    of = lambda k: p * F.lit(k).cast("decimal(10,0)")
    window = F.struct(_whole(-down(-of(low))).alias("lo"), _whole(down(of(high))).alias("hi"))
    windows = best.groupBy("akey").agg(F.collect_set(window).alias("windows"))
    found = tiled(asked.join(windows, "akey"), within, ["akey", "anchor_id", "negative_id", "negative_score"])
    hundred = _whole(F.col("negative_score")) * F.lit(100).cast("decimal(3,0)")
    fits = (of(low) <= hundred) & (hundred <= of(high))
    pairs = best.join(found.drop("anchor_id"), "akey").where(fits)
    order = Window.partitionBy("akey", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

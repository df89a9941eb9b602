"""Exact top-k inner-product search, term at a time.

Both sides are cut into blocks of bounded size. A task holds one block of queries
and one of candidates: it turns the candidates into postings (dimension, weights),
scatters every nonzero query weight over the posting of its dimension into a dense
score array, selects the best k by partition, and emits them. A window merges the
blocks' lists. Scores are exact whole numbers; a component or a reported score that
needs more than 64 bits is an error, never a wrong number.

Vectors that are null or hold null, NaN or infinite components take no part, nor do
rows without ``vec_id``. Every row is a candidate of the queries with another ``vec_id``; rows
that repeat a query's ``vec_id`` ask together, so its list holds their best scores. Vectors of
unequal length meet in their common dimensions. Ties go to the smaller ``vec_id``. Extra columns
are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "query_id long, vec_id long, score long"


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, x as double; an error where that needs over 64 bits."""

    def one(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(scaled) < float(1 << 63), F.floor(scaled)).otherwise(F.raise_error(F.lit("a component needs over 64 bits")).cast("long"))

    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    """Not null, all components there and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def _matrix(batches: list[pa.RecordBatch], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their weights, short vectors filled with zeros."""
    ids, rows = [], []
    for b in batches:
        mask = b.column("side").to_numpy(zero_copy_only=False) == side
        if mask.any():
            part = b.filter(pa.array(mask))
            ids.append(part.column("vec_id").to_numpy(zero_copy_only=False))
            lists = part.column("w")
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            out = np.zeros((len(n), n.max(initial=0)), np.int64)
            out[np.arange(out.shape[1])[None, :] < n[:, None]] = flat
            rows.append(out)
    if not ids:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    width = max(r.shape[1] for r in rows)
    m = np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows])
    ids = np.concatenate(ids)
    order = np.argsort(ids, kind="stable")
    return ids[order], m[order]


def _kind(q: np.ndarray, c: np.ndarray, dims: int) -> type:
    """The fastest type in which no sum can lose a digit."""
    most = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    bound = most(q) * most(c) * max(1, dims)
    return next((kind for kind, bits in ((np.float32, 24), (np.float64, 53), (np.int64, 63)) if bound < 1 << bits), object)


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> pa.RecordBatch:
    """The best ``k`` candidates of each query; ``cid`` ascends, so positions break ties."""
    dims = min(q.shape[1], c.shape[1])
    kind = _kind(q, c, dims)
    postings = []
    for d in range(dims):
        at = np.flatnonzero(c[:, d])
        if 4 * len(at) > len(cid):
            at = slice(None)  # a posting of most rows is added faster with its zeros
        postings.append((at, c[at, d].astype(kind)))
    weights = q.astype(kind)
    out: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
    for i in range(len(qid)):
        score = np.zeros(len(cid), kind)
        for d in np.flatnonzero(q[i, :dims]):
            at, w = postings[d]
            score[at] += weights[i, d] * w
        own = slice(*np.searchsorted(cid, [qid[i], qid[i] + 1]))
        pos = np.delete(np.arange(len(cid)), own)
        score = np.delete(score, own)
        if len(pos) > k:
            kth = np.sort(score)[-k] if kind is object else -np.partition(-score, k - 1)[k - 1]
            over = np.flatnonzero(score > kth)
            best = np.concatenate([over, np.flatnonzero(score == kth)[: k - len(over)]])
        else:
            best = np.arange(len(pos))
        out.append((np.full(len(best), qid[i]), cid[pos[best]], list(map(int, score[best]))))
    numbers = [x for _, _, s in out for x in s]
    if any(abs(x) >= 1 << 63 for x in numbers):
        raise OverflowError("a score needs over 64 bits")
    ids = [np.concatenate(x) for x in list(zip(*out))[:2]] or [np.zeros(0, np.int64)] * 2
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*ids, numbers)], names=["query_id", "vec_id", "score"])


def exact_top_k(
    vectors: DataFrame, queries: Column, k: int = 20, query_block: int = 1024, candidate_block: int = 8192
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest inner product for each row where ``queries`` holds."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(queries, F.lit(False)).alias("q_"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    n, nq = rows.agg(F.count("*"), F.count_if("q_")).first()
    c_blocks, q_blocks = max(1, -(-n // candidate_block)), max(1, -(-nq // query_block))
    block = lambda of: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.lit(of - 1))
    tile = lambda qb, cb, side: F.struct(qb.alias("qb"), cb.alias("cb"), F.lit(side).alias("side"))
    offers = F.transform(every(q_blocks), lambda qb: tile(qb, F.col("c_"), 1))
    asks = F.transform(every(c_blocks), lambda cb: tile(F.col("own_"), cb, 0))
    tiles = F.explode(F.concat(offers, F.when(F.col("q_"), asks).otherwise(F.slice(asks, 1, 0))))
    dealt = rows.select("vec_id", whole_numbers(F.col("embedding")).alias("w"), "q_", block(c_blocks).alias("c_"), block(q_blocks).alias("own_"))
    dealt = dealt.select("vec_id", "w", tiles.alias("t")).select("t.*", "vec_id", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        yield search_block(*_matrix(held, 0), *_matrix(held, 1), k)

    # One partition a tile is asked for, so that every core has work.
    best = dealt.repartition(min(c_blocks * q_blocks, 100_000), "qb", "cb").groupBy("qb", "cb").applyInArrow(run, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Embedding near-duplicates by PCA-ordered tiled comparison.

Exact copies are folded first (with their count). The remaining vectors are scaled
to unit length and turned to their principal axes, largest variance first; the axes
come from one sum of outer products, whose size is fixed by the dimension. Rows are
dealt to blocks by where they lie on the leading axes, and a task compares two blocks. Two
blocks whose ranges on these axes and largest suffix norms keep every pair under the
threshold are never brought together. In a tile, one product of the leading axes, with the
suffix norm as one more axis, bounds each pair's cosine from above; only pairs that can
still reach the threshold go on to the next axes. Pairs that stay are decided by the cosine of
the given vectors in double precision. A task emits a link count and one star edge a
row, never the pairs.

Vectors that are null or empty, have null or non-finite components, or are zero link
with nothing, nor do vectors of different length. Each vector is first scaled by a power of two,
so very large and very small components neither overflow nor vanish. Rows without ``vec_id``
keep their row; repeated rows count as copies. Extra columns are ignored. Empty tables give
empty results. Each length of vector takes jobs of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, cut
from .topk import usable

#: Leading axes multiplied before each test of the bound.
STEPS = (24, 40)
#: Rows of a tile compared at a time, which bounds the pairs in memory.
SLICE = 128
#: Axes by which rows are dealt, and the most of them that split blocks.
RANGE_AXES, MAX_SPLITS = 8, 8
#: Allowances for rounding: of bounds in single and in double precision.
_SLACK32, _SLACK = 1e-5, 1e-9


def _dense(col: pa.Array) -> np.ndarray:
    """One vector a row, each scaled by a power of two to a largest component of 0.5 to 1."""
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(reps: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(dim, dim) rotation, columns by falling variance of the unit vectors; and the vectors' mean on these axes."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for b in batches:
            if len(b):
                x = _unit(_dense(b.column(0)))
                total += x.T @ x
                first += x.sum(0)
                n += len(x)
        flat = np.concatenate([total.ravel(), first, [n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "v"])

    got = reps.select("embedding").mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(dim * dim + dim + 1)
    flat[got["at"].to_numpy()] = got["v"].to_numpy()
    axes = np.linalg.eigh(flat[: dim * dim].reshape(dim, dim))[1][:, ::-1].copy()
    return axes, (flat[dim * dim : -1] / max(1.0, flat[-1])) @ axes


def _suffix(r: np.ndarray, at: int) -> np.ndarray:
    return np.sqrt((r[:, at:] ** 2).sum(1))


def similar_in_slices(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into x, into y) with cosine at or over ``threshold``, for ``SLICE`` rows of x at a time; no pair is kept."""
    xr, yr = _unit(x) @ axes, _unit(y) @ axes
    dim = x.shape[1]
    steps = [s for s in STEPS if s < dim] or [dim]
    first = steps[0]
    lead = lambda r: np.column_stack([r[:, :first], _suffix(r, first)]).astype(np.float32)
    xb, yb = lead(xr), np.ascontiguousarray(lead(yr).T)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    for at in range(0, len(x), SLICE):
        i, j = np.divmod(np.flatnonzero(xb[at : at + SLICE] @ yb >= np.float32(threshold - _SLACK32)), len(y))
        i += at
        known = _pairwise(xr[:, :first], yr[:, :first], i, j)
        for a, b in zip(steps, [*steps[1:], dim]):
            keep = known + _suffix(xr, a)[i] * _suffix(yr, a)[j] >= threshold - _SLACK if len(i) else np.zeros(0, bool)
            i, j, known = i[keep], j[keep], known[keep]
            if a < b and len(i):
                known = known + _pairwise(xr[:, a:b], yr[:, a:b], i, j)
        keep = _pairwise(x, y, i, j) / (nx[i] * ny[j]) >= threshold
        yield i[keep], j[keep]


def similar_in_tile(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of a tile at once; for tiles with few."""
    i, j = zip(*similar_in_slices(x, y, axes, threshold))
    return np.concatenate(i), np.concatenate(j)


def _pairwise(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of chosen rows, in slices of bounded memory."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        out[s] = np.einsum("ij,ij->i", x[i[s]], y[j[s]])
    return out


def _roots(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each node, given the roots so far and further links, which are followed between roots."""
    i, j = label[i], label[j]
    i, j = i[i != j], j[i != j]
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def embedding_components(vectors: DataFrame, threshold: float = 0.9, block: int = 8192) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors``."""
    fit = usable(F.col("embedding")) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fit, F.col("embedding")).alias("embedding"))
    reps = cut(
        rows.where("embedding is not null")
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    sizes = {r["dim"]: r["n"] for r in reps.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    links = edges = None
    for dim, n in sizes.items():
        one = reps.where(F.size("embedding") == dim)
        out = cut(_tiles(one, *principal_axes(one, dim), n, threshold, block))
        got_links = out.where("links > 0").select("rep", "links")
        got_edges = out.where("root <> rep").select("rep", "root")
        links = got_links if links is None else links.unionAll(got_links)
        edges = got_edges if edges is None else edges.unionAll(got_edges)
    if links is None:
        own = F.col("vec_id")
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept"))
    total = links.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(edges)
    rooted = reps.join(comp, reps.rep == comp.node, "left").withColumn("root", F.coalesce("component", "rep"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    full = rooted.join(least, "root").join(total, "rep", "left")
    full = full.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    joined = rows.where("embedding is not null").join(full, "embedding", "left").select("vec_id", "links", "component_id")
    # Rows that take no part need no join, so they are no common key.
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    return joined.unionAll(alone).select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _ranged(reps: DataFrame, axes: np.ndarray, mean: np.ndarray, splits: int) -> DataFrame:
    """``reps`` with ``key`` (which side of the mean on each of the first ``splits`` axes), leading coordinates and suffix norm."""
    n_axes = min(RANGE_AXES, len(mean))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                r = _unit(_dense(b.column(2))) @ axes
                key = ((r[:, :splits] >= mean[:splits]) << np.arange(splits)).sum(1) if splits else np.zeros(len(r), np.int64)
                c = pa.FixedSizeListArray.from_arrays(pa.array(r[:, :n_axes].ravel()), n_axes).cast(pa.list_(pa.float64()))
                cols = [*b.columns, pa.array(key.astype(np.int32)), c, pa.array(_suffix(r, n_axes))]
                yield pa.RecordBatch.from_arrays(cols, names=["rep", "n", "embedding", "key", "c", "tail"])

    kind = reps.schema["embedding"].dataType.simpleString()
    return reps.select("rep", "n", "embedding").mapInArrow(place, f"rep long, n long, embedding {kind}, key int, c array<double>, tail double")


def partners(low: np.ndarray, high: np.ndarray, tail: np.ndarray, threshold: float) -> np.ndarray:
    """Which blocks may hold similar rows: the largest product their ranges (rows: blocks) and suffix norms allow reaches the threshold."""
    ends = [a[:, None, :] * b[None, :, :] for a in (low, high) for b in (low, high)]
    return np.maximum.reduce(ends).sum(2) + tail[:, None] * tail[None, :] >= threshold - _SLACK


def _tiles(reps: DataFrame, axes: np.ndarray, mean: np.ndarray, n: int, threshold: float, block: int) -> DataFrame:
    """For each tile and row: links to the tile's other rows (copies counted) and the row's root there."""
    splits = min(MAX_SPLITS, len(mean), max(0, int(np.ceil(np.log2(n / block)))))
    placed = _ranged(reps, axes, mean, splits)
    k = min(RANGE_AXES, len(mean))
    edges = [f(F.get("c", F.lit(i))).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(k)]
    stats = placed.groupBy("key").agg(F.count("*").alias("rows"), F.max("tail").alias("tail"), *edges).toArrow()
    keys = stats["key"].to_numpy()
    col = lambda name: stats[name].to_numpy()
    low, high = (np.column_stack([col(f"{f}{i}") for i in range(k)]) for f in ("min", "max"))
    near = partners(low, high, col("tail"), threshold)
    chunks = np.zeros(1 << splits, int)
    chunks[keys] = -(-col("rows") // block)
    others = [""] * (1 << splits)
    for row, key in zip(near, keys):
        others[key] = ",".join(map(str, keys[row]))
    in_key = F.array(*map(F.lit, chunks.tolist()))
    # A unit is a bounded part of a block; its number is the block's and its own.
    unit = lambda key, part: key.cast("long") * (1 << 32) + part
    own = unit(F.col("key"), F.pmod(F.xxhash64("rep"), F.get(in_key, F.col("key"))))
    dealt = placed.select("rep", "n", "embedding", own.alias("u"), F.explode(F.split(F.get(F.array(*map(F.lit, others)), F.col("key")), ",").cast("array<int>")).alias("ok"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.get(in_key, F.col("ok")) - 1)).alias("part"))
    other = unit(F.col("ok"), F.col("part"))
    dealt = dealt.select(F.least("u", other).alias("lo"), F.greatest("u", other).alias("hi"), F.col("u").alias("b"), "rep", "n", "embedding")
    # One partition a tile is asked for, so that every core has work.
    tiles = (int((near * np.outer(chunks[keys], chunks[keys])).sum()) + int(chunks.sum())) // 2
    dealt = dealt.repartition(max(1, min(tiles, 100_000)), "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        side = t["b"].to_numpy()
        rep, count = t["rep"].to_numpy(), t["n"].to_numpy()
        x = _dense(t["embedding"].combine_chunks())
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i, j in similar_in_slices(x[left], x[right], axes, threshold):
            i, j = left[i], right[j]
            other = i != j
            i, j = i[other], j[other]
            np.add.at(links, i, count[j])
            if lo != hi:
                np.add.at(links, j, count[i])
            root = _roots(root, i, j)
        hit = links > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(rep[hit]), pa.array(links[hit]), pa.array(rep[root[hit]])], names=["rep", "links", "root"]
        )

    return dealt.groupBy("lo", "hi").applyInArrow(compare, "rep long, links long, root long")

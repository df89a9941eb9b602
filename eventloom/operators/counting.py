"""How many groups every two members share, for the members of two blocks at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Counts that are held at once, and groups of many members that are multiplied at once.
COUNTS, GROUPS = 1 << 23, 512
#: Members of a batch of results, in pairs.
BATCH = 1 << 18
#: A group is multiplied as a row of bits if it holds more than this share of all pairs of the blocks, else its pairs are counted one by one.
DENSE = 1 / 64

SCHEMA = "x string, ys array<struct<y: string, n: long>>"
_PAIR = pa.struct([("y", pa.string()), ("n", pa.int64())])


def _numbered(lists: list[list[str]]) -> tuple[list[str], list[np.ndarray]]:
    names = sorted({v for x in lists for v in x})
    at = {v: i for i, v in enumerate(names)}
    return names, [np.array([at[v] for v in x], np.int64) for x in lists]


def _bits(lists: list[np.ndarray], start: int, n: int) -> np.ndarray:
    out = np.zeros((n, len(lists)), np.float32)
    for k, x in enumerate(lists):
        out[x[(x >= start) & (x < start + n)] - start, k] = 1
    return out


def _counts(xs: list[np.ndarray], ys: list[np.ndarray], n_x: int, n_y: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first x, counts of shared groups of some x with all y)."""
    dense = [len(x) * len(y) > DENSE * n_x * n_y for x, y in zip(xs, ys)]
    many = [(x, y) for x, y, d in zip(xs, ys, dense) if d]
    few = [(x, y) for x, y, d in zip(xs, ys, dense) if not d]
    step = max(1, COUNTS // n_y)
    for start in range(0, n_x, step):
        n = min(step, n_x - start)
        out = np.zeros((n, n_y), np.float32)
        for i in range(0, len(many), GROUPS):
            part = many[i : i + GROUPS]
            out += _bits([x for x, _ in part], start, n) @ _bits([y for _, y in part], 0, n_y).T
        for x, y in few:
            x = x[(x >= start) & (x < start + n)]
            if len(x):
                out[np.ix_(x - start, y)] += 1
        yield start, out


def _tile(rows: list[tuple[list[str], list[str] | None]], least: int, most: int | None) -> Iterator[pa.RecordBatch]:
    own = rows[0][1] is None
    x_names, xs = _numbered([x for x, _ in rows])
    y_names, ys = (x_names, xs) if own else _numbered([y for _, y in rows])
    names = pa.array(y_names, pa.string())
    for start, counts in _counts(xs, ys, len(x_names), len(y_names)):
        if own:
            counts[np.arange(len(y_names)) <= np.arange(start, start + len(counts))[:, None]] = 0
        floor = least
        if most is not None and counts.size > most:
            # Of these counts none below the last of the most frequent ones is among the most frequent of all.
            floor = max(least, int(np.partition(counts, counts.size - most, axis=None)[counts.size - most]))
        step = max(1, BATCH // len(y_names))
        for i in range(0, len(counts), step):
            x, y = np.nonzero(counts[i : i + step] >= floor)
            if len(x):
                n = counts[i + x, y].astype(np.int64)
                ends = np.flatnonzero(np.diff(x, append=-1)) + 1
                pairs = pa.StructArray.from_arrays([names.take(pa.array(y)), pa.array(n)], fields=list(_PAIR))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([pa.array([x_names[start + i + k] for k in x[ends - 1].tolist()], pa.string()), lists], ["x", "ys"])


def shared(least: int, most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (lo, hi, xs, ys) sorted by lo and hi, one a group that both blocks have members in, to each x with those y it shares ``least`` groups
    or more with. Where lo is hi, ys is ignored and y comes after x. With ``most``, pairs that cannot be among so many most frequent ones may be left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            for lo, hi, x, y in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "xs", "ys"))):
                if (lo, hi) != current:
                    if rows:
                        yield from _tile(rows, least, most)
                    current, rows = (lo, hi), []
                rows.append((x, None if lo == hi else y))
        if rows:
            yield from _tile(rows, least, most)

    return run

"""Shared groups of members are counted by blocks, dense and rare groups alike."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import counting, venues


@pytest.mark.parametrize("counts, dense", [(1 << 23, 1 / 64), (50, 0.2), (50, 9), (7, 0)])
def test_counts_equal_plain_ones(spark, counts, dense, monkeypatch):
    monkeypatch.setattr(counting, "COUNTS", counts)
    monkeypatch.setattr(counting, "DENSE", dense)
    monkeypatch.setattr(counting, "BATCH", 20)
    g = random.Random(3)
    xs = [[f"x{g.randrange(20):02d}" for _ in range(g.choice([1, 3, 15]))] for _ in range(60)]
    ys = [[f"y{g.randrange(15):02d}" for _ in range(g.choice([1, 2, 12]))] for _ in range(60)]
    rows = [(sorted(set(x)), sorted(set(y))) for x, y in zip(xs, ys)]
    for own in (False, True):
        want = {}
        for x, y in rows:
            for p in x:
                for q in x if own else y:
                    if not own or p < q:
                        want[p, q] = want.get((p, q), 0) + 1
        for most in (None, 5):
            got = {(r["x"], p["y"]): p["n"] for b in counting._tile([(x, None if own else y) for x, y in rows], 2, most) for r in b.to_pylist() for p in r["ys"]}
            every = {k: n for k, n in want.items() if n >= 2}
            if most is None:
                assert got == every
            else:
                top = lambda d: sorted((-n, k) for k, n in d.items())[:most]
                assert got.items() <= every.items() and top(got) == top(every)


def test_pairs_are_not_made_one_by_one(spark):
    rows = spark.range(4000).select(F.lit("2024-01-01").alias("date"), F.concat(F.lit("Nacht "), (F.col("id") % 2).cast("string"), F.lit("er Saal")).alias("title"), F.concat(F.lit("o"), (F.col("id") % 500).cast("string")).alias("ort"))
    rows = rows.unionAll(rows.select(F.lit("2024-01-02").alias("date"), "title", "ort"))
    pairs = venues.suspicious_pairs(rows, example=False)
    assert "explode(xs" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 2 * (250 * 249 // 2) and pairs.where("n <> 2").count() == 0
    assert [tuple(r) for r in venues.suspects(venues.suspicious_pairs(rows, example=False, most=2), 2).collect()] == [("o0", "o10", 2), ("o0", "o100", 2)]

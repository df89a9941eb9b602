"""Venue pairs are counted where they are made."""

import itertools
import random

from pyspark.sql import functions as F

from eventloom.operators import venues


def test_pairs_equal_all_pairs_and_are_not_shuffled(spark):
    rng = random.Random(5)
    rows = [(f"2024-01-{rng.randint(1, 4):02d}", rng.choice(["Rote Nacht", "Lange Rote Nacht", "Fest", "ab"]), rng.choice(["", None, *[f"ort{i}" for i in range(40)]])) for _ in range(600)]
    df = spark.createDataFrame(rows, "date string, title string, ort string").withColumn("date", F.to_date("date"))
    held = {}
    for d, t, o in rows:
        key = "-".join([w for w in t.lower().split() if len(w) > 2][:3])
        if key and o:
            held.setdefault(o, set()).add((d, key, t))
    want = {}
    for a, b in itertools.combinations(sorted(held), 2):
        both = sorted(held[a] & held[b])
        if len(both) >= 2:
            want[a, b] = (len(both), both[0][2])
    got = {(r["a"], r["b"]): (r["n"], r["example"]) for r in venues.suspicious_pairs(df).collect()}
    assert got == want and len(got) > 100
    counted = venues.suspicious_pairs(df, example=False)
    assert {(r["a"], r["b"]): r["n"] for r in counted.collect()} == {k: n for k, (n, _) in want.items()}
    # From the venues of two blocks on, nothing moves any more.
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Generate explode(ys")[0]

"""Toxicity: every labelled row is learnt from, in shards."""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from eventloom.llm import toxicity  # noqa: E402


def test_every_labelled_row_counts_and_partitions_do_not(spark):
    """Over 2,500 rows of either class: word counts are those of all fitted rows, and each shard's rows are fitted."""
    rng = np.random.default_rng(3)
    n = 8000
    texts = [" ".join([*rng.choice([f"w{k}" for k in range(50)], 5), "idiot" if i % 2 else "fine", f"only{i % 400}"]) for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'de' AS lang").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")
    marks = toxicity.marks_of(labels)
    learnt = {int(r["id_"]) for r in marks.collect()}
    assert sum(i % 2 for i in learnt) > 2500 and sum(1 - i % 2 for i in learnt) > 2500

    coded = toxicity.shards_of(docs, marks, 4)
    keys, counts, totals = toxicity._counted(coded)
    sizes = {r["shard"]: r["count"] for r in coded.where("toxic >= 0").groupBy("shard").count().collect()}
    assert len(sizes) == 4 and sum(sizes.values()) == len(learnt)
    fitted = sum(s - -(-s // 5) for s in sizes.values())
    assert totals.sum() == fitted
    at = dict(zip(keys.tolist(), counts.T.tolist()))
    assert at[toxicity.forms("idiot")[0]] == [0, totals[1]] and at[toxicity.forms("fine")[0]] == [totals[0], 0]

    m = toxicity.fit(docs, labels, shard=1600)
    again = toxicity.fit(docs.repartition(7), labels.repartition(2), shard=1600)
    assert np.array_equal(m.emb, again.emb) and np.array_equal(toxicity._rest(m), toxicity._rest(again)) and m.thresholds == again.thresholds
    unseen = [i for i in range(n) if i not in learnt]
    s = toxicity.score_texts(m, [texts[i] for i in unseen], {})
    assert np.mean((s >= 0.3) == np.array([i % 2 for i in unseen])) > 0.99

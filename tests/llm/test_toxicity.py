"""The toxicity classifier: forward pass against plain loops, the registered query's columns, and edge cases."""

import os
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

from eventloom.llm import toxicity  # noqa: E402

CLEAN = [f"w{i}" for i in range(200)]
BAD = ["idiotisch", "idiotin", "idioten", "idiot"]


def corpus(n, seed=2):
    """(texts, labels): every other text holds an insult."""
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(n):
        t = list(rng.choice(CLEAN, 30))
        if i % 2:
            t[rng.integers(30)] = BAD[rng.integers(4)]
        texts.append(" ".join(t))
    return texts, np.arange(n) % 2


@pytest.fixture(scope="module")
def model():
    return toxicity.train(*corpus(400), epochs=5)


def plain_score(m, text):
    """Sum of form embeddings a word; each filter at each place; the best place; the logistic layer."""
    words = toxicity.words(text) or [None]
    v = [sum(m.emb[r] for r in m.known(w)) if w else np.zeros(toxicity.DIM) for w in words] + [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1)
    best = []
    for w, taps in m.conv.items():
        for q in range(taps.shape[2]):
            best.append(max(sum(float(v[i + j] @ taps[j, :, q]) for j in range(w)) for i in range(len(words))))
    z = np.maximum(np.array(best) + m.bias, 0) @ m.head + m.offset
    return 1 / (1 + np.exp(-(m.scale * z + m.shift)))


def test_forward_pass_equals_plain_loops(model):
    texts = ["", None, "idiot", "w1 w2 idioten w3", " ".join(CLEAN), "unknown words only", "w1", "IDIOT w5"]
    got = toxicity.score_texts(model, texts, {})
    assert got == pytest.approx([plain_score(model, t) for t in texts], abs=1e-5)
    assert got[0] == got[1]


def test_left_out_rows_give_no_statistics():
    """Words that only rows of the calibration fifth hold have no embedding."""
    texts, y = corpus(200)
    texts = [f"{t} calibrationonly" if i % 5 == 0 else t for i, t in enumerate(texts)]
    m = toxicity.train(texts, y, epochs=1)
    assert not any(m.known("calibrationonly")) and any(m.known("idiot"))


def test_learns_without_log_odds():
    """The convolution learns by its steps alone, too."""
    m = toxicity.train(*corpus(600), epochs=25, prior=False)
    texts, y = corpus(200, seed=77)
    s = toxicity.score_texts(m, texts, {})
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.9


def test_query_columns_held_out_accuracy_and_odd_rows(spark):
    texts, y = corpus(500)
    rows = [(i, t, "de" if i % 3 else None, "x") for i, t in enumerate(texts)]
    rows += [(9001, None, "de", "x"), (9002, "", "de", "x"), (None, "an idiot here", "de", "x"), (3, texts[3], "de", "x"), (9003, "w1 " * 40_000 + "idiot", "de", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic string")
    marks = [(i, int(v), 0) for i, v in enumerate(y)] + [(1, 0, 0), (None, 1, 0), (5, None, 0), (70_000, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    m = toxicity.fit(docs, labels)
    got = toxicity.judged(docs, m).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for r in got:
        want = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == want and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    unseen = [i for i in range(len(texts)) if by[i]["held_out"]]
    assert len(unseen) > 60 and np.mean([by[i]["predicted"] == y[i] for i in unseen]) > 0.95
    assert by[9001]["score"] == by[9002]["score"] and by[9003]["predicted"] == 1
    kept = toxicity.reject_toxic(docs, m)
    assert kept.columns == docs.columns
    flagged = {r["doc_id"] for r in got if r["flagged"]}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got} - flagged and len(flagged) > 200


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    assert m is None and {r["score"] for r in toxicity.judged(docs, m).collect()} == {0.0}
    assert toxicity.reject_toxic(docs, m).count() == 2
    one_class = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, one_class) is None
    some = toxicity.train(*corpus(60), epochs=1)
    assert toxicity.judged(docs.where("false"), some).count() == 0 and toxicity.reject_toxic(docs.where(F.lit(False)), some).count() == 0

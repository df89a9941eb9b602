"""The near-copy stage against all pairs, with planted copies at Jaccard 0.8 to 0.95."""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from eventloom.llm import near_copies  # noqa: E402


def plain_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def groups_of_all_pairs(texts):
    sets = plain_sets(texts)
    link = [[j for j, b in enumerate(sets) if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9] for a in sets]
    comp = list(range(len(texts)))
    for _ in texts:
        comp = [min(comp[j] for j in link[i]) for i in range(len(texts))]
    return comp, sets


def corpus(seed=11):
    """Texts and, for each base text, copies with 1 to 6 changed words; a passage that many texts share."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(words, 30))
    texts = []
    for i in range(25):
        base = [*rng.choice(words, int(rng.integers(20, 260))), *(passage if i % 2 else [])]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(int(rng.integers(1, 7))):
                copy[rng.integers(len(copy))] = f"x{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    order = rng.permutation(len(texts))  # a base need not be the first of its group
    return [texts[i] for i in order] + [None, "", "  ", "one two", "One  TWO", "one two three"]


def test_stage_equals_all_pairs(spark):
    texts = corpus()
    comp, sets = groups_of_all_pairs(texts)
    planted = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and a != b]
    assert sum(0.8 <= p < 0.9 for p in planted) >= 10 and sum(0.9 <= p < 1 for p in planted) >= 10
    assert sum(0.6 <= p < 0.8 for p in planted) >= 10
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_ string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, c in enumerate(comp) if i == c]
    assert {r["doc_id"]: r["group_id"] for r in near_copies.near_copy_groups(docs).collect()} == dict(enumerate(comp))


def test_rows_without_id_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (3, "A B C"), (3, "A B C"), (None, None)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in near_copies.keep_first(docs).collect()) == ["3", "3", "None", "None"]
    assert near_copies.keep_first(docs.where("false")).count() == 0

"""Near copies: the sets of documents that only share a rare shingle are not read again."""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from eventloom.llm import near_copies  # noqa: E402


def test_unlike_documents_with_a_common_shingle_are_not_verified(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(["a rare run of words", *(f"w{k}" for k in rng.integers(0, 5000, 200))]) for _ in range(30)]
    copy = texts[0].split()
    copy[100] = "changed"
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(copy)])), "doc_id long, text string")
    asked, real = set(), near_copies.whole_sets

    def seen(rows, wanted, size):
        asked.update(r["h"] for r in wanted.collect())
        return real(rows, wanted, size)

    monkeypatch.setattr(near_copies, "whole_sets", seen)
    got = {r["doc_id"]: r["group_id"] for r in near_copies.near_copy_groups(docs).collect()}
    assert got == {i: i % 30 for i in range(31)}
    assert len(asked) == 2


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(9)
    for n in (0, 1, 5, 100, 3000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate([a[n // 5 :], rng.integers(-(1 << 62), 1 << 62, n // 5)]))
        ones = int(np.bitwise_count((near_copies._parity(a) ^ near_copies._parity(b)).view(np.uint64)).sum())
        assert ones <= len(np.setxor1d(a, b))

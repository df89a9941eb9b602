"""Hard negatives, main text of pages and phrase collocations against plain versions, and their edge cases."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import collocations, hard_negatives, html_text, layouts

VECTORS = "vec_id long, embedding array<double>, label int, qb string, w string"


def _plain_negatives(rows, anchors, scale=256):
    usable = [(i, y, [math.floor(scale * x) for x in e]) for i, e, y in rows if i is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, y, w in sorted({(i, y, tuple(w)) for i, y, w in usable if anchors(i)}):
        scored = [(sum(p * q for p, q in zip(w, v)), i, z) for i, z, v in usable if i != a]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in scored if s[2] == y][:5]:
            for r, (ns, n, _) in enumerate([s for s in scored if s[2] != y and 30 * ps <= 100 * s[0] <= 90 * ps][:10], 1):
                out.append((a, p, r, n, ps, ns))
    return sorted(out)


def _got(spark, rows, anchors, **more):
    df = spark.createDataFrame([(i, e, y, "x", "y") for i, e, y in rows], VECTORS)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, anchors, **more).collect())


def test_products_are_exact_for_any_size():
    g = np.random.default_rng(1)
    for top, dims in ((3, 5), (200, 64), (1 << 20, 130), (1 << 29, 7), (1 << 61, 3)):
        a, b = g.integers(-top, top + 1, (7, dims)), g.integers(-top, top + 1, (9, dims))
        want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
        assert hard_negatives.exact_products(a, b).tolist() == want


def test_hard_negatives_equal_brute_force_in_many_tiles(spark):
    g = random.Random(4)
    base = [[g.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + g.gauss(0, 0.4) for x in base[g.randrange(4)]], g.randrange(3)) for i in range(300)]
    rows += [(300 + i, base[0], 1) for i in range(60)]  # ties
    rows += [(7, base[1], 2), (7, base[1], 2), (20, base[2], 0), (None, base[0], 1), (400, None, 1), (401, [1.0, None], 1), (402, [math.nan], 1), (403, [math.inf], 1), (404, base[0], None), (405, [], 1), (410, [2.0], 1)]
    want = _plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    got = _got(spark, rows, F.col("vec_id") % 10 == 0, anchor_block=8, stripe=50, least_tiles=1)
    assert got == want
    assert _got(spark, rows, F.col("vec_id") % 10 == 0) == want


def test_hard_negatives_without_rows_or_anchors(spark):
    assert _got(spark, [], F.col("vec_id") % 10 == 0) == []
    assert _got(spark, [(1, [1.0], 1), (2, [1.0], 2)], F.col("vec_id") % 10 == 0) == []
    assert _got(spark, [(10, [1.0], 1), (2, [1.0], 2)], F.col("vec_id") % 10 == 0) == []


def test_scores_past_64_bits_are_errors(spark):
    rows = [(10, [2.0**40, 1.0], 1), (11, [2.0**40, 1.0], 1), (12, [2.0**39, 1.0], 2)]
    with pytest.raises(Exception, match="64 bits"):
        _got(spark, rows, F.col("vec_id") == 10)


def _plain_phrases(docs, least=10, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    out = []
    cands = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for (lang, p), a in cands.items():
        if any(la == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for (la, q), b in cands.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(mine, 1)]
    return sorted(ranked)


def _phrases(spark, docs, **more):
    df = spark.createDataFrame([(i, t, la, "x") for i, (t, la) in enumerate(docs)], "doc_id long, text string, lang string, word string")
    return sorted(tuple(r) for r in collocations.collocations(df, **more).collect())


def _texts(seed, n):
    g = random.Random(seed)
    words = ["a", "b", "Tag", "tag", "Über", "x1", "y-z", "naïve", "　", "q q", "日本"]
    return [("".join(g.choice(words) + g.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(g.randrange(60))), g.choice(["en", "de", None, "und"])) for _ in range(n)]


def test_collocations_equal_plain_counts(spark):
    docs = _texts(3, 150) + [("no new phrase here " * 40, "en"), (None, "en"), ("", "fr"), (" . , ", "es"), ("Ab cD " * 30, None)]
    want = _plain_phrases(docs)
    assert len(want) > 100
    assert _phrases(spark, docs) == want
    assert _phrases(spark, docs, top=7) == _plain_phrases(docs, top=7)
    assert _phrases(spark, []) == []
    assert _phrases(spark, [(None, None)]) == []


def test_collocations_over_many_shards_and_levels(spark, monkeypatch):
    docs = _texts(5, 400)
    monkeypatch.setattr(collocations, "SHARD", 300)
    monkeypatch.setattr(collocations, "FAN_BITS", 2)
    assert _phrases(spark, docs) == _plain_phrases(docs)


@pytest.mark.parametrize("bits", [2, 3, 17, 21, 22, 33, 42])
def test_filters_give_back_what_was_put_in(bits):
    p, g = collocations.Packing(bits), np.random.default_rng(bits)
    ids = [g.integers(0, 1 << bits, 500) for _ in range(3)]
    x, y = p.packed(*ids)
    assert all((a == b).all() for a, b in zip(p.unpacked(x, y), ids))
    assert int(x.max()) < 1 << p.left and int(y.max()) < 1 << p.right
    n = g.choice([1, 2, 254, 255, 256, 1 << 40], 500)
    x, y, n = p.counted(x, y, n)
    skip = min(3, p.left)
    back = [collocations.from_filter(p, skip, b, f) for b, f in collocations._split(p, skip, x, y, n)]
    assert all((np.concatenate(c) == d).all() for c, d in zip(zip(*back), (x, y, n)))


def _cut(page):
    return [b.text for b in html_text.blocks(page)]


def test_blocks_of_pages():
    assert _cut("") == [] and _cut("plain &lt;text  here") == ["plain <text here"]
    page = '<head><title>t</title></head><!-- <p>no --><p><b>One &amp; <i>tw</i>o<br>lines<p>Next<script>var t="</p><p>x";</script> one</p></p><STYLE>p{}</STYLE><ul><li>a<li>b &nbsp; c</ul> 3 < 4 <p hidden>gone</p>end'
    assert _cut(page) == ["One & two lines", "Next one", "a", "b c", "3 < 4", "end"] or _cut(page) == ["One & two lines", "Next", "one", "a", "b c", "3 < 4", "end"]
    paths = {b.text: b.path for b in html_text.blocks('<div class="ad"><p>x</div><article><p>y')}
    assert ".ad" in paths["x"] and "article" in paths["y"] and ".ad" not in paths["y"]
    assert _cut("<p title='a>b'>q</p><p title=\"un>r</p>") != []
    assert _cut("<script>never closed <p>x</p>") == []


@pytest.fixture(scope="module")
def model(spark):
    return html_text.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), layouts=1200)


def test_labels_of_unseen_layouts(spark, model):
    texts = [b.text for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(100).collect() for b in html_text.blocks(r["html"])]
    g, memo = np.random.default_rng(77), {}
    made = [p for p in (layouts.page(g, layouts.sentences(texts)) for _ in range(300)) if p[0]]
    got = html_text.scores(model, [html_text.features(b, memo) for b, _ in made])
    wrong = sum(int(((s >= 0.5) != y).sum()) for s, (_, y) in zip(got, made))
    assert wrong < 0.02 * sum(len(y) for _, y in made)


def test_text_of_pages_equals_their_articles(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: "\n\n".join(b.text for b in html_text.blocks(r["html"]) if "article" in b.path) for r in pages.collect()}
    got = html_text.extract_text(pages, model).collect()
    assert sum(r["text"] == want[r["page_id"]] for r in got) >= 0.98 * len(want) and len(got) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_text_of_odd_pages(spark, model):
    long = "<article><h1>Title here.</h1>" + "<p>The town opened a new bridge, and many people came to see it.</p>" * 20000 + "</article><footer>&copy; 2024 All rights reserved</footer>"
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "u", "<nav><a href=/>Home</a></nav>", "x"), (None, "u", "<p", "x"), (4, "u", long, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract_text(df, model).collect()}
    assert got[1]["text"] == "" and got[1]["n_chars"] == 0 and got[2]["text"] == "" and got[3]["text"] == ""
    assert got[4]["text"].count("\n\n") == 20000 and "rights" not in got[4]["text"]
    empty = df.where("false")
    assert html_text.extract_text(empty, model).count() == 0


def test_dense_tiles_keep_no_pairs():
    """2,048 vectors that all link with each other: roots and counts slice by slice, in bounded memory."""
    import tracemalloc

    from eventloom.llm import embed_dedup

    x = np.ones((2048, 64)) + np.random.default_rng(0).normal(0, 0.01, (2048, 64))
    tracemalloc.start()
    links, root = 0, np.arange(2048)
    for i, j in embed_dedup.similar_in_slices(x, x, np.eye(64), 0.9):
        links += len(i)
        root = embed_dedup._roots(root, i, j)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == 2048 * 2048 and not root.any() and peak < 150e6


@pytest.mark.parametrize("n,m", [(50, 30), (200, 150), (300, 600)])
def test_roots_of_links_in_parts(n, m):
    from eventloom.llm import embed_dedup

    g = np.random.default_rng(n)
    i, j = g.integers(0, n, m), g.integers(0, n, m)
    label = np.arange(n)
    for k in range(0, m, 7):
        label = embed_dedup._roots(label, i[k : k + 7], j[k : k + 7])
    want = list(range(n))
    for _ in range(n):
        for a, b in zip(i, j):
            want[a] = want[b] = min(want[a], want[b])
    assert label.tolist() == want

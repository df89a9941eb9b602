"""Each stage of the pipeline, and the whole run, against a plain version over a small folder of tables."""

import os
import re
import struct
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from eventloom.llm import toxicity  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = "token: abcdef123456"
RULES = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""",
    r"AKIA[A-Z0-9]{16,}",
    r"[0-9a-f]{24,}",
)


def rows():
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(500)]
    out = []
    for i in range(160):
        lines = [" ".join(rng.choice(words, int(rng.integers(6, 20)))) for _ in range(int(rng.integers(1, 6)))]
        if i % 2:
            k = int(rng.integers(len(lines)))
            lines[k] = f"{lines[k]} idiotisch"
        if i % 8 == 0:
            lines.append("all rights reserved by the authors of this collection of texts")
        if i % 10 == 0:
            lines.append(f"{SECRET}{i}")
        out.append("\n".join(lines))
    whole = " ".join(rng.choice(words, 200))
    changed = whole.split()
    changed[100] = "changed"
    out += [whole, " ".join(changed), whole.upper(), None, "", "long " * 9000]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def plain_lines(docs):
    """{doc_id: text} without the lines that match an earlier line, kept or not."""
    seen, exact, out = [], set(), {}
    for i, text in sorted(docs.items()):
        if text is None:
            out[i] = None
            continue
        left = []
        for line in text.split("\n"):
            a = set(line.lower().split())
            gone = bool(a) and (line in exact or any(len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in seen))
            if a:
                seen.append(a)
                exact.add(line)
            if not gone:
                left.append(line)
        out[i] = "\n".join(left)
    return out


def plain_near(docs):
    """Ids of the first document of each group of near copies."""
    sets = {}
    for i, t in docs.items():
        w = (t or "").lower().split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    link = {i: [j for j, b in sets.items() if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9] for i, a in sets.items()}
    for _ in range(5):
        comp = {i: min(comp[j] for j in link[i]) for i in sets}
    return {i for i in sets if comp[i] == i}


def plain_masked(text):
    if text is None:
        return None
    spans = sorted((m.start(), m.end()) for r in RULES for m in re.finditer(r, text))
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out.append(text[at:a] + "[SECRET]")
        at = max(at, b)
    return "".join(out) + text[at:]


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_and_run_equal_a_plain_version(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = texts_of(docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "secrets", "packing"]
    steps = dict(corpus_pipeline.STAGES)

    kept = steps["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns
    m = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = dict(zip(given, toxicity.score_texts(m, list(given.values()), {})))
    want = {i: t for i, t in given.items() if scores[i] < m.thresholds.get("en", m.general)}
    assert texts_of(kept) == want
    assert not any("idiotisch" in (t or "") for t in want.values()) and len(want) >= 80

    lined = steps["line_dedup"](spark, spark.createDataFrame(kept.collect(), COLUMNS), folder)
    want = plain_lines(want)
    assert texts_of(lined) == want and lined.columns == docs.columns
    assert sum("all rights reserved" in (t or "") for t in want.values()) == 1

    first = steps["simhash"](spark, spark.createDataFrame(lined.collect(), COLUMNS), folder)
    want = {i: want[i] for i in plain_near(want)}
    assert texts_of(first) == want and first.columns == docs.columns

    masked = steps["secrets"](spark, spark.createDataFrame(first.collect(), COLUMNS), folder)
    want = {i: plain_masked(t) for i, t in want.items()}
    assert texts_of(masked) == want and masked.columns == docs.columns
    assert not any(SECRET in (t or "") for t in want.values()) and any("[SECRET]" in (t or "") for t in want.values())

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(want)
    for i, t in want.items():
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)


def test_two_runs_do_not_share_folders(spark, folder):
    a, b = corpus_pipeline.run(spark, folder), corpus_pipeline.run(spark, folder)
    assert a.count() == b.count() > 0


def test_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

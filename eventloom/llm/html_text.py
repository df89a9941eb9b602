"""Main text of web pages by a recurrent labeller of their blocks.

A page is cut into leaf blocks: runs of text that no block-level tag interrupts; inline
tags and line breaks stay inside a block. Scripts, styles, comments, the head and other
elements that are never shown as text carry no block. A two-way LSTM in numpy reads the blocks in page order. Its input is
the sum of trained vectors of hashed tag-path features (tags, words of class, id and
role, inner ones apart), the mean of trained vectors of the block's hashed words, and a
few numbers (length, share of link text, punctuation, capitals, digits). Every block so gets its
label from the whole page. Kept blocks are joined by an empty line.

The model is trained here: one task takes a bounded sample of pages (``MAX_PAGES`` with up to
``MAX_CHARS`` characters, those with the smallest hashes), cuts their text into sentences and sets
these into random layouts, whose labels are known by construction: the lists below name the usual
tags and class words of each part of a page. So no mark on the pages themselves is taken as a
label, and words, order and shape count where tags say nothing. Pages are labelled in full, whatever their length.

Nulls: a null html is an empty page: text "" and n_chars 0. Rows that repeat a page_id are kept, one result each. Tags that
are never closed, stray closing tags and unknown tags are allowed; a ``<`` that opens no tag is text. Ties (a score of exactly the
threshold) are kept. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample.
MAX_PAGES, MAX_CHARS = 300, 1 << 16
TAG_ROWS, WORD_ROWS, DIM, HIDDEN, NUMBERS = 1 << 14, 1 << 14, 16, 24, 8

# HTML's elements by kind.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input label nobr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN_PARTS = frozenset("head script style noscript template svg math canvas object audio video select datalist button textarea title xmp iframe noembed noframes".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An open element that an implied end must not leave.
FENCES = frozenset("ul ol dl table tr td th article section aside main nav div body".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+>", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN_STYLE = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: float):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order: one-spaced text, tag-path features, share of link text."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked, in_link, hidden = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            raw = entities.unescape("".join(held))
            text = " ".join(raw.split())
            if text and not hidden:
                path: list[str] = []
                for depth, (_, names) in enumerate(reversed(stack)):
                    path += [f"0{n}" for n in names] if depth == 0 else [f"1{n}" for n in names] if depth < 3 else []
                    path += names
                out.append(Block(text, tuple(path), min(1.0, linked / len(text))))
            held.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal hidden
        hidden -= sum("" in names for _, names in stack[at:])
        del stack[at:]

    def implied(names: frozenset[str] | set[str], fences: frozenset[str]) -> None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in names:
                close(at)
            elif stack[at][0] in fences:
                return

    pos = 0
    while m := _TOKEN.search(page, pos):
        if m.start() > pos:
            held.append(page[pos : m.start()])
            if in_link:
                linked += m.start() - pos
        pos = m.end()
        slash, name, rest = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                held.append("\n")
            elif name == "a":
                in_link = 0 if slash else 1
            continue
        flush()
        in_link = 0
        if slash:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if at >= 0:
                close(at)
            continue
        if name in CLOSES_P:
            implied({"p"}, FENCES)
        if name in SIBLINGS:
            implied(SIBLINGS[name], FENCES - SIBLINGS[name] - ({"tr"} if name == "tr" else set()))
        if name == "body":
            implied({"head"}, frozenset())
        if name in RAW:
            end = re.compile(rf"</{name}\s*+>", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if name in VOID or rest.endswith("/") and name not in FENCES | CLOSES_P:
            continue
        names = [name]
        for v in _NAMES.findall(rest):
            names += ["." + w.lower() for w in _PART.findall(v[0] or v[1] or v[2])]
        if name in HIDDEN_PARTS or _HIDDEN_STYLE.search(rest):
            names.append("")
            hidden += 1
        stack.append((name, tuple(names)))
    held.append(page[pos:])
    flush()
    return out


def _hash(s: str, rows: int) -> int:
    return 1 + zlib.crc32(s.encode("utf-8", "surrogatepass")) % (rows - 1)


def features(found: list[Block], memo: dict[str, int]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(tag rows, word rows, numbers) of a page's blocks; ``memo`` keeps hashes from call to call."""
    tags, words = [], []
    numbers = np.zeros((len(found), NUMBERS), np.float32)
    if len(memo) > 1 << 18:
        memo.clear()
    for i, b in enumerate(found):
        tags.append(np.array([memo.get("<" + t) or memo.setdefault("<" + t, _hash(t, TAG_ROWS)) for t in b.path] or [0], np.int32))
        w = b.text.lower().split(" ")
        words.append(np.array([memo.get(x) or memo.setdefault(x, _hash(x, WORD_ROWS)) for x in w], np.int32))
        n = len(b.text)
        marks = sum(map(b.text.count, ".,;:!?"))
        numbers[i] = (
            min(np.log1p(n) / 6, 2),
            b.linked,
            min(1, 8 * marks / n),
            b.text[-1] in ".!?:",
            min(1, 4 * sum(1 for x in w[:200] if x[:1].isdigit()) / min(200, len(w))),
            b.text[:1].isupper(),
            i / len(found),
            min(np.log1p(len(found)) / 6, 2),
        )
    return tags, words, numbers


class Model:
    """Parameters by name; see the head of the module."""

    def __init__(self, seed: int = 5):
        g = np.random.default_rng(seed)
        size = 2 * DIM + NUMBERS
        self.p: dict[str, np.ndarray] = {
            "tags": g.normal(0, 0.1, (TAG_ROWS, DIM)),
            "words": g.normal(0, 0.02, (WORD_ROWS, DIM)),
            "out": g.normal(0, 0.2, (2 * HIDDEN + size, 1)),
            "bias": np.zeros(1),
        }
        for d in "fb":
            self.p["x" + d] = g.normal(0, size**-0.5, (size, 4 * HIDDEN))
            self.p["h" + d] = g.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            self.p["b" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}


def _weights(rows: list[np.ndarray], kind: int) -> np.ndarray:
    """Tag-path features are added up, so a mark counts alike at any depth; words are averaged."""
    return np.full((len(rows), 1), 0.3, np.float32) if kind == 0 else 1 / np.array([[len(r)] for r in rows], np.float32)


def _summed(table: np.ndarray, rows: list[np.ndarray], kind: int) -> np.ndarray:
    starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
    return np.add.reduceat(table[np.concatenate(rows)], starts) * _weights(rows, kind)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states of (time, page, feature) input; padding passes states on."""
    steps, rows = x.shape[:2]
    h = c = np.zeros((rows, HIDDEN), np.float32)
    out, trace = np.empty((steps, rows, HIDDEN), np.float32), []
    xs = x @ w + b
    for t in range(steps):
        z = xs[t] + h @ u
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        tc = np.tanh(new)
        m = mask[t][:, None]
        if keep:
            trace.append((h, c, i, f, o, g, tc))
        c = m * new + (1 - m) * c
        h = m * (o * tc) + (1 - m) * h
        out[t] = h
    return out, trace


def _lstm_back(d_out: np.ndarray, x: np.ndarray, w: np.ndarray, u: np.ndarray, mask: np.ndarray, trace: list) -> tuple[np.ndarray, ...]:
    steps, rows = x.shape[:2]
    dh = dc = np.zeros((rows, HIDDEN), np.float32)
    dz_all = np.empty((steps, rows, 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc = trace[t]
        m = mask[t][:, None]
        dh = dh + d_out[t]
        inner = m * dh
        d_new = m * dc + inner * o * (1 - tc * tc)
        dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), inner * tc * o * (1 - o), d_new * i * (1 - g * g)], 1)
        dz_all[t] = dz
        du += h.T @ dz
        dc = d_new * f + (1 - m) * dc
        dh = dz @ u.T + (1 - m) * dh
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return dz_all @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, parts))
    x = np.zeros((steps, len(parts), parts[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(parts)), np.float32)
    for k, p in enumerate(parts):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def _inputs(m: Model, pages: list[tuple]) -> list[np.ndarray]:
    """One input matrix a page, the vectors of all pages averaged at once."""
    every = lambda k: [r for p in pages for r in p[k]]
    flat = np.concatenate([_summed(m.p["tags"], every(0), 0), _summed(m.p["words"], every(1), 1), np.concatenate([p[2] for p in pages])], 1)
    return np.split(flat, np.cumsum([len(p[2]) for p in pages])[:-1])


def _forward(m: Model, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
    p = m.p
    hf, tf = _lstm(x, p["xf"], p["hf"], p["bf"], mask, keep)
    hb, tb = _lstm(x[::-1], p["xb"], p["hb"], p["bb"], mask[::-1], keep)
    joint = np.concatenate([hf, hb[::-1], x], 2)
    return (joint @ p["out"])[:, :, 0] + p["bias"], joint, tf, tb


def scores(m: Model, pages: list[tuple]) -> list[np.ndarray]:
    """The score of each block of each page; pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i][2])) if len(pages[i][2])]
    for at in range(0, len(order), 64):
        mine = order[at : at + 64]
        x, mask = _padded(_inputs(m, [pages[i] for i in mine]))
        z = _forward(m, x, mask)[0]
        for k, i in enumerate(mine):
            out[i] = _sigmoid(z[: len(pages[i][2]), k])
    return out


def train(pages: list[tuple], labels: list[np.ndarray], epochs: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Model:
    """Adam on the mean cross entropy of blocks; path features and words are left out at random.

    Word vectors move slowly, so that words count where many pages agree on them and are not learnt by heart.
    """
    m, g = Model(), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in m.p.items()}
    second = {k: np.zeros_like(v) for k, v in m.p.items()}
    step, total = 0, epochs * -(-len(pages) // batch)
    for _ in range(epochs):
        order = g.permutation(len(pages))
        for at in range(0, len(order), batch):
            mine = order[at : at + batch]
            some = [_thinned(pages[i], g) for i in mine]
            x, mask = _padded(_inputs(m, some))
            y, _m = _padded([labels[i][:, None].astype(np.float32) for i in mine])
            z, joint, tf, tb = _forward(m, x, mask, True)
            dz = ((_sigmoid(z) - y[:, :, 0]) * mask / mask.sum()).astype(np.float32)
            grad = {"out": (joint.reshape(-1, joint.shape[2]).T @ dz.reshape(-1, 1)), "bias": dz.sum(keepdims=True)[0]}
            d_joint = dz[:, :, None] * m.p["out"][:, 0]
            dx = d_joint[:, :, 2 * HIDDEN :].copy()
            da, grad["xf"], grad["hf"], grad["bf"] = _lstm_back(d_joint[:, :, :HIDDEN], x, m.p["xf"], m.p["hf"], mask, tf)
            db, grad["xb"], grad["hb"], grad["bb"] = _lstm_back(d_joint[::-1, :, HIDDEN : 2 * HIDDEN], x[::-1], m.p["xb"], m.p["hb"], mask[::-1], tb)
            dx += da + db[::-1]
            for k, (name, lo) in enumerate((("tags", 0), ("words", DIM))):
                grad[name] = np.zeros_like(m.p[name])
                for j, page in enumerate(some):
                    n = np.array([len(r) for r in page[k]])
                    np.add.at(grad[name], np.concatenate(page[k]), np.repeat(dx[: len(n), j, lo : lo + DIM] * _weights(page[k], k), n, axis=0))
            step += 1
            now = rate * (1 - 0.9 * step / total)
            for name, d in grad.items():
                first[name] += 0.1 * (d - first[name])
                second[name] += 0.01 * (d * d - second[name])
                m.p[name] -= (now * (0.1 if name == "words" else 1) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return m


def _thinned(page: tuple, g: np.random.Generator) -> tuple:
    """Some path features and words left out; now and then all of one kind on the page."""
    tags, words, numbers = page
    drop = g.choice([0.1, 0.3, 0.9], p=[0.6, 0.3, 0.1])
    thin = lambda rows, p: [np.where(g.random(len(r)) < p, 0, r) for r in rows]
    return thin(tags, drop), thin(words, g.choice([0.4, 0.95])), numbers


def fit(pages: DataFrame, rows: int = MAX_PAGES, chars: int = MAX_CHARS, layouts: int = 2000) -> Model:
    """Train on layouts of the sampled pages' sentences; one task trains, whatever the table's size."""
    from . import layouts as made

    some = pages.where(F.col("html").isNotNull() & (F.length("html") <= chars)).select("html")
    some = some.orderBy(F.xxhash64("html"), "html").limit(rows).repartition(1).sortWithinPartitions(F.xxhash64("html"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [b.text for batch in batches for page in batch.column(0).to_pylist() for b in blocks(page)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained(made.sentences(texts), layouts))], pa.binary())], names=["model"])

    got = some.mapInArrow(run, "model binary").collect()  # one row of fixed size; none where there is no page
    return pickle.loads(bytes(got[0]["model"])) if got else trained(made.sentences([]), layouts)


def trained(sentences: list[str], layouts: int, seed: int = 3) -> Model:
    """A model trained on so many random layouts of the sentences."""
    from . import layouts as made

    g, memo = np.random.default_rng(seed), {}
    pages, labels = [], []
    for _ in range(layouts):
        found, label = made.page(g, sentences)
        if found:
            pages.append(features(found, memo))
            labels.append(label)
    return train(pages, labels)


def extract_text(pages: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                found = [blocks(p or "") for p in part.column(2).to_pylist()]
                kept = scores(model, [features(f, memo) for f in found])
                texts = ["\n\n".join(b.text for b, s in zip(f, k) if s >= threshold) for f, k in zip(found, kept)]
                cols = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")

"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the embeddings of its hashed forms (the word and its
prefixes), so inflected words share what they have in common. Filters of widths 1 to 3
slide over the words, each filter is max-pooled over the whole text, and a logistic
layer gives the score. Every labelled row that may be learnt is: the rows are dealt by the
hash of their id to shards of about ``SHARD`` rows and coded once. Word statistics are counted
over all shards; then, in each round, one task a shard takes the common model some epochs on, in numpy, and the
models are averaged (each embedding over the shards that moved it). The driver only ever holds the
model, whose size the hash space bounds; texts are scored in Arrow batches where they are.
Every fifth row of a shard is left out of the word statistics and of the steps; the
score's scale and the thresholds by language are calibrated on all of those rows, whose logits
are counted in steps of 1/``STEPS``.

The score depends on the text alone. Nulls: a null text counts as empty and is scored
like an empty one; a null language takes the general threshold; a null ``doc_id`` is
never labelled nor held out. A label given more than once counts as toxic if any is.
Repeated rows are each scored; extra columns are ignored by :func:`score` and kept by
:func:`reject_toxic`. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import cut

#: Labelled rows of a shard, about; rounds of averaging, and epochs of each.
SHARD, ROUNDS, EPOCHS = 5000, 3, 3
#: Hash space of word forms, which bounds the model; only forms in at least MIN_DOCS fitted texts get an embedding.
SPACE, MIN_DOCS = 1 << 20, 4
PREFIXES = (4, 5, 6)
DIM, FILTERS, WIDTHS = 8, 6, (1, 2, 3)
CUT = 0.3
STEPS = 1024
#: Bits of an id's hash that index the filter of labelled ids.
FILTER = 24
#: Parameters travel as whole numbers of this size's inverse, so that their sums do not depend on the order.
_UNIT = 1 << 24
MEMO, CHARS = 300_000, 2_000_000
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", text or "").lower())


def forms(word: str) -> list[int]:
    """Hashes of the word and of its proper prefixes."""
    h = xxhash.xxh3_64_intdigest
    out = [h(word.encode("utf-8", "surrogatepass"), 0) % SPACE]
    out += [h(word[:n].encode("utf-8", "surrogatepass"), n) % SPACE if len(word) > n else -1 for n in PREFIXES]
    return out


@dataclass
class Model:
    """The form with hash ``keys[i]`` (sorted) has row i + 1 of ``emb`` (row 0 is zero); filter width w has taps ``conv[w]`` (w, DIM, FILTERS)."""

    keys: np.ndarray
    emb: np.ndarray
    conv: dict[int, np.ndarray]
    bias: np.ndarray
    head: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    general: float = CUT

    def known(self, word: str) -> list[int]:
        return self.rows_of(np.array(forms(word))).tolist()

    def rows_of(self, own: np.ndarray) -> np.ndarray:
        """Rows of ``emb`` of an array of hashes, 0 for those without one."""
        if not len(self.keys):
            return np.zeros(own.shape, np.int32)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return np.where(self.keys[at] == own, at + 1, 0).astype(np.int32)


def _windows(v: np.ndarray, conv: dict[int, np.ndarray]) -> np.ndarray:
    """(positions, filters): every filter at every position of the padded word vectors."""
    n = len(v) - max(WIDTHS) + 1
    return np.concatenate([sum(v[j : j + n] @ taps[j] for j in range(w)) for w, taps in conv.items()], axis=1)


def _pooled(v: np.ndarray, starts: np.ndarray, conv: dict[int, np.ndarray]) -> np.ndarray:
    """Max over each text's own places; ``v`` holds the texts in a row, each followed by padding, ``starts`` where they begin.

    Windows that begin in the padding reach into the next text and count for none.
    """
    out = _windows(v, conv)
    edges = np.column_stack([starts, np.append(starts[1:] - (max(WIDTHS) - 1), len(out))]).ravel()[:-1]
    return np.maximum.reduceat(out, edges, axis=0)[::2]


def _layout(texts: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, texts in a row with padding between; where each text begins)."""
    gap = np.full(max(WIDTHS) - 1, pad, np.int32)
    parts, starts, at = [], [], 0
    for t in texts:
        starts.append(at)
        body = t if len(t) else gap[:1]
        parts += [body, gap]
        at += len(body) + len(gap)
    return np.concatenate(parts), np.array(starts)


def coded(texts: Iterable[str | None]) -> tuple[list[np.ndarray], list[str]]:
    """Each text as an array of word numbers, and the words; no text is kept."""
    place: dict[str, int] = {}
    out = []
    for t in texts:
        found = words(t)
        out.append(np.fromiter((place.setdefault(w, len(place)) for w in found), np.int32, len(found)))
    return out, list(place)


def left_out(n: int) -> np.ndarray:
    """Which rows of a training sample only calibrate."""
    return np.arange(n) % 5 == 0


def train(texts: Iterable[str | None], labels: np.ndarray, epochs: int = 9, seed: int = 7, prior: bool = True) -> Model:
    """Fit the network in this process; the rows of :func:`left_out` give no word statistics and no steps, and set the score's scale.

    With ``prior`` the first axis of a form's embedding starts as its log odds in the fitted rows, else all start at random.
    """
    numbers, vocabulary = coded(texts)
    labels, own = np.asarray(labels, np.int64), _forms_of(vocabulary)
    keys, counts = _form_counts(numbers, own, labels)
    m = _start(keys, counts, np.bincount(labels[~left_out(len(labels))], minlength=2), seed, prior)
    _epochs(m, _fresh(m), numbers, own, labels, epochs, np.random.default_rng([seed, 0]))
    rest = np.flatnonzero(left_out(len(labels)))
    m.scale, m.shift = _scaled(logits(m, [numbers[i] for i in rest], own), labels[rest], np.ones(len(rest)))
    return m


def _forms_of(vocabulary: list[str]) -> np.ndarray:
    """(words, forms of a word): their hashes, -1 for none."""
    return np.array([forms(w) for w in vocabulary], np.int32).reshape(-1, 1 + len(PREFIXES))


def _form_counts(numbers: list[np.ndarray], own: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the fitted rows' forms, sorted; (2, hashes): in how many rows of either class)."""
    counts = np.zeros((2, SPACE), np.int64)
    for i in np.flatnonzero(~left_out(len(numbers))):
        mine = np.unique(own[np.unique(numbers[i])])
        counts[labels[i], mine[mine >= 0]] += 1
    keys = np.flatnonzero(counts.sum(0))
    return keys, counts[:, keys]


def _start(keys: np.ndarray, counts: np.ndarray, totals: np.ndarray, seed: int, prior: bool = True) -> Model:
    """The model before any step; forms in fewer than MIN_DOCS rows are left out, ``totals`` are the fitted rows of either class."""
    rng = np.random.default_rng(seed)
    often = counts.sum(0) >= MIN_DOCS
    keys, counts = keys[often], counts[:, often]
    emb = np.zeros((len(keys) + 1, DIM), np.float32)
    emb[1:] = rng.normal(0, 0.01, (len(keys), DIM))
    if prior:
        rate = (counts + 0.5) / (totals + 2.0)[:, None]
        emb[1:, 0] = np.clip(np.log(rate[1]) - np.log(rate[0]), -2, 4) / 4
    conv = {w: rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        conv[w][:, 0, :2] += 1.0 / w
    width = FILTERS * len(WIDTHS)
    return Model(keys, emb, conv, np.zeros(width, np.float32), rng.normal(0, 0.1, width).astype(np.float32) + np.float32(0.2), -1.0)


def _fresh(m: Model) -> dict[str, np.ndarray]:
    """Sums of squared gradients before any step: of the embeddings, and of all else in a row."""
    return {"emb": np.full(m.emb.shape, 1e-6, np.float32), "rest": np.full(len(_rest(m)), 1e-6, np.float32)}


def _rest(m: Model) -> np.ndarray:
    """All parameters but the embeddings in a row."""
    return np.concatenate([*[m.conv[w].ravel() for w in WIDTHS], m.bias, m.head, [m.offset]]).astype(np.float32)


def _set_rest(m: Model, flat: np.ndarray) -> None:
    shapes = [*[m.conv[w].shape for w in WIDTHS], m.bias.shape, m.head.shape]
    parts = np.split(flat.astype(np.float32), np.cumsum([int(np.prod(x)) for x in shapes]))
    m.conv = {w: parts[k].reshape(shapes[k]) for k, w in enumerate(WIDTHS)}
    m.bias, m.head, m.offset = parts[-3], parts[-2], float(parts[-1][0])


def _epochs(m: Model, sums: dict[str, np.ndarray], numbers: list[np.ndarray], own: np.ndarray, labels: np.ndarray, epochs: int, rng: np.random.Generator) -> np.ndarray:
    """Take ``m`` and ``sums`` some epochs on; the rows of ``emb`` that moved."""
    fit = np.flatnonzero(~left_out(len(numbers)))
    known = m.rows_of(np.concatenate([own, np.full((1, own.shape[1]), -1, own.dtype)]))  # the last word is the padding
    moved = np.zeros(len(m.emb), bool)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)) if len(fit) else ():
            flat, starts = _layout([numbers[i] for i in batch], len(own))
            held, place = np.unique(flat, return_inverse=True)
            v = m.emb[known[held]].sum(1)[place]
            out = _windows(v, m.conv) + m.bias
            ends = np.append(starts[1:], len(flat))
            best = np.stack([s + out[s : max(s + 1, e - max(WIDTHS) + 1)].argmax(0) for s, e in zip(starts, ends)])
            top = np.take_along_axis(out, best, 0)
            act = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ m.head + m.offset, -30, 30)))
            err = (p - labels[batch]).astype(np.float32) / len(batch)
            d_act = np.outer(err, m.head) * (top > 0)
            grads, at, d_v = [], [np.zeros(0, np.int64)], [np.zeros((0, DIM), np.float32)]
            for k, w in enumerate(WIDTHS):
                taps = m.conv[w]
                g = np.zeros_like(taps)
                for q in range(FILTERS):
                    c = k * FILTERS + q
                    live = np.flatnonzero(d_act[:, c])
                    e = d_act[live, c]
                    for j in range(w):
                        at.append(best[live, c] + j)
                        g[j, :, q] = e @ v[at[-1]]
                        d_v.append(np.outer(e, taps[j, :, q]))
                grads.append((g + 1e-4 * taps).ravel())
            grad = np.concatenate([*grads, d_act.sum(0), act.T @ err + 1e-4 * m.head, [err.sum()]]).astype(np.float32)
            sums["rest"] += grad**2
            _set_rest(m, _rest(m) - 0.05 * grad / np.sqrt(sums["rest"]))
            touched = known[flat[np.concatenate(at)]]
            hit, where = np.unique(touched.ravel(), return_inverse=True)
            total = np.zeros((len(hit), DIM), np.float32)
            np.add.at(total, where.ravel(), np.repeat(np.concatenate(d_v), touched.shape[1], 0).astype(np.float32))
            real = hit > 0
            hit, total = hit[real], total[real] + 1e-4 * m.emb[hit[real]]
            sums["emb"][hit] += total**2
            m.emb[hit] -= 0.02 * total / np.sqrt(sums["emb"][hit])
            moved[hit] = True
    return np.flatnonzero(moved)


def _scaled(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the labels on the logits, of which each counts ``n`` times, lightly damped, by Newton steps."""
    a = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (n * (p - y)) + 0.1 * (a - [1.0, 0.0])
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        a = a - np.linalg.solve(h, g)
    return (float(a[0]), float(a[1])) if a[0] > 0.1 else (1.0, 0.0)


def logits(m: Model, texts: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """One for each text of word numbers; ``own`` holds the words' forms."""
    table = np.concatenate([m.emb[m.rows_of(own)].sum(1), np.zeros((1, DIM), np.float32)])
    out = []
    for t in texts:
        flat, starts = _layout([t], len(own))
        top = _pooled(table[flat], starts, m.conv) + m.bias
        out.append(np.maximum(top, 0) @ m.head + m.offset)
    return np.concatenate(out) if out else np.zeros(0)


def calibrate(m: Model, scores: np.ndarray, labels: np.ndarray, langs: list[str | None], n: np.ndarray, least: int = 30) -> None:
    """Each language's threshold: the one that errs least on its rows (each counts ``n`` times); ``CUT`` if that does, else halfway between scores."""

    def best(s: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
        s, place = np.unique(s, return_inverse=True)
        clean, toxic = (np.bincount(place, n * (y == c), len(s)) for c in (0, 1))
        errors = np.concatenate([[clean.sum()], clean.sum() + np.cumsum(toxic - clean)])
        k = np.flatnonzero(errors == errors.min())
        low, high = np.append(0.0, s)[k], np.append(s, 1.0)[k]
        if ((low < CUT) & (CUT <= high)).any():
            return CUT
        return float(np.clip(min((low + high) / 2, key=lambda t: abs(t - CUT)), 0.1, 0.9))

    if len(scores) and labels.any():
        m.general = best(scores, labels, n)
    of = np.array(langs, object)
    for lang in sorted({x for x in langs if x}):
        mine = of == lang
        if (n * labels)[mine].sum() >= least and (n * (1 - labels))[mine].sum() >= least:
            m.thresholds[lang] = best(scores[mine], labels[mine], n[mine])


def held_out(doc_id: Column) -> Column:
    """Whether a row's label may never be learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def marks_of(labels: DataFrame) -> DataFrame:
    """(id_, toxic) of every label that may be learnt; ids as text, toxic if any label of the id is."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("string").alias("id_"))
    return known.agg((F.max("toxic") == 1).cast("int").alias("toxic")).where(~held_out(F.col("id_")))


def _maybe_marked(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of ``texts`` whose ``id_`` may be in ``marks``: one bit for each value of its hash's low ``FILTER`` bits; spares the others the shuffle."""
    low = F.xxhash64("id_").bitwiseAND(F.lit((1 << FILTER) - 1).cast("long"))
    word, one = F.shiftright(low, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    table = marks.groupBy(word.alias("at_")).agg(F.bit_or(one).alias("bits_"))
    return texts.join(F.broadcast(table), (word == F.col("at_")) & (F.col("bits_").bitwiseAND(one) != 0), "left_semi")


def _batch(shard: int, toxic: list[int], langs: list[str | None], parts: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    numbers = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32)))
    cols = [pa.array([shard] * len(parts), pa.int32()), pa.array(toxic, pa.int32()), pa.array(langs, pa.string()), numbers]
    return pa.RecordBatch.from_arrays(cols, names=["shard", "toxic", "lang", "numbers"])


def shards_of(docs: DataFrame, marks: DataFrame, shards: int) -> DataFrame:
    """(shard, toxic, lang, numbers) of all marked texts as word numbers; a shard ends with its words' forms (toxic -1).

    A shard lies in one partition, in one order whatever the partitions before; of a repeated id the least text counts.
    A mark stands before the texts of its id, so texts are shuffled once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, y, place = None, None, 0, {}
        toxic, langs, parts, held = [], [], [], 0

        def end() -> pa.RecordBatch:
            return _batch(shard, [*toxic, -1], [*langs, None], [*parts, _forms_of(list(place)).ravel()])

        for b in batches:
            for at, key, mark, text, lang in zip(*(c.to_pylist() for c in b.columns)):
                if at != shard:
                    if shard is not None:
                        yield end()
                    shard, last, place = at, None, {}
                    toxic, langs, parts, held = [], [], [], 0
                if mark is not None:
                    last, y = key, mark
                    continue
                if key != last:
                    continue
                last = None
                found = words(text)
                parts.append(np.fromiter((place.setdefault(w, len(place)) for w in found), np.int32, len(found)))
                toxic.append(y)
                langs.append(lang)
                held += len(found)
                if held >= CHARS:
                    yield _batch(shard, toxic, langs, parts)
                    toxic, langs, parts, held = [], [], [], 0
        if shard is not None:
            yield end()

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.select(F.col("doc_id").cast("string").alias("id_"), F.lit(None).cast("int").alias("toxic"), "text", lang.cast("string").alias("lang"))
    texts = _maybe_marked(texts.where(F.col("id_").isNotNull()), marks)
    rows = texts.unionByName(marks, allowMissingColumns=True)
    # Another hash deals the shards, so that a shard's order tells nothing of its number.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id_", F.lit(1)), F.lit(shards)).cast("int")).select("shard", "id_", "toxic", "text", "lang")
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.xxhash64("id_"), "id_", F.col("toxic").asc_nulls_last(), "text", "lang")
    return cut(dealt.mapInArrow(run, "shard int, toxic int, lang string, numbers array<int>"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[str | None], list[np.ndarray], np.ndarray]]:
    """(shard, labels, languages, texts as word numbers, forms of the words) of each shard of :func:`shards_of`."""
    y, langs, numbers = [], [], []
    for b in batches:
        lists = b.column(3)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for i, (shard, toxic, lang) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
            part = values[offsets[i] : offsets[i + 1]]
            if toxic >= 0:
                y.append(toxic)
                langs.append(lang)
                numbers.append(part)
            else:
                yield shard, np.array(y, np.int64), langs, numbers, part.reshape(-1, 1 + len(PREFIXES))
                y, langs, numbers = [], [], []


def _counted(coded_rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, (2, hashes) rows of either class that hold them, rows of either class) over the fitted rows of all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y, _, numbers, own in _read(batches):
            keys, counts = _form_counts(numbers, own, y)
            totals = np.bincount(y[~left_out(len(y))], minlength=2)
            cols = [np.append(keys, -1), *(np.append(counts[c], totals[c]) for c in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["form", "clean", "toxic"])

    found = coded_rows.mapInArrow(run, "form long, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = found.where((F.col("form") < 0) | (F.col("clean") + F.col("toxic") >= MIN_DOCS)).toArrow()
    form, counts = got["form"].to_numpy(), np.stack([got["clean"].to_numpy(), got["toxic"].to_numpy()])
    order = np.argsort(form)
    return form[order][1:], counts[:, order][:, 1:], counts[:, order][:, 0]


def _one_round(coded_rows: DataFrame, m: Model, sums: dict[str, np.ndarray], number: int, epochs: int, seed: int) -> None:
    """Take ``m`` and ``sums`` some epochs on in every shard and average; a shard counts by its fitted rows."""
    width = 2 * DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, y, _, numbers, own in _read(batches):
            mine, squares = pickle.loads(pickle.dumps((m, sums)))
            moved = _epochs(mine, squares, numbers, own, y, epochs, np.random.default_rng([seed, number, shard]))
            rest = np.concatenate([_rest(mine), squares["rest"]])
            rest = np.append(rest, np.zeros(-len(rest) % width)).reshape(-1, width)
            values = np.concatenate([rest, np.concatenate([mine.emb[moved], squares["emb"][moved]], 1)])
            weight = max(1, int((~left_out(len(y))).sum()))
            at = np.concatenate([-1 - np.arange(len(rest)), moved])
            units = np.rint(values.astype(np.float64) * _UNIT).astype(np.int64) * weight
            cols = [pa.array(at), pa.array(np.full(len(at), weight)), *(pa.array(units[:, k]) for k in range(width))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["at", "weight", *(f"v{k}" for k in range(width))]
    got = coded_rows.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("at").agg(*(F.sum(c).alias(c) for c in names[1:]))
    got = got.select("at", *((F.col(c) / F.col("weight") / _UNIT).cast("float").alias(c) for c in names[2:])).toArrow()
    at, values = got["at"].to_numpy(), np.stack([got[c].to_numpy() for c in names[2:]], 1)
    hit = at > 0
    m.emb[at[hit]], sums["emb"][at[hit]] = values[hit, :DIM], values[hit, DIM:]
    rest = values[~hit][np.argsort(-at[~hit])].ravel()
    n = len(sums["rest"])
    sums["rest"] = rest[n : 2 * n].copy()
    _set_rest(m, rest[:n])


def _left_out_logits(coded_rows: DataFrame, m: Model) -> pa.Table:
    """(lang, toxic, step, n): how many left-out rows of all shards have which logit, in steps of 1/STEPS from -32 to 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y, langs, numbers, own in _read(batches):
            rest = np.flatnonzero(left_out(len(y)))
            step = np.rint(np.clip(logits(m, [numbers[i] for i in rest], own), -32, 32) * STEPS).astype(np.int64)
            cols = [pa.array([langs[i] for i in rest], pa.string()), pa.array(y[rest]), pa.array(step)]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "toxic", "step"])

    return coded_rows.mapInArrow(run, "lang string, toxic long, step long").groupBy("lang", "toxic", "step").agg(F.count("*").alias("n")).toArrow()


def fit(docs: DataFrame, labels: DataFrame, shard: int = SHARD, seed: int = 7) -> Model | None:
    """Train on every labelled row that may be learnt, about ``shard`` of them a task, and calibrate on the left-out fifth; None without both classes."""
    marks = marks_of(labels)
    n = {r["toxic"]: r["count"] for r in marks.join(docs.select(F.col("doc_id").cast("string").alias("id_")), "id_", "left_semi").groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    coded_rows = shards_of(docs, marks, -(-sum(n.values()) // shard))
    m = _start(*_counted(coded_rows), seed)
    sums = _fresh(m)
    for k in range(ROUNDS):
        _one_round(coded_rows, m, sums, k, EPOCHS, seed)
    found = _left_out_logits(coded_rows, m)
    z, y, n = found["step"].to_numpy() / STEPS, found["toxic"].to_numpy(), found["n"].to_numpy()
    m.scale, m.shift = _scaled(z, y, n)
    calibrate(m, _squashed(m, z), y, found["lang"].to_pylist(), n)
    return m


def _squashed(m: Model, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m.scale * z + m.shift, -30, 30)))


def score_texts(m: Model, texts: list[str | None], memo: dict[str, int]) -> np.ndarray:
    """Scores in 0 to 1; ``memo`` keeps the words' summed embeddings from call to call."""
    if "" not in memo:
        memo[""] = 0
        memo[b"table"] = np.zeros((1, DIM), np.float32)  # the padding word
    split = [words(t) for t in texts]
    new = [w for w in dict.fromkeys(w for t in split for w in t) if w not in memo]
    if new:
        at = len(memo) - 1
        memo.update(zip(new, range(at, at + len(new))))
        memo[b"table"] = np.concatenate([memo[b"table"], m.emb[m.rows_of(_forms_of(new))].sum(1)])
    pad = [""] * (max(WIDTHS) - 1)
    starts, at = [], 0
    codes: list[int] = []
    for t in split:
        starts.append(at)
        body = (t or [""]) + pad
        codes.extend([memo[w] for w in body])
        at += len(body)
    if not texts:
        return np.zeros(0)
    top = _pooled(memo[b"table"][np.array(codes)], np.array(starts), m.conv) + m.bias
    return _squashed(m, np.maximum(top, 0) @ m.head + m.offset)


def score(docs: DataFrame, m: Model | None) -> DataFrame:
    """(doc_id, lang, score) for each row."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select("doc_id", lang.cast("string").alias("lang"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    if m is None:
        return rows.select("doc_id", "lang", F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            out, held, total = [], [], 0
            for t in b.column(2):
                held.append(t.as_py())
                total += len(held[-1] or "")
                if total >= CHARS:
                    out.append(score_texts(m, held, memo))
                    held, total = [], 0
                    if len(memo) > MEMO:
                        memo = {}
            out.append(score_texts(m, held, memo))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(out), pa.float64())], names=["doc_id", "lang", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang string, score double")


def threshold_of(lang: Column, m: Model | None) -> Column:
    """The calibrated threshold of a row's language, the general one where the language has none."""
    if m is None:
        return F.lit(2.0)
    out = F.lit(m.general)
    for name, t in m.thresholds.items():
        out = F.when(lang == name, t).otherwise(out)
    return out


def reject_toxic(docs: DataFrame, m: Model | None) -> DataFrame:
    """``docs`` without the rows whose score reaches their language's threshold."""
    if m is None:
        return docs
    names = docs.columns
    lang = "lang" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        cut = m.thresholds
        for b in batches:
            texts, at = b.column(names.index("text")), 0
            while at < len(b):
                end, total = at, 0
                while end < len(b) and total < CHARS:
                    total += len(texts[end].as_py() or "")
                    end += 1
                s = score_texts(m, texts.slice(at, end - at).to_pylist(), memo)
                tongue = b.column(names.index("lang")).slice(at, end - at).to_pylist() if lang else [None] * (end - at)
                limit = np.array([cut.get(x, m.general) for x in tongue])
                yield b.slice(at, end - at).filter(pa.array(s < limit))
                at = end
                if len(memo) > MEMO:
                    memo = {}

    return docs.mapInArrow(run, docs.schema)


def judged(docs: DataFrame, m: Model | None, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted, flagged): ``predicted`` by one cut, ``flagged`` by the language's threshold."""
    s = F.col("score")
    return score(docs, m).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (s >= cut).cast("int").alias("predicted"),
        (s >= threshold_of(F.col("lang"), m)).cast("int").alias("flagged"),
    )

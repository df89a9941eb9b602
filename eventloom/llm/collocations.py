"""Phrase collocations, counted losslessly in counting quotient filters.

A text is lower-cased in A-Z and cut into pieces at ``. , ; : ! ?`` and line ends, pieces into
words at blanks and tabs. For each language, n counts words and f(phrase) its occurrences
within pieces, overlaps included. A candidate is a phrase of two or three words found
``least`` times or more; its score is floor(1000000 a a / (l r)) at the cut between words where
that is lowest, ties to the earlier cut. One whose words stand inside a longer candidate
with at least half its count is dropped. The best ``top`` of a language are returned.

How: each task turns its texts into word numbers, a few megabytes ("shard") at a time, and
writes them with the shard's word counts to the shared folder; texts are never shuffled. Word
counts are added up, and words found ``least`` times get dense ids: a rarer word is in no
candidate, so it only ends a phrase. A shard packs the ids of each phrase of two or three words into
one number of known width and permutes it invertibly (a Feistel network). The leading bits
name a bucket, the next ones the quotient, and all others are the remainder, so nothing is
lost. A filter keeps sorted runs: an occupied bit for each quotient, a run-end bit and the
remainder's bytes for each entry, and a counter of one byte or nine. Filters of ``FAN`` shards
at a time merge bucket by bucket, level by level, one shuffle a level;
a merge holds about as many entries as one shard does, so its size does not depend on the
corpus, and phrases found everywhere cost a row a filter. Phrases that reach ``least`` at the last
level are turned back into ids; what follows is joins of candidates.

Nulls: a null text is empty, a null ``lang`` is ``und``, so such rows join those. ``doc_id`` is not used, so rows that repeat
one count each. Extra columns are ignored; an empty table gives an empty result. Phrases
are ordered by bytes. Scores are exact decimals; a phrase found over 10**15 times is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.components import ensure_checkpoint_dir

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD = 8 << 20
#: Filters merged at a time, a power of two.
FAN_BITS = 8
_PLAIN = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def numbered(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, word number of each token); a piece's first token has its number inverted."""
    raw = np.frombuffer(b"\n".join(t.lower().translate(_PLAIN) for t in texts), np.uint8)
    inside = (raw != 10) & (raw != 32)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    coded = flat.dictionary_encode()
    tokens = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    piece = np.cumsum(raw == 10)[start] if len(start) else np.zeros(0, np.int64)
    first = np.diff(piece, prepend=-1) != 0
    return coded.dictionary, np.where(first, ~tokens, tokens)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, lang, tokens, words, counts)."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def shard(lang: str) -> pa.RecordBatch:
        words, tokens = numbered(held.pop(lang))
        del size[lang]
        counts = np.bincount(np.where(tokens < 0, ~tokens, tokens), minlength=len(words)).astype(np.int64)
        one = lambda values, kind: pa.array([values], kind)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().hex]),
                pa.array([lang]),
                pa.array([tokens.tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
                one(counts, pa.list_(pa.int64())),
            ],
            names=["shard", "lang", "tokens", "words", "counts"],
        )

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
            t = text.as_py()
            held.setdefault(lang, []).append(t)
            size[lang] = size.get(lang, 0) + len(t)
            if size[lang] >= SHARD:
                yield shard(lang)
        while sum(size.values()) >= 2 * SHARD:  # many languages, each with little text
            yield shard(max(size, key=size.__getitem__))
    for lang in list(held):
        yield shard(lang)


class Packing:
    """Phrases of up to three ids of ``bits`` bits (0: no word) as permuted numbers, a left and a right half."""

    def __init__(self, bits: int):
        if bits > 42:
            raise OverflowError("over 2**42 frequent words")
        self.bits, self.high = bits, (bits + 1) // 2
        self.left, self.right = bits + self.high, bits + bits // 2

    def _mixed(self, x: np.ndarray, k: int, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & np.uint64((1 << width) - 1)

    def packed(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64(self.bits // 2)
        x = (a.astype(np.uint64) << np.uint64(self.high)) | (b.astype(np.uint64) >> low)
        y = ((b.astype(np.uint64) & np.uint64((1 << int(low)) - 1)) << np.uint64(self.bits)) | c.astype(np.uint64)
        for k in (1, 2):
            x = x ^ self._mixed(y, k, self.left)
            y = y ^ self._mixed(x, k + 2, self.right)
        return x, y

    def unpacked(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for k in (2, 1):
            y = y ^ self._mixed(x, k + 2, self.right)
            x = x ^ self._mixed(y, k, self.left)
        low, bits, high = (np.uint64(v) for v in (self.bits // 2, self.bits, self.high))
        top = x & np.uint64((1 << self.high) - 1)
        a, b, c = x >> high, (top << low) | (y >> bits), y & np.uint64((1 << self.bits) - 1)
        return a.astype(np.int64), b.astype(np.int64), c.astype(np.int64)

    def counted(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct numbers with their counts added up."""
        if not len(x):
            return x, y, n
        if self.left + self.right <= 64:
            key = (x << np.uint64(self.right)) | y
            order = np.argsort(key, kind="stable")  # runs that are sorted already only merge
        else:
            order = np.lexsort((y, x))
        x, y, n = x[order], y[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        return x[at], y[at], np.add.reduceat(n, at)


def _bytes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each number, whole bytes, one byte plane after another."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-width // 8)]
    return np.ascontiguousarray(planes.T).tobytes()


def _numbers(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : -(-width // 8)] = np.frombuffer(data, np.uint8).reshape(-(-width // 8), n).T
    return out.view("<u8").ravel().astype(np.uint64)


def to_filter(p: Packing, skip: int, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> bytes:
    """A counting quotient filter of sorted numbers that share their first ``skip`` bits."""
    q = min(p.left - skip, max(0, len(x).bit_length() - 1))
    rest = p.left - skip - q
    quotient = ((x >> np.uint64(rest)) & np.uint64((1 << q) - 1)).astype(np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    run_end = np.append(quotient[1:] != quotient[:-1], True)
    small = np.where(n < 255, n, 255).astype(np.uint8)
    head = np.array([len(x), q], "<u4").tobytes()
    return b"".join(
        [head, np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(), _bytes(x & np.uint64((1 << rest) - 1), rest), _bytes(y, p.right), small.tobytes(), n[n >= 255].astype("<i8").tobytes()]
    )


def from_filter(p: Packing, skip: int, bucket: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers and counts of a filter whose first ``skip`` bits are ``bucket``."""
    view = memoryview(data)
    size, q = (int(v) for v in np.frombuffer(view[:8], "<u4"))
    rest, at = p.left - skip - q, 8

    def take(n: int) -> memoryview:
        nonlocal at
        at += n
        return view[at - n : at]

    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(take(-(-(1 << q) // 8)), np.uint8), count=1 << q))
    ends = np.unpackbits(np.frombuffer(take(-(-size // 8)), np.uint8), count=size)
    quotient = occupied[np.cumsum(ends) - ends].astype(np.uint64)
    left = _numbers(take(size * -(-rest // 8)), size, rest)
    y = _numbers(take(size * -(-p.right // 8)), size, p.right)
    n = np.frombuffer(take(size), np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(take(8 * int((n == 255).sum())), "<i8")
    x = (np.uint64(bucket) << np.uint64(p.left - skip)) | (quotient << np.uint64(rest)) | left
    return x, y, n


def _split(p: Packing, skip: int, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, filter) of sorted numbers, buckets being their first ``skip`` bits."""
    bucket = (x >> np.uint64(p.left - skip)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(x) else np.zeros(0, np.int64)
    for i, j in zip(edges[:-1], edges[1:]):
        yield int(bucket[i]), to_filter(p, skip, x[i:j], y[i:j], n[i:j])


def _rows(group: int, found: Iterator[tuple[int, bytes]]) -> pa.Table:
    got = list(found)
    return pa.table(
        {"owner": pa.array([group] * len(got), pa.int64()), "bucket": pa.array([b for b, _ in got], pa.int64()), "filter": pa.array([f for _, f in got], pa.binary())}
    )


def phrases(p: Packing, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All phrases of two and three words as permuted numbers with counts; id 0 is in no phrase, nor are breaks."""
    two = (ids[:-1] > 0) & (ids[1:] > 0) & ~starts[1:]
    three = two[:-1] & two[1:]
    at2, at3 = np.flatnonzero(two), np.flatnonzero(three)
    a = np.concatenate([ids[at2], ids[at3]])
    b = np.concatenate([ids[at2 + 1], ids[at3 + 1]])
    c = np.concatenate([np.zeros(len(at2), np.int64), ids[at3 + 2]])
    return p.counted(*p.packed(a, b, c), np.ones(len(a), np.int64))


def _saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def _dense_ids(words: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """``words`` with ids from 1 on, and their number; offsets by partition are joined, as no order is needed."""
    marked = _saved(words.withColumn("m", F.monotonically_increasing_id()), folder, "marked")
    part = F.shiftright("m", 33)
    sizes = marked.groupBy(part.alias("part")).agg(F.count("*").alias("size")).orderBy("part").collect()  # a row a partition
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r["part"], total))
        total += r["size"]
    known = words.sparkSession.createDataFrame(offsets, "part long, before long")
    ided = marked.withColumn("part", part).join(F.broadcast(known), "part")
    return ided.withColumn("id", F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("m", "part", "before"), total


def _plain(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def phrase_counts(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): frequent words (lang, word, f, id), frequent phrases (w1, w2, w3, a), all words (lang, n)."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/collocations-{uuid.uuid4().hex}"
    shards = _plain(docs).mapInArrow(_shards, "shard string, lang string, tokens binary, words array<string>, counts array<long>")
    shards = _saved(shards, folder, "shards")
    each = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    each = each.select("shard", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    totals = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words, size = _dense_ids(words, folder)
    words = _saved(words, folder, "words")
    p = Packing(max(2, size.bit_length()))
    n_shards = shards.count()

    levels = 1
    while 1 << FAN_BITS * levels < n_shards:
        levels += 1
    owners = [max(1, -(-n_shards >> FAN_BITS * i)) for i in range(levels + 1)]
    skips = [min(p.left, FAN_BITS * (i + 1)) for i in range(levels)]

    def count(key: tuple, tokens: pa.Table, ids: pa.Table) -> pa.Table:
        t = np.frombuffer(tokens.column("tokens")[0].as_py(), np.int32)
        starts, t = t < 0, np.where(t < 0, ~t, t)
        of = np.zeros(int(t.max(initial=-1)) + 1, np.int64)
        of[ids.column("at").to_numpy()] = ids.column("id").to_numpy()
        return _rows(tokens.column("owner")[0].as_py(), _split(p, skips[0], *phrases(p, of[t], starts)))

    own = lambda of: F.pmod(F.xxhash64("shard"), F.lit(of))
    known = each.join(words, ["lang", "word"]).select("shard", "at", "id")
    coded = spark.read.parquet(f"{folder}/shards").select("shard", own(owners[1]).alias("owner"), "tokens")
    found = coded.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(count, "owner long, bucket long, filter binary")
    for i in range(1, levels):
        found = _merged(found, p, skips[i - 1], skips[i], owners[i + 1])

    def last(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, n = _sum(p, skips[-1], key[1].as_py(), batches)
        keep = n >= least
        a, b, c = p.unpacked(x[keep], y[keep])
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, c, n[keep])], names=["w1", "w2", "w3", "a"])

    kept = found.groupBy("owner", "bucket").applyInArrow(last, "w1 long, w2 long, w3 long, a long")
    return words, _saved(kept, folder, "phrases"), totals


def _sum(p: Packing, skip: int, bucket: int, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filters of one bucket, merged a few at a time."""
    total = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    parts, waiting = [total], 0
    for b in batches:
        for f in b.column("filter"):
            parts.append(from_filter(p, skip, bucket, f.as_py()))
            waiting += len(parts[-1][0])
            if waiting > max(1 << 20, len(parts[0][0])):
                parts, waiting = [p.counted(*(np.concatenate(v) for v in zip(*parts)))], 0
    return p.counted(*(np.concatenate(v) for v in zip(*parts)))


def _merged(found: DataFrame, p: Packing, skip: int, deeper: int, owners: int) -> DataFrame:
    """The filters of each owner's bucket as one, split by the next bits and dealt to fewer owners."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _sum(p, skip, key[1].as_py(), batches)
        yield from _rows(key[0].as_py() % owners, _split(p, deeper, *merged)).to_batches()

    return found.groupBy("owner", "bucket").applyInArrow(run, "owner long, bucket long, filter binary")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases."""
    words, found, totals = phrase_counts(docs, least)
    word = lambda k: words.select(F.col("id").alias(f"w{k}"), *([F.col("lang")] if k == 1 else []), F.col("word").alias(f"s{k}"), F.col("f").alias(f"f{k}"))
    two = found.where("w3 = 0").select("w1", "w2", "a")
    three = found.where("w3 <> 0")
    pair = lambda x, y, name: two.select(F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(name))

    def cut(k: int, left: str, right: str) -> Column:
        # Decimals of 36 digits: exact for counts up to 10**15.
        score = F.expr(f"cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    longer = three.select("w1", "w2", "a").unionAll(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = longer.groupBy("w1", "w2").agg(F.max("a").alias("most"))
    free = F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True))
    twos = two.join(longer, ["w1", "w2"], "left").where(free).join(word(1), "w1").join(word(2), "w2")
    twos = twos.select("lang", F.concat_ws(" ", "s1", "s2").alias("phrase"), "a", cut(1, "f1", "f2").alias("c"))
    threes = three.join(pair("w1", "w2", "f12"), ["w1", "w2"]).join(pair("w2", "w3", "f23"), ["w2", "w3"])
    threes = threes.join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    threes = threes.select("lang", F.concat_ws(" ", "s1", "s2", "s3").alias("phrase"), "a", F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3")).alias("c"))
    ranked = twos.unionAll(threes).select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    # The best of each part of a language first, so that a large language is one task's work only for 64 * top rows.
    for keys in (["lang", "salt"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.withColumn("rank", F.col("rank").cast("long")).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

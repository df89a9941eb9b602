"""Hierarchical multi-length packing of token ids into training sequences.

Every text is encoded in full and closed by an end id. Whole windows of the longest
tier leave a document first; what remains is routed to the smallest tier that holds
it. Each tier is packed from its own documents, largest first; the gap of a window is
filled from the shorter tiers, best fit first, and what is left of the gap by cutting
the next short document. Windows are therefore full, and a full window of any tier has
a power of two of ids, so it needs no padding. At the end of a partition what is
still queued goes to windows of falling powers of two.

Windows of all tiers are dealt to step groups of equal token totals: a window goes to the first
group with room for it, and as sizes are powers of two that divide ``STEP_TOKENS``, groups
fill up exactly. Only the groups still open at the end of a partition hold less, and together with
no more open ones than tiers there are.

Documents never leave their partition, so nothing shuffles, and a task holds only the
short documents in its queues. Sequence ids are the partition's number times 2**40 plus
a running number: the same for the same input splits, also when a task is run again.

Nulls: a null text counts as empty, which is the end id alone; a null ``doc_id`` keeps
its pieces. Repeated rows are packed each; extra columns are ignored; an empty table
gives no piece.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)
#: Chunks remembered by a worker before it starts anew; characters encoded at once; ids queued before short tiers are packed.
MEMO, CHARS, QUEUED = 400_000, 250_000, 400_000
#: New words encoded in one string.
JOINED = 64
STEP_TOKENS = 65_536
#: White space that Python splits at but the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
#: A mark that another mark precedes, and so belongs to its piece.
_JOINED = re.compile(r"[,.](?=\s)(?<=[^\w\s][,.]|_[,.])")
#: The pieces of a chunk of plain characters, by the tokenizer's own rule.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PLAIN = re.compile(r"[!-~]+")
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


class _Codes(dict):
    """Numbers strings in the order they are first asked for, and keeps the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        code = self[chunk] = len(self)
        return code


class ChunkEncoder:
    """Ids of texts by a tokenizer whose tokens never cross white space: each distinct chunk is encoded once."""

    def __init__(self, path: str) -> None:
        # A task has one core: threads of the tokenizer's own would only add memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        tokens = self.tok.get_vocab()
        self.ends = np.zeros(max(tokens.values()) + 1, bool)
        self.ends[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.codes = _Codes()
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Pieces that may be encoded apart. Case does not count, and a mark right after a letter or digit and before
        white space is a piece of its own, so both are undone where nothing else depends on them."""
        if _ODD.search(text):
            return [x for x in _SPACE.split(text) if x]
        if "<|" in text or "Σ" in text:  # a special token's name; a letter whose lower case depends on its place
            return text.split()
        text = text.lower()
        if not _JOINED.search(text):
            for mark in ",.":
                text = text.replace(mark + " ", f" {mark} ").replace(mark + "\n", f" {mark} ")
        return text.split()

    def _words(self, words: list[str]) -> Iterator[np.ndarray]:
        """Ids of words of letters, many in one string: only a word's last token has an end, so ends part them."""
        for at in range(0, len(words), JOINED * 256):
            some = words[at : at + JOINED * 256]
            groups = [some[i : i + JOINED] for i in range(0, len(some), JOINED)]
            for group, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
                if len(cuts) == len(group) + 1 and cuts[-1] == len(ids):
                    yield from (ids[a:b] for a, b in zip(cuts, cuts[1:]))
                else:
                    yield from self._alone(group)

    def _alone(self, chunks: list[str]) -> Iterator[np.ndarray]:
        for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False):
            yield np.array(e.ids, np.uint32)

    def _new(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of chunks not seen before, from their pieces where those may be encoded apart."""
        pieces = {c: _PIECES.findall(c.lower()) for c in chunks if not c.isalpha() and _PLAIN.fullmatch(c) and "<|" not in c}
        single = dict.fromkeys(c for c in chunks if c not in pieces) | dict.fromkeys(x for p in pieces.values() for x in p)
        words = list(filter(str.isalpha, single))
        rest = [x for x in single if not x.isalpha()]
        ids = dict(zip(words, self._words(words))) | dict(zip(rest, self._alone(rest)))
        ids |= {c: np.concatenate([ids[x] for x in p]) for c, p in pieces.items()}
        return [ids[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > MEMO:
            self._reset()
        chunks = [self.chunks(t) for t in texts]
        total = sum(map(len, chunks))
        code = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(chunks)), np.int64, total)
        if new := self.codes.new:
            got = self._new(new)
            n = np.fromiter(map(len, got), np.int64, len(got))
            self.ids = np.concatenate([self.ids, *got])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)])
            self.codes.new = []
        lo, n = self.starts[code], self.starts[code + 1] - self.starts[code]
        ends = np.cumsum(n)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - lo, n)]
        edges = np.concatenate([[0], ends])[np.cumsum([len(c) for c in chunks], dtype=np.int64)] if chunks else np.zeros(0, np.int64)
        return np.split(ids, edges[:-1])


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """This worker's encoder."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


class Packer:
    """Queues of one partition. A piece is (length, order, doc, start, doc_tokens, ids)."""

    def __init__(self, window: int, shortest: int, partition: int) -> None:
        self.tiers = []
        t = window
        while t >= shortest:
            self.tiers.append(t)
            t //= 2
        self.queues: dict[int, list[tuple]] = {t: [] for t in self.tiers}
        self.queued = 0
        self.sequence = partition << 40
        self.partition = partition
        self.room: dict[int, int] = {}
        self.groups = 0
        self.order = 0
        self.out: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, window, at = len(ids), self.tiers[0], 0
        while total - at >= window:
            self._emit([(window, 0, doc, at, total, ids[at : at + window])], window)
            at += window
        if at < total:
            self._queue(doc, at, total, ids[at:])

    def _queue(self, doc: int | None, start: int, total: int, ids: np.ndarray) -> None:
        n = len(ids)
        tier = next((t for t in reversed(self.tiers) if n <= t), self.tiers[0])
        self.order += 1
        insort(self.queues[tier], (n, self.order, doc, start, total, ids), key=lambda p: p[:2])
        self.queued += n

    def _take(self, room: int, tiers: list[int]) -> tuple | None:
        """The longest queued piece that fits ``room``, longer tiers first."""
        for t in tiers:
            q = self.queues[t]
            if q and (i := bisect_right(q, room, key=lambda p: p[0])):
                self.queued -= q[i - 1][0]
                return q.pop(i - 1)
        return None

    def _cut(self, room: int, tiers: list[int]) -> tuple | None:
        """``room`` ids off the shortest queued piece; its rest is routed anew."""
        for t in reversed(tiers):
            if q := self.queues[t]:
                n, order, doc, start, total, ids = q.pop(0)
                self.queued -= n
                self._queue(doc, start + room, total, ids[room:])
                return room, order, doc, start, total, ids[:room]
        return None

    def pack(self, keep: int) -> None:
        """Fill windows, longest tier first, until at most ``keep`` ids are queued or no window can be filled."""
        for k, tier in enumerate(self.tiers):
            while self.queues[tier] and self.queued >= max(tier, keep + 1):
                self._emit(self._window(tier, self.tiers[k:]), tier)

    def _window(self, size: int, tiers: list[int]) -> list[tuple]:
        got, room = [], size
        while room:
            piece = self._take(room, tiers) or self._cut(room, tiers) or self._take(room, self.tiers) or self._cut(room, self.tiers)
            got.append(piece)
            room -= piece[0]
        return got

    def close(self) -> None:
        """Everything left, in windows of falling powers of two."""
        self.pack(0)
        while self.queued:
            size = min(self.tiers[0], 1 << (self.queued.bit_length() - 1))
            self._emit(self._window(size, self.tiers), size)

    def _group(self, size: int) -> int:
        """The first step group with room for a window."""
        number = next((g for g, room in self.room.items() if room >= size), None)
        if number is None:
            number, self.groups = self.groups, self.groups + 1
            self.room[number] = STEP_TOKENS
        self.room[number] -= size
        if not self.room[number]:
            del self.room[number]
        return number

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        group = (self.partition << 40) + self._group(tier)
        offset = 0
        for n, _, doc, start, total, ids in pieces:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
            self.out.append((doc, start, n, crc, total, self.sequence, offset, tier, group))
            offset += n
        self.sequence += 1

    def drain(self) -> pa.RecordBatch:
        cols = list(zip(*self.out)) or [()] * 9
        self.out = []
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, window: int = 4096, shortest: int = 256) -> DataFrame:
    """One row a piece; ``tier`` is its sequence's size and ``step_group`` the group the sequence belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = chunk_encoder(path), Packer(window, shortest, TaskContext.get().partitionId())
        for b in batches:
            at, held, total = 0, [], 0
            texts = b.column(1)
            for i, t in enumerate(texts):
                held.append(t.as_py() or "")
                total += len(held[-1])
                if total >= CHARS or i == len(texts) - 1:
                    for who, ids in zip(b.column(0).slice(at, len(held)).to_pylist(), enc.encode(held)):
                        packer.add(who, np.append(ids, np.uint32(end_id)))
                    if packer.queued > QUEUED:
                        packer.pack(QUEUED // 2)
                    yield packer.drain()
                    at, held, total = i + 1, [], 0
        packer.close()
        yield packer.drain()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)

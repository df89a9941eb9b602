"""Byte-level BPE encoding and decoding with recursive DuckDB queries in each partition.

A task cuts its texts into pieces by the tokenizer's pattern. For pieces not seen
before, the token-position rows of their bytes join the merge table in a recursive
query; each round contracts every piece's leftmost pair of minimum rank, until no
pair can merge. Decoding joins (text, position, id) rows with the vocabulary and
concatenates bytes in position order. Spark only deals texts out; nothing shuffles.

The rounds of a query all stay in memory, so pieces are merged in batches of bounded size. Pieces
over ``LONG`` bytes (runs without a break) take a recursive query that keeps only the present
state of each position. One of its rounds contracts all of a piece's minimum-rank pairs, leftmost
first where they overlap; that is what one pair a round would come to, as no token that may
be made this way can be merged again at a lower rank (ranks for which the vocabulary does not
grant that are contracted one at a time).

Nulls: a null text counts as empty (no ids, digests of nothing); a null ``doc_id``
keeps its row. Repeated rows each give a row; extra columns are ignored; an empty
table gives an empty result. The vocabulary file must be at ``path`` on every worker.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 400
#: Bound on the rows that the rounds of one query may leave: the sum of the squares of its pieces' lengths.
ROUNDS = 20_000_000
#: Pieces remembered by a worker before it starts anew, and characters encoded at once.
MEMO, CHARS = 400_000, 1_500_000

_ENCODE = """
with recursive t as (
  select k, id, 0 as it from start
  union all
  select t.k, case when t.k = b.at then b.new else t.id end, t.it + 1
  from t join (
    select w, w * 1024 + (best // 1024) % 1024 as at, w * 1024 + best % 1024 as gone, cast(best // 1048576 as int) as new
    from (
      select n.k // 1024 as w, min(cast(m.id as bigint) * 1048576 + (n.k % 1024) * 1024 + n.nk % 1024) as best
      from (select k, id, lead(id) over (order by k) as nid, lead(k) over (order by k) as nk from t) n
      join merges m on m.l = n.id and m.r = n.nid
      where n.nk // 1024 = n.k // 1024
      group by 1)) b on t.k // 1024 = b.w
  where t.k <> b.gone),
last as (select k // 1024 as w, max(it) as it from t group by 1)
select t.k // 1024 as w, t.id from t join last on t.k // 1024 = last.w and t.it = last.it order by t.k
"""
_ENCODE_LONG = """
with recursive t(k, id) using key (k) as (
  select k, id from start
  union
  (with n as (select k, id, lead(k) over (order by k) as nk, lead(id) over (order by k) as nid from recurring.t where id >= 0),
  c as (select n.k, n.nk, n.k >> 32 as w, m.id as new from n join merges m on m.l = n.id and m.r = n.nid where n.nk >> 32 = n.k >> 32),
  least as (select w, min(new) as new from c group by w),
  o as (select c.*, lag(nk) over (order by k) as before from c join least using (w, new)),
  runs as (select *, sum(case when before = k then 0 else 1 end) over (order by k) as run from o),
  picked as (select *, row_number() over (partition by run order by k) as i, row_number() over (partition by w order by k) as nth from runs),
  go as (select k, nk, new from picked where nth = 1 or (i % 2 = 1 and new not in (select id from alone)))
  select k, new from go union all select nk, -1 from go))
select k >> 32 as w, id from t where id >= 0 order by k
"""
#: One thread aggregates the sorted rows in their order.
_DECODE = """
select d, string_agg(c, '') as chars from (select x.d, v.c from x join vocab v on v.id = x.id order by x.p) group by d
"""
#: Bytes travel as characters of the same number; only 0 takes another.
_ZERO = "\u0100"


class Coder:
    """Encoder and decoder of one vocabulary, with its own in-memory database."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "350MB", "temp_directory": ""})
        r = self.ranks
        rows = [(r[t[:i]], r[t[i:]], n) for t, n in r.items() for i in range(1, len(t)) if t[:i] in r and t[i:] in r]
        merges = pa.table({c: pa.array(v, pa.int32()) for c, v in zip(("l", "r", "id"), zip(*rows))})
        vocab = pa.table({"id": pa.array(r.values(), pa.int32()), "c": pa.array([t.decode("latin-1").replace("\0", _ZERO) for t in r])})
        self._load("merges", merges)
        self._load("vocab", vocab)
        alone = sorted({part for *parts, n in rows for part in parts if n < part})
        self._load("alone", pa.table({"id": pa.array(alone, pa.int32())}))
        self.byte = np.array([r[bytes([i])] for i in range(256)], np.int32)
        self._reset()

    def _load(self, name: str, table: pa.Table) -> None:
        self.db.register("loaded", table)
        self.db.execute(f"create table {name} as select * from loaded")
        self.db.unregister("loaded")

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def _merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece by the recursive queries, a batch of bounded work at a time."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        for long in (False, True):
            held, work = [], 0
            for i in [i for i, b in enumerate(pieces) if (len(b) > LONG) == long]:
                work += len(pieces[i]) if long else len(pieces[i]) ** 2
                held.append(i)
                if work > ROUNDS:
                    self._merge_some(pieces, held, out, long)
                    held, work = [], 0
            if held:
                self._merge_some(pieces, held, out, long)
        return out

    def _merge_some(self, pieces: list[bytes], which: list[int], out: list[np.ndarray], long: bool) -> None:
        n = np.array([len(pieces[i]) for i in which], np.int64)
        word = np.repeat(np.arange(len(which), dtype=np.int64), n)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        raw = np.frombuffer(b"".join(pieces[i] for i in which), np.uint8)
        self.db.register("start", pa.table({"k": (word << (32 if long else 10)) + pos, "id": self.byte[raw]}))
        got = self.db.sql(_ENCODE_LONG if long else _ENCODE).fetchnumpy()
        self.db.unregister("start")
        counts = np.bincount(np.asarray(got["w"], np.int64), minlength=len(which))
        ids = np.asarray(got["id"], np.int32)
        for i, a, b in zip(which, np.cumsum(counts) - counts, np.cumsum(counts)):
            out[i] = ids[a:b]

    def _learn(self, words: Iterable[str]) -> None:
        """Encode pieces not yet in the memo."""
        new = [w for w in words if w not in self.memo]
        if not new:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        slots = [None if (r := self.ranks.get(b)) is None else np.array([r], np.int32) for b in raw]
        todo = [i for i, s in enumerate(slots) if s is None]
        for i, part in zip(todo, self._merge([raw[i] for i in todo])):
            slots[i] = part
        count = np.array([len(s) for s in slots], np.int64)
        at = len(self.memo)
        self.memo.update(zip(new, range(at, at + len(new))))
        self.ids = np.concatenate([self.ids, *slots])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(count)])

    def _codes(self, text: str) -> Iterator[list[str]]:
        if len(text) <= CHARS:
            yield self.find.findall(text)
        else:
            pieces = (m.group() for m in self.find.finditer(text))
            while some := list(islice(pieces, 200_000)):
                yield some

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        out, counts, total = [], [], 0
        for text in texts:
            n = 0
            for pieces in self._codes(text):
                if len(self.memo) > MEMO:
                    self._reset()
                out.append(pieces)
                n += 1
                total += 1
            counts.append(n)
        flat = [w for pieces in out for w in pieces]
        self._learn(dict.fromkeys(flat))
        memo = self.memo
        code = np.fromiter((memo[w] for w in flat), np.int64, len(flat))
        lo, n = self.starts[code], self.starts[code + 1] - self.starts[code]
        ends = np.cumsum(n)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - lo, n)]
        pieces_of = np.array([len(p) for p in out], np.int64)
        text_of_run = np.repeat(np.arange(len(texts)), counts)
        text_of_piece = np.repeat(text_of_run, pieces_of)
        per_text = np.bincount(text_of_piece, weights=n, minlength=len(texts)).astype(np.int64)
        return ids, per_text

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> list[bytes]:
        """Bytes of each text from its ids, by ordered aggregation."""
        pos = np.arange(len(ids), dtype=np.int64)
        x = pa.table({"d": np.repeat(np.arange(len(per_text), dtype=np.int32), per_text), "p": pos, "id": ids})
        self.db.register("x", x)
        out = [b""] * len(per_text)
        for d, chars in self.db.sql(_DECODE).fetchall():
            out[d] = (chars.replace(_ZERO, "\0") if _ZERO in chars else chars).encode("latin-1")
        self.db.unregister("x")
        return out


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """This worker's coder for a vocabulary."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def slices(texts: pa.Array, chars: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts (null: empty) of about ``chars`` characters, with where they start."""
    at, held, total = 0, [], 0
    for t in texts:
        held.append(t.as_py() or "")
        total += len(held[-1])
        if total >= chars:
            yield at, held
            at, held, total = at + len(held), [], 0
    if held:
        yield at, held


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the token ids and the bytes they decode to."""
    return _coded(docs, path, pattern, False)


def roundtrip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    return _coded(docs, path, pattern, True)


def _coded(docs: DataFrame, path: str, pattern: str, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            for at, texts in slices(b.column(1), CHARS):
                ids, n = c.encode(texts)
                parts = np.split(ids.astype("<u4"), np.cumsum(n)[:-1])
                decoded = c.decode(ids, n)
                who = b.column(0).slice(at, len(texts))
                if digest:
                    hashed = [hashlib.sha256(p.tobytes()).hexdigest() for p in parts]
                    cols = [who, pa.array(n, pa.int64()), pa.array(hashed), pa.array([hashlib.sha256(d).hexdigest() for d in decoded])]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    cols = [who, pa.array(parts, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"])

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {out}")

"""Token totals for every context limit from one exact length histogram.

Each text is encoded in full and counted; documents are then aggregated by encoded
length (partial sums map-side, so a shuffle row is a length, not a document). Suffix
sums over the lengths answer, for a limit L: how many documents are longer, how many
tokens a cut at L keeps, and which quantile L is.

Nulls: a null text counts as empty, of length 0. Repeated rows each count; other
columns are ignored. An empty table gives an empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import ensure_checkpoint_dir

_ENCODERS: dict[tuple[str, str], tiktoken.Encoding] = {}
#: Lengths summed in one window partition; the partitions' totals are few.
BLOCK = 1024


def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """This worker's encoder."""
    if (path, pattern) not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def encoded_lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(n_tokens), one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode_ordinary
        for b in batches:
            n = [len(encode(t.as_py() or "")) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def length_histogram(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(n_tokens, n_docs), one row a length that occurs; checkpointed, so that its readers encode no text again."""
    ensure_checkpoint_dir(docs.sparkSession)
    return encoded_lengths(docs, path, pattern).groupBy("n_tokens").agg(F.count("*").alias("n_docs")).checkpoint()


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each occurring length L: documents and tokens of longer texts, tokens kept and lost by a cut at L, and the
    share of documents of at most L tokens."""
    h = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    h = h.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    totals = totals.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"),
        F.sum("d").over(all_rows).alias("all_docs"),
        F.sum("t").over(all_rows).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    own = h.select(
        "*",
        F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("d_in"),
        F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("t_in"),
    )
    longer, longer_tokens = F.col("d_after") + F.col("d_in"), F.col("t_after") + F.col("t_in")
    kept = F.col("all_tokens") - longer_tokens + F.col("n_tokens") * longer
    return own.join(totals, "block").select(
        "n_tokens",
        "n_docs",
        "tokens",
        longer.alias("docs_longer"),
        longer_tokens.alias("tokens_longer"),
        kept.alias("tokens_kept"),
        (F.col("all_tokens") - kept).alias("tokens_lost"),
        ((F.col("all_docs") - longer) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(suffix_sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_longer, tokens_kept) for any context limits, occurring lengths or not.

    Between two occurring lengths the counts of the lower one hold, and every longer document keeps ``limit`` tokens.
    """
    wanted = F.explode(F.array(*[F.lit(int(x)) for x in sorted(set(limits))]).cast("array<long>"))
    whole = F.col("tokens_kept") - F.col("n_tokens") * F.col("docs_longer")
    rows = suffix_sums.select("n_tokens", "n_docs", "docs_longer", whole.alias("whole"), wanted.alias("limit"))
    below = F.col("n_tokens") <= F.col("limit")
    last = lambda c: F.max_by(c, F.when(below, F.col("n_tokens")))
    got = rows.groupBy("limit").agg(
        last("docs_longer").alias("over"), last("whole").alias("whole"), F.sum("n_docs").alias("all_docs")
    )
    over = F.coalesce("over", "all_docs")
    return got.select("limit", over.alias("docs_longer"), (F.coalesce("whole", F.lit(0)) + F.col("limit") * over).alias("tokens_kept"))

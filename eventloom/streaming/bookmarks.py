"""Bookmark messages as a stream: each message replaces all bookmarks of its device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.runs import latest_snapshots


def _state(path: str, batch: int) -> str:
    return f"{path}/state-{batch}"


def sync(messages: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keep the newest message (g, items, t, id) of each device under ``path``, one folder a batch.

    A batch reads the folder of the one before and overwrites its own, so a repeated batch gives the same state.
    """

    def merge(batch: DataFrame, n: int) -> None:
        rows = batch
        if n > 0:
            rows = batch.unionByName(batch.sparkSession.read.parquet(_state(path, n - 1)))
        latest_snapshots(rows).write.mode("overwrite").parquet(_state(path, n))

    return messages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_state(spark, path: str, query: StreamingQuery) -> DataFrame:
    """State after the query's last batch."""
    return spark.read.parquet(_state(path, query.lastProgress["batchId"]))

"""Bookmark messages as a stream with keyed state: the cost of a batch follows its messages, not the devices known.

Two keyed operators follow each other. The first is keyed by address and admits a message if its device is known there or fewer than
``most`` devices sent from that address the same day. The second is keyed by device and holds its newest message, whose bookmarks replace all
earlier ones; a timer clears it once the last of its days is past. Both states live in the query's checkpoint, versioned by batch,
so a query that starts again goes on where it stopped; :func:`held` reads the newest state as a table.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

MESSAGE = "ip string, g string, items array<struct<k:string,d:string>>, t long, id long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def _end_of(day: str) -> int:
    """When a day is over everywhere, as epoch milliseconds."""
    start = datetime.datetime.fromisoformat(day).replace(tzinfo=datetime.timezone.utc)
    return int(start.timestamp() * 1000) + DAY_MS + DAY_MS // 2


class Admit(StatefulProcessor):
    """Keyed by address: messages of known devices, and of others while the day has room."""

    def __init__(self, most: int = 10):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A device is forgotten two days after its last message, so the map stays as small as the limit allows.
        self.devices = handle.getMapState("devices", "g string", "day string", 2 * DAY_MS)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r["t"], r["id"])):
            day = datetime.datetime.fromtimestamp(r["t"] / 1000, datetime.timezone.utc).date().isoformat()
            known = self.devices.containsKey((r["g"],))
            if known or sum(v[0] == day for v in self.devices.values()) < self.most:
                if not known or self.devices.getValue((r["g"],))[0] < day:  # a late message takes no day back
                    self.devices.updateValue((r["g"],), (day,))
                yield Row(g=r["g"], items=r["items"], t=r["t"], id=r["id"])

    def close(self) -> None:
        pass


class Newest(StatefulProcessor):
    """Keyed by device: its newest message; emits it whenever it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getValueState("marks", "items array<struct<k:string,d:string>>, t long, id long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = max(rows, key=lambda r: (r["t"], r["id"]))
        old = self.marks.get()
        if old is not None and (old[1], old[2]) >= (new["t"], new["id"]):
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        days = [i["d"] for i in new["items"] or []]
        over = _end_of(max(days)) if days else 0
        if days and over > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(over)
            self.marks.update(([(i["k"], i["d"]) for i in new["items"]], new["t"], new["id"]))
        else:
            # Nothing that lies ahead: an empty list is kept, so that no older message comes back, until the address forgets the device.
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 2 * DAY_MS)
            self.marks.update(([], new["t"], new["id"]))
        yield Row(g=key[0], items=new["items"], t=new["t"], id=new["id"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.marks.clear()
        return iter(())

    def close(self) -> None:
        pass


def sync(messages: DataFrame, out: str, checkpoint: str, most: int = 10, **trigger: object) -> StreamingQuery:
    """Admit and keep ``messages`` (ip, g, items of k and d, t in epoch milliseconds, id); accepted changes are appended under ``out``."""
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    # Timers fire with the next messages: batches without any would follow each other for ever.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = "g string, items array<struct<k:string,d:string>>, t long, id long"
    admitted = messages.groupBy("ip").transformWithState(Admit(most), rows, "append", "processingTime")
    newest = admitted.groupBy("g").transformWithState(Newest(), rows, "append", "processingTime")
    return newest.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def held(spark: SparkSession, checkpoint: str, today: str) -> DataFrame:
    """(g, k, d) of all bookmarks that the state holds from ``today`` on."""
    known = spark.read.format("state-metadata").load(checkpoint)
    operator = known.where(F.contains("operatorProperties", F.lit("marks"))).agg(F.max("operatorId")).first()[0]
    state = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "marks").load(checkpoint)
    each = state.select(F.col("key.g").alias("g"), F.explode("value.items").alias("i")).select("g", "i.k", "i.d").distinct()
    return each.where(F.col("d") >= today)

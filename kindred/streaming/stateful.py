"""Streams that keep state by key: first-seen rows with a time to live, and ids that are given out and used again."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, as keyed processors need; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class FirstSeen(StatefulProcessor):
    """Gives the earliest row of a key's micro-batch unless the key has been given less than ``ttl`` milliseconds before."""

    def __init__(self, ts: str, ttl: int):
        self.ts, self.ttl = ts, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.given = handle, handle.getValueState("given", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        for r in rows:
            if first is None or r[self.ts] < first[self.ts] or r[self.ts] == first[self.ts] and str(tuple(r)) < str(tuple(first)):
                first = r
        at = int(first[self.ts].timestamp() * 1000)
        if self.given.exists():
            held = self.given.get()[0]
            if at < held + self.ttl:
                return
            self.handle.deleteTimer(held + self.ttl)
        self.given.update((at,))
        self.handle.registerTimer(at + self.ttl)
        yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.given.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, key: str, ts: str, ttl_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """The first row of each key, and again the first after ``ttl_seconds`` of event time; all columns as they are.

    A key's state is one number, which a timer clears once the watermark, ``delay`` behind the latest row, is past its time to
    live. A micro-batch gives at most one row of a key, its earliest. Rows behind the watermark are left out, and
    so are null keys and times.
    """
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    plain = StructType([f for f in stream.schema.fields])
    return rows.groupBy(key).transformWithState(FirstSeen(ts, ttl_seconds * 1000), plain, "Append", "EventTime")


#: Freed ids that lie in one entry of an allocator's state.
QUEUE_IDS = 512


class Allocator(StatefulProcessor):
    """Ids of one shard: the queue of ids to use again, oldest first, the next new one, and which ids each pid holds.

    State is read once and written once a micro-batch for each pid that comes up in it, and the queue in entries of QUEUE_IDS, so calls
    to the store grow with pids and not with requests.
    """

    def __init__(self, start: int, shards: int):
        self.start, self.shards = start, shards

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", "next long, first long, last long")
        self.queue = handle.getMapState("queue", "place long", "ids array<long>")
        self.held = handle.getMapState("held", "pid string", "ids array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        shard = key[0]
        new, first, last = self.ends.get() if self.ends.exists() else (0, 0, 0)
        free, freed, ids, before = deque(), deque(), {}, {}  # ids read from the queue's front, ids to come behind it, what pids hold
        for r in sorted(rows, key=lambda r: r["at"]):  # of a micro-batch, which the stream's source bounds
            pid = r["pid"]
            if pid not in ids:
                before[pid] = list(self.held.getValue((pid,))[0]) if self.held.containsKey((pid,)) else []
                ids[pid] = list(before[pid])
            if r["op"] == "insert":
                if not free and first < last:
                    free.extend(self.queue.getValue((first,))[0])
                    self.queue.removeKey((first,))
                    first += 1
                if free or freed:
                    given = (free or freed).popleft()
                else:
                    given, new = self.start + shard + self.shards * new, new + 1
                ids[pid].append(given)
                yield Row(at=r["at"], op="insert", pid=pid, image_id=given)
            elif r["op"] == "delete":
                for gone in ids[pid]:
                    yield Row(at=r["at"], op="delete", pid=pid, image_id=gone)
                if ids[pid]:
                    freed.extend(ids[pid])
                    ids[pid] = []
                else:
                    yield Row(at=r["at"], op="delete", pid=pid, image_id=None)
        if free:  # what was read and not used goes back to the front
            first -= 1
            self.queue.updateValue((first,), (list(free),))
        while freed:
            self.queue.updateValue((last,), ([freed.popleft() for _ in range(min(QUEUE_IDS, len(freed)))],))
            last += 1
        for pid, now in ids.items():
            if now and now != before[pid]:
                self.held.updateValue((pid,), (now,))
            elif before[pid] and not now:
                self.held.removeKey((pid,))
        self.ends.update((new, first, last))

    def close(self) -> None:
        pass


def allocated(requests: DataFrame, start: int, shards: int = 16) -> DataFrame:
    """(at, op, pid, image_id) for a stream of requests(at, op, pid): inserts take an id, deletes free all ids of their pid.

    Ids are used again in the order in which they became free, new ones after them, as one allocator would with one
    shard. With more, pids are dealt to shards by hash, and a shard's new ids are start + shard + shards * n, so no two
    shards ever give the same. Requests of a micro-batch count in the order of ``at``; a delete gives a row for
    each id freed, one with null if there is none. Null pids and other operations give nothing.
    """
    shard = F.pmod(F.xxhash64("pid"), F.lit(shards)).cast("int")
    rows = requests.where("pid IS NOT NULL AND op IN ('insert', 'delete')").select(shard.alias("shard"), F.col("at").cast("bigint").alias("at"), "op", "pid")
    return rows.groupBy("shard").transformWithState(Allocator(start, shards), "at bigint, op string, pid string, image_id bigint", "Append", "None")

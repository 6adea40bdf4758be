"""What a job or a stream tells of itself while it runs: counts by Observation, progress by a listener."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Batches that a log keeps one by one; older ones stay in its sums.
HELD_BATCHES = 10_000


def count_columns(column: str, values: Iterable[str], others: str | None = "other") -> list[Column]:
    """Counts of known values of a column, and of all others, as metrics: an observation can't group."""
    values = list(values)
    of = [F.count(F.when(F.col(column) == v, 1)).alias(v) for v in values]
    return of if others is None else [*of, F.count(F.when(~F.coalesce(F.col(column).isin(*values), F.lit(False)), 1)).alias(others)]


def observed(df: DataFrame, act: Callable[[DataFrame], None], *metrics: Column) -> DataFrame:
    """(metric, value): runs ``act`` on df and gives the metrics of the rows that went through it, and its seconds.

    They are gathered as the job runs; nothing is read again.
    """
    seen, began = Observation(), time.time()
    act(df.observe(seen, F.count("*").alias("rows"), *metrics))
    told = seen.get | {"seconds": time.time() - began}
    return df.sparkSession.createDataFrame([(k, float(v) if v is not None else None) for k, v in told.items()], "metric string, value double")


class ProgressLog(StreamingQueryListener):
    """Rows, seconds and observed metrics of each micro-batch of each named stream."""

    def __init__(self):
        self.lock = threading.Lock()
        self.batches: list[tuple] = []
        self.sums: dict[tuple[str, str], float] = defaultdict(float)
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        told = {"rows": float(p.numInputRows), "seconds": p.batchDuration / 1000}
        for row in (p.observedMetrics or {}).values():
            told |= {k: float(v) for k, v in row.asDict().items() if v is not None}
        with self.lock:
            for k, v in told.items():
                self.sums[p.name or str(p.id), k] += v
            self.batches.append((p.name or str(p.id), p.batchId, told["rows"], told["seconds"]))
            del self.batches[:-HELD_BATCHES]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended.add(str(event.id))

    def totals(self, spark: SparkSession, name: str) -> DataFrame:
        """(metric, value): sums over all micro-batches of a stream."""
        with self.lock:
            rows = [(k, v) for (of, k), v in self.sums.items() if of == name]
        return spark.createDataFrame(rows, "metric string, value double")


def logged(stream: DataFrame, name: str, run: Callable[[DataFrame], str], *metrics: Column, wait_seconds: float = 30) -> DataFrame:
    """(metric, value) of a stream that ``run`` starts and brings to its end, giving its query's id."""
    spark, log = stream.sparkSession, ProgressLog()
    spark.streams.addListener(log)
    try:
        ended = run(stream.observe(f"{name}_metrics", *metrics))
        until = time.time() + wait_seconds  # events come after the stream has ended
        while ended not in log.ended and time.time() < until:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(log)
    return log.totals(spark, name)

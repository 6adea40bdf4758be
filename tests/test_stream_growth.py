from collections import deque
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from kindred.plans import stream_queries
from kindred.streaming import stateful


def records_read(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()))


def test_input_files_are_dealt_in_few_passes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "PART_ROWS", 500)
    spark.range(10_000).select(F.col("id").alias("at"), (F.col("id") % 7).alias("x")).write.parquet(f"{tmp_path}/t")
    df, before = spark.read.parquet(f"{tmp_path}/t"), records_read(spark)
    at = stream_queries._in_files(spark, df, "at")
    assert records_read(spark) - before <= 30_000  # bounds, dealing, files: one pass each
    files = spark.read.parquet(at).groupBy(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_modification_time").alias("t")).agg(
        F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n")).orderBy("low").collect()
    assert len(files) == 20 and sum(f.n for f in files) == 10_000
    assert all(a.high < b.low and a.t <= b.t for a, b in zip(files, files[1:]))


class Store(dict):
    calls = 0

    def called(self):
        Store.calls += 1

    def exists(self):
        self.called()
        return None in self

    def get(self):
        self.called()
        return self[None]

    def update(self, v):
        self.called()
        self[None] = v

    def containsKey(self, k):  # noqa: N802
        self.called()
        return k in self

    def getValue(self, k):  # noqa: N802
        self.called()
        return self[k]

    def updateValue(self, k, v):  # noqa: N802
        self.called()
        self[k] = v

    def removeKey(self, k):  # noqa: N802
        self.called()
        del self[k]


def test_an_allocator_calls_its_store_once_a_pid():
    stores = {}
    keep = lambda name, *_: stores.setdefault(name, Store())
    a = stateful.Allocator(100, 1)
    a.init(SimpleNamespace(getValueState=keep, getMapState=keep))
    rows = [Row(at=i, op="delete" if i % 7 == 0 else "insert", pid=f"u{i * 13 % 11}") for i in range(30_000)]
    got = [r for k in range(0, 30_000, 10_000) for r in a.handleInputRows((0,), iter(rows[k:k + 10_000]), None)]
    free, held, new, want = deque(), {}, 100, []
    for r in rows:
        if r.op == "insert":
            if free:
                x = free.popleft()
            else:
                x, new = new, new + 1
            held.setdefault(r.pid, []).append(x)
            want.append((r.at, "insert", r.pid, x))
        else:
            gone = held.pop(r.pid, [])
            free.extend(gone)
            want += [(r.at, "delete", r.pid, x) for x in gone or [None]]
    assert [(r.at, r.op, r.pid, r.image_id) for r in got] == want
    assert Store.calls < 300

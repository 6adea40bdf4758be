from collections import Counter, deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions.lsh import HyperPlane, RepeatHash, Sparse, StableDistribution
from kindred.operators import histograms, tuning
from kindred.plans.model_queries import HISTOGRAM
from kindred.sources import url_queue
from kindred.streaming import observe, stateful

START = datetime(2024, 1, 1)


def run(stream, at, **options):
    with stateful.keyed_state(stream.sparkSession):
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return q


def test_first_seen_lives_so_long_and_survives_restarts(spark, tmp_path):
    schema = "user string, ts timestamp, n long"
    at = str(tmp_path)
    files = [[("a", 0, 1), ("b", 5, 2), ("a", 3, 3)], [("a", 50, 4), ("c", 60, 5), (None, 61, 6)], [("a", 130, 7), ("b", 131, 8)], [("c", 140, 9), ("z", 400, 10)], [("c", 420, 11), ("z", 430, 12)]]
    got = []
    for k, rows in enumerate(files):  # each run goes on from the state of the one before
        spark.createDataFrame([(u, START + timedelta(seconds=s), n) for u, s, n in rows], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        run(stateful.first_seen(stream, "user", "ts", 100, "1 hour"), at)
        got.append({r.n for r in spark.read.schema(schema).parquet(f"{at}/out").collect()})
    given, want = {}, set()
    for rows, now in zip(files, got):
        first = {}
        for u, s, n in rows:
            if u and (u not in first or s < first[u][0]):
                first[u] = (s, n)
        for u, (s, n) in first.items():
            if u not in given or s >= given[u] + 100:
                given[u] = s
                want.add(n)
        assert now == want


@pytest.mark.parametrize("shards", [1, 4])
def test_ids_are_used_again_over_restarts(spark, tmp_path, shards):
    r = np.random.default_rng(shards)
    ops = [(i, str(r.choice(["insert", "insert", "delete"])), f"p{r.integers(6)}") for i in range(120)] + [(500, "insert", None), (501, "other", "p1")]
    at = str(tmp_path)
    schema = "at long, op string, pid string"
    for k in range(5):
        spark.createDataFrame([o for o in ops if o[0] % 500 // 24 == k], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        if k in (1, 4):
            run(stateful.allocated(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), 100, shards), at)
    shard_of = {r.pid: r.s for r in spark.createDataFrame([(f"p{i}",) for i in range(6)], "pid string").select("pid", F.pmod(F.xxhash64("pid"), F.lit(shards)).alias("s")).collect()}
    queues, new, held, want = [deque() for _ in range(shards)], [0] * shards, {}, []
    for i, op, pid in ops[:120]:
        s = shard_of[pid]
        if op == "insert":
            if queues[s]:
                given = queues[s].popleft()
            else:
                given, new[s] = 100 + s + shards * new[s], new[s] + 1
            held.setdefault(pid, []).append(given)
            want.append((i, op, pid, given))
        else:
            gone = held.pop(pid, [])
            queues[s].extend(gone)
            want += [(i, op, pid, g) for g in gone] or [(i, op, pid, None)]
    got = [tuple(x) for x in spark.read.schema("at long, op string, pid string, image_id long").parquet(f"{at}/out").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def spool(path, texts):
    path.mkdir(exist_ok=True)
    for k, t in texts.items():
        (path / k).write_bytes(t)


@pytest.mark.parametrize("span", [1, 3, 7, 1000])
def test_spans_share_urls_out(tmp_path, monkeypatch, span):
    monkeypatch.setattr(url_queue, "LOOK", 5)
    text = b"  http://a/1\nhttp://bb/22  http://ccc/\xc3\xa9 \t\nd\n\n http://long/" + b"x" * 40 + b"\n e  http://end"
    spool(tmp_path / "s", {"f1": text, "f2": b"", "f3": b" \n ", "_hidden": b"no"})
    reader = url_queue.UrlQueueReader({"path": str(tmp_path / "s"), "span_bytes": str(span)})
    end = reader.latestOffset()
    got = [u for p in reader.partitions(reader.initialOffset(), end) for b in reader.read(p) for u in b.column(0).to_pylist()]
    assert got == text.decode().split()
    small = url_queue.UrlQueueReader({"path": str(tmp_path / "s"), "span_bytes": str(span), "max_bytes": "9"})
    at, seen, batches = small.initialOffset(), [], 0
    while (to := small.latestOffset()) != at:
        seen += [u for p in small.partitions(at, to) for b in small.read(p) for u in b.column(0).to_pylist()]
        at, batches = to, batches + 1
    assert seen == got and batches > 3


def test_each_url_comes_once_over_restarts(spark, tmp_path):
    at, urls = str(tmp_path), [f"http://h{i % 7}/{i}" for i in range(400)]
    spool(tmp_path / "spool", {f"f{k}": "\n".join(urls[100 * k:100 * k + 100]).encode() for k in range(3)})
    fail = {"on": True}

    def out(batch, number):
        if number == 2 and fail["on"]:
            fail["on"] = False
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{at}/out/{number}")

    def go():
        q = url_queue.url_stream(spark, f"{at}/spool", f"{at}/state", 900, 200).writeStream.foreachBatch(out).option(
            "checkpointLocation", f"{at}/state").trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="lost"):
        go()
    go()  # replays the batch that failed
    spool(tmp_path / "spool", {"f3": "\n".join(urls[300:]).encode()})
    go()
    go()  # nothing is left
    import pathlib
    numbers = sorted(int(p.name) for p in pathlib.Path(f"{at}/out").iterdir())
    got = Counter(r.url for n in numbers for r in spark.read.parquet(f"{at}/out/{n}").collect())
    assert got == Counter(urls) and len(numbers) > 6


def test_observed_counts(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None) for i in range(50)], "i long, op string")
    told = {r.metric: r.value for r in observe.observed(df, lambda d: d.write.parquet(f"{tmp_path}/w"), *observe.count_columns("op", ["a", "b"])).collect()}
    assert told.pop("seconds") > 0 and told == {"rows": 50, "a": 20, "b": 20, "other": 10}
    assert spark.read.parquet(f"{tmp_path}/w").count() == 50


def test_sparse_hashes_equal_dense_ones(spark):
    r = np.random.default_rng(0)
    x = r.integers(-3, 4, (20, 12)) * (r.random((20, 12)) < 0.3)
    rows = [(i, [(int(j), int(v[j])) for j in np.flatnonzero(v)] + [(99, 5), (-1, 7)], v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, s array<struct<index: bigint, value: bigint>>, d array<bigint>")
    for h in (StableDistribution(tuple(r.integers(-9, 10, 12).tolist()), 2, 7), HyperPlane(tuple(r.integers(-9, 10, 12).tolist())), StableDistribution.draw(12, 4.0, 1)):
        got = df.select(Sparse(h).hash(F.col("s")).alias("a"), h.hash(F.col("d")).alias("b"), Sparse(h).delta(F.col("s")).alias("c"), h.delta(F.col("d")).alias("d")).collect()
        assert all(g.a == g.b and g.c == pytest.approx(g.d) for g in got)


def test_histogram_distances(spark):
    sets = tuple(tuple(RepeatHash((StableDistribution(tuple(np.random.default_rng(9 * n + m).integers(-5, 6, 3).tolist()), 0, 40),), (2654435761,), 8) for m in range(2)) for n in range(3))
    of = histograms.RandomHistogram(sets, 8)
    x = np.random.default_rng(1).integers(-50, 51, (60, 3))
    df = spark.createDataFrame([(i % 4, i % 3 + 1, v.tolist()) for i, v in enumerate(x)] + [(0, 5, None)], "g int, w long, v array<bigint>")
    held = histograms.histograms(df, ["g"], "v", F.col("w"), of)
    dense = np.zeros((4, of.dim()), int)
    for i, v in enumerate(x):
        for n, hashes in enumerate(sets):
            for h in hashes:
                dense[i % 4, 8 * n + (int(np.floor((np.dot(h.of[0].a, v)) / 40)) * 2654435761 % 2**32) % 8] += i % 3 + 1
    got = np.zeros_like(dense)
    for r in held.collect():
        got[r.g, r.bin] = r.weight
    assert (got == dense).all() and HISTOGRAM.dim() == 96
    assert {(r.a, r.b): r.l1 for r in histograms.distances(held, "g").collect()} == {(a, b): abs(dense[a] - dense[b]).sum() for a in range(4) for b in range(a + 1, 4)}


def test_tuned_index_keeps_its_promise(spark, sf):
    rows = spark.read.parquet(sf.replace("0.001", "0.01") + "/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    told = tuning.report(rows, 5, 0.9).first()
    assert told.predicted >= 0.9 and abs(told.predicted - told.measured) < 0.05
    centres = np.random.default_rng(3).normal(size=(50, 8)) * 10
    near = spark.createDataFrame([(i, (centres[i % 50] + np.random.default_rng(i).normal(size=8)).tolist()) for i in range(1500)], "id long, vec array<double>")
    told = tuning.report(near, 5, 0.9).first()
    assert told.measured >= 0.85 and told.met < 0.5  # an index pays where neighbours lie together

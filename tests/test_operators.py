import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import descriptors, text
from kindred.functions.bits import BLOCKS, hamming, unsigned_order
from kindred.operators import dedup, images, knn, linear, ordering, sampling, search, store
from kindred.operators.hamming_join import block_rows, hamming_join
from kindred.operators.sift import describe


def sketches(spark, n=300, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        base = [r.getrandbits(16) for _ in range(4)]
        rows.append((i, *base))
        for j in range(1, 10):
            flipped = list(base)
            for bit in r.sample(range(64), j):
                flipped[bit // 16] ^= 1 << bit % 16
            rows.append((i + j * 1000, *flipped))
    return rows, spark.createDataFrame(rows, "id long, b0 long, b1 long, b2 long, b3 long")


def brute(rows, t):
    words = np.array([sum(b << (16 * k) for k, b in enumerate(r[1:])) for r in rows], np.uint64)
    ids = [r[0] for r in rows]
    d = np.bitwise_count(words[:, None] ^ words[None])
    return {(ids[a], ids[b]) for a, b in np.argwhere(d <= t)}


@pytest.mark.parametrize("t", [0, 3, 7, 8])
def test_hamming_join_is_exact(spark, t):
    rows, df = sketches(spark)
    found = [(r.q_id, r.id) for r in hamming_join(df, df, t).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows, t)


def test_blocks_without_flips_lose_pairs(spark):
    rows, df = sketches(spark)
    q = block_rows(df).select("block", "block_key", F.col("id").alias("q_id"), *[F.col(b).alias(f"q{b}") for b in BLOCKS])
    found = q.join(block_rows(df), ["block", "block_key"]).where(
        hamming([F.col(f"q{b}") for b in BLOCKS], [F.col(b) for b in BLOCKS]) <= 7).select("q_id", "id").distinct().count()
    assert found < len(brute(rows, 7))


def test_ranking_edges(spark):
    counted = spark.createDataFrame([(1, 10, 5), (1, 11, 1), (1, 12, 9), (1, 13, 2), (1, 14, 3), (1, 15, 5), (1, 16, 5)],
                                    "query_id long, image_id long, votes long")
    held = spark.createDataFrame([(10, "a", 1), (11, "b", 4), (12, "c", 4), (13, "d", 45), (14, "", 4), (15, "e", 10), (16, "e", 10)],
                                 "image_id long, pid string, siftnum long")
    got = [(r.image_id, r.pid, r.score, r["rank"]) for r in search.rank_images(counted, held).orderBy("rank").collect()]
    assert got == [(12, "c", 1.0, 1), (15, "e", 0.5, 2), (16, "e", 0.5, 3)]


def test_positions_and_sampling(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = {r.k: r.position for r in ordering.positions(df, F.col("k")).collect()}
    assert got == {i: i for i in range(1000)}
    assert sorted(r.k for r in ordering.every_nth(df, 100, F.col("k")).collect()) == list(range(0, 1000, 100))
    assert ordering.positions(df.limit(0), F.col("k")).count() == 0
    back = sampling.rebase(sampling.expire(df, "k", 300), "k", 300)
    assert sorted(r.k for r in back.collect()) == list(range(300, 1000))


def test_unsigned_order(spark):
    signed = spark.createDataFrame([(0,), (-1,), (1,), (-(2**63),), (2**63 - 1,)], "f long")
    assert [r.f % 2**64 for r in signed.orderBy(unsigned_order(F.col("f"))).collect()] == sorted([0, 2**64 - 1, 1, 2**63, 2**63 - 1])


def test_descriptor_goldens(spark):
    df = spark.createDataFrame([([0.5] * 128,), ([i / 255 for i in range(128)],), ([1.0] + [0.0] * 127,)], "d array<double>")
    e = [r[0] for r in df.select(descriptors.entropy(F.col("d"))).collect()]
    assert e[0] == pytest.approx(0) and e[1] == pytest.approx(7) and e[2] == pytest.approx(0.0659, abs=1e-3)
    low = df.select(descriptors.log_scale(F.col("d")).alias("x")).collect()[2].x
    assert low[0] == 1.0 and low[1] == 0.0
    assert df.select(descriptors.quantise(F.col("d")).alias("x")).collect()[0].x[0] == 0.5


def test_urls_status_and_sizes(spark):
    df = spark.createDataFrame([("http://a/b/x.jpg?q",), ("plain",), ("http://a/b&c",), ("",)], "u string")
    assert [r[0] for r in df.select(text.pid_from_url(F.col("u"))).collect()] == ["x", "", "b&c", ""]
    assert [r[0] for r in df.select(text.pid_from_url_v1(F.col("u"))).collect()] == ["x", "plain", "b", ""]
    sizes = [(100, 80), (240, 120), (1000, 200), (200, 1100), (20000, 100), (121, 121)]
    d = spark.createDataFrame(sizes, "w long, h long")
    w, h = text.resized(F.col("w"), F.col("h"))
    got = [tuple(r) for r in d.select(w, h).collect()]
    assert got == [(100, 80), (120, 60), (500, 100), (100, 500), (20000, 100), (120, 120)]
    assert got == [images.fit_size(*s) for s in sizes]
    codes = spark.createDataFrame([(0,), (7,), (99,)], "c int").select(text.status_name(F.col("c"))).collect()
    assert [r[0] for r in codes] == ["REPLY_OK", "REPLY_INVALID_PID", ""]


def test_greedy_dedup_depends_on_order_and_is_idempotent(spark):
    rows = [("up", i, v) for i, v in enumerate([0, 1, 3, 7, 15])] + [("down", i, v) for i, v in enumerate([15, 7, 3, 1, 0])]
    once = sampling.greedy_dedup(spark.createDataFrame(rows, "r string, i long, b long"), "r", ["i"], ["b"], 1)
    kept = lambda df: {r: [x.b for x in sorted(df.collect(), key=lambda x: x.i) if x.r == r] for r in ("up", "down")}
    assert kept(once) == {"up": [0, 3, 15], "down": [15, 3, 0]} == kept(sampling.greedy_dedup(once, "r", ["i"], ["b"], 1))


@pytest.mark.parametrize("listed", [1000, 2])
def test_blacklist_of_any_length(spark, monkeypatch, listed):
    monkeypatch.setattr(sampling, "LISTED", listed)
    x = np.random.default_rng(0).integers(-3, 4, (60, 4))
    bad = np.random.default_rng(1).integers(-3, 4, (7, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(float))], "id long, vec array<double>")
    black = spark.createDataFrame([(v.tolist(),) for v in bad.astype(float)], "u array<double>")
    got = {r.id for r in sampling.without_listed(rows, black, "id", "vec", "u", 6).collect()}
    assert got == set(np.flatnonzero((((x[:, None] - bad[None]) ** 2).sum(2) >= 6).all(1)).tolist())


def test_store(spark):
    images = spark.createDataFrame([(1, "a", "f", 1), (2, "b", "f", 0), (3, "a", "g", 1)], "image_id long, pid string, fingerprint string, siftnum long")
    marks = spark.createDataFrame([(256, 1, 2, 3, 4), (768, 5, 6, 7, 8)], "sketch_id long, b0 long, b1 long, b2 long, b3 long")
    held = store.Store(images, marks, spark.createDataFrame([], "image_id long"), 4)
    left, reply = store.delete_by_pid(held, spark.createDataFrame([("a",), ("z",)], "pid string"))
    assert [r.image_id for r in left.images.collect()] == [2] and left.sketches.count() == 0 == left.postings().count()
    assert {(r.pid, r.reply) for r in reply.collect()} == {("a", "REPLY_OK"), ("z", "REPLY_INVALID_PID")}
    records = spark.createDataFrame([(1, "x", "h"), (2, "", "h"), (3, "y", "h"), (4, "z", None), (5, None, "h")], "request long, pid string, fingerprint string")
    new = spark.createDataFrame([(1, 0, 9, 9, 9, 9), (1, 1, 8, 8, 8, 8), (2, 0, 7, 7, 7, 7)], "request long, ord long, b0 long, b1 long, b2 long, b3 long")
    full, reply = store.insert(left, records, new)
    assert sorted((r.request, r.image_id, r.reply) for r in reply.collect() if r.image_id) == [(1, 1, "REPLY_OK"), (3, 3, "REPLY_OK"), (4, 4, "REPLY_OK")]
    assert {r.request for r in reply.collect() if r.reply == "REPLY_INVALID_PID"} == {2, 5}
    assert sorted((r.image_id, r.pid, r.siftnum) for r in full.images.collect()) == [(1, "x", 2), (2, "b", 0), (3, "y", 0), (4, "z", 0)]
    assert sorted(r.sketch_id for r in full.sketches.collect()) == [256, 257] and full.postings().count() == 8
    assert full.free.count() == 0 and full.next_id == 5
    settings = store.settings_put(spark.createDataFrame([("k", "1")], "key string, value string"), "k", "2")
    assert [tuple(r) for r in settings.collect()] == [("k", "2")]


def test_sorted_index_reads_only_its_range(spark, tmp_path):
    from kindred.operators import sorted_index
    rows, df = sketches(spark, 60)
    sorted_index.save(df, str(tmp_path / "i"))
    part = sorted_index.between(spark, str(tmp_path / "i"), "b1", 100, 20000)
    assert "PushedFilters: [IsNotNull(b1), GreaterThanOrEqual(b1,100), LessThanOrEqual(b1,20000)]" in part._jdf.queryExecution().toString()
    assert sorted(r.id for r in part.collect()) == sorted(r[0] for r in rows if 100 <= r[2] <= 20000)
    found = [(r.q_id, r.id) for r in sorted_index.search(df, str(tmp_path / "i"), 3).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, 3)


@pytest.mark.parametrize("width", [8192, 5])
def test_running_ratio(spark, width):
    flags = [random.Random(i).random() < 0.4 for i in range(300)]
    placed = spark.createDataFrame(list(enumerate(flags)), "position long, seen boolean").repartition(4)
    got = {r.position: r.distinct_so_far for r in dedup.running_ratio(placed, "seen", width=width).collect()}
    assert got == {i: sum(not f for f in flags[:i + 1]) for i in range(300)}


def test_statistics_of_one_value(spark):
    r = dedup.statistics(spark.createDataFrame([(2.0,)], "v double"), "v").first()
    assert (r.n, r.deviation) == (1, 0.0)


def test_images(spark):
    flat, ramp = np.full((60, 80), 7, np.uint8), np.tile(np.arange(80, dtype=np.uint8), (60, 1))
    assert images.area_resize(flat, 8, 12).tolist() == [[7] * 8] * 12
    assert images.fingerprint(flat) == 0
    row = images.fingerprint(ramp) & 255
    assert row == 0b11110000 and images.fingerprint(ramp) == int("f0" * 8, 16)
    assert images.fingerprint(ramp, "mean") >> 56 == int(images.area_resize(ramp, 8, 12)[:7].sum()) // 56
    assert images.fingerprint(np.full((50, 40), 255, np.uint8), "nibbles") == 2**64 - 1
    colour = np.zeros((10, 10, 3), np.uint8)
    colour[:, :, 2] = 255
    h = images.hue_saturation(colour)
    assert h.sum() == pytest.approx(0) or h.sum() == pytest.approx(1)
    r = np.random.default_rng(0)
    found = list(describe(np.kron(r.integers(0, 255, (12, 12)), np.ones((8, 8))).astype(float)))
    assert found and all(d.shape == (128,) and 0 <= d.min() and d.max() <= 1 for *_, d in found)
    assert not list(describe(flat.astype(float)))


def test_linear_sketches(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(50, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    m, t = r.normal(size=(128, 16)), r.normal(size=128)
    got = {g.id: bytes(g.sketch) for g in linear.projection_sketch(df, "vec", m, t).collect()}
    assert got == {i: np.packbits(v @ m.T + t <= 0).tobytes() for i, v in enumerate(x)}
    mean, axes = linear.principal_axes(df, "vec", 3)
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.abs(axes[0] @ np.linalg.svd(x - x.mean(0))[2][0]), 1)
    cells = {g.id: g.cell for g in linear.nearest_mean(df, "vec", x[:5]).collect()}
    assert [cells[i] for i in range(5)] == [0, 1, 2, 3, 4]


def test_nearest_within_and_recall(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, vec array<double>")
    pairs = knn.pairs_by_block(df, df, block_rows=6)
    assert pairs.count() == 20 * 19
    near = knn.nearest(pairs, 2, descriptors.l2_squared)
    assert {r.id for r in near.where("q_id = 10").collect()} == {9, 11}
    assert knn.nearest(pairs, None, descriptors.l2_squared, within=4.1).where("q_id = 10").count() == 4
    for block in (6, 4096):
        got = knn.exhaustive(df, df, k=2, block_rows=block)
        assert sorted(map(tuple, got.select("q_id", "id", "dist", "rank").collect())) == sorted(map(tuple, near.select("q_id", "id", "dist", "rank").collect()))
    assert knn.exhaustive(df, df, within=4.1).where("q_id = 10").count() == 4 and knn.exhaustive(df.limit(0), df, k=1).count() == 0
    assert {r.recall for r in knn.recall(near, near.where("rank = 1")).collect()} == {0.5}

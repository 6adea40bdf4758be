import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions.lsh import HyperPlane, StableDistribution
from kindred.operators import knn, pruned
from kindred.operators.index_store import FlatIndex, ForestIndex
from kindred.operators.lsh_model import RecallTable, search_to_recall
from kindred.operators.store import Store
from kindred.operators.versions import Conflict, VersionedStore


def held(spark, n=20):
    images = spark.createDataFrame([(i, f"p{i % 7}", f"f{i}", 2) for i in range(n)], "image_id bigint, pid string, fingerprint string, siftnum bigint")
    marks = spark.createDataFrame([((i << 8) + o, i, o, 1, 2) for i in range(n) for o in range(2)], "sketch_id bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint")
    return Store(images, marks, spark.createDataFrame([(900,), (901,)], "image_id bigint"), 1000)


def records(spark, pids, first=0):
    r = spark.createDataFrame([(first + i, p, f"new{first + i}") for i, p in enumerate(pids)], "request bigint, pid string, fingerprint string")
    return r, r.select("request", F.lit(0).cast("bigint").alias("ord"), *[F.lit(k).cast("bigint").alias(f"b{k}") for k in range(4)])


class Plain:
    """The same store as Python's own lists."""

    def __init__(self, n=20):
        self.images = {i: (f"p{i % 7}", f"f{i}", 2) for i in range(n)}
        self.marks = {(i << 8) + o for i in range(n) for o in range(2)}
        self.free, self.next = {900, 901}, 1000

    def insert(self, pids, first):
        pool = sorted(self.free)
        for k, p in enumerate(pids):
            i = pool[k] if k < len(pool) else self.next + k - len(pool)
            self.images[i] = (p, f"new{first + k}", 1)
            self.marks.add(i << 8)
        self.next += max(0, len(pids) - len(pool))
        self.free -= set(pool[:len(pids)])

    def delete(self, pid):
        gone = {i for i, v in self.images.items() if v[0] == pid}
        self.images = {i: v for i, v in self.images.items() if i not in gone}
        self.marks = {m for m in self.marks if m >> 8 not in gone}
        self.free |= gone


def same(kept, plain):
    s = kept.load()
    assert {r.image_id: (r.pid, r.fingerprint, r.siftnum) for r in s.images.collect()} == plain.images
    assert {r.sketch_id for r in s.sketches.collect()} == plain.marks
    assert {r.image_id for r in s.free.collect()} == plain.free and s.next_id == plain.next


def depth(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_twenty_changes_keep_the_plan_as_deep(spark, tmp_path):
    kept, plain = VersionedStore(spark, str(tmp_path / "s")), Plain()
    kept.create(held(spark))
    depths = []
    for turn in range(10):
        pids = [f"p{turn % 7}", "x", f"q{turn}"]
        kept.insert(*records(spark, pids, 100 * turn))
        plain.insert(pids, 100 * turn)
        gone = f"p{(turn + 3) % 7}" if turn % 2 else "x"
        replies = kept.delete_by_pid(spark.createDataFrame([(gone,), ("none",)], "pid string"))
        assert {r.pid: r.reply for r in replies.collect()}["none"] == "REPLY_INVALID_PID"
        plain.delete(gone)
        depths.append(depth(kept.load().images))
        if turn in (4, 9):
            same(VersionedStore(spark, kept.path), plain)
    assert len(set(depths)) == 1
    before = kept.load(3).images.count()
    kept.compact()
    same(kept, plain)
    assert depth(kept.load().images) <= depths[0] and kept.load(3).images.count() == before
    assert len(kept.vacuum()) > 20 and kept.log.versions() == [kept.version().number]
    same(VersionedStore(spark, kept.path), plain)


def test_upsert_rotate_and_conflicts(spark, tmp_path):
    kept = VersionedStore(spark, str(tmp_path / "s"))
    kept.create(held(spark, 4))
    kept.upsert(spark.createDataFrame([(1, None, "changed"), (77, "p", None)], "image_id bigint, pid string, fingerprint string"))
    kept.upsert(spark.createDataFrame([(1, 9)], "image_id bigint, siftnum bigint"))
    got = {r.image_id: tuple(r)[1:] for r in kept.load().images.collect()}
    assert got[1] == ("p1", "changed", 9) and got[77] == ("p", None, None) and got[0] == ("p0", "f0", 2) and len(got) == 5
    assert kept.load().sketches.count() == 8  # attributes change, sketches stay
    kept.rotate()
    kept.insert(*records(spark, ["new"], 5))
    assert kept.load().images.count() == 6 and kept.load(generation=0).images.count() == 1 and kept.load(generation=1).images.count() == 5
    kept.delete_by_pid(spark.createDataFrame([("p0",)], "pid string"))
    kept.compact()
    assert kept.load(generation=1).images.count() == 4 and {r.image_id for r in kept.load().free.collect()} == {0, 901}
    kept.rotate()
    assert [r.pid for r in kept.load().images.collect()] == ["new"]
    other = VersionedStore(spark, kept.path)
    v = other.version()
    kept.insert(*records(spark, ["late"], 9))
    with pytest.raises(Conflict):
        other._commit(v, 0, [])
    (tmp_path / "s" / "_versions" / f"v-{kept.version().number + 1:08d}.json").write_text("{\"chan")
    assert kept.load().images.count() == 2  # a version that was never finished is passed over
    with pytest.raises(FileNotFoundError):
        VersionedStore(spark, str(tmp_path / "none")).version()


def points(n, dim, seed, whole=True):
    x = np.random.default_rng(seed).integers(-60, 61, (n, dim))
    return [(i, v.tolist()) for i, v in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vec array<bigint>")


def found(df):
    return sorted((r.q_id, r.id, float(r.dist), r["rank"]) for r in df.collect())


def test_an_appended_index_equals_the_whole_one(spark, tmp_path):
    rows = points(300, 6, 1)
    df = frame(spark, rows)
    hashes = [StableDistribution(tuple(np.random.default_rng(t).integers(-5, 6, 6).tolist()), 3, 150) for t in range(4)]
    index = FlatIndex(spark, str(tmp_path / "i"))
    index.create(hashes, 8)
    first = index.append(df.where("id < 150"))
    before = {k: list(v) for k, v in index.log.read()[1]["parts"].items()}
    touched = index.append(df.where("id >= 150 and id < 160"))
    after = index.log.read()[1]["parts"]
    assert set(touched) < set(first) and all(after[k] == before[k] for k in before if k not in touched)
    index.append(df.where("id >= 160"))
    want = found(knn.lsh_nearest(df, knn.tables(df, hashes), hashes, 5))
    assert found(FlatIndex(spark, index.log.path).nearest(df, 5)) == want
    many = {k for k, v in index.log.read()[1]["parts"].items() if len(v) > 2}
    assert many and set(index.compact(2)) == many and found(index.nearest(df, 5)) == want
    assert {len(v) for k, v in index.log.read()[1]["parts"].items() if k in many} == {1} and index.compact(2) == []


def plain_trie(keys, depth):
    """(prefix, key, n) of the nodes down to where one key is left."""
    out = []

    def walk(prefix):
        own = [k for k in keys if k.startswith(prefix)]
        if own:
            out.append((prefix, own[0] if len(set(own)) == 1 else None, len(own)))
            if len(set(own)) > 1:
                walk(prefix + "0")
                walk(prefix + "1")
    walk("")
    return sorted(out, key=str)


@pytest.mark.parametrize("head", [0, 2])
def test_forest_leaves_split_as_they_fill(spark, tmp_path, head):
    rows = points(90, 5, 2) + [(100 + i, [60, 60, 60, 60, 60]) for i in range(20)]
    trees = [[HyperPlane(tuple(np.random.default_rng(10 * t + i).integers(-5, 6, 5).tolist())) for i in range(6)] for t in range(3)]
    df = frame(spark, rows)
    index = ForestIndex(spark, str(tmp_path / "f"))
    index.create(trees, head)
    bits = [[(i, "".join("1" if int(np.dot(h.a, v)) >= 0 else "0" for h in t)) for i, v in rows] for t in trees]
    for part in (df.where("id < 30"), df.where("id >= 30")):
        old = dict(index.log.read()[1]["nodes"])
        touched = index.append(part)
        assert all(f == old[k] for k, f in index.log.read()[1]["nodes"].items() if k not in touched)
    got = {}
    for r in index.nodes().collect():
        got.setdefault(r.tab, []).append((r.prefix, r.key, r.n))
    assert {t: sorted(v, key=str) for t, v in got.items()} == {t: plain_trie([b for _, b in bits[t]], 6) for t in range(3)}
    for most in (150, 10_000) if head else ():
        assert found(index.nearest(df, most, 4)) == found(knn.forest_nearest(df, df, trees, most, 4))


def test_forest_recall(spark):
    r = np.random.default_rng(4)
    centres = r.integers(-400, 401, (30, 8))
    df = frame(spark, [(i, (centres[i % 30] + r.integers(-20, 21, 8)).tolist()) for i in range(600)])
    trees = [[HyperPlane(tuple(np.random.default_rng(10 * t + i).integers(-8, 9, 8).tolist())) for i in range(10)] for t in range(6)]
    truth = knn.exhaustive(df, df, 5)
    near = knn.recall(truth.select("q_id", "id"), knn.forest_nearest(df, df, trees, 200, 5)).agg(F.avg("recall")).first()[0]
    assert near >= 0.9


def test_pruned_search_is_exact_and_skips(spark):
    r = np.random.default_rng(6)
    centres = r.integers(-3000, 3001, (40, 4))
    rows = [(i, (centres[i % 40] + r.integers(-30, 31, 4)).tolist()) for i in range(800)] + [(900, rows_of_one()), (901, rows_of_one()), (902, None)]
    df = frame(spark, rows)
    told = []
    got = pruned.nearest(df, df, 5, pivots=40, told=told)
    want = knn.exhaustive(df.where("vec is not null"), df.where("vec is not null"), 5)
    assert found(got) == found(want)
    assert sum(n for _, n in told) < 0.25 * 802 * 40
    flat = frame(spark, [(i, [7, 7]) for i in range(30)])
    assert found(pruned.nearest(flat, flat, 3)) == found(knn.exhaustive(flat, flat, 3))
    assert pruned.nearest(flat, flat.limit(0), 3).count() == 0 and pruned.nearest(flat.limit(0), flat, 3).count() == 0
    few = frame(spark, points(3, 2, 9))
    assert found(pruned.nearest(few, few, 5)) == found(knn.exhaustive(few, few, 5))


def rows_of_one():
    return [1, 2, 3, 4]


def all_probes_then_cut(queries, rows, hashes, table, k, target):
    """The same search by taking every probe of every query first."""
    from pyspark.sql import Window
    most = table.values.shape[1] - 1
    once = knn.nearest_in_bins(knn.probed(queries, hashes, most), knn.digit_tables(rows, hashes), k).groupBy("q_id", "id").agg(
        F.min("dist").alias("dist"), F.min("probe").alias("probe"))
    levels = once.withColumn("probes", F.explode(F.sequence(F.col("probe"), F.lit(most))))
    best = levels.withColumn("rank", F.row_number().over(Window.partitionBy("q_id", "probes").orderBy("dist", "id"))).where(F.col("rank") <= k)
    expected = best.groupBy("q_id", "probes").agg((F.sum(table.lookup(F.sqrt("dist"), F.col("probes"))) / k).alias("recall"))
    stop = expected.groupBy("q_id").agg(F.coalesce(F.min(F.when(F.col("recall") >= target, F.col("probes"))), F.lit(most)).alias("probes"))
    return best.join(stop, ["q_id", "probes"])


def test_queries_that_are_done_leave(spark):
    table = RecallTable.simulate(1.0, 3, 4, 0.05, 3.0)
    x = np.random.default_rng(2).normal(size=(60, 6)) * 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    hashes = [[StableDistribution.draw(6, 1.0, s) for s in range(3)]]
    asked = {}
    for target in (0.2, 2.0):
        told = []
        got = search_to_recall(df, df, hashes, table, 3, target, told)
        want = all_probes_then_cut(df, df, hashes, table, 3, target)
        assert sorted((r.q_id, r.id, r["rank"], r.probes) for r in got.collect()) == sorted((r.q_id, r.id, r["rank"], r.probes) for r in want.collect())
        asked[target] = sum(told)
        assert told == sorted(told, reverse=True)
    assert asked[0.2] < asked[2.0] == 60 * 5

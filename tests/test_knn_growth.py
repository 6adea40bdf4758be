import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import knn


def vectors(spark, n, dim=8, seed=1):
    return spark.range(n).select("id", F.array(*[F.floor(200 * F.rand(seed + i)) for i in range(dim)]).alias("vec")).localCheckpoint()


def shuffled(spark, run):
    """Bytes that all stages of run() write for shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    sc._jsc.sc().listenerBus().waitUntilEmpty()

    def total():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))
    before = total()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def asks(v, bins):
    return v.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"), F.lit(0).alias("tab"), (F.col("id") % bins).alias("bin"), F.lit(0).alias("probe"))


@pytest.mark.parametrize("run", [
    lambda v: knn.exhaustive(v, v, 3, block_rows=64),
    lambda v: knn.nearest_in_bins(asks(v, 4), v.select(F.lit(0).alias("tab"), (F.col("id") % 4).alias("bin"), "id", "vec"), 3, block_rows=64)])
def test_shuffles_grow_no_faster_than_the_rows(spark, run):
    small, large = vectors(spark, 4000), vectors(spark, 16_000)
    a, b = (shuffled(spark, lambda: run(v).write.format("noop").mode("overwrite").save()) for v in (small, large))  # noqa: B023
    assert b < 6 * a


@pytest.mark.parametrize("scale", [1, 1.37, 1e5])
def test_near_ties_and_own_rows(scale):
    r = np.random.default_rng(3)
    x = r.integers(-2, 3, (300, 3)) * scale
    ids = np.sort(r.integers(0, 250, 300))  # some ids twice
    vec, norm = knn._exact(x)
    assert (vec.dtype == np.float32) == (scale == 1)
    d = np.rint((np.maximum(((x[:, None] - x) ** 2).sum(axis=2), 0)) / scale**2)
    for k, within in ((4, None), (None, 3 * scale**2 - 0.5 * scale**2), (2, 1.5 * scale**2)):
        got = {}
        for row, col, dist in knn._near((ids, vec, norm), (ids, vec, norm), k, within):
            for i, j, z in zip(row.tolist(), col.tolist(), dist.tolist()):
                got.setdefault(i, []).append((round(z / scale**2), j))
        for i in range(300):
            want = sorted((int(d[i, j]), j) for j in range(300) if ids[j] != ids[i] and (within is None or d[i, j] * scale**2 < within))
            found = sorted(got.get(i, []))
            assert [z for z, _ in found] == [z for z, _ in want][:k]
            if scale == 1:
                assert found == want[:k]


def test_a_range_search_ranks_what_several_cells_find(spark):
    v = vectors(spark, 900, 4)
    got = knn.exhaustive(v, v, within=4000.0, block_rows=100).collect()
    x = {r.id: np.array(r.vec) for r in v.collect()}
    want = {(a, b, float(((x[a] - x[b]) ** 2).sum())) for a in x for b in x if a != b and ((x[a] - x[b]) ** 2).sum() < 4000}
    assert {(r.q_id, r.id, r.dist) for r in got} == want
    by = {}
    for r in got:
        by.setdefault(r.q_id, []).append(r)
    assert all([r["rank"] for r in sorted(f, key=lambda r: (r.dist, r.id))] == list(range(1, len(f) + 1)) for f in by.values())

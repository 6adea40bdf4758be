import numpy as np
import pytest

from kindred.llm import multi_index, topk, whitening
from kindred.llm.oracles import ORACLE_SQL
from kindred.llm.queries import QUERIES
from oracle import duck, rows_of


def live(rows):
    return [(i, v) for i, v in rows if i is not None and v and any(v) and all(x is not None and np.isfinite(x) for x in v)]


def in_order(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def brute_nearest(rows, k, step):
    ok, asks = live(rows), {}
    for i, v in ok:
        if i % step == 0:
            asks[i] = min(asks.get(i, v), v)
    out = []
    for q, x in asks.items():
        best = sorted((-in_order(x, y), i) for i, y in ok if i != q and len(y) == len(x))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def vector_rows(n=150, width=8):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=width).tolist()) for i in range(n)] + [(500 + i, [0.5] * width) for i in range(40)]
    rows += [(300, None), (301, [None] + [1.0] * (width - 1)), (302, [float("nan")] * width), (303, [float("inf")] * width), (320, []), (340, [0.0] * width)]
    rows += [(304, [9.0, 1.0, 2.0]), (400, [1.0, 2.0, 3.0]), (None, [5.0] * width), (360, [2.0]), (361, [3.0]), (362, [-1.0])]
    rows += [(501, [0.5] * width), (20, rows[20][1]), (20, rows[21][1]), (40, rows[20][1])]  # repeated rows and ids
    return rows


@pytest.mark.parametrize("sizes", [(8192, 8192), (16, 3)])
def test_multi_index_equals_brute_force_where_all_is_found(spark, monkeypatch, sizes):
    monkeypatch.setattr(multi_index, "TILE_ROWS", sizes[0])
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", sizes[1])
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1, 2, "s", 3) for i, v in rows], "vec_id long, embedding array<double>, id long, tile int, cell string, score long")
    got = sorted(map(tuple, multi_index.nearest(df, k=5, recall=1.0).collect()))
    assert got == brute_nearest(rows, 5, 20)
    assert multi_index.nearest(df.limit(0)).count() == 0
    assert multi_index.nearest(df.where("vec_id = 340 or vec_id is null")).count() == 0


def test_multi_index_recall(spark, sf):
    df = spark.read.parquet(sf.replace("0.001", "0.01") + "/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = {(q, i) for q, _, i, _ in brute_nearest(rows, 20, 20)}
    got = QUERIES["op11_multi_index"](spark, sf.replace("0.001", "0.01")).collect()
    scores = {i: v for i, v in rows}
    assert all(g.score == in_order(scores[g.query_id], scores[g.vec_id]) for g in got)
    assert len(got) == len(want) and len({(g.query_id, g.vec_id) for g in got} & want) >= 0.9 * len(want)


def test_cells_come_off_the_heap_by_nearness():
    r = np.random.default_rng(5)
    index = multi_index.MultiIndex(r.normal(size=(6, 4)), r.normal(size=(7, 4)))
    counts, q = r.integers(0, 5, (6, 7)), r.normal(size=8)
    near = (index.first @ q[:4])[:, None] + (index.second @ q[4:])[None, :]
    for most in (0, 1, 17, 40, counts.sum()):
        order, reach = index.visited(q, counts, most)
        got = {(i, order[c]) for i in range(6) for c in range(reach[i])}
        cells, want, seen = np.argsort(-near, axis=None), set(), 0
        for c in cells:
            if seen >= most:
                break
            want.add(divmod(c, 7))
            seen += counts.ravel()[c]
        assert got == want


def test_a_query_id_given_twice_asks_with_the_least_vector(spark, tmp_path):
    rows = [(0, [0.4, 0.1]), (0, [-0.9, 0.3]), (1, [0.5, 0.5]), (2, [-0.5, 0.2]), (3, [0.1, -0.6]), (3, [0.1, -0.6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [int(np.floor(256 * x)) for x in (-0.9, 0.3)]
    best = sorted((-sum(int(np.floor(256 * x)) * y for x, y in zip(v, asked)), i) for i, v in rows if i)
    got = sorted(map(tuple, topk.top_k(df, k=3).collect()))
    assert got == [(0, r + 1, i, -s) for r, (s, i) in enumerate(best[:3])]
    df.coalesce(1).write.parquet(f"file://{tmp_path}/e")
    c = duck("/root/testdata/sf0.001")
    c.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    c = c.execute(ORACLE_SQL["op1_exact_topk"])
    names = [d[0] for d in c.description]
    assert rows_of(names, c.fetchall()) == rows_of(["query_id", "rank", "vec_id", "score"], topk.top_k(df).collect())


def brute_white(rows, most=16):
    """(vec_id, component): values for rows of one dimension, by plain numpy on the distinct integer vectors."""
    x = [(i, tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v)) for i, v in rows]
    fit = np.array(sorted({v for _, v in x}), object)
    n, sums = len(fit), fit.sum(0)
    moved = (fit * n - sums).astype(float) / n
    cov = moved.T @ moved / n
    values, vectors = np.linalg.eigh(cov)
    best = [k for k in np.argsort(-values) if values[k] > 1e-9 * np.trace(cov)][:most]
    out = []
    for i, v in x:
        z = np.array(v, object) * n - sums
        for c, k in enumerate(best):
            out.append((i, c + 1, n, int((z * z).sum()), float((z.astype(float) / n) @ vectors[:, k] / values[k] ** 0.5), values[k] / np.trace(cov)))
    return out


def same_white(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    by = {}
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:4] == w[:4] and abs(g[5] - w[5]) < 1e-9 * w[5] and g[6] < 1e-6
        assert abs(abs(g[4]) - abs(w[4])) < 1e-7
        if abs(w[4]) > 1e-6:
            by.setdefault(g[1], set()).add(np.sign(g[4]) == np.sign(w[4]))
    assert all(len(signs) == 1 for signs in by.values())  # either sign, but one for all rows


@pytest.mark.parametrize("pairs_at_once", [4096, 7])
def test_whitening(spark, monkeypatch, pairs_at_once):
    monkeypatch.setattr(whitening, "PAIRS_AT_ONCE", pairs_at_once)
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=5) * [5, 4, 3, 2, 1]).tolist()) for i in range(90)] + [(None, [1.0, 2.0, 3.0, 4.0, 5.0])]
    rows += [(7, rows[7][1]), (200, rows[8][1])]
    odd = [(300, None), (301, [None] + [1.0] * 4), (302, [float("nan")] * 5), (303, [float("-inf")] * 5), (304, []), (305, [1e300] * 5), (306, [1.0] * 9)]
    df = spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows + odd], "vec_id long, embedding array<double>, n long, x int, component string")
    same_white(whitening.whiten(df).collect(), brute_white(rows))
    same_white(whitening.whiten(df, components=2).collect(), brute_white(rows, 2))
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 306")).count() == 0  # one vector has no variance
    flat = [(i, [float(i % 7), 0.25, float(i % 5)]) for i in range(40)]  # a dimension without variance
    same_white(whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect(), brute_white(flat))


def test_whitening_deviations_stay_exact(spark):
    rows = [(i, [float(2**40 + i * 1024), float(i % 2)]) for i in range(64)] + [(99, [2.0**50, 0.0])]
    want = {}
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    for (i, _), v in zip(rows, x):
        d = sum((len(x) * c - sum(w[k] for w in x)) ** 2 for k, c in enumerate(v))
        want[i] = d if d < 2**63 else None
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {g.vec_id: g.deviation for g in got} == want
    few = [(i, [float(3 * i), 1.5 * i * i]) for i in range(50)]
    same_white(whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect(), brute_white(few))


def test_whitening_of_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same_white(QUERIES["op13_whitening"](spark, sf).collect(), brute_white(rows))

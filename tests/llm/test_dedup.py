import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from kindred.llm import embed_dedup, repeats, simhash, substring
from kindred.llm.shared import BATCH_SETTING, SLICE_BYTES, connected_components, small_batches, text_slices, written

LOW = -(2**63)


def pool(seed, n, words=40, size=60):
    r = random.Random(seed)
    passage = [f"p{r.randrange(words)}" for _ in range(30)]
    rows = []
    for i in range(n):
        w = [f"w{r.randrange(words)}" for _ in range(r.randrange(size))]
        if i % 3 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage[r.randrange(6):]
        if i % 4 == 0 and rows:
            w = rows[r.randrange(len(rows))][1].split()[r.randrange(3):]
        rows.append((i, " ".join(w)))
    return rows


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    ids = sorted({x for e in edges for x in e})
    at = {x: k for k, x in enumerate(ids)}
    want = dict(zip(ids, brute.least_reachable(len(ids), [(at[a], at[b]) for a, b in edges], ids)))
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in set(want) - set(got))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_fingerprints(seed, groups, size):
    r = random.Random(seed)
    out = set()
    for _ in range(groups):
        f = r.getrandbits(64)
        for _ in range(size):
            g = f
            for b in r.sample(range(64), r.randrange(4)):
                g ^= 1 << b
            out.add(g)
    return sorted(out)


@pytest.mark.parametrize("piece", [20_000, 7])
def test_links_are_exact(spark, monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)  # small pieces: large buckets are dealt in pairs of pieces
    f = near_fingerprints(1, 60, 20)
    rows = [(x - 2**64 if x >> 63 else x, i) for i, x in enumerate(f)]
    found = connected_components(simhash.link(spark.createDataFrame(rows, "fp long, id long"), 3))
    got = {r.node: r.component for r in found.collect()}
    d = np.bitwise_count(np.array(f, np.uint64)[:, None] ^ np.array(f, np.uint64)[None])
    want = brute.least_reachable(len(f), np.argwhere(d <= 3).tolist(), list(range(len(f))))
    assert [got.get(i, i) for i in range(len(f))] == want


def test_masks_miss_nothing():
    for radius, rows in ((3, 10), (3, 10**8), (3, 10**11), (7, 10**5)):
        masks = simhash._masks(radius, rows)
        r = random.Random(rows)
        for _ in range(300):
            x = sum(1 << b for b in r.sample(range(64), radius))
            assert any(x & m == 0 for m in masks)


def check_simhash(rows, df):
    rows = [(LOW if i is None else i, t) for i, t in rows]
    f = [brute.simhash(t) for _, t in rows]
    ids = [i for i, _ in rows]
    d = np.bitwise_count(np.array(f, np.uint64)[:, None] ^ np.array(f, np.uint64)[None])
    comp = brute.least_reachable(len(f), np.argwhere(d <= 3).tolist(), ids)
    back = lambda x: None if x == LOW else x
    want = sorted([(back(i), f"{x:016x}", back(c)) for i, x, c in zip(ids, f, comp)], key=str)
    assert sorted([tuple(r) for r in df.collect()], key=str) == want


def test_simhash_edges(spark, edge_rows, edge_docs, no_docs):
    check_simhash([r[:2] for r in edge_rows], simhash.components(edge_docs))
    assert simhash.components(no_docs).count() == 0


def test_simhash_pool(spark):
    rows = pool(5, 120)
    check_simhash(rows, simhash.components(spark.createDataFrame(rows, "doc_id long, text string")))


def test_near_copies(spark, edge_docs, no_docs):
    r = random.Random(9)
    rows = []
    for g in range(30):
        w = [f"v{r.randrange(3000)}" for _ in range(150)]
        for c in range(4):
            x = list(w)
            if c:
                x[r.randrange(150)] = f"edit{g}-{c}"
            rows.append((g * 10 + c, " ".join(x)))
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == [g * 10 for g in range(30)]
    out = simhash.drop_near_copies(edge_docs)
    ids = {x.doc_id for x in out.collect()}
    assert out.columns == edge_docs.columns and {1, 4, 7, 8, 10, 11} <= ids and not {2, 5, 6, 9, 13} & ids
    assert simhash.drop_near_copies(no_docs).count() == 0


def check_repeats(rows, df):
    want = sorted(brute.without_repeats(rows), key=str)
    assert sorted([tuple(r) for r in df.collect()], key=str) == want


def test_substring_edges(spark, edge_rows, edge_docs, no_docs):
    check_repeats([r[:2] for r in edge_rows], substring.digest_without_repeats(edge_docs))
    p, q = (" ".join(f"{c}{i}" for i in range(30)) for c in "pq")
    rows = [(1, p), (5, p), (5, q), (None, "n " + q), (None, p + " x"), (None, q), (5, q), (5, q), (7, None), (None, None), (None, None), (8, p + " " + q)]
    check_repeats(rows, substring.digest_without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert substring.digest_without_repeats(no_docs).count() == 0 == substring.without_repeats(no_docs).count()
    assert substring.without_repeats(edge_docs).columns == edge_docs.columns


@pytest.mark.parametrize("held, budget", [(2_000_000, 64 << 20), (50, 400)])
def test_substring_pool(spark, monkeypatch, held, budget):
    monkeypatch.setattr(substring, "HELD_WORDS", held)  # many small deals, so that repeats meet in the groups
    monkeypatch.setattr(repeats, "HELD_HASHES", held)
    monkeypatch.setattr(repeats, "GROUP_HASHES", held)
    monkeypatch.setattr(substring, "GROUP_BYTES", budget)  # prefixes are lengthened
    rows = pool(11, 150, words=12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_repeats(rows, substring.digest_without_repeats(df))


@pytest.mark.parametrize("width", [3, 40])
def test_groups_stay_within_the_budget(spark, monkeypatch, width):
    """One five-word line in very many windows, all different and all repeated once."""
    monkeypatch.setattr(substring, "GROUP_BYTES", 20_000)
    r = random.Random(5)
    known = substring._Hashes()
    gram = lambda k: substring._sequence_hash(np.array([known[b"hot%d" % (5 * k + i)] for i in range(5)], np.int64).view(np.uint64), 5)[0]
    least = min(range(5000), key=gram)  # so that most windows that hold the line have a prefix that ends with it
    line = " ".join(f"hot{5 * least + k}" for k in range(5))
    texts = [" ".join([*(f"w{r.randrange(10**6)}" for _ in range(18)), line, *(f"w{r.randrange(10**6)}" for _ in range(18))]) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts + texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(width)
    named = df.select(*(c.alias(k) for k, c in substring._name_columns("doc_id", "text").items()), "text")
    words, remove = written(substring._words(named, substring._candidates(named, 20)), "words")
    to = substring._partition(words, 20)
    dealt = [x for x in substring._deal([(r.doc, r.k1, r.k2, r.start, bytes(r.words)) for r in words.collect()[:400]], 20, substring._Hashes(), to)]
    size = {}
    for g, kind, *_, w in dealt:
        size[g] = size.get(g, 0) + len(w)
    remove()
    assert to.pieces.max() > 1 and max(size.values()) <= 1.5 * 20_000
    check_repeats(rows, substring.digest_without_repeats(df))


def test_equal_hashes_are_not_equal_words(spark, monkeypatch):
    monkeypatch.setattr(substring.xxhash, "xxh64_intdigest", lambda w: 7)  # in this process: all words clash
    a, b = (" ".join(f"{c}{i}" for i in range(25)) for c in "ab")
    to = substring.Partition(np.zeros(64, np.int64), np.ones(64, np.int64), 1)
    rows = [(i, 0, 0, 0, t.encode()) for i, t in enumerate([a, b, a])]
    dealt = list(substring._deal(rows, 20, substring._Hashes(), to))
    table = pa.table(dict(zip([x.split()[0] for x in substring.TREE_SCHEMA.split(", ")], zip(*dealt))))
    assert {(r["doc"], k) for r in substring._tree(table, 20).to_pylist() for k in range(r["start"], r["start"] + r["n"])} == {(2, k) for k in range(25)}


def test_repeated_hashes(spark, monkeypatch):
    for name, value in (("HELD_HASHES", 30), ("GROUP_HASHES", 40)):
        monkeypatch.setattr(repeats, name, value)
    r = random.Random(1)
    rows = [(i, [r.choice([r.getrandbits(63), 5, 9, 2**62 + i // 2]) for _ in range(r.randrange(9))]) for i in range(80)]
    hashed = lambda b: ((((i,), np.array(h, np.int64)) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    finish = lambda meta, row, place, h: pa.table([pa.array(meta[row, 0]), pa.array(place), pa.array(h.view(np.int64))], names=["i", "place", "h"])
    df = spark.createDataFrame(rows, "i long, h array<long>").repartition(4)
    got = repeats.repeated(df, hashed, finish, "i long, place long, h long", 3, 8, ["i"])
    chunks = lambda n: {r.chunk for r in df.sortWithinPartitions("i").mapInArrow(lambda bs: (repeats._batch(list(repeats._chunk(
        *map(list, zip(*hashed(b))), 3, 8))) for b in bs if b.num_rows), repeats.SCHEMA).collect()}
    assert chunks(1) == chunks(2)  # named by their content
    seen = [x for _, h in rows for x in h]
    assert sorted(map(tuple, got.collect())) == sorted((i, k, x) for i, h in rows for k, x in enumerate(h) if seen.count(x) > 1)


def test_substring_texts(spark):
    p = " ".join(f"q{i}" for i in range(25))
    rows = [(1, f"a {p} b"), (2, f"c\n\t{p}  d  e"), (3, "untouched  text\n")]
    out = {r.doc_id: r.text for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: f"a {p} b", 2: "c\n\td  e", 3: "untouched  text\n"}


def check_vectors(rows, df, threshold=0.95):
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a != b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links.append((a, b))
    n = np.bincount([a for a, _ in links], minlength=len(rows)) if links else np.zeros(len(rows), int)
    order = [LOW if i is None else i for i, _ in rows]
    comp = brute.least_reachable(len(rows), links, order)
    want = sorted([(i, int(k), None if c == LOW else c, i is None or i == c) for (i, _), k, c in zip(rows, n, comp)], key=str)
    assert sorted([tuple(r) for r in df.collect()], key=str) == want


@pytest.mark.parametrize("tile", [8192, 16])
def test_embeddings(spark, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup, "TILE_ROWS", tile)
    r = np.random.default_rng(2)
    base = r.normal(size=(12, 24))
    rows = [(i, (base[i % 12] + r.normal(size=24) * r.choice([0, 0.1, 0.25, 0.4])).tolist()) for i in range(90)]
    rows += [(100 + i, list(rows[i][1])) for i in range(3)] + [(200, None), (201, []), (202, [0.0] * 24), (203, [1.0, None] * 12), (204, [float("nan")] * 24),
                                                               (205, [float("inf")] * 24), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, v string, id long, links long")
    check_vectors(rows, embed_dedup.near_vectors(df))
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [48, 2500])
def test_bounds_hold(dim):
    r = np.random.default_rng(4)
    v = r.normal(size=(200, dim)) * 10.0 ** r.integers(-6, 6, size=(200, 1))
    _, codes, scale, rest, norm = embed_dedup.quantise(v)
    assert (embed_dedup.code_products(codes, codes) == (codes.astype(np.int64) @ codes.T.astype(np.int64))).all()
    approx = (codes * scale[:, None]) @ (codes * scale[:, None]).T
    cos = (v @ v.T) / np.sqrt(np.outer((v * v).sum(1), (v * v).sum(1)))
    assert (np.abs(cos - approx) <= rest[:, None] + rest + rest[:, None] * rest + 1e-12).all()


def test_vectors_of_extreme_size(spark):
    rows = [(0, [1e-170, 2e-170]), (1, [1.0, 2.0]), (2, [1e200, 2e200]), (3, [5e-324, 0.0]), (4, [1e308, 0.0]), (5, [-1.0, -2.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_many_columns(spark):
    """Beyond 1,040 columns a product of codes no longer fits a 32-bit float."""
    r = np.random.default_rng(6)
    base = r.normal(size=(20, 1500))
    rows = [(i, (base[i % 20] + r.normal(size=1500) * r.choice([0.2, 0.3, 0.33])).tolist()) for i in range(60)]
    check_vectors(rows, embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))


def jaccard_groups(rows, size=5):
    """The least id of each row's group, by brute force over five-word shingle sets."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return brute.least_reachable(len(rows), links, [i for i, _ in rows])


def block_edits(seed=21, groups=40):
    """Texts with truncated and extended copies about a similarity of 0.8, and one passage that most of them share."""
    r = random.Random(seed)
    common = [f"c{k}" for k in range(25)]
    rows = []
    for g in range(groups):
        w = [f"v{r.randrange(2000)}" for _ in range(r.randrange(60, 500))] + (common if g % 4 else [])
        for c in range(5):
            cut = int(len(w) * r.uniform(0.05, 0.25))
            x = w if not c else w[:-cut] if c < 3 else w + [f"f{r.randrange(2000)}" for _ in range(cut)]
            rows.append((g * 10 + c, " ".join(x)))
    return rows


@pytest.mark.parametrize("piece", [20_000, 3])
def test_near_copies_by_block(spark, monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    monkeypatch.setattr(simhash, "SETS", piece)
    rows = block_edits() + [(9000, ""), (9001, None), (9002, "two words"), (9003, "TWO  words")]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    want = jaccard_groups(rows)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want))


def test_near_copies_of_one_id(spark):
    p = " ".join(f"q{i}" for i in range(60))
    rows = [(None, p), (None, p), (None, "other text"), (None, "third one"), (4, p + " end"), (5, "five"), (5, "five"), (5, "not five"), (6, None), (None, ""), (None, None)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    got = sorted(((r.doc_id, r.text or "") for r in kept), key=str)
    assert got == sorted([(None, p), (None, "other text"), (None, "third one"), (5, "five"), (5, "not five"), (None, "")], key=str)
    twice = spark.createDataFrame(block_edits(groups=8) * 2, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in simhash.drop_near_copies(twice).collect()) == sorted(set(jaccard_groups(block_edits(groups=8))))


def test_near_copies_on_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == sorted(set(jaccard_groups(rows)))


def test_similar_sets():
    r = np.random.default_rng(0)
    base = [np.unique(r.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(6)]
    sets = [b[: r.integers(40, 61)] for b in base for _ in range(7)] + [base[0], np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert set(zip(*(x.tolist() for x in simhash.similar_sets(sets)))) == want


def test_references_discard_nothing_near():
    """Pairs within the radius are joined whatever the references; many others are discarded by the table."""
    r = np.random.default_rng(3)
    centre = r.integers(0, 2**63, (4, 2)).astype(np.uint64)
    noise = np.array([[sum(1 << int(b) for b in r.choice(64, 6, replace=False)) for _ in range(2)] for _ in range(200)], np.uint64)
    fp = np.concatenate([centre[np.arange(200) % 4] ^ noise, r.integers(0, 2**63, (100, 2)).astype(np.uint64)])
    n = np.full(300, 100)
    forest, (met, left, near) = simhash.near_in_buckets(np.zeros(300, int), n, np.zeros(300, int), (fp[:, 0], fp[:, 1]))
    d = np.bitwise_count(fp[:, None] ^ fp[None]).astype(int).sum(axis=2)
    want = brute.least_reachable(300, np.argwhere(d <= simhash.NEAR_RADIUS).tolist(), list(range(300)))
    assert forest.root.tolist() == want and near <= left < met


def test_batches_are_bounded_and_the_setting_comes_back(spark):
    from pyspark.sql import functions as F
    docs = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("word "), 4000).alias("text"))  # 60 MB in one partition

    def sizes(batches):
        for b in batches:
            parts = list(text_slices([b]))
            assert sum(p.num_rows for p in parts) == b.num_rows and all(p.nbytes <= 1.1 * SLICE_BYTES for p in parts)
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    most = lambda: docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    assert spark.conf.get(BATCH_SETTING, None) is None and most() > 4 * SLICE_BYTES
    with small_batches(spark):
        assert most() <= 1.3 * SLICE_BYTES
    assert spark.conf.get(BATCH_SETTING, None) is None
    spark.conf.set(BATCH_SETTING, "12345678")
    with pytest.raises(ValueError), small_batches(spark):
        raise ValueError
    assert spark.conf.get(BATCH_SETTING) == "12345678"
    spark.conf.unset(BATCH_SETTING)

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from kindred.llm import sharding, topk, toxicity, url_filter
from kindred.llm.queries import ORACLE_SQL, QUERIES
from oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, sf, name):
    check(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def brute_top(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q and len(y) == len(x))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("rows_per", [(8192, 2048), (16, 2)])
def test_top_k(spark, monkeypatch, rows_per):
    monkeypatch.setattr(topk, "SHARD_ROWS", rows_per[0])
    monkeypatch.setattr(topk, "BLOCK_ROWS", rows_per[1])
    monkeypatch.setattr(topk, "FAN_IN", 3)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).tolist()) for i in range(160)] + [(200 + i, [0.5] * 8) for i in range(8)]
    rows += [(300, None), (350, []), (301, [None] + [1.0] * 7), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [9.0] * 3), (400, [1.0] * 3), (None, [5.0] * 8)]
    rows += [(201, [0.5] * 8), (7, rows[7][1])]  # repeated rows
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<double>, id long, block string")
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute_top(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_beyond_doubles(spark):
    big = float(2**40)
    rows = [(0, [big, 1.0]), (1, [1.0, 3.0]), (2, [1.0, 4.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1).collect()
    assert [(g.vec_id, g.score) for g in got] == [(2, (2**48) * 256 + 256 * 1024)]


@pytest.mark.parametrize("bucket", [16384, 3])
def test_sharding_edges(spark, edge_rows, edge_docs, no_docs, bucket):
    got = sharding.shard_documents(edge_docs, shards=4, rows_per_bucket=bucket).collect()
    want = sorted([(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows], key=str)
    assert sorted([(g.doc_id, g["size"], g.text_crc32) for g in got], key=str) == want
    by = {}
    for g in got:
        assert g.law == "rows" and g.grown_shard is None
        by.setdefault(g.shard, []).append(g.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard_documents(no_docs).count() == 0


def test_shards_match_the_mixture(spark):
    rows = [(i, "t", "big" if i % 3 else f"s{i % 7}") for i in range(2400)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), 24, rows_per_bucket=100).collect()
    share = {}
    for g in got:
        share.setdefault(g.source, [0] * 24)[g.shard] += 1
    assert all(max(v) - min(v) <= 2 for v in share.values())


def test_url_parts_and_rules(spark):
    urls = ["HTTP://WWW.Example.org/es/x?y#z", "http://example.org/en/12", "http://a.org", "http://org/x", "https://x.com/de/1", "http://x.com/fr/",
            "http://borg/x", "no scheme", None, "", "a://b://c/d", "http://h?q/x", "http://h#f", "http://exaÉmple.net:80/p"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, k int")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, none).collect()}
    assert [got[i][:3] for i in range(len(urls))] == [
        ("www.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("a.org", "", None), ("org", "/x", "org/"),
        ("x.com", "/de/1", "com/de/"), ("x.com", "/fr/", "com/fr/"), ("borg", "/x", None), ("", "", None), ("", "", None), ("", "", None),
        ("b:", "//c/d", None), ("h", "", None), ("h", "", None), ("exaÉmple.net:80", "/p", None)]
    assert [got[i][3] for i in (0, 1, 3, 4, 5)] == ["block", "block", "allow", "block", "allow"]
    assert {v[3] for v in got.values()} <= {"allow", "block"}
    assert url_filter.filter_urls(pages.limit(0), none).count() == 0


def test_hierarchy(spark):
    hosts = ["a.b.example.com", "example.com:8080", "user:pw@www.shop.co.uk:80", "co.uk", "x.github.io", "localhost", "", "10.0.0.1:99", "[::1]:80", "com.", "b:"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string")
    domain, suffix = url_filter.hierarchy(F.col("h"))
    got = {r.h: (r.d, r.s) for r in rows.select("h", domain.alias("d"), suffix.alias("s")).collect()}
    assert [got[h] for h in hosts] == [("example.com", "com"), ("example.com", "com"), ("shop.co.uk", "co.uk"), ("co.uk", "co.uk"), ("x.github.io", "github.io"),
                                       ("localhost", "localhost"), ("", ""), ("10.0.0.1", "address"), ("[::1]", "address"), ("com", "com"), ("b", "b")]


def test_reputation_follows_labels(spark):
    rows, good = [], []
    for h in range(40):
        for i in range(30):
            rows.append((h * 100 + i, f"http://h{h}.site{h % 8}.net/{i}"))
            good.append((h * 100 + i, int(i % 10 != 0) if h % 2 else int(i % 10 == 0)))
    rows.append((9999, "http://new.site1.net/"))
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(good, "page_id long, good int")).collect()}
    assert all(got[h * 100].verdict == ("allow" if h % 2 else "block") for h in range(40))
    assert got[9999].reputation < got[100].reputation


def labelled(seed=0, n=600):
    r = random.Random(seed)
    plain, bad = [f"w{r.randrange(900)}" for _ in range(400)], ["awfulword", "nastything", "vileterm", "grimstem"]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(plain, k=r.randrange(30, 200))
        toxic = int(i % 8 == 0)
        if toxic:
            for _ in range(2 + len(w) // 25):
                w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", ",", "xy"])
        docs.append((i, " ".join(w)))
        labels.append((i, toxic))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = labelled()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.grade_documents(df, seen).collect()}
    late = [(got[i].rejected, t) for i, t in labels if i >= 400]
    assert sum(a == bool(t) for a, t in late) / len(late) > 0.97
    assert np.mean([got[i].severity for i, t in labels if t]) > 1 > 0.2 > np.mean([got[i].severity for i, t in labels if not t])
    assert all(0 <= g.grade <= 3 and g.severity <= 3 for g in got.values())
    kept = {r.doc_id for r in toxicity.drop_toxic(df, seen).collect()}
    assert kept == {i for i, g in got.items() if not g.rejected}


def test_toxicity_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one_class = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    both = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (11, 0), (4, 1), (3, 1)], "doc_id long, toxic int")
    for labels in (none, one_class):
        assert toxicity.grade_documents(edge_docs, labels).where("rejected").count() == 0
    got = toxicity.grade_documents(edge_docs, both).collect()
    assert len(got) == edge_docs.count() and all(g.severity == 0 for g in got if g.doc_id in (4, 5))
    assert toxicity.drop_toxic(edge_docs, both).columns == edge_docs.columns
    assert toxicity.grade_documents(no_docs, both).count() == 0


def test_ordinal_thresholds_are_ordered():
    r = np.random.default_rng(0)
    x = r.normal(size=500)
    grades = np.digitize(x + r.normal(size=500) * 0.2, [-0.5, 0.3, 1.0])
    m = toxicity.CumulativeLink.fit(np.arange(500), np.zeros(500, int), x, grades, 1, 4)
    assert (np.diff(m.thresholds) > 0).all() and m.weights[0] > 2
    hit = [int((-np.diff(np.concatenate([[1], m.at_least({0: v}), [0]]))).argmax()) for v in x]
    assert np.mean(np.array(hit) == grades) > 0.75


def test_fit_finds_the_optimum():
    """The penalised likelihood, written out plainly, falls in no direction from what fit() returns."""
    r = np.random.default_rng(8)
    x = r.random((300, 6)) * (r.random((300, 6)) < 0.6)
    grades = np.digitize(x @ [2, -1, 0, 1.5, 0, 0.5] + r.logistic(size=300), [0.2, 1.5, 2.5])
    rows, cols = np.nonzero(x)

    def loss(weights, thresholds):
        total = 0.0
        for xi, g in zip(x, grades):
            p = [0.0, *(1 / (1 + np.exp(-(t - weights @ xi))) for t in thresholds), 1.0]
            total -= np.log(p[g + 1] - p[g])
        return total / len(x) + 1e-3 * weights @ weights

    m = toxicity.CumulativeLink.fit(rows, cols, x[rows, cols], grades, 6, 4, steps=2000, decay=2e-3)
    best = loss(m.weights, m.thresholds)
    for _ in range(40):
        step = r.normal(size=9) * r.choice([0.01, 0.1])
        assert loss(m.weights + step[:6], m.thresholds + step[6:]) > best - 1e-6


def test_features_are_parameters(spark):
    docs, labels = labelled()
    df, seen = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    few, every = (toxicity.fit(df, seen, features=n, least_docs=k)[0] for n, k in ((5, 4), (None, 1)))
    words = {f for _, t in docs for w in t.split() for f in toxicity.word_features(w.strip(","))}
    assert len(few) == 5 and set(every) == words


def test_pipeline(spark, sf):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.names == docs.schema.names
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 0.7 * docs.count()
        docs = out
    final = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in final.select("doc_id").collect()} == ids
    assert final.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_registered():
    names = entry_module.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_few_labels_make_no_host_certain(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.s{i % 3}.net/") for i in range(12)], "page_id long, url string")
    for good in (0, 1):
        got = url_filter.filter_urls(pages, spark.createDataFrame([(5, good)], "page_id long, good int")).collect()
        assert all(0 < r.reputation < 0.9 for r in got), good
        other = [r.reputation for r in got if r.page_id != 5]
        mine = next(r.reputation for r in got if r.page_id == 5)
        assert all(mine > o for o in other) if good else all(mine < o for o in other)


def test_toxicity_sample_is_bounded_by_rows(spark, monkeypatch):
    docs = [(i % 2, f"awfulword number {i} of many" if i % 2 else f"plain words {i}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.CumulativeLink.fit
    monkeypatch.setattr(toxicity.CumulativeLink, "fit", staticmethod(lambda rows, cols, values, grades, *a, **k: seen.append(len(grades)) or fit(rows, cols, values, grades, *a, **k)))
    assert toxicity.fit(df, labels, fit_rows=50) is not None
    assert seen and max(seen) <= 50


def test_caches_are_bounded_by_bytes(monkeypatch):
    import public_tokenizers

    from kindred.llm import bpe, substring
    monkeypatch.setattr(bpe, "HELD_BYTES", 20_000)
    monkeypatch.setattr(substring, "HELD_BYTES", 20_000)
    b = bpe.Bpe(tuple(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), public_tokenizers.PATTERN)
    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=300)) for _ in range(60)]
    whole = [list(b.run([" ".join(words[k:k + 6])])) for k in range(0, 60, 6)]
    assert len(b.place) < 60 and len(b.pieces) < 60
    again = [list(b.run([" ".join(words[k:k + 6])])) for k in range(0, 60, 6)]
    assert whole == again
    known = substring._Hashes()
    first = [known[w.encode()] for w in words * 3]
    assert first == [substring._Hashes()[w.encode()] for w in words * 3] and len(known) * 300 <= 21_000

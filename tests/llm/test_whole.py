"""The registered queries that SQL can't express, and the pipeline, on the small tables against plain versions."""

import hashlib
import re

import brute
import numpy as np
import pytest

import corpus_pipeline
from kindred.llm import substring, toxicity
from kindred.llm.queries import QUERIES
from test_dedup import check_simhash, jaccard_groups
from test_text import TIKTOKEN, check_packing, plain_counts


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_op2(spark, sf, rows):
    want = []
    for i, t in rows:
        ids = TIKTOKEN.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op2_bpe"](spark, sf).collect())) == sorted(want)


def test_op3(spark, sf, rows):
    bins, least = check_packing(rows, QUERIES["op3_best_fit_packing"](spark, sf), 2048)
    assert bins <= 1.03 * least + 1


def test_op4(spark, sf, rows):
    assert sorted(map(tuple, QUERIES["op4_token_counts"](spark, sf).collect()), key=str) == plain_counts(rows)


def test_op10(spark, sf, rows):
    check_simhash(rows, QUERIES["op10_simhash"](spark, sf))


def plain_rejected(model, text):
    words = re.findall(r"\w+", (text or "").lower())
    counts = {}
    for w in words:
        for f in (w + "$", *(w[:k] for k in toxicity.PREFIXES if len(w) >= k)):
            counts[f] = counts.get(f, 0) + 1
    score = sum(model[1].weights[i] * np.log1p(200 * counts[f] / (len(words) + 20)) for i, f in enumerate(model[0]) if f in counts)
    return bool(text) and 1 / (1 + np.exp(model[1].thresholds[0] - score)) >= toxicity.REJECT_FROM


def test_op8(spark, sf, rows):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.rejected for r in QUERIES["op8_toxicity"](spark, sf).collect()}
    assert got == {i: plain_rejected(model, t) for i, t in rows}


def test_pipeline(spark, sf, rows):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    left = sorted((i, t or "") for i, t in rows if not plain_rejected(model, t))
    kept = [r for r, c in zip(left, jaccard_groups(left)) if r[0] == c]
    first, cut = {}, []
    for i, t in kept:
        w = t.encode().split()
        for s in range(len(w) - substring.WINDOW + 1):
            k = tuple(w[s:s + substring.WINDOW])
            first[k] = min(first.get(k, (i, s)), (i, s))
    for i, t in kept:
        raw = t.encode()
        spots = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)] + [len(raw)]
        w = raw.split()
        keep = np.ones(len(w), bool)
        for s in range(len(w) - substring.WINDOW + 1):
            if first[tuple(w[s:s + substring.WINDOW])] < (i, s):
                keep[s:s + substring.WINDOW] = False
        cut.append((i, t if keep.all() else b"".join(raw[spots[k]:spots[k + 1]] for k in np.flatnonzero(keep)).decode()))
    check_packing(cut, corpus_pipeline.run(spark, sf), 2048)


def test_stages_edges(spark, sf, edge_rows, edge_docs, no_docs):
    """Every stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""
    docs, kept = edge_docs, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        got = [r.asDict() for r in out.collect()]
        empty = stage(spark, no_docs, sf)
        assert empty.columns == out.columns and empty.count() == 0, name
        if name == "best_fit_packing":
            assert sorted(str(r["doc_id"]) for r in got if r["piece"] == 0) == sorted(str(i) for i, _ in kept)
            break
        assert out.columns == edge_docs.columns and out.dtypes == edge_docs.dtypes
        if name == "simhash_near_dedup":
            order = lambda r: (-(2**63) if r[0] is None else r[0], brute.text_order(r[1])[0])
            rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=order)
            groups = jaccard_groups([(k, t) for k, (_, t) in enumerate(rows)])
            assert sorted([(r["doc_id"], r["text"]) for r in got], key=str) == sorted([r for k, r in enumerate(rows) if groups[k] == k], key=str)
        if name == "substring_dedup":
            words = {(i, n - gone) for i, n, gone, _ in brute.without_repeats(kept)}
            assert {(r["doc_id"], len((r["text"] or "").encode().split())) for r in got} == words
        kept = [(r["doc_id"], r["text"]) for r in got]
        docs = spark.createDataFrame([tuple(r[c] for c in edge_docs.columns) for r in got], edge_docs.schema)

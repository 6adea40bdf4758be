"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HELD_BYTES, checkpointed, text_slices

#: Parameters of fit(): labelled rows that the model is fitted on, at most; features that it keeps, the most telling
#: ones (None: all); labelled documents in which a feature must occur. README tells what the last two cost.
FIT_ROWS, FEATURES, LEAST_DOCS = 4000, 1500, 4
GRADES = 4
PREFIXES = (4, 6)
REJECT_FROM = 0.5
HELD_WORDS = 200_000
TOKEN = re.compile(r"\w+")


def word_features(word: str) -> tuple[str, ...]:
    """The word itself, marked as whole, and its beginnings."""
    return (word + "$", *(word[:k] for k in PREFIXES if len(word) >= k))


def _weights(counts, n_words: int):
    return {f: float(np.log1p(200 * c / (n_words + 20))) for f, c in counts.items()}


class Features:
    """Sparse features of a text over a fixed vocabulary: log(1 + 200 c / (words + 20))."""

    def __init__(self, vocabulary: list[str]):
        self.index = {f: i for i, f in enumerate(vocabulary)}
        self.held: dict[str, tuple[int, ...]] = {}
        self.held_bytes = 0

    def _of(self, word: str) -> tuple[int, ...]:
        found = tuple(i for i in map(self.index.get, word_features(word)) if i is not None)
        if len(self.held) >= HELD_WORDS or self.held_bytes > HELD_BYTES:
            self.held.clear()
            self.held_bytes = 0
        self.held[word] = found
        self.held_bytes += len(word)
        return found

    def __call__(self, text: str) -> dict[int, float]:
        words = TOKEN.findall(text.lower())
        held, make = self.held, self._of
        counts = Counter()
        for w in words:
            found = held.get(w)
            if found is None:
                found = make(w)
            if found:
                counts.update(found)
        return _weights(counts, len(words))


class CumulativeLink:
    """P(grade <= k) = sigmoid(theta_k - w.x): one weight vector, ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @staticmethod
    def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int,
            n_grades: int, steps: int = 400, rate: float = 0.05, decay: float = 2e-4, tolerance: float = 1e-7) -> CumulativeLink:
        """Maximum likelihood with an L2 penalty by Adam, with a rate that falls to zero over ``steps``.

        It ends early where the loss has changed by less than ``tolerance`` of itself over 20 steps. Gaps between
        thresholds stay positive.
        """
        n = len(grades)
        share = np.array([(grades <= k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
        start = np.log(share / (1 - share))
        gaps = np.log(np.diff(start).clip(0.05))
        p = np.concatenate([np.zeros(n_features), start[:1], gaps])
        m, v = np.zeros_like(p), np.zeros_like(p)
        sig = lambda x: 1 / (1 + np.exp(-x.clip(-40, 40)))
        at, losses = np.arange(n), []
        for t in range(1, steps + 1):
            theta = np.concatenate([p[n_features:n_features + 1], p[n_features] + np.cumsum(np.exp(p[n_features + 1:]))])
            score = np.bincount(rows, p[cols] * values, n)
            below = np.concatenate([np.zeros((n, 1)), sig(theta[None, :] - score[:, None]), np.ones((n, 1))], axis=1)
            hi, lo = below[at, grades + 1], below[at, grades]
            like = (hi - lo).clip(1e-9)
            losses.append(-np.log(like).mean() + decay / 2 * (p[:n_features] @ p[:n_features]))
            if t > 20 and abs(losses[-21] - losses[-1]) < tolerance * abs(losses[-1]):
                break
            d_hi, d_lo = hi * (1 - hi) / like, lo * (1 - lo) / like
            d_score = (d_hi - d_lo) / n
            d_theta = np.zeros(n_grades + 1)
            np.add.at(d_theta, grades + 1, -d_hi / n)
            np.add.at(d_theta, grades, d_lo / n)
            d_theta = d_theta[1:-1]
            tail = np.cumsum(d_theta[::-1])[::-1]
            g = np.concatenate([np.bincount(cols, d_score[rows] * values, n_features) + decay * p[:n_features],
                                tail[:1], tail[1:] * np.exp(p[n_features + 1:])])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta = np.concatenate([p[n_features:n_features + 1], p[n_features] + np.cumsum(np.exp(p[n_features + 1:]))])
        return CumulativeLink(p[:n_features], theta)

    def at_least(self, x: dict[int, float]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        score = sum(self.weights[i] * v for i, v in x.items())
        return 1 / (1 + np.exp((self.thresholds - score).clip(-40, 40)))


def severity_grades(toxic: np.ndarray, shares: np.ndarray, n_grades: int = GRADES) -> np.ndarray:
    """0 for clean documents; toxic ones in equal parts by their share of telling words, from 1."""
    grades = np.zeros(len(toxic), int)
    at = np.flatnonzero(toxic == 1)
    rank = np.argsort(np.argsort(shares[at], kind="stable"), kind="stable")
    grades[at] = 1 + rank * (n_grades - 1) // max(len(at), 1)
    return grades


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int | None = FEATURES, least_docs: int = LEAST_DOCS,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(vocabulary, CumulativeLink) from labelled documents; None without both classes.

    A sample of ``fit_rows`` labelled rows, by hash, bounds what the driver gets: rows equal in id and text count once,
    and ids that many rows share leave no more of them. Features are chosen
    by the difference of their document frequencies in the classes, ``features`` of those that occur in
    ``least_docs`` labelled documents or more. The labels say toxic or not. The grades above 0 are therefore made here:
    toxic documents in equal parts by their share of words that tell toxic text, so expected severity
    ranks toxic texts by such words and isn't checked by any label.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    named = rows.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))
    names = named.select("doc_id", "k1", "k2").join(F.broadcast(chosen), "doc_id").distinct().orderBy(F.xxhash64("doc_id", "k1", "k2"), "doc_id", "k1", "k2").limit(fit_rows)
    names = checkpointed(names)  # texts are read for these rows only
    sample = checkpointed(named.join(F.broadcast(names), ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id", "k1", "k2"]).select("doc_id", "text", "toxic"))

    def seen(batches):
        both = (Counter(), Counter())
        for b in text_slices(batches):
            for text, toxic in zip(b.column(0), b.column(1)):
                both[toxic.as_py()].update({f for w in set(TOKEN.findall(text.as_py().lower())) for f in word_features(w)})
        names = list(both[0].keys() | both[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(
            pa.array([c[f] for f in names], pa.int64()) for c in both)], names=["feature", "clean", "toxic"])

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return None
    gap = F.col("toxic") / sizes[1] - F.col("clean") / sizes[0]
    pooled = (F.col("toxic") + F.col("clean") + 1) / (sizes[0] + sizes[1] + 2)
    told = sample.select("text", "toxic").mapInArrow(seen, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") + F.col("clean") >= least_docs)
    best = told.select("feature", "clean", "toxic", (F.abs(gap) / F.sqrt(pooled)).alias("gap")).orderBy(
        F.desc("gap"), "feature")
    best = (best if features is None else best.limit(features)).collect()
    vocabulary = [r["feature"] for r in best]
    telling = {i for i, r in enumerate(best) if r["toxic"] / sizes[1] > 10 * (r["clean"] + 1) / sizes[0] and r["feature"].endswith("$")}

    def sparse(batches):
        of = Features(vocabulary)
        for b in text_slices(batches):
            x = [of(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), pa.array([list(r.keys()) for r in x], pa.list_(pa.int32())),
                pa.array([list(r.values()) for r in x], pa.list_(pa.float64()))], names=["doc_id", "toxic", "i", "x"])

    data = sorted(sample.select("doc_id", "text", "toxic").mapInArrow(
        sparse, "doc_id long, toxic int, i array<int>, x array<double>").collect(), key=lambda r: (r["doc_id"], r["i"]))
    row = np.repeat(np.arange(len(data)), [len(r["i"]) for r in data])
    col = np.array([i for r in data for i in r["i"]], int)
    val = np.array([x for r in data for x in r["x"]], float)
    toxic = np.array([r["toxic"] for r in data])
    shares = np.array([sum(x for i, x in zip(r["i"], r["x"]) if i in telling) for r in data], float)
    return vocabulary, CumulativeLink.fit(row, col, val, severity_grades(toxic, shares), len(vocabulary), GRADES)


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, p_toxic, grade) of every whole text, in the rows' order.

    severity is the expected grade, grade the likeliest. Null and empty texts, and all texts
    where no model could be fitted, have severity 0. Texts of any length are read whole; repeated rows are
    scored each; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    def run(batches):
        of = Features(model[0]) if model else None
        for b in text_slices(batches):
            out = []
            for t in b.column(1):
                t = t.as_py()
                if not (t and model):
                    out.append((0.0, 0.0, 0))
                    continue
                p = model[1].at_least(of(t))
                each = -np.diff(np.concatenate([[1.0], p, [0.0]]))
                out.append((float(p.sum()), float(p[0]), int(each.argmax())))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(
                cols, (pa.float64(), pa.float64(), pa.int32())))], names=["doc_id", "severity", "p_toxic", "grade"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int")


def grade_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """score() with a model fitted on the labelled documents, and whether each is rejected.

    Null ids are scored but never fitted; repeated ids are scored each, and fitted each with the label of the
    id, toxic if any of its labels is; without labels of both classes nothing is rejected; whole texts of
    any length are scored; an empty table gives no rows; other columns are ignored.
    """
    return score(docs, fit(docs, labels, **options)).withColumn("rejected", F.col("p_toxic") >= REJECT_FROM)


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the rejected ones, all columns as they are, whatever their names, in one pass after the fit.

    Null and empty texts stay, and all rows where no model can be fitted; repeated rows are judged each; an empty table
    stays empty. See grade_documents() for ids and labels.
    """
    model = fit(docs, labels, text_col=text_col, **options)
    if not model:
        return docs
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        of = Features(model[0])
        for b in text_slices(batches):
            keep = [not t.is_valid or model[1].at_least(of(t.as_py()))[0] < REJECT_FROM for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

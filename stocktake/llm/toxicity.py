"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are 0 (not toxic), 1 (mildly) and 2 (strongly). The labels say only toxic or not, so toxic
training texts are graded by how much they hold of what sets toxic texts apart: above the median
is 2. The model is P(grade <= k) = sigmoid(theta_k - w x) with one weight vector for all ordered
thresholds; x holds log(1 + count) of the
selected words and word beginnings. The output is the expected grade.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stocktake.llm.shared import written
from stocktake.llm.textops import SPACE, Text, chunks

BITS = 18
#: The model is fitted on at most so many labelled documents of either kind, those of the smallest hashes.
SAMPLE = 3000
#: Words that enter the model: at most so many, with at least this score.
FEATURES, SCORE = 400, 7.0
GRADES = 3
#: Share of the likelihood that toxic texts have; less of it calls fewer clean texts toxic.
TOXIC_SHARE = 0.25
#: Bytes of the word beginnings that are features too.
PREFIXES = (4, 6, 7)

SEPARATORS = SPACE.copy()
SEPARATORS[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True


@dataclass(frozen=True)
class Ordinal:
    """slot: feature of each word bin or -1; weights and ordered thresholds."""

    slot: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """w x of each text, and P(grade <= k)."""
        size, doc, bins = _bins(column)
        slots = self.slot[bins]
        hit = slots >= 0
        doc = doc[hit]
        pair, count = np.unique(doc * len(self.weights) + slots[hit], return_counts=True) if len(self.weights) else (np.zeros(0, np.int64), np.zeros(0))
        wx = np.bincount(pair // max(len(self.weights), 1), weights=np.log1p(count) * self.weights[pair % max(len(self.weights), 1)], minlength=size) if len(pair) else np.zeros(size)
        return wx, _sigmoid(self.thresholds[None, :] - wx[:, None])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _bins(column: pa.Array) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of texts, and the text and bin of every feature: each word, and the beginnings of longer words."""
    text = Text(column, SEPARATORS)
    doc = np.repeat(np.arange(text.size), text.n_words)
    docs, bins = [doc], [text.word_hashes(fold=True)]
    for n in PREFIXES:
        longer = text.ends - text.starts > n
        docs.append(doc[longer])
        bins.append(text.prefix_hashes(n, fold=True)[longer])
    return text.size, np.concatenate(docs), (np.concatenate(bins) >> np.uint64(64 - BITS)).astype(np.int64)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, steps: int = 600, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient descent (Adam) on the weighted likelihood; thresholds stay ordered through exp(gap)."""
    n, m = x.shape
    params = np.concatenate([np.zeros(m), [1.0], np.zeros(GRADES - 2)])
    first, second = np.zeros_like(params), np.zeros_like(params)
    share = weight / weight.sum()
    for step in range(1, steps + 1):
        w, t0, gaps = params[:m], params[m], np.exp(params[m + 1:])
        theta = t0 + np.concatenate([[0], np.cumsum(gaps)])
        s = np.einsum("ij,j->i", x, w)  # no threaded BLAS beside a live session
        cum = np.concatenate([np.zeros((n, 1)), _sigmoid(theta[None] - s[:, None]), np.ones((n, 1))], axis=1)
        dens = cum * (1 - cum)
        rows = np.arange(n)
        prob = np.maximum(cum[rows, grade + 1] - cum[rows, grade], 1e-12)
        up, low = dens[rows, grade + 1] / prob, dens[rows, grade] / prob
        d_s = share * (up - low)
        d_theta = np.array([-(share * (up * (grade == k) - low * (grade == k + 1))).sum() for k in range(GRADES - 1)])
        grad = np.concatenate([np.einsum("ij,i->j", x, d_s) + decay * w, [d_theta.sum()], [d_theta[k + 1:].sum() * gaps[k] for k in range(GRADES - 2)]])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        params = params - 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return params[:m], params[m] + np.concatenate([[0], np.cumsum(np.exp(params[m + 1:]))])


def train(docs: DataFrame, labels: DataFrame) -> Ordinal:
    """Fit on a bounded sample of labelled documents (at most SAMPLE of either kind); without both kinds of label, every grade is 0.

    Labels that are null or without a document are left out; null and empty texts are texts without words; a label that
    occurs twice counts once, and of several documents with its doc_id one counts; empty tables give a model that calls nothing toxic; other columns are ignored.
    """
    never = Ordinal(np.full(1 << BITS, -1), np.zeros(0), np.array([40.0, 40.0]))
    pick = lambda toxic: labels.filter(F.col("toxic") == toxic).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = written(pick(0).union(pick(1)), "toxic-sample")  # at most 2 * SAMPLE rows

    def features(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                size, doc, bins = _bins(part.column(1))
                order = np.argsort(doc, kind="stable")
                parts = np.split(bins[order].astype(np.int32), np.cumsum(np.bincount(doc, minlength=size))[:-1])
                yield pa.record_batch([*(part.column(n) for n in ("doc_id", "toxic", "h")), pa.array(parts, pa.list_(pa.int32()))], names=["doc_id", "toxic", "h", "bins"])

    found = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text", "doc_id", F.xxhash64("text").alias("h"))
             .mapInArrow(features, "doc_id bigint, toxic int, h bigint, bins array<int>"))
    rows = found.groupBy("doc_id", "toxic").agg(F.min(F.struct("h", "bins")).alias("one")).select("toxic", "one.bins").toPandas()  # a row a label
    toxic = rows["toxic"].to_numpy(np.int64)
    if not len(rows) or toxic.min() == toxic.max():
        return never
    seen = [np.unique(np.asarray(b, np.int64)) for b in rows["bins"]]
    in_toxic = np.bincount(np.concatenate([s for s, t in zip(seen, toxic) if t]), minlength=1 << BITS)
    in_clean = np.bincount(np.concatenate([s for s, t in zip(seen, toxic) if not t]), minlength=1 << BITS)
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    p1, p0, both = (in_toxic + 0.5) / (n1 + 1), (in_clean + 0.5) / (n0 + 1), (in_toxic + in_clean + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    best = np.argsort(-z, kind="stable")[:FEATURES]
    best = best[z[best] >= min(SCORE, z[best[0]])]
    slot = np.full(1 << BITS, -1)
    slot[best] = np.arange(len(best))
    counts = np.zeros((len(rows), len(best)))
    for i, b in enumerate(rows["bins"]):
        k = slot[np.asarray(b, np.int64)]
        counts[i] = np.bincount(k[k >= 0], minlength=len(best))
    marks = np.log1p(counts).sum(axis=1)
    grade = np.where(toxic == 1, 1 + (marks > np.median(marks[toxic == 1])), 0)
    order = np.lexsort((*counts.T, grade))  # the rows' order is not fixed; sums are taken in this one
    weights, thresholds = fit_ordinal(np.log1p(counts[order]), grade[order], np.where(toxic == 1, TOXIC_SHARE / n1, (1 - TOXIC_SHARE) / n0)[order])
    return Ordinal(slot, weights, thresholds)


def severity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, expected_severity, grade, p_toxic, toxic) for every row; toxic: P(grade >= 1) is at least one half.

    Null and empty texts are scored as texts without words; equal rows give equal results; an empty
    table gives an empty result; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                _, below = model.score(part.column(1))
                expected = (1 - below).sum(axis=1)
                grades = np.diff(np.concatenate([np.zeros((len(below), 1)), below, np.ones((len(below), 1))], axis=1), axis=1).argmax(axis=1)
                yield pa.record_batch([part.column(0), pa.array(expected), pa.array(grades.astype(np.int32)), pa.array(1 - below[:, 0]), pa.array(below[:, 0] <= 0.5)],
                                      names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(run, "doc_id bigint, expected_severity double, grade int, p_toxic double, toxic boolean")

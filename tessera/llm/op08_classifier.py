"""Operator 8, quality classifier by nearest-neighbour voting in a latent semantic space.

A bounded sample of labelled texts gives term weights, a latent space (singular vectors) and the
labelled vectors, at most ``LEARN_DOCS`` x ``DIMS`` numbers, which every task holds.  Each text is
projected, its exact cosine products with all labelled vectors are computed block by block, and
its ``NEIGHBOURS`` most alike vote with their label, weighted by similarity.

Defined results: a text without terms (null, empty, blank) scores the share of label 1 in the
sample; without any labelled row every text scores 0.5; scores are rounded to six digits; of
equally similar neighbours (similarities are rounded to nine digits) the smaller labelled doc_id
votes first.  Labels enter only through rows
that may be learned from, never as inputs of a score.  Only doc_id and text (and labels' doc_id and
label) are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import terms, vec
from .common import learnable, map_arrow

#: Bound on labelled texts, dimensions, votes, power of the similarity in a vote.
LEARN_DOCS, DIMS, NEIGHBOURS, POWER = 3000, 32, 25, 4
THRESHOLD = 0.7


class Voter:
    def __init__(self, s: terms.Sample, dims: int = DIMS):
        self.prior = float(np.mean([x == "1" for x in s.label])) if s.n else 0.5
        self.n = s.n
        if not s.n:
            return
        self.idf = s.idf
        self.space = terms.latent(s, min(dims, s.n))
        self.label = np.array([x == "1" for x in s.label], dtype=np.float32)
        self.known = _unit(s.times(self.space).astype(np.float64))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not self.n:
            return np.full(n, 0.5)
        text, term, tf, _ = terms.count(data, offsets)
        weight = terms.weigh(text, term, tf, self.idf, n)
        x = terms.segment_sum(text, term, weight, self.space, n)
        blank = np.einsum("ij,ij->i", x, x) < 1e-12
        x = _unit(x.astype(np.float64))
        out = np.empty(n)
        for lo in range(0, n, 256):
            out[lo : lo + 256] = vote(x[lo : lo + 256] @ self.known.T, self.label)
        out[blank] = self.prior
        return np.round(np.clip(out, 0, 1), 6)


def vote(near: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The share of label 1 among the nearest of each row of similarities, weighted by a power of them."""
    k = min(NEIGHBOURS, near.shape[1])
    rank = np.rint(near * 1e9).astype(np.int64) * (1 << 20) - np.arange(near.shape[1])  # at most 2^20 labelled rows
    top = np.sort(np.argpartition(-rank, k - 1, axis=1)[:, :k], axis=1)
    weight = np.maximum(np.rint(np.take_along_axis(near, top, axis=1) * 1e9) / 1e9, 1e-3) ** POWER
    return (weight * label[top]).sum(axis=1) / weight.sum(axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, bound: int = LEARN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    voter = Voter(terms.sample(documents, labels, label, bound))
    kind = documents.schema["doc_id"].dataType.simpleString()
    held = documents.sparkSession.sparkContext.broadcast(voter)

    def work(batch: pa.RecordBatch):
        for lo, hi, data, offsets in vec.slices(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(held.value(data, offsets))], ["doc_id", "score"])

    scored = map_arrow(documents.select("doc_id", "text"), work, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

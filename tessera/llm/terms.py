"""Hashed terms of texts, and models fitted on bounded samples of labelled texts.

A text's terms are its words (folded), the shapes of its words (letters, digits and symbols, runs
shortened), and repetitions of the word before.  Weights are root term frequencies times inverse
document frequencies of the learning sample; word and shape blocks are put together after both
have length one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import bounded_sample, learnable, map_arrow

WORD_BITS, SHAPE_BITS = 14, 10
N_WORD, N_SHAPE = 1 << WORD_BITS, 1 << SHAPE_BITS
SIZE = N_WORD + N_SHAPE

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[48:58] = 48


def count(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, root frequency) of the distinct terms of each text of a slice, and words per text."""
    n = len(offsets) - 1
    words = vec.Words(data, offsets, vec.BLANK_WORDS_FOLDED)
    kind = _CLASS[data]
    keep = np.ones(len(kind), dtype=bool)
    keep[1:] = kind[1:] != kind[:-1]
    inner = offsets[:-1][offsets[:-1] < len(kind)]
    keep[inner] = True
    kept = np.r_[0, np.cumsum(keep)]
    shapes = vec.Words(kind[keep], kept[offsets], vec.BLANK_WORDS)
    text = words.text_of()
    h = words.hash
    term = (h >> vec.U64(64 - WORD_BITS)).astype(np.int64)
    again = np.flatnonzero((h[1:] == h[:-1]) & (text[1:] == text[:-1])) + 1
    shape = N_WORD + 1 + (shapes.hash % vec.U64(N_SHAPE - 1)).astype(np.int64)
    key = np.concatenate([text << 16 | term, text[again] << 16 | N_WORD, shapes.text_of() << 16 | shape])
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    tf = np.sqrt(np.diff(np.r_[first, len(key)])).astype(np.float32)
    key = key[first]
    return key >> 16, key & 0xFFFF, tf, np.bincount(text, minlength=n)


def weigh(text: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Weights with the word block and the shape block of each text scaled to length one."""
    w = tf * idf[term]
    block = text * 2 + (term >= N_WORD)
    norm = np.sqrt(np.bincount(block, w * w, 2 * n))
    return (w / np.maximum(norm, 1e-12)[block]).astype(np.float32)


class Sample:
    """A bounded learning sample as sparse rows on the driver."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r[0])
        self.label = [r[1] for r in rows]
        self.n = len(rows)
        sizes = [len(r[2]) // 2 for r in rows]
        self.text = np.repeat(np.arange(self.n), sizes)
        self.term = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint16).astype(np.int64)
        self.tf = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.float32)
        self.idf = np.log((1 + self.n) / (1 + np.bincount(self.term, minlength=SIZE))).astype(np.float32) + 1
        self.weight = weigh(self.text, self.term, self.tf, self.idf, self.n)

    def times(self, dense: np.ndarray) -> np.ndarray:
        """The sample's matrix times a dense one."""
        return segment_sum(self.text, self.term, self.weight, dense, self.n)

    def transposed(self, dense: np.ndarray) -> np.ndarray:
        order = np.argsort(self.term, kind="stable")
        return segment_sum(self.term[order], self.text[order], self.weight[order], dense, SIZE)


def segment_sum(row: np.ndarray, column: np.ndarray, weight: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
    """Sparse (sorted by row) times dense, in blocks of bounded memory."""
    out = np.zeros((n, dense.shape[1]), dtype=np.float32)
    step = 1 << 17
    lo = 0
    while lo < len(row):
        hi = min(lo + step, len(row))
        r = row[lo:hi]
        part = dense[column[lo:hi]] * weight[lo:hi, None]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[first]] += np.add.reduceat(part, first, axis=0)
        lo = hi
    return out


def sample(documents: DataFrame, labels: DataFrame, label: str, bound: int) -> Sample:
    """About ``bound`` learnable documents with a non-null label (an SQL expression over labels).

    A doc_id counts once, however often it is repeated: with its largest label and the text of least hash.
    """
    marked = labels.select("doc_id", F.expr(label).cast("string").alias("label")).where(F.col("label").isNotNull() & learnable())
    marked = bounded_sample(marked.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", bound)
    rows = documents.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # at most about ``bound`` short rows
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def work(batch: pa.RecordBatch):
        for lo, hi, data, offsets in vec.slices(batch.column("text")):
            text, term, tf, _ = count(data, offsets)
            cut = np.searchsorted(text, np.arange(hi - lo + 1))
            term = term.astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), batch.column("label").slice(lo, hi - lo), pa.array([term[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([tf[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                ["doc_id", "label", "term", "tf"],
            )

    return Sample(map_arrow(rows, work, "doc_id long, label string, term binary, tf binary").collect())


def latent(s: Sample, dims: int, seed: int = 5) -> np.ndarray:
    """Terms x dims: right singular vectors of the sample by randomized subspace iteration."""
    start = (vec.constants(SIZE * (dims + 8), seed) >> vec.U64(40)).astype(np.float32).reshape(SIZE, dims + 8) / (1 << 23) - 1
    q, _ = np.linalg.qr(s.times(start))
    for _ in range(3):
        q, _ = np.linalg.qr(s.transposed(q))
        q, _ = np.linalg.qr(s.times(q))
    _, _, v = np.linalg.svd(s.transposed(q).T, full_matrices=False)
    return np.ascontiguousarray(v[:dims].T, dtype=np.float32)


def logistic(s: Sample, classes: list[str], steps: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """(terms + 1) x classes: weights of a multinomial logistic regression; the last row is the intercept."""
    y = np.zeros((s.n, len(classes)), dtype=np.float32)
    y[np.arange(s.n), [classes.index(x) for x in s.label]] = 1
    order = np.argsort(s.term, kind="stable")
    term, text, weight = s.term[order], s.text[order], s.weight[order]
    w = np.zeros((SIZE + 1, len(classes)), dtype=np.float32)
    w[-1] = np.log(y.mean(axis=0) + 1e-6)
    look, rate = w.copy(), 4.0
    for k in range(steps):  # accelerated gradient descent
        p = softmax(s.times(look[:-1]) + look[-1])
        e = (p - y) / s.n
        g = np.vstack([segment_sum(term, text, weight, e, SIZE), e.sum(axis=0)])
        g[:-1] += ridge * look[:-1]
        old, w = w, look - rate * g
        look = w + k / (k + 3) * (w - old)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)

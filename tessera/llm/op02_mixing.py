"""Operator 2, mixing sources to target weights by soft membership.

A classifier learned from a labelled table gives each document posteriors p over domains.  With n
words, a document of rate r is expected to bring r * n * p[k] tokens to domain k.  The rates are
the nonnegative least-squares fit of these totals to the targets, nearest to rate 1, found by
projected gradient steps

    r <- max(0, r - p . G^-1 e),    e = expected totals - targets,    G = sum of n p p'

where G (domains x domains) whitens the residual and scaling each rate's step by 1 / n makes it
depend on p alone.  A document's rate is thus a function of its posteriors and of the short list
of past steps, so each step is one aggregation over a written table of posteriors; no rates are
stored or shuffled, and only domains x domains numbers reach the driver.

Defined results: a null or empty text has no tokens and the posteriors of the class shares; a
corpus without tokens or labels keeps rate 1 for every row; repeated rows have equal rates; null
doc_id is allowed.  Targets are shares by domain of ``epochs`` times the corpus' tokens; they are
scaled to sum 1.  Where they are out of reach, steps end when one brings less than a thousandth or
after ``STEPS`` of them, near the least residual and short of the few extreme documents that have it.
Kept columns may have any names; one named like a column of the result (whatever its case) gives
way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import terms, vec
from .common import map_arrow, stash

LEARN_DOCS = 4000
#: Domain of a labelled row, and the share of tokens wanted from each domain: a choice of the caller's, here mostly
#: clean text with enough of the rest to be seen.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' WHEN quality = 1 THEN 'clean' END"
TARGETS = {"clean": 0.86, "low": 0.08, "toxic": 0.06}
STEPS, CLOSE = 20, 1e-6


def posteriors(rows: DataFrame, text: str, documents: DataFrame, labels: DataFrame, domain: str, domains: list[str], bound: int, keep: list[str]) -> DataFrame:
    """The kept columns of rows with ``_n`` words and ``_p0``, ``_p1``, ... posteriors of their text; learned from documents and labels."""
    s = terms.sample(documents, labels, domain, bound)
    seen = sorted(set(s.label) & set(domains))
    weights = None
    if seen and s.n:
        s = terms.Sample([(i, x, *r) for i, (x, r) in enumerate(zip(s.label, _rows(s), strict=True)) if x in seen])
        weights = terms.logistic(s, seen)
    at = [domains.index(x) for x in seen]
    held = rows.sparkSession.sparkContext.broadcast((weights, s.idf))
    k = len(domains)
    schema = rows.select(*keep).schema
    for name, kind in (("_n", "long"), *((f"_p{i}", "double") for i in range(k))):
        schema = schema.add(name, kind)

    def work(batch: pa.RecordBatch):
        weights, idf = held.value
        for lo, hi, data, offsets in vec.slices(batch.column(text)):
            n = hi - lo
            of, term, tf, words = terms.count(data, offsets)
            p = np.full((n, k), 1.0 / k)
            if weights is not None:
                z = terms.segment_sum(of, term, terms.weigh(of, term, tf, idf, n), weights[:-1], n) + weights[-1]
                p = np.zeros((n, k))
                p[:, at] = terms.softmax(z.astype(np.float64))
            kept = [batch.column(c).slice(lo, n) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(words), *(pa.array(p[:, i]) for i in range(k))], [*keep, "_n", *(f"_p{i}" for i in range(k))])

    return map_arrow(rows.select(*dict.fromkeys([*keep, text])), work, schema)


def _rows(s: terms.Sample):
    cut = np.searchsorted(s.text, np.arange(s.n + 1))
    for a, b in zip(cut, cut[1:]):
        yield s.term[a:b].astype(np.uint16).tobytes(), s.tf[a:b].tobytes()


def _rate(steps: list[np.ndarray]) -> Column:
    r = F.lit(1.0)
    for c in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col(f"_p{i}") * F.lit(float(x)) for i, x in enumerate(c)), F.lit(0.0)))
    return r


def fit(table: DataFrame, targets: list[float], epochs: float = 1.0, steps: int = STEPS) -> list[np.ndarray]:
    """The projected gradient steps over a written table of (_n, _p...).

    A step is first tried in the metric of the documents whose rate is still positive, which is fast
    once many rates are 0; where that does not bring the residual down by a tenth it is halved, and at
    last taken in the metric of all documents, which always brings it down.
    """
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]

    def look(done: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
        rate = _rate(done)
        row = table.agg(
            *(F.sum(F.col("_n") * F.col(f"_p{i}") * rate) for i in range(k)),
            *(F.sum(F.when(rate > 0, F.col("_n") * F.col(f"_p{i}") * F.col(f"_p{j}")).otherwise(0.0)) for i, j in pairs),
            F.sum("_n"),
        ).first()
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k:-1], strict=True):
            gram[i, j] = gram[j, i] = x or 0.0
        return np.array([x or 0.0 for x in row[:k]]), gram, row[-1] or 0

    got, gram, n = look([])
    if not n:
        return []
    ridge = np.eye(k) * 1e-9 * np.trace(gram)
    whole = np.linalg.inv(gram + ridge)
    want = np.array(targets) / sum(targets) * n * epochs
    done: list[np.ndarray] = []
    active = gram
    for _ in range(steps):
        e = got - want
        if np.abs(e).sum() <= CLOSE * want.sum():
            break
        near = np.linalg.inv(active + ridge)
        for metric in (near, near / 2, near / 4, whole):
            trial = [*done, metric @ e]
            new, gram, _ = look(trial)
            if (new - want) @ whole @ (new - want) < 0.9 * (e @ whole @ e):
                break
        if (new - want) @ whole @ (new - want) > 0.999 * (e @ whole @ e):
            break  # the targets are out of reach; the residual is at its least
        done, got, active = trial, new, gram
    return done


def mix(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: str = DOMAIN, epochs: float = 1.0, bound: int = LEARN_DOCS, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (doc_id alone by default) with n_tokens, p_<domain> and rate of each row."""
    domains = sorted(targets)
    own = {"n_tokens", "rate", *(f"p_{d}".lower() for d in domains)}
    keep = [c for c in keep or ["doc_id"] if c.lower() not in own]
    rows = documents.select(*(documents[c].alias(f"k{i}") for i, c in enumerate(keep)), documents["text"].alias("text"))
    text = f"k{keep.index('text')}" if "text" in keep else "text"
    table = stash(posteriors(rows, text, documents, labels, domain, domains, bound, [f"k{i}" for i in range(len(keep))]), "posteriors")
    steps = fit(table, [targets[d] for d in domains], epochs)
    return table.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("_n").alias("n_tokens"), *(F.col(f"_p{i}").alias(f"p_{d}") for i, d in enumerate(domains)), _rate(steps).alias("rate"))


def mixed(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the mixture takes, all columns, with what ``mix`` adds and ``copies``; those without a copy go."""
    names = [c for c in documents.columns if c.lower() != "copies"]
    return mix(documents, labels, keep=names, **how).withColumn("copies", copies(F.col("rate"), F.col("doc_id"))).where("copies > 0")


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a document: the rate rounded up with the probability of its fraction, by a fixed hash of the key."""
    part = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (part < rate - F.floor(rate)).cast("int")).cast("long")

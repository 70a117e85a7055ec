"""Operator 9, language identification by rank-order profiles.

A profile lists the most frequent character n-grams (1 to 3 letters, word edges as blanks) in
order of frequency.  A text's own list is compared to each language's list: every n-gram adds
the difference of its two ranks, or ``PROFILE`` if the language's list lacks it.  The language
with the smallest sum wins; equal sums go to the smaller name.

Defined results: null text or text without a letter gives ``und`` with score 0; equal counts
are ranked by the n-gram's code; texts of any length are used whole; an empty table gives an
empty result; without learnable rows every text is ``und``; of more than ``MOST_LANGS`` languages
the most frequent are learned, equal ones by name.  Only the named columns are read,
so further columns of any name do no harm.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .common import learnable, map_arrow

#: Length of a rank list, and what an n-gram missing from it adds.
PROFILE = 300
#: Bounds on the documents each profile is learned from, and on the profiles: the most frequent languages.
LEARN_DOCS, MOST_LANGS = 2000, 256
_BITS = 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    points = np.arange(0x110000, dtype=np.int64)
    keep = np.zeros(0x110000, dtype=bool)
    for lo in range(0, 0x110000, 0x10000):
        if lo == 0xD0000 or lo >= 0x40000:  # planes without letters
            continue
        keep[lo : lo + 0x10000] = [chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(lo, lo + 0x10000)]
    return np.where(keep, points, 0)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, n-gram code) of every n-gram of every text."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in lowered], dtype=np.int64)
    ids = np.repeat(np.arange(len(texts)), sizes + 2)
    points = np.frombuffer("".join(f"\n{t}\n" for t in lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = _letters()[points]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (ids[1:] != ids[:-1])
    s, ids = s[keep], ids[keep]
    one = s != 0
    two = (one[:-1] | one[1:]) & (ids[:-1] == ids[1:])
    three = one[1:-1]
    out = np.concatenate([s[one], (s[:-1] << _BITS | s[1:])[two] | 1 << 60, (s[:-2] << 2 * _BITS | s[1:-1] << _BITS | s[2:])[three] | 2 << 60])
    return np.concatenate([ids[one], ids[:-1][two], ids[1:-1][three]]), out


def _count(ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (id, code hash) with counts; 44 bits of hash stand for the n-gram within a slice."""
    key = np.sort(ids.astype(np.uint64) << vec.U64(44) | vec.mix(codes.astype(np.uint64)) >> vec.U64(20))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.r_[first, len(key)])
    key = key[first]
    return (key >> vec.U64(44)).astype(np.int64), (key & vec.U64((1 << 44) - 1)).astype(np.int64), counts


def ranked(ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, code hash, rank) of the ``PROFILE`` most frequent n-grams of each id."""
    ids, codes, counts = _count(ids, codes)
    order = np.lexsort((codes, -counts, ids))
    ids, codes = ids[order], codes[order]
    if not len(ids):
        return ids, codes, ids
    begin = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    rank = np.arange(len(ids)) - np.repeat(begin, np.diff(np.r_[begin, len(ids)]))
    keep = rank < PROFILE
    return ids[keep], codes[keep], rank[keep]


def _learnable_rows(documents: DataFrame, bound: int) -> DataFrame:
    """(lang, text) of about ``bound`` learnable rows of each language, all of a rarer one, chosen by a hash of the id."""
    rows = documents.where(F.col("lang").isNotNull() & learnable())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("size")).orderBy(F.desc("size"), "lang").limit(MOST_LANGS)  # short rows
    scale = 1 << 30
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(scale))
    chosen = rows.where("text is not null").select("doc_id", "text", "lang").join(F.broadcast(sizes), "lang").where(part * F.col("size") < float(bound * scale))
    return chosen.select("lang", "text")


def learn(documents: DataFrame, bound: int = LEARN_DOCS) -> dict[str, list[int]]:
    """Profiles {language: codes by rank} from the learnable rows, about ``bound`` of each language at most."""
    rows = _learnable_rows(documents, bound)

    def count(batch: pa.RecordBatch):
        langs, texts = batch.column("lang").to_pylist(), batch.column("text")
        for lo, hi, _, _ in vec.slices(texts):
            names = sorted(set(langs[lo:hi]))
            at = np.array([names.index(x) for x in langs[lo:hi]])
            ids, codes = grams(texts.slice(lo, hi - lo).to_pylist())
            ids, codes, counts = _count(at[ids] if len(ids) else ids, codes)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(ids)), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

    counted = map_arrow(rows, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    found = counted.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= PROFILE).select("lang", "rank", "code").collect()
    out: dict[str, list[int]] = {}
    for lang, _, code in sorted(map(tuple, found)):
        out.setdefault(lang, []).append(code)
    return out


class Judge:
    """Distances of texts to fixed profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.codes = np.array(sorted({c for p in profiles.values() for c in p}), dtype=np.int64)
        self.rank = np.full((len(self.langs), len(self.codes)), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[k, np.searchsorted(self.codes, np.array(profiles[lang], dtype=np.int64))] = np.arange(len(profiles[lang]))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        ids, codes, rank = ranked(*grams(texts))
        if not len(ids) or not self.langs:
            return ["und"] * n, np.zeros(n)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        far = np.empty((len(self.langs), n))
        for k in range(len(self.langs)):
            r = np.where(known, self.rank[k, at], -1)
            far[k] = np.bincount(ids, np.where(r < 0, PROFILE, np.abs(r - rank)), n)
        size = np.bincount(ids, minlength=n)
        best = far.argmin(axis=0)
        score = np.where(size > 0, 1 - far[best, np.arange(n)] / (PROFILE * np.maximum(size, 1)), 0.0)
        return [self.langs[k] if m else "und" for k, m in zip(best, size, strict=True)], score


def identify(documents: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """(doc_id, lang_pred, score) of each row; one narrow pass, nothing is shuffled."""
    judge = Judge(profiles)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        texts = batch.column("text")
        for lo, hi, _, _ in vec.slices(texts):
            lang, score = judge(texts.slice(lo, hi - lo).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return map_arrow(documents.select("doc_id", "text"), work, f"doc_id {kind}, lang_pred string, score double")


def languages(documents: DataFrame, bound: int = LEARN_DOCS) -> DataFrame:
    """Learns profiles from the learnable rows and judges every row."""
    return identify(documents, learn(documents, bound)).select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(documents: DataFrame, least: float = 0.0) -> DataFrame:
    """The documents whose language is known; ``und`` or a score below ``least`` rejects. All columns stay."""
    profiles = learn(documents)
    judge = Judge(profiles)
    schema = documents.schema

    def work(batch: pa.RecordBatch):
        texts = batch.column("text")
        for lo, hi, _, _ in vec.slices(texts):
            lang, score = judge(texts.slice(lo, hi - lo).to_pylist())
            keep = [x != "und" and s >= least for x, s in zip(lang, score, strict=True)]
            yield batch.slice(lo, hi - lo).filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(lambda batches: (out for batch in batches for out in work(batch)), schema)

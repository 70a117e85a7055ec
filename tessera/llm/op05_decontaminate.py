"""Operator 5, benchmark decontamination by a prefix-filtered set join.

A window is ``size`` consecutive words of a benchmark item (a shorter item is one window).  Its
shingles are ordered by how often they occur in the documents; containment of the whole window
needs only the rarest one as prefix token.  Tokens of documents and windows are joined; what meets
fixes the window's place, which must lie inside the text (length and positional bounds), and every
word of the window is then compared.

Benchmark and documents are both tables, of any size.  No index is held anywhere: each pass over
the documents carries a bit table of bounded size (``bits.MOST_BITS``, 32 MB) that turns away words whose
token no window has, and an equi-join decides.  A wrong bit costs a row in that join.  Candidates
carry the words around them, and results go back by a key of the text (128 bits), so copies of a
text are verified once and no text is shuffled; rows without a candidate are not joined at all.
What is shuffled are counts of the benchmark's shingles, candidates, and results.

Defined results: null or empty texts have no words and no hits; items with null id or no words are
ignored; rows with the same item_id count as one item; each document row is judged on its own, so
repeated rows repeat their result; ties in rarity go to the smaller hash, then to the earlier
place.  Only the named columns are read.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .bits import Bits
from .common import map_arrow, stash

WINDOW = 10
SHINGLE = 3
_TEXT = ["t1", "t2"]
_KEY = ["k1", "k2"]


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, k1, k2, words): the windows of each item, with a key of their words."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")

    def work(batch: pa.RecordBatch):
        for lo, hi, data, offsets in vec.slices(batch.column("text")):
            words = vec.Words(data, offsets, vec.ALNUM_WORDS)
            counts = words.counts()
            n = np.minimum(counts, size)
            many = np.where(counts > 0, counts - n + 1, 0)
            item = np.repeat(np.arange(hi - lo), many)
            at = words.first[item] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            runs, raw, n = vec.Runs(words.hash), words.hash.tobytes(), n[item]
            key, other = np.zeros((2, len(at)), dtype=vec.U64)
            for k in np.unique(n).tolist():
                same = n == k
                key[same] = _sized(runs, at[same], k)
                other[same] = vec.mix(vec.sequence_hash(words.hash, at[same], k) + vec.U64(k))
            text = [raw[8 * a : 8 * (a + b)] for a, b in zip(at.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("item").slice(lo, hi - lo).take(pa.array(item)), pa.array(key.view(np.int64)), pa.array(other.view(np.int64)), pa.array(text, pa.binary())], ["item", *_KEY, "words"])

    return map_arrow(rows, work, "item string, k1 long, k2 long, words binary")


def _sized(runs: vec.Runs, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of k words that differ from those of other lengths."""
    return vec.mix(runs(at, k) + vec.U64(k))


def shingles_of(windows: DataFrame, shingle: int) -> DataFrame:
    """(k1, k2, place, h): every shingle of every window; shorter windows have shorter ones."""

    def work(batch: pa.RecordBatch):
        data, offsets, _ = vec.buffers(batch.column("words"))
        h = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), dtype=np.uint64)
        first = (offsets - offsets[0]) // 8
        n = np.diff(first)
        s = np.minimum(n, shingle)
        many = n - s + 1
        window = np.repeat(np.arange(len(n)), many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, runs, out = first[window] + place, vec.Runs(h), np.zeros(len(window), dtype=vec.U64)
        for k in np.unique(s).tolist():
            same = s[window] == k
            out[same] = _sized(runs, at[same], k)
        rows = pa.array(window)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in _KEY), pa.array(place.astype(np.int32)), pa.array(s[window].astype(np.int32)), pa.array(out.view(np.int64))], [*_KEY, "place", "s", "h"])

    return map_arrow(windows.select(*_KEY, "words"), work, "k1 long, k2 long, place int, s int, h long")


class Tokens:
    """The tokens of shingles (s, h): their bits, and the lengths there are."""

    def __init__(self, rows: DataFrame):
        self.sizes, self.bits = sorted(rows.agg(F.collect_set("s")).first()[0]), Bits(rows, F.col("h"))

    def hits(self, words: vec.Words):
        """(positions, hashes) of the shingles of a slice that pass, for each length."""
        text, runs = words.text_of(), vec.Runs(words.hash)
        for k in self.sizes:
            at = np.flatnonzero(text[: max(len(text) - k + 1, 0)] == text[k - 1 :])
            h = _sized(runs, at, k)
            ok = self.bits(h)
            yield at[ok], h[ok]


def _counts(documents: DataFrame, tokens) -> DataFrame:
    """(h, n): how often each shingle that may be a token occurs in all documents."""

    def work(batch: pa.RecordBatch):
        for _, _, data, offsets in vec.slices(batch.column("text")):
            found = [h for _, h in tokens.value.hits(vec.Words(data, offsets, vec.ALNUM_WORDS))]
            key, n = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=vec.U64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return map_arrow(documents.select("text"), work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _candidates(documents: DataFrame, tokens, size: int) -> DataFrame:
    """One row for each document, with its number of words, and one for each candidate (``h`` is not null): place, words before it, words around it."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        for lo, hi, data, offsets in vec.slices(batch.column("text")):
            words = vec.Words(data, offsets, vec.ALNUM_WORDS)
            n = hi - lo
            ids, t1, t2 = (batch.column(c).slice(lo, n) for c in ("doc_id", *_TEXT))
            found = list(tokens.value.hits(words))
            at = np.concatenate([a for a, _ in found]) if found else np.zeros(0, dtype=np.int64)
            h = np.concatenate([x for _, x in found]) if found else np.zeros(0, dtype=vec.U64)
            text = np.searchsorted(words.first, at, side="right") - 1
            looked = np.zeros(n, dtype=bool)
            looked[text] = True
            none = pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays([ids, t1, t2, pa.array(words.counts()), pa.array(looked), none, none, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], _NAMES)
            if not len(at):
                continue
            a, b = np.maximum(words.first[text], at - size + 1), np.minimum(words.first[text + 1], at + size)
            raw = words.hash.tobytes()
            around = [raw[8 * x : 8 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            of, m = pa.array(text), len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, ids.type), t1.take(of), t2.take(of), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.array((at - words.first[text]).astype(np.int32)), pa.array((at - a).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(around, pa.binary())], _NAMES
            )

    return map_arrow(documents.select("doc_id", "text", *_TEXT), work, f"doc_id {kind}, t1 long, t2 long, n_words long, looked boolean, pos int, before int, h long, around binary")


_NAMES = ["doc_id", "t1", "t2", "n_words", "looked", "pos", "before", "h", "around"]


def _text_key() -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(41), text).alias("t2")]


def _matches(documents: DataFrame, benchmark: DataFrame, size: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of ``_candidates``; (t1, t2, start, end, k1, k2) of every occurrence of a window in a text; (k1, k2, item))."""
    held = documents.sparkSession.sparkContext.broadcast
    windows = stash(windows_of(benchmark, size), "windows")
    shingles = shingles_of(windows.dropDuplicates(_KEY), shingle)
    shingles = stash(shingles, "shingles")
    documents = documents.select("doc_id", "text", *_text_key())
    counts = _counts(documents, held(Tokens(shingles)))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "place", "s")).alias("m")
    prefix = shingles.join(counts, "h", "left").groupBy(*_KEY).agg(rarest).select(*_KEY, "m.h", "m.place", "m.s")
    prefix = stash(prefix.join(windows.dropDuplicates(_KEY).select(*_KEY, "words"), _KEY), "prefixes")
    rows = stash(_candidates(documents, held(Tokens(prefix)), size), "candidates")
    found = rows.where("h is not null").groupBy(*_TEXT, "pos", "h").agg(F.first("before").alias("before"), F.first("around").alias("around"))
    hits = found.join(prefix, "h").where("before >= place and substring(around, 8 * (before - place) + 1, length(words)) = words")
    hits = hits.select(*_TEXT, (F.col("pos") - F.col("place")).alias("start"), F.expr("pos - place + length(words) div 8").cast("int").alias("end"), *_KEY)
    return rows, hits, windows.select(*_KEY, "item").distinct()


def _hit_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The union of each text's matches."""
    n_hit, runs = [], []
    for spans in batch.column("spans").to_pylist():
        spans = np.array([(s["start"], s["end"]) for s in spans], dtype=np.int64)
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        far = np.maximum.accumulate(spans[:, 1])
        first = np.flatnonzero(np.r_[True, spans[1:, 0] > far[:-1]])
        begin, end = spans[first, 0].tolist(), far[np.r_[first[1:] - 1, len(far) - 1]].tolist()
        n_hit.append(sum(end) - sum(begin))
        runs.append(",".join(f"{a}:{b}" for a, b in zip(begin, end, strict=True)))
    return pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), pa.array(n_hit, pa.int64()), pa.array(runs, pa.string())], ["t1", "t2", "n_hit", "hits"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits) of each document row.

    ``hits`` holds the hit words as runs "first:end" (word numbers, end exclusive), comma-joined.
    """
    rows, hits, members = _matches(documents, benchmark, size, shingle)
    hits = stash(hits, "hits")
    words = map_arrow(hits.groupBy(*_TEXT).agg(F.collect_set(F.struct("start", "end")).alias("spans")), _hit_words, "t1 long, t2 long, n_hit long, hits string")
    items = hits.select(*_TEXT, *_KEY).distinct().join(members, _KEY).groupBy(*_TEXT).agg(F.sort_array(F.collect_set("item")).alias("items"))
    result = words.join(items.select(*_TEXT, F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), _TEXT)
    rows = rows.where("n_words is not null")
    none = rows.where("not looked").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"), F.lit("").alias("hits"))
    some = rows.where("looked").join(result, _TEXT, "left")
    zero = F.lit(0).cast("long")
    some = some.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("hits", F.lit("")).alias("hits"))
    return none.union(some)


def keep_clean(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The documents without a hit; all columns stay. Rows with a null or repeated doc_id are judged by their texts like any other."""
    _, hits, _ = _matches(documents, benchmark, size, shingle)
    hit = stash(hits.select(*_TEXT).distinct(), "hit")
    held = documents.sparkSession.sparkContext.broadcast(Bits(hit, F.col("t1")))

    def suspect(batch: pa.RecordBatch):
        out = np.zeros(batch.num_rows, dtype=bool)
        out[held.value(batch.column("t1").to_numpy().view(np.uint64))] = True
        return out

    names = documents.columns
    rows = documents.select(*(documents[c].alias(f"c{i}") for i, c in enumerate(names)), *_text_key())
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    clear = map_arrow(rows, lambda b: b.filter(pa.array(~suspect(b))), rows.schema)
    other = map_arrow(rows, lambda b: b.filter(pa.array(suspect(b))), rows.schema)
    return clear.select(*back).union(other.join(hit, _TEXT, "left_anti").select(*back))
